"""Licence wording as templates: fixed wording with optional and replaceable regions.

<<beginOptional>> ... <<endOptional>>   may be left out; may hold other regions
<<var;match=.{a,b}>>                    any a to b words
<<var;match=one wording|another>>       one of these wordings
"""

from __future__ import annotations

TEXT, NOTICE, GRANT = 1.0, 0.95, 0.9

_LICENSED = "<<var;match=licensed|released|distributed|available|published|provided>> under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of <<beginOptional>>the<<endOptional>><<endOptional>>"
_VERSION = "<<beginOptional>><<var;match=version|v>><<endOptional>>"
_LICENSE = "<<var;match=license|licence>>"

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>><<var;match=1|a|i>><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer<<beginOptional>> in this position and unchanged<<endOptional>>.
<<beginOptional>><<var;match=2|b|ii>><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;match=.{1,24}>> "AS IS" AND ANY EXPRESS<<beginOptional>>ED<<endOptional>> OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL <<var;match=.{1,24}>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# The licences' own public wording, with SPDX identifiers in lower case as labels. (label, weight, template)
TEMPLATES: list[tuple[str, float, str]] = [
    ("mit", TEXT, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<var;match=noninfringement|non infringement>>.
IN NO EVENT SHALL <<var;match=.{1,20}>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", TEXT, """Permission to use, copy, modify, <<var;match=and or|and>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=.{1,12}>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL <<var;match=.{1,12}>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", TEXT, f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause", TEXT, f"""{_BSD_HEAD}
<<beginOptional>><<var;match=3|c|iii>><<endOptional>> Neither the name of <<var;match=.{{1,16}}>> nor the names of <<var;match=its|the|their>> <<beginOptional>><<var;match=copyright holders and|copyright holder nor|other>><<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{_BSD_TAIL}"""),
    ("apache-2.0", NOTICE, """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;match=file|work|software|project>> except in compliance with the License. You may obtain a copy of the License at
<<beginOptional>><<var;match=http|https>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    *(
        (f"{family}-{version}.0-{which}", NOTICE, f"""is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public {_LICENSE} as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> {tail}""")
        for family, name in (("gpl", "General"), ("lgpl", "Lesser General"), ("agpl", "Affero General"))
        for version in ("2", "3")
        for which, tail in (("or-later", f"either version {version} of the License, or (at your option) any later version."), ("only", f"version {version} <<beginOptional>>only<<endOptional>> of the License."))
    ),
    ("mit", GRANT, f"{_LICENSED} <<beginOptional>>the<<endOptional>> MIT {_LICENSE}"),
    ("apache-2.0", GRANT, f"{_LICENSED} Apache {_LICENSE} {_VERSION} <<var;match=2.0|2>>"),
    *((f"gpl-{v}.0", GRANT, f"{_LICENSED} GNU General Public {_LICENSE} {_VERSION} {v}<<beginOptional>>.0<<endOptional>>") for v in ("2", "3")),
    *(
        (f"cc-by{tail.lower()}-{v}", GRANT, f"<<var;match=licensed under|released under|available under|distributed under|published under>> <<beginOptional>><<var;match=a|the>><<endOptional>> <<beginOptional>>terms of the<<endOptional>> {name} <<beginOptional>>license<<endOptional>> {v}")
        for tail, name in (("", "CC BY"), ("-SA", "CC BY-SA"), ("-NC", "CC BY-NC"), ("-ND", "CC BY-ND"), ("-NC-SA", "CC BY-NC-SA"), ("-NC-ND", "CC BY-NC-ND"))
        for v in ("3.0", "4.0")
    ),
    *((label, GRANT, f"SPDX-License-Identifier: {label}") for label in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "gpl-2.0-only", "gpl-3.0-only", "gpl-2.0-or-later", "gpl-3.0-or-later", "mpl-2.0", "unlicense")),
    ("mpl-2.0", NOTICE, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;match=http|https>>://mozilla.org/MPL/2.0"),
    ("unlicense", TEXT, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
