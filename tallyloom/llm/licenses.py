"""Licence scans by template markup.

Each template is compiled to an automaton over words: a place for each word of the wording, follow sets that may jump over
optional regions and run through replaceable ones. A text is accepted where some stretch of its words is a path from a first
to a last place, so all mandatory wording must stand there word by word. Every template has a stretch of wording that is in no region;
only around its places can the template match, as all regions are bounded, and only there the automaton runs. Its steps are
remembered by (places, word), so that most words cost one look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .license_templates import TEMPLATES

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Score of a text that names a licence without accepted wording.
NAMED = 0.5
#: Steps that an automaton remembers.
MEMORY = 50_000
_WORDS = bytes(c if chr(c).isdigit() or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_TAG = re.compile(r"<<(beginOptional|endOptional|var;match=(.*?))>>", re.S)
_GAP = re.compile(r"\.\{(\d+),(\d+)\}")
ANY = None


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and bytes above 0x7F, A-Z lower-cased."""
    return (text or b"").translate(_WORDS).split()


def parse(template: str) -> list[tuple]:
    """Items of a template: ("word", w), ("optional", items), ("gap", least, most), ("any_of", [items, ...])."""
    levels: list[list[tuple]] = [[]]

    def wording(text: str) -> list[tuple]:
        return [("word", w) for w in words_of(text.encode())]

    at = 0
    for tag in _TAG.finditer(template):
        levels[-1] += wording(template[at : tag.start()])
        at = tag.end()
        if tag[1] == "beginOptional":
            levels.append([])
        elif tag[1] == "endOptional":
            if len(levels) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = levels.pop()
            levels[-1].append(("optional", inner))
        elif gap := _GAP.fullmatch(tag[2].strip()):
            levels[-1].append(("gap", int(gap[1]), int(gap[2])))
        else:
            levels[-1].append(("any_of", [wording(x) for x in tag[2].split("|")]))
    if len(levels) > 1:
        raise ValueError("beginOptional without endOptional")
    return levels[0] + wording(template[at:])


def _longest(items: list[tuple]) -> int:
    """The most words that items can take."""
    size = {"word": lambda x: 1, "optional": lambda x: _longest(x[1]), "gap": lambda x: x[2], "any_of": lambda x: max(map(_longest, x[1]))}
    return sum(size[x[0]](x) for x in items)


@dataclass
class Automaton:
    label: str
    weight: float
    items: list[tuple]
    words: list[bytes | None] = field(default_factory=list)  # by place
    follow: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        empty, self.first, self.last = self._build(self.items)
        runs, run = [], []
        for k, item in enumerate([*self.items, ("end",)]):
            if item[0] == "word":
                run.append(k)
            elif run:
                runs.append(run)
                run = []
        if empty or not runs:
            raise ValueError(f"template {self.label} has no mandatory wording outside its regions")
        best = max(runs, key=len)
        self.anchor = b" " + b" ".join(self.items[k][1] for k in best) + b" "
        self.anchor_words, self.before, self.after = len(best), _longest(self.items[: best[0]]), _longest(self.items[best[-1] + 1 :])
        self.masks: dict[bytes, int] = {}
        self.free = 0
        for place, word in enumerate(self.words):
            if word is ANY:
                self.free |= 1 << place
            else:
                self.masks[word] = self.masks.get(word, 0) | 1 << place
        self.steps: dict[tuple[int, bytes | None], int] = {}

    def _place(self, word: bytes | None) -> int:
        self.words.append(word)
        self.follow.append(0)
        return 1 << (len(self.words) - 1)

    def _link(self, places: int, to: int) -> None:
        while places:
            low = places & -places
            self.follow[low.bit_length() - 1] |= to
            places ^= low

    def _build(self, items: list[tuple]) -> tuple[bool, int, int]:
        """Whether items may be empty, their first and their last places."""
        empty, first, last = True, 0, 0
        for item in items:
            if item[0] == "word":
                x = self._place(item[1])
                e, f, z = False, x, x
            elif item[0] == "optional":
                _, f, z = self._build(item[1])
                e = True
            elif item[0] == "gap":
                places = [self._place(ANY) for _ in range(item[2])]
                for a, b in zip(places, places[1:], strict=False):
                    self._link(a, b)
                e, f = item[1] == 0, places[0] if places else 0
                z = sum(places[max(0, item[1] - 1) :])
            else:
                made = [self._build(x) for x in item[1]]
                e, f, z = any(x[0] for x in made), 0, 0
                for x in made:
                    f, z = f | x[1], z | x[2]
            self._link(last, f)
            first = first | f if empty else first
            last = last | z if e else z
            empty = empty and e
        return empty, first, last

    def step(self, places: int, word: bytes) -> int:
        """Places after one more word; a path may begin at every word."""
        key = (places, word if word in self.masks else None)
        found = self.steps.get(key)
        if found is None:
            to, rest = self.first, places
            while rest:
                low = rest & -rest
                to |= self.follow[low.bit_length() - 1]
                rest ^= low
            found = to & (self.masks.get(word, 0) | self.free)
            if len(self.steps) >= MEMORY:
                self.steps.clear()
            self.steps[key] = found
        return found

    def accepts(self, words: list[bytes], joined: bytes) -> bool:
        """Whether some stretch of words is accepted; joined is the words with a space around each."""
        at = joined.find(self.anchor)
        word, seen, upto, places = 0, 0, 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)  # the anchor's place among the words
            seen = at
            if word - self.before > upto:
                upto, places = word - self.before, 0
            for k in range(upto, min(len(words), word + self.anchor_words + self.after)):
                places = self.step(places, words[k])
                if places & self.last:
                    return True
                upto = k + 1
            at = joined.find(self.anchor, at + 1)
        return False


_compiled: list[Automaton] = []


def automata() -> list[Automaton]:
    if not _compiled:
        _compiled.extend(Automaton(label, weight, parse(text)) for label, weight, text in sorted(TEMPLATES, key=lambda t: (-t[1], t[0])))
    return _compiled


def _places(phrase: bytes, joined: bytes) -> list[int]:
    """Words at which phrase begins."""
    found, at, word, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = joined.find(phrase, at + 1)
    return found


def scan_text(text: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base, places = set(), []
    for phrase, label in PHRASES:
        here = _places(b" " + phrase.encode() + b" ", joined)
        if here:
            base.add(label)
            places += here
    labels, score = set(base), NAMED if base else 0.0
    accepted: set[str] = set()
    for machine in automata():
        if machine.label not in accepted and machine.accepts(words, joined):  # heavier templates come first
            accepted.add(machine.label)
            score = max(score, machine.weight)
    labels |= accepted
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame) -> DataFrame:
    """What licences each row of docs (doc_id, text) names or grants.

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (the smallest and the largest of them, null
    without any), base_labels, labels (also of accepted templates; both distinct, sorted, comma-joined) and score: the greatest weight
    of an accepted template (1 for a licence's text, 0.95 for its notice, 0.9 for a sentence that grants it), else 0.5 where a base phrase
    stands, else 0. Null and empty texts have no words, no labels (empty strings) and score 0. Rows that repeat come out as
    often as they came, null ids stay null, an empty table gives no rows; other columns aren't read. Memory is one batch of texts.
    """
    bounded_batches(docs.sparkSession)
    types = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(text.as_buffer().to_pybytes() if text.is_valid else None) for text in batch.column(1).cast(pa.binary())]
            columns = [batch.column(0), *(pa.array([row[k] for row in found], kind) for k, (_, kind) in enumerate(types[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(types))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _pattern(items: list[tuple]) -> str:
    """The regular expression of items over words that each end with a space."""
    part = {
        "word": lambda x: x[1].decode() + " ",
        "optional": lambda x: f"(?:{_pattern(x[1])})?",
        "gap": lambda x: f"(?:[^ ]+ ){{{x[1]},{x[2]}}}",
        "any_of": lambda x: f"(?:{'|'.join(map(_pattern, x[1]))})",
    }
    return "".join(part[x[0]](x) for x in items)


def _sql() -> str:
    """The same templates as regular expressions."""
    phrases = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, unnest([i for i in range(0, len(w)) if w[i + 1 : i + {len(phrase.split())}] = [{', '.join(repr(x) for x in phrase.split())}]]) AS place FROM w" for phrase, label in PHRASES)
    templates = ", ".join(f"('{label}', {weight}, '{_pattern(parse(text))}')" for label, weight, text in TEMPLATES)
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS MATERIALIZED ({phrases}),
b AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z FROM p GROUP BY doc_id),
t(label, weight, pattern) AS (VALUES {templates}),
m AS MATERIALIZED (SELECT doc_id, label, weight FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS x FROM w), t WHERE regexp_matches(x, ' ' || pattern)),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS weight
      FROM (SELECT doc_id, label, true AS base, {NAMED} AS weight FROM p UNION ALL SELECT doc_id, label, false, weight FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, a AS first_word, z AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(weight, 0) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


SQL = _sql()
