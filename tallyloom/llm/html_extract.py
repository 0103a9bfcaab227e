"""Main text of web pages by tree scoring.

Each paragraph (block of text) earns a point, one for each comma and up to three for its length. Its parent gets all of them, its
grandparent half, further ancestors a share that falls with distance, LEVELS of them in all. A container's points are discounted
by its link density; the best container is kept with those siblings that score well beside it, and with the columns beside it or beside its
ancestors that hold a container of like score. Boilerplate tags, roles and hidden subtrees never count.

Class names and ids only speak for a block as whole words of a few kinds (_NAMED), a heading's, section's or list item's id never does but for a
comment form's, and neither does a name that is the slug of the block's own heading. A named block goes, unless it holds an article or over half of
the page's text outside links; inside an article it only goes if it is short or mostly links. Blocks of comments,
adverts and the like (_ASIDE) only count where nothing else is left. An article stays whole; articles beside
it are kept if they have a fair share of its points. Work is linear in the page; nothing recurses.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening tag ends these open elements, unless one of the scopes lies between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_SCOPE = frozenset(("button", "td", "th", "table", "object"))
_BOILERPLATE = frozenset("nav footer aside button select svg math canvas object menu dialog input".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_BEFORE = r"(?:(?:site|page|post|entry|main|top|bottom|left|right|global|article|blog|primary|secondary|mobile|desktop|block|section|content|inner|inline|user|reader|google|more|sub|js)[_-])*"
_AFTER = r"(?:[_-](?:\d+|area|list|wrapper|wrap|container|box|block|bar|content|links?|menu|nav|slot|unit|banner|buttons?|icons?|panel|form|items?|inner|outer|left|right|top|bottom|row|col|group|widget|text|message|popup|modal|overlay|posts?|articles?|stories|news|reading|topics?|thread|notice|reply|only|signup|subscribe|subscription|prompt|cta|placeholder|label|toggle|trigger|consent|sidebar|heading|title|wrap|inner|body|meta))*"
#: Words of class and id that name a block which isn't the article, with the usual words around them.
_NAMED = re.compile(_BEFORE + r"(?:banners?|side-?bars?|menu|nav|navbar|navigation|breadcrumbs?|notices?|notifications?|alert|overlay|login|share|sharing|social|foot|footer|masthead|pagination|pager|toolbar|skip|widgets?|disclaimer|copyright|popup|modal)" + _AFTER, re.I)
#: Of those, the ones whose blocks are never lifted while other text is left: they hold articles and much text of their own.
_ASIDE = re.compile(_BEFORE + r"(?:ads?|adv|adverts?|advertisements?|advertising|adsense|sponsor|sponsored|promo|promos|promotion|comments?|commentlist|disqus|respond|reply|replies|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|related-(?:posts?|articles?|stories|links?|content|items?|news|reading|topics?)|related|recommended|recommendations|hidden|sr-only)" + _AFTER, re.I)
_COMMENT = re.compile(r"comments?|comment-\w+|reader-?comments?|commentlist|disqus_thread|respond|reply|replies", re.I)
_HEAD = re.compile(_BEFORE + r"(?:header|head|topbar)" + _AFTER, re.I)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Tags whose id is most often the slug of a heading.
_SLUGS = frozenset((*_HEADINGS, "section", "li", "dt", "dd", "p", "tr", "figure", "article", "blockquote", "pre", "hgroup"))
#: A named block inside an article is part of it from so many characters outside links on, if they are more than this share of its text.
PROSE_CHARS, PROSE_SHARE = 300, 2 / 3
#: Points that a container starts with.
_START = {"article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
LEVELS = 6
SIBLING_SHARE = 0.2
#: Share of the best article's points, without what any article starts with, that makes an article beside it part of the page's text.
ARTICLE_SHARE = 0.3
#: Share of the best container's score that makes a container elsewhere a column of the same text.
COLUMN_SHARE = 0.5
PLAIN, NAMED, ASIDE, DROPPED = range(4)


def _boilerplate(tag: str, attrs: str, in_article: bool) -> tuple[int, str]:
    """DROPPED for boilerplate, NAMED or (never lifted beside other text) ASIDE where only a name or <form> says so; and that name."""
    if tag in _BOILERPLATE or (tag == "header" and not in_article):
        return DROPPED, ""
    kind, named = (NAMED, "") if tag == "form" else (PLAIN, "")
    if not attrs or tag in ("html", "body", "main"):
        return kind, named
    for name, a, b, c, bare in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if bare or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in _ROLES):
            return DROPPED, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return DROPPED, ""
        if name not in ("class", "id") or tag in _HEADINGS:
            continue
        for word in value.split():
            only_comments = tag == "article" or (name == "id" and (tag in _SLUGS or tag not in _BLOCK))
            if only_comments and not _COMMENT.fullmatch(word):
                continue
            if _ASIDE.fullmatch(word):
                kind, named = max((kind, named), (ASIDE, word))
            elif _NAMED.fullmatch(word) or (not in_article and _HEAD.fullmatch(word)):
                kind, named = max((kind, named), (NAMED, word))
    return (kind if tag in _BLOCK or kind == PLAIN else DROPPED), named


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def _unnamed(tags: list[str], parents: list[int], named: list[int], names: list[str], inside: list[bool], blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The blocks outside named subtrees that aren't lifted; all if there are none."""
    if not any(named):
        return blocks
    n = len(tags)
    size, whole, article, heading, out = [0] * n, [0] * n, [False] * n, [""] * n, [False] * n
    for owner, text, links in blocks:
        size[owner] += len(text) - links
        whole[owner] += len(text)
        if tags[owner] in _HEADINGS and not heading[owner]:
            heading[owner] = text
    for k in range(n - 1, 0, -1):  # the first heading of a block comes last here
        up = parents[k]
        size[up] += size[k]
        whole[up] += whole[k]
        heading[up] = heading[k] or heading[up]
        if article[k] or (tags[k] in ("article", "main") and size[k] > 0):
            article[up] = True
    for k in range(1, n):
        if named[k] == PLAIN:
            out[k] = out[parents[k]]
            continue
        lifted = named[k] == NAMED and (article[k] or 2 * size[k] > size[0] or (inside[parents[k]] and size[k] >= PROSE_CHARS and size[k] > PROSE_SHARE * whole[k]))
        own = names[k] and heading[k] and _slug(heading[k]) == _slug(names[k]) and not _COMMENT.fullmatch(names[k]) and size[k] > PROSE_SHARE * whole[k]
        out[k] = out[parents[k]] or not (lifted or own)
    return [b for b in blocks if not out[b[0]]] or blocks


def extract(page: str | None) -> str:
    """The main text: blocks in page order joined by an empty line; empty if there is none."""
    page = page or ""
    tags, parents, dropped, inside, named, names = ["#"], [-1], [False], [False], [PLAIN], [""]  # nodes
    blocks: list[tuple[int, str, int]] = []  # owner, text, characters in links
    stack, owners, part, links, at = [0], [0], [], 0, 0
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places on the stack of the open elements of a tag

    def flush() -> None:
        nonlocal links
        if part:
            text = " ".join("".join(part).split())
            if text:
                blocks.append((owners[-1], text, min(links, len(text))))
            part.clear()
        links = 0

    def last(some: Iterable[str]) -> int:
        """The place on the stack of the last open element with one of some tags; 0 for none."""
        return max((opened[x][-1] for x in some if opened[x]), default=0)

    def pop_to(depth: int) -> None:
        for n in reversed(stack[depth:]):
            opened[tags[n]].pop()
            if owners[-1] == n:
                owners.pop()
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal links
        if text and not dropped[stack[-1]]:
            text = html.unescape(text) if "&" in text else text
            part.append(text)
            if opened["a"]:
                links += len(text.strip())

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            depth = last((name,))
            if depth:
                if any(tags[n] in _BLOCK for n in stack[depth:]):
                    flush()
                pop_to(depth)
            continue
        if name in _BLOCK:
            flush()
            if (depth := last(("p",))) > last(_P_SCOPE):
                pop_to(depth)
        if name in _ENDS:
            ends, scope = _ENDS[name]
            while (depth := last(ends)) > last(scope - ends):
                pop_to(depth)
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in _VOID:
            if name in ("br", "hr", "wbr"):
                part.append("" if name == "wbr" else " ")
            continue
        up, attrs = stack[-1], m[3] or m[6] or ""
        tags.append(name)
        parents.append(up)
        kind, word = _boilerplate(name, attrs, inside[up])
        dropped.append(dropped[up] or kind == DROPPED)
        named.append(kind if kind < DROPPED else PLAIN)
        names.append(word)
        inside.append(inside[up] or name in ("article", "main"))
        if not attrs.endswith("/") or name not in ("path", "g", "use"):
            opened[name].append(len(stack))
            stack.append(len(tags) - 1)
            if name in _BLOCK:
                owners.append(len(tags) - 1)
    say(page[at:])
    flush()
    return "\n\n".join(text for _, text, _ in _kept(tags, parents, _unnamed(tags, parents, named, names, inside, blocks)))


def _kept(tags: list[str], parents: list[int], blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    if not blocks:
        return blocks
    n = len(tags)
    points, size, linked, scored = [0.0] * n, [0] * n, [0] * n, [False] * n
    for owner, text, links in blocks:
        size[owner] += len(text)
        linked[owner] += links
        value = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - links / len(text))
        # text straight inside a container is a paragraph of that container; a paragraph passes its points up
        up = owner if tags[owner] in _START or owner == 0 or tags[owner] == "body" else parents[owner]
        for level in range(LEVELS):
            if up < 0:
                break
            points[up] += value if level == 0 else value / (level * 2 if level < 2 else level * 3)
            scored[up] = True
            up = parents[up]
    for k in range(n - 1, 0, -1):
        size[parents[k]] += size[k]
        linked[parents[k]] += linked[k]
    own = lambda k: points[k] * (1 - linked[k] / max(1, size[k]))
    score = [(points[k] + _START.get(tags[k], 0)) * (1 - linked[k] / max(1, size[k])) if scored[k] and points[k] > 0 else -1.0 for k in range(n)]
    best = max(range(n), key=lambda k: (score[k], -k))
    if score[best] < 0:
        return blocks
    k, above, in_article = best, [best], False  # an article stays whole
    while k > 0:
        if tags[k] in ("article", "main"):
            best, in_article = k, True
        k = parents[k]
        above.append(k)
    keep = [False] * n
    keep[best] = True
    need = max(10.0, SIBLING_SHARE * score[best])
    if not in_article:  # columns: what stands beside an ancestor and holds a container of like score
        on_way, strong = set(above), [False] * n
        for k in range(n - 1, 0, -1):
            strong[k] = strong[k] or (score[k] >= COLUMN_SHARE * score[best] and 3 * linked[k] < size[k])
            strong[parents[k]] = strong[parents[k]] or strong[k]
        for k in range(1, n):
            keep[k] = keep[k] or (strong[k] and k not in on_way and parents[k] in on_way and parents[k] != best)
    for k in range(1, n):
        if parents[k] == parents[best] and k != best:
            if tags[best] in ("article", "main"):  # other articles beside it, not what a main or an article stands beside
                keep[k] = tags[k] == tags[best] and own(k) >= ARTICLE_SHARE * own(best)
            else:
                text_like = tags[k] in ("p", "h1", "h2", "h3", "blockquote", "pre") and linked[k] < 0.25 * max(1, size[k]) and size[k] > 0
                keep[k] = score[k] >= need or text_like
    for k in range(1, n):
        keep[k] = keep[k] or keep[parents[k]]
    return [b for b in blocks if keep[b[0]]]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of each row of pages (page_id, url, html).

    Null html is empty; pages without text give an empty string. Rows that repeat come out as often as they
    came, other columns aren't read, an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
