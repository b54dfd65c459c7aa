"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each under the path of its open container elements. Per path the text
length and the punctuation are added up and divided by the number of nodes; the two ratios are smoothed
over neighbouring paths in page order, fused by multiplying, weighted by what the path's names say, and
paths over a threshold hold the content. Everything happens inside one page, so the operator is one map
over pages: no shuffle, memory bounded by the largest page.

A null or empty page has an empty text. Repeated rows give repeated rows, other columns, also of the names that
the result bears, are ignored, an empty table gives an empty one. Paths of equal scores are judged alike. White space is what
Unicode calls so, the no-break space included. Memory is bounded by the largest page.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from statistics import fmean, pstdev

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.runtime import lean, ship

#: Elements whose text is never part of an article.
BARRED = frozenset("script style noscript template nav header footer aside form menu dialog iframe svg button select option textarea input head title".split())
#: Of these nothing inside is markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block: their tags neither end it nor stand for white space.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label math mrow mi mn mo msub msup mfrac msqrt mtext semantics".split())
#: Opening one of these ends an open p.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Of these an open sibling ends when the next one opens, up to the element that holds the list.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words of class, id and role values that mark menus, notices, adverts and comments; and words that say nothing beside them.
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies complementary contentinfo disqus foot footer header masthead menu modal nav navbar navigation"
    " newsletter notice popup promo related replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
NEUTRAL = frozenset("area articles bar block bottom box buttons center container content desktop fixed form global group holder inner item items left link links list main mobile outer overlay page panel posts primary right section secondary site sticky stories text thread top unit wrap wrapper".split())
CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|comment-?list|cookie|cookies|consent|disqus|foot|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|article-?body|body-?text|content|entry|entry-?content|main|main-?content|post|post-?body|post-?content|story|text)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PUNCT = re.compile(r"[.,;:!?…]")
SPACE = re.compile(r"\s+")
#: Elements that hold a container's text just as its paragraphs do.
PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 li blockquote pre figcaption dt dd td th".split())
#: Weights of neighbouring paths in smoothing.
KERNEL = (0.25, 0.5, 0.25)
#: Weight of the score of a path through an element that is named as content.
NAMED = 3.0


def _decoded(text: str) -> str:
    return html.unescape(text) if "&" in text else text


@functools.lru_cache(4096)
def not_content(said: str) -> bool:
    """Whether a class, id or role among these is made of words for what is no content: of `ad`, `site-header` and `commentList`, not of `related-work`."""
    for name in said.split():
        words = [w for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w not in NEUTRAL]
        if words and NOT_CONTENT.issuperset(words):
            return True
    return False


def blocks(page: str) -> list[tuple[tuple[str, ...], str, bool]]:
    """(path, text, barred) of each block in page order; the text has its character references decoded and its white space joined."""
    out: list[tuple[tuple[str, ...], str, bool]] = []
    stack: list[tuple[str, str, bool]] = []  # name, name with what its attributes say, barred from here on
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                out.append((tuple(x[1] for x in stack), text, bool(stack) and stack[-1][2]))

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            parts.append(_decoded(page[at:]))
            break
        if m.start() > at:
            parts.append(_decoded(page[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        flush()
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.end() - 1) + 1 if end else n
            at = at or n
            continue
        if name in ENDS_P and any(x[0] == "p" for x in stack):
            close(next(k for k, x in enumerate(stack) if x[0] == "p"))
        if name in SIBLINGS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SIBLINGS[name]:
                    break
                if stack[k][0] == name:
                    close(k)
                    break
        if name in VOID or m[3].endswith("/"):
            continue
        said = " ".join(x or y or z for x, y, z in ATTR.findall(m[3])) if "=" in m[3] else ""
        bad = name in BARRED or (bool(said) and not_content(said)) or (bool(m[3]) and bool(HIDDEN.search(m[3])))
        label = f"{name}.+" if name in ("article", "main") or (said and CONTENT.search(said)) else f"{name}.{said}" if said else name
        stack.append((name, label, bad or (bool(stack) and stack[-1][2])))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, one to a line."""
    found = [b for b in blocks(page or "") if not b[2]]
    if not found:
        return ""
    # headings, list items, quotes and the like count as paragraphs of their container's path
    lead = [tuple("p" if x in PARAGRAPHS else x for x in path) for path, _, _ in found]
    order = list(dict.fromkeys(lead))
    size, marks, nodes = dict.fromkeys(order, 0), dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for path, (_, text, _) in zip(lead, found, strict=True):
        size[path] += len(text)
        marks[path] += len(PUNCT.findall(text))
        nodes[path] += 1
    ratio = [size[p] / nodes[p] for p in order]
    dots = [(marks[p] + 1) / nodes[p] for p in order]

    def smooth(x: list[float]) -> list[float]:
        return [sum(w * x[min(max(i + k, 0), len(x) - 1)] for k, w in zip((-1, 0, 1), KERNEL, strict=True)) for i in range(len(x))]

    weight = [NAMED if any(x.endswith(".+") for x in p) else 1.0 for p in order]
    fused = [a * b * w for a, b, w in zip(smooth(ratio), smooth(dots), weight, strict=True)]
    cut = max(0.2 * max(fused), min(fmean(fused), pstdev(fused)) if len(fused) > 1 else 0.0)
    own = [a * b * w for a, b, w in zip(ratio, dots, weight, strict=True)]  # smoothing must not lift a poor path beside a rich one
    keep = {p for p, f, o in zip(order, fused, own, strict=True) if f >= cut and o >= 0.1 * max(own)}
    return "\n".join(text for path, (_, text, _) in zip(lead, found, strict=True) if path in keep)


@lean
def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of each page."""
    ship(pages.sparkSession)
    p = pages.select("page_id", "url", "html")
    kinds = dict(p.dtypes)
    return p.mapInArrow(_map, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
