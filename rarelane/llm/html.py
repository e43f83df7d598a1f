"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read once into blocks of text, each with the elements around it.  A block's
score (log odds of content) comes from its words, its share of link text, its tag and
the elements around it: menus, headers, footers, side columns, notices, adverts,
forms and reader comments, by element, role, class or id.  The score's size is the
block's capacity to the source (content) or to the sink (boilerplate).  Neighbouring
blocks are tied by smoothness edges, more strongly the nearer their common element
is, and so are successive blocks of one container.  The minimum cut gives the
labelling of least total cost; what the source still reaches is the main text.

Blocks are split at block elements; ``br`` counts as white space.  Character
references are decoded, white space inside a block becomes one space, blocks are
joined in page order by a line end.  Unclosed elements end with their parents, an
unclosed tag, comment or script hides what follows it.

Null or empty html, and pages without content, give an empty text.  Null or repeated
ids and urls give a row each.  An empty table gives no rows.  Other columns are not
read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Element names and the words that mark boilerplate in class, id and role.
HIDDEN = "script style noscript template textarea select svg iframe object canvas title button audio video"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul"
)
AWAY = "nav footer aside form menu dialog"
MARKS = (
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget"
)
ROLES = "alert banner complementary contentinfo dialog form menu navigation search"

_NAMES = {k: frozenset(v.split()) for k, v in dict(void=VOID, blocks=BLOCKS, away=AWAY, marks=MARKS, roles=ROLES).items()}
_TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(HIDDEN.split())})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Score of a block that stands in boilerplate, and the strength of the ties.
AWAY_SCORE, TIE = -8.0, 0.6


class Element:
    __slots__ = ("name", "parent", "depth", "away", "holds_main", "last")

    def __init__(self, name: str, parent: "Element | None", away: bool):
        self.name, self.parent, self.away = name, parent, away
        self.depth = parent.depth + 1 if parent else 0
        self.holds_main, self.last = False, None


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def _marked(rest: str) -> bool:
    """Whether the attributes name boilerplate or hide the element."""
    for match in _ATTRIBUTE.finditer(rest):
        name, value = match[1].lower(), (match[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name == "role":
            if value.lower() in _NAMES["roles"]:
                return True
        elif any(w.lower() in _NAMES["marks"] for w in _WORD.findall(value)):
            return True
    return False


def read_blocks(page: str) -> tuple[list[Block], bool]:
    """Blocks in page order, and whether the page has an article or main element."""
    root = here = Element("", None, False)
    blocks: list[Block] = []
    parts: list[str] = []
    links, linked, has_main, at = 0, 0, False, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, linked, here))
            parts.clear()
        linked = 0

    for tag in _TAGS.finditer(page):
        if tag.start() > at:
            parts.append(page[at : tag.start()])
            if links:
                linked += tag.start() - at
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            links = 0 if tag["end"] else 1
        elif name == "br":
            parts.append(" ")
        elif name in _NAMES["blocks"]:
            close()
            links = 0
            if tag["end"]:
                found = here
                while found is not root and found.name != name:
                    found = found.parent
                if found is not root:
                    here = found.parent
                continue
            if here.name == "p" or here.name == name and name in ("li", "tr", "td", "th", "dd", "dt", "option"):
                here = here.parent
            if name not in _NAMES["void"]:
                away = name in _NAMES["away"] or name not in ("html", "body") and _marked(tag["rest"])
                if name == "header":  # an article's own header holds its title
                    own = here
                    while own is not root and own.name not in ("article", "main"):
                        own = own.parent
                    away = away or own is root
                here = Element(name, here, away)
                if name in ("article", "main", "h1"):
                    has_main = has_main or name != "h1"
                    own = here.parent
                    while own is not None and not own.holds_main:
                        own.holds_main = True
                        own = own.parent
    parts.append(page[at:])
    close()
    return blocks, has_main


def score(block: Block, has_main: bool) -> float:
    """Log odds that a block is content."""
    element, inside, own = block.element, False, block.element
    while own is not None:
        # an element around the whole article is no boilerplate, whatever it is called
        if own.away and not own.holds_main:
            return AWAY_SCORE
        inside = inside or own.name in ("article", "main")
        own = own.parent
    words = block.text.count(" ") + 1
    value = min(3.0, 0.12 * words) - 1.0 - 4.0 * min(1.0, block.linked / len(block.text))
    if block.text[-1] in ".!?…:\"”»":
        value += 0.8
    if element.name in ("p", "blockquote", "pre"):
        value += 0.7
    elif element.name in ("h1", "h2", "h3"):
        value += 1.4
    if has_main:
        value += 2.5 if inside else -2.5
    return value


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between successive blocks of one container."""
    out = []
    for i, block in enumerate(blocks):
        if i:
            a, b, steps = blocks[i - 1].element, block.element, 0
            while a is not b:
                if a.depth >= b.depth:
                    a = a.parent
                else:
                    b = b.parent
                steps += 1
            out.append((i - 1, i, TIE / (1 + steps)))
        holder = block.element.parent
        if holder is not None:
            if holder.last is not None and holder.last < i - 1:
                out.append((holder.last, i, TIE / 3))
            holder.last = i
    return out


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content side of the minimum cut, by augmenting shortest paths from source to sink.

    A positive score is the capacity from the source, a negative one that to the sink.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    supply = [max(0.0, s) for s in scores]
    room = [max(0.0, -s) for s in scores]
    least = 1e-9
    while True:
        came = {i: -1 for i in range(n) if supply[i] > least}
        queue, end = deque(came), None
        while queue and end is None:
            i = queue.popleft()
            for j, w in near[i].items():
                if w > least and j not in came:
                    came[j] = i
                    if room[j] > least:
                        end = j
                        break
                    queue.append(j)
        if end is None:
            return [i in came for i in range(n)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(supply[path[-1]], room[end], *(near[a][b] for b, a in zip(path, path[1:])))
        supply[path[-1]] -= flow
        room[end] -= flow
        for b, a in zip(path, path[1:]):
            near[a][b] -= flow
            near[b][a] += flow


def main_text(page: str) -> str:
    blocks, has_main = read_blocks(page)
    kept = cut([score(b, has_main) for b in blocks], ties(blocks))
    return "\n".join(b.text for b, stays in zip(blocks, kept) if stays)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kind = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(batch.column("html")[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(extract, kind)
