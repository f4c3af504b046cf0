"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text. The blocks of one root-to-leaf path of block elements share two ratios: text
length and punctuation marks for each block. Both are smoothed over the blocks in page order, fused into one value
and held against a threshold. The paths that pass show where the content is: the deepest element that holds all of
them, or the article around it. The main text is every block in it, menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments left out. A name that may also stand for layout (post-header, has-sidebar)
leaves an element out only if its text is mostly links.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import pieces

# No alternative looks beyond the next "<" or ">" without taking all that it saw, so a page is read in linear time.
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    r"""|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([A-Za-z][^\s/<>]*+)([^<>]*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；！？]")
# Elements and names in markup.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_EMPTY = frozenset("area base col embed hr input link meta param source track".split())
#: Their text is no markup; of these, the last two end with the page if nothing ends them before.
_RAW = frozenset("iframe noscript textarea title script style".split())
#: Left out with all inside if an end tag closes them; one that is closed by nothing holds nothing.
_EMBEDDED = frozenset("audio canvas iframe math noscript object select svg template textarea title video".split())
_OUT = frozenset("head nav header footer aside form button menu dialog fieldset legend map".split())
_NEVER_OUT = frozenset("html body main article".split())
_NAMES_OUT = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal "
    "nav navbar navigation newsletter notice notices popup promo promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# Of these, names that wrappers and parts of an article bear too.
_LAYOUT = frozenset("banner footer header masthead menu nav navbar navigation notice notices related reply replies respond search sidebar skip toolbar widget".split())
# What else may stand in a name beside these without another meaning: names of places and parts.
_PLACES = frozenset(
    "area aside bar block body bottom box btn button buttons column container content entry field foot form group head heading icon icons inline inner item items label left link links list main message "
    "module outer overlay page panel part popup post posts right row section site slot small sticky text title top unit wrap wrapper zone".split()
)
_STATES = frozenset("has is no with without".split())
_ROLES_OUT = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
# What an opening element closes, up to the element that bounds the search.
_CLOSES = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
THRESHOLD, MOST, LINKS = 0.35, 0.5, 0.7
#: Elements that are content unless most of their text is links; and those that must hold most of the page besides.
DOUBTFUL, WRAPPING = -1, -2
# Elements that hold a part of a text among siblings.
_WHOLE = frozenset("article body div html main".split())


class Page:
    """Blocks of text in page order, and the elements around them as numbers: an element comes after those around it."""

    def __init__(self):
        self.tags, self.parents, self.said = [""], [0], [0]
        self.paths, self._path_of = [0], {}
        self.texts: list[str] = []
        self.links: list[int] = []  # characters of a block's text within links
        self.at: list[int] = []

    def element(self, tag: str, parent: int, said: int) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.said.append(said)
        self.paths.append(self._path_of.setdefault((self.paths[parent], tag), len(self._path_of) + 1))
        return len(self.tags) - 1

    def block(self, text: str, links: int, at: int) -> None:
        self.texts.append(text)
        self.links.append(links)
        self.at.append(at)

    def down(self, own: list, join) -> list:
        """What each element takes over from those around it."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = join(out[self.parents[e]], out[e])
        return out

    def up(self, own: list[int]) -> list[int]:
        """Sums over each element and all inside."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parents[e]] += out[e]
        return out

    def within(self, blocks, value) -> list[int]:
        own = [0] * len(self.tags)
        for b in blocks:
            own[self.at[b]] += value(b)
        return self.up(own)


def _named(name: str) -> int:
    """What one class or id says, as in _outside."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    told = _NAMES_OUT.intersection(parts)
    if not told:
        return 0
    if parts[0] in _STATES:
        return DOUBTFUL
    if not told <= _LAYOUT:
        return 1 if told | _PLACES >= set(parts) else DOUBTFUL  # share-buttons says it, share-price may be content
    return WRAPPING if len(told) == len(set(parts)) else DOUBTFUL


def _outside(tag: str, attributes: str) -> int:
    """2: the element says so itself, 1: its names do, 0: content, DOUBTFUL or WRAPPING: its text decides."""
    if tag in _NEVER_OUT:
        return 0
    if tag in _OUT or tag in _EMBEDDED:
        return 2
    if not attributes.strip():
        return 0
    said = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in _ROLES_OUT:
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            return 2
        if name in ("class", "id"):
            for each in map(_named, value.split()):
                said = 1 if 1 in (said, each) else min(said, each)
    return 2 if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) else said


def read(html: str) -> Page:
    page = Page()
    stack, open_ = [0], defaultdict(int)
    parts: list[str] = []
    links, in_link, at = 0, False, 0
    endless: set[str] = set()

    def end() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            page.block(text, links, stack[-1])
        parts.clear()
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                links += len(piece)

    def close(i: int, ended: bool = False) -> None:
        """Close elements from the i-th on; an end tag ended the i-th itself, or none did."""
        for e in stack[i + ended :]:
            if page.tags[e] in _EMBEDDED:
                page.said[e] = 0
        for e in stack[i:]:
            open_[page.tags[e]] -= 1
        del stack[i:]

    def after_raw(tag: str, start: int) -> int | None:
        """Where the end tag of raw text ends, or the page; None: the tag has no end, so its text is markup."""
        m = None if tag in endless else re.compile(rf"</{tag}\s*+[^<>]*+>", re.I).search(html, start)
        if m:
            return m.end()
        endless.add(tag)
        return len(html) if tag in ("script", "style") else None

    while m := _PART.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW and not closing and (raw_end := after_raw(tag, at)) is not None:
            parts.append(" ")
            at = raw_end
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        end()
        in_link = False
        if closing:
            if open_[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if page.tags[stack[i]] == tag), True)
            continue
        if tag in _EMPTY or tag in _EMBEDDED and attributes.endswith("/"):
            continue
        goes, bound = _CLOSES.get(tag, ((), ()))
        if any(open_[x] for x in goes):
            for i in range(len(stack) - 1, 0, -1):
                now = page.tags[stack[i]]
                if now in bound:
                    break
                if now in goes:
                    close(i)
                    if tag != "tr":
                        break
        if page.tags[stack[-1]] == "p":
            close(len(stack) - 1)
        stack.append(page.element(tag, stack[-1], _outside(tag, attributes)))
        open_[tag] += 1
    say(html[at:])
    end()
    close(1)
    return page


def _smoothed(values: list[float]) -> list[float]:
    n = len(values)
    return [(values[max(i - 1, 0)] + 2 * values[i] + values[min(i + 1, n - 1)]) / 4 for i in range(n)]


def content(page: Page) -> list[int]:
    """Numbers of the blocks of the main text. Time and memory are linear in the page, however deep its elements lie."""
    texts, links, at = page.texts, page.links, page.at
    out = page.down([max(x, 0) for x in page.said], max)
    shown = [b for b in range(len(texts)) if not out[at[b]]]
    size, linked = page.within(shown, lambda b: len(texts[b])), page.within(shown, links.__getitem__)
    enough = MOST * sum(len(texts[b]) for b in shown)
    left = page.down([x < 0 and (linked[e] > MOST * size[e] or x == WRAPPING and size[e] <= enough) for e, x in enumerate(page.said)], lambda a, b: a or b)
    kept = [b for b in shown if not left[at[b]]] or shown or [b for b in range(len(texts)) if out[at[b]] < 2]
    if not kept:
        return []
    path = [page.paths[at[b]] for b in kept]
    count, length, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for b, p in zip(kept, path, strict=True):
        count[p] += 1
        length[p] += len(texts[b]) - links[b]
        marks[p] += len(_PUNCTUATION.findall(texts[b]))
    by_length = _smoothed([length[p] / count[p] for p in path])
    by_marks = _smoothed([marks[p] / count[p] for p in path])
    fused: dict[int, float] = defaultdict(float)
    for p, x, y in zip(path, by_length, by_marks, strict=True):
        fused[p] = max(fused[p], (max(x, 0.0) * (1 + y)) ** 0.5)
    least = THRESHOLD * max(fused.values())
    passing = [b for b, p in zip(kept, path, strict=True) if fused[p] >= least]
    passing = [b for b in passing if links[b] <= LINKS * len(texts[b])] or passing  # menus pass beside long text
    # the deepest element around all of them; then the article around, else an element that stands among siblings: a paragraph, list or section goes up
    holds = page.within(passing, lambda b: 1)
    around = max(e for e, n in enumerate(holds) if n == len(passing))
    chain = [around]
    while chain[-1]:
        chain.append(page.parents[chain[-1]])
    found = {t: next((e for e in chain if page.tags[e] in of), 0) for t, of in (("article", {"article"}), ("main", {"main"}), ("whole", _WHOLE))}
    text = found["article"] or found["main"]
    anchor = text or found["whole"]
    inside = page.down([e == anchor for e in range(len(page.tags))], lambda a, b: a or b)
    # without an article, links before and after all content are menus
    return [b for b in kept if inside[at[b]] and (text or passing[0] <= b <= passing[-1] or links[b] <= LINKS * len(texts[b]))]


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by two line ends; a null or empty page has none."""
    if not html:
        return ""
    page = read(html)
    return "\n\n".join(page.texts[b] for b in content(page))


def extracted(pages: DataFrame, *carried: str) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages(page_id, url, html)``, then the columns carried along.

    One row for each row, repeated ids included. A null, empty or wordless page has an empty text. An empty table
    gives no rows. Other columns are not looked at.
    """
    of = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *carried)
    names = ["page_id", "url", "text", "n_chars", *carried]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in of.schema[3:])
    return of.mapInArrow(extract, "page_id long, url string, text string, n_chars long" + more)
