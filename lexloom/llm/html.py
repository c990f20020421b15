"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path. For each path the text length and the punctuation
are summed over its blocks, less what stands in links; the logarithms of the two ratios to the number of blocks are smoothed along
the order in which the paths appear, but for those under a hint, and fused by their product. The score of a path is that, weighted by what the page says of it:
ARTICLE times as much inside of an article or main element, HINTED times as much under a class, id or role that names
boilerplate. Paths that score at least THRESHOLD of the text-weighted mean of those without a hint (of all, if every path has
one; taken before HINTED) select the content.

The main text is what stands in the lowest section that holds all content, widened where only headings stand beside it, so
that headings and short lines come along; blocks under a hint come along only if their own path is content. If that
section is the page itself, each part of it that holds content is taken so. Only elements that never hold main text (menus,
footers, asides, controls and their labels) are left out whatever they score; so a button inside a sentence loses its words.

A form is judged by score, as pages may be wrapped in one: it is left out unless what stands in it and under no hint has an article or
PROSE letters of sentences, and scores more by letters than what stands outside of it.

Reading is linear in the page: each element knows its path, its nearest block and its range of blocks, and open elements
are looked up by tag, so that neither depth nor stray end tags cost more than their own length.

Defined cases: null, empty or tag-less html gives its plain text or nothing; quotes in a tag count only behind "="; unclosed
elements end where the next block or the page does; a page of adverts and menus only gives an empty text; very long and very
deep pages are read whole; a path at the threshold is content; repeated rows give equal results; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.common import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " head html hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "head", "html", "body"}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())  # what may stand in a head
NEVER = frozenset("nav footer aside label legend output select button menu dialog svg math canvas object audio video map datalist head".split())
#: Words of classes, ids and roles that name boilerplate, and words that only place it; a name counts if it has nothing else.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menubar"
    " breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist commentform disqus reply replies cookie cookies consent notice notices"
    " alert popup modal overlay share sharing social related recommended subscribe newsletter signup login search pagination pager toolbar widget skip copyright"
    " legal complementary contentinfo".split()
)
PLACES = frozenset("area bar block body box bottom buttons center col column container fixed footer header holder inner item items left link links list main outer panel posts right row section site slot top unit wrap wrapper".split())
#: Hints that a page's own layout may carry: they do not count inside an article that stands in such an element.
LAYOUT = frozenset("sidebar header footer nav navbar navigation menu banner search social".split())
SECTIONS = frozenset("html body article main section div td blockquote center table tbody tr".split())
PAGE = frozenset(("", "html", "body"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
SMOOTH, THRESHOLD, HINTED, ARTICLE, PLAIN = (0.25, 0.5, 0.25), 0.2, 0.04, 6.0, 0.5  # PLAIN: what text without punctuation counts
PROSE = 100  # letters, in blocks with a mark that ends a sentence, that a form has to hold to be the page's wrapper
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*(?:\s|\Z)|[。！？]")


class Path(NamedTuple):
    number: int
    hint: int  # 0, 1 (of layout only) or 2
    article: bool


class Element:
    """order and last: its place among all elements, and that of the last one inside it. begin and end: its blocks' numbers."""

    __slots__ = ("tag", "parent", "path", "holder", "out", "order", "last", "begin", "end", "links", "form")

    def __init__(self, tag: str, parent: Element | None, path: Path, out: bool, order: int, begin: int):
        self.tag, self.parent, self.path, self.out, self.order, self.begin = tag, parent, path, out, order, begin
        self.last, self.end = order, begin
        self.holder = self if parent is None or tag in BLOCK else parent.holder
        self.links = (parent.links if parent else 0) + (tag == "a")
        self.form = (parent.form if parent else None) or (self if tag == "form" else None)  # the outermost one


class Block(NamedTuple):
    text: str
    path: Path
    holder: Element
    linked: int  # letters in links


def named(attributes: str) -> tuple[list[str], int]:
    """Words of the class, id and role, and the hint that they give."""
    words, hints = set(), set()
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            own = {w.lower() for w in WORD.findall(name)}
            words |= own
            if own <= HINTS | PLACES:
                hints |= own & HINTS
    return sorted(words), 2 if hints - LAYOUT else 1 if hints else 0


def blocks_of(page: str) -> list[Block]:
    """The blocks that may be content, in page order."""
    paths: dict[tuple, Path] = {}
    root = Element("", None, Path(0, 0, False), False, 0, 0)
    stack, opened, out, order = [root], {}, [], 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            holder = stack[-1].holder
            line = " ".join(html.unescape("".join(text)).split())
            if line and not holder.out:
                out.append(Block(line, holder.path, holder, linked))
            text.clear()
        linked = 0

    def close(n: int) -> None:
        """Drop the stack's elements from n on."""
        if any(e.tag in BLOCK for e in stack[n:]):
            flush()
        for e in stack[n:]:
            e.last, e.end = order, len(out)
            opened[e.tag].pop()
        del stack[n:]

    def innermost(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def ended(tags, stops) -> None:
        """Close the innermost of these elements, unless one of the stops is nearer."""
        if (n := innermost(tags)) > innermost(stops):
            close(n)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        m = TOKEN.match(page, lt) if lt >= 0 else None
        upto = m.start() if m else (lt + 1 if lt >= 0 else size)
        if upto > at and stack[-1].tag == "head" and page[at:upto].strip():
            ended({"head"}, ())
        if upto > at and not stack[-1].out:
            piece = page[at:upto]
            text.append(piece)
            if stack[-1].links:
                linked += len(piece.strip())
        at = m.end() if m else upto
        if not m or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            ended({tag}, {"table"} - {tag} if tag not in ("body", "html") else ())
            if tag == "br":
                text.append(" ")
            continue
        if opened.get("head") and tag not in HEAD:
            ended({"head"}, ())
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = size if not end else end.start()
            if end:
                at = page.find(">", at) + 1 or size
            if tag in ("title", "textarea"):
                text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                ended({"p"}, {"table", "td"})
                flush()
            else:
                text.append(" ")
            continue
        if tag in ("html", "body") and opened.get(tag):
            continue
        if tag in ENDS_P:
            ended({"p"}, {"table", "td", "button"})
        if tag in ENDS_SAME:
            ended(ENDS_SAME[tag], STOPS_AT[tag])
        if tag in BLOCK:
            flush()
        if m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        parent = stack[-1]
        words, hint = named(m[3]) if m[3] else ([], 0)
        if tag in ("html", "body"):
            hint = 0
        article = tag in ("article", "main")
        inherited = 0 if article and parent.path.hint == 1 else parent.path.hint
        never = parent.out or tag in NEVER or (tag == "header" and not parent.path.article)
        if tag in BLOCK:
            key = (parent.path.number, tag, *words)
            path = paths.setdefault(key, Path(len(paths) + 1, max(inherited, hint), article or parent.path.article))
        elif hint > parent.path.hint:  # an inline element has no path of its own
            never, path = True, parent.path
        else:
            path = parent.path
        order += 1
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, parent, path, never, order, len(out)))
        if never and not parent.out and tag not in BLOCK:
            text.append(" ")
    flush()
    close(1)
    root.last, root.end = order, len(out)
    return out


def path_scores(blocks: list[Block]) -> dict[int, tuple[float, float, float]]:
    """By path: its score, the same without HINTED, and the letters of its blocks outside of links."""
    sums: dict[Path, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0
        s[2] += 1

    def smoothed(v: list[float]) -> list[float]:
        padded = [*v[:1], *v, *v[-1:]]
        return [sum(w * x for w, x in zip(SMOOTH, padded[i : i + 3])) for i in range(len(v))]

    out = {path.number: (0.0, 0.0, 0) for path in sums}  # nothing but links: no part in the order
    for hinted in (False, True):  # those under a hint stand for themselves and do not pull down the content between them
        kind = [(path, s) for path, s in sums.items() if bool(path.hint) == hinted and s[0]]
        length, stops = ([math.log1p(s[k] / s[2]) for _, s in kind] for k in (0, 1))
        if not hinted:
            length, stops = smoothed(length), smoothed(stops)
        for (path, s), a, b in zip(kind, length, stops):
            fused = a * (PLAIN + b) * (ARTICLE if path.article else 1.0)
            out[path.number] = (fused * (HINTED if hinted else 1.0), fused, s[0])
    return out


def content_paths(blocks: list[Block]) -> set[int]:
    """The tag paths whose score passes the threshold."""
    scores = path_scores(blocks)
    plain = [(score, n) for score, fused, n in scores.values() if score == fused and n] or [(fused, n) for _, fused, n in scores.values()]
    mean = sum(f * n for f, n in plain) / (sum(n for _, n in plain) or 1)
    return {p for p, (score, _, n) in scores.items() if n and score >= THRESHOLD * mean}


def without_forms(blocks: list[Block]) -> list[Block]:
    """The blocks but for those of forms that are no wrapper of the page's text. A rejected form's blocks become none, so that the
    others keep their numbers."""
    forms = {b.holder.form.order for b in blocks if b.holder.form}
    if not forms:
        return blocks
    scores, whole, prose = path_scores(blocks), {}, dict.fromkeys(forms, 0)
    for b in blocks:
        if not b.path.hint and b.linked < len(b.text):
            form = b.holder.form.order if b.holder.form else None
            whole[form] = whole.get(form, 0) + scores[b.path.number][1] * (len(b.text) - b.linked)
            if form is not None:
                prose[form] += PROSE if b.path.article else len(b.text) if SENTENCE.search(b.text) else 0
    total = sum(whole.values())
    out = {f for f in forms if prose[f] < PROSE or 2 * whole.get(f, 0) <= total}
    return [b._replace(text="") if b.holder.form and b.holder.form.order in out else b for b in blocks]


def main_text(page: str | None) -> str:
    blocks = without_forms(blocks_of(page or ""))
    there = [b for b in blocks if b.text]
    good = content_paths(there) if there else set()
    content = [b.holder for b in blocks if b.path.number in good and b.linked < len(b.text)]  # a block without text is none
    if not content:
        return ""
    top, last = min(content, key=lambda e: e.order), max(e.order for e in content)
    while not (top.tag in SECTIONS | PAGE and last <= top.last):
        top = top.parent
    while top.tag not in PAGE and top.parent.tag in SECTIONS - PAGE:  # the heading may stand beside the text's element
        beside = blocks[top.parent.begin : top.begin] + blocks[top.end : top.parent.end]
        if not all(b.holder.tag in HEADINGS for b in beside if b.text):
            break
        top = top.parent
    if top.tag not in PAGE:
        inside = blocks[top.begin : top.end]
    else:
        part: dict[int, Element] = {}  # of each element below, the part of the page that it stands in

        def part_of(e: Element) -> Element:
            way = []
            while e is not top and e.parent is not top and e.order not in part:
                way.append(e)
                e = e.parent
            found = part.get(e.order, e)
            part.update((x.order, found) for x in way)
            return found

        chosen = {part_of(e).order for e in content if e is not top}
        inside = [
            b for b in blocks[top.begin : top.end]
            if (b.path.number in good if b.holder is top else (p := part_of(b.holder)).order in chosen or (p is b.holder and p.tag in HEADINGS))
        ]
    return "\n".join(b.text for b in inside if b.text and (not b.path.hint or b.path.number in good))


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
