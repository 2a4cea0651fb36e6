"""Sections of XML, HTML and plain articles."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import takewhile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Headings at which the wanted section begins and ends.
BEGIN = re.compile(r"^\W*(?:\d+(?:\.\d+)*\.?\s*)?(?:(?:experimental|materials?|patients?)\s+(?:and|&)\s+)?(?:methods?|methodology|experimental procedures?|métodos|méthodes|metodi|methoden)\b", re.I)
STOP = re.compile(r"^\W*(?:\d+(?:\.\d+)*\.?\s*)?(?:results?|discussion|conclusions?|references|acknowledg\w*|funding|supplementary)\b", re.I)
HEADING_CHARS = 80


def from_xml(text: str) -> list[tuple[str, str]]:
    """(title, paragraph) of the sections whose title begins the wanted part; namespaces don't matter; broken XML gives nothing."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""
    out: list[tuple[str, str]] = []

    def walk(e: ElementTree.Element, title: str, inside: bool) -> None:
        for c in e:
            if name(c) in ("sec", "section"):
                own = next((" ".join("".join(t.itertext()).split()) for t in c if name(t) == "title"), "")
                walk(c, own or title, (inside or bool(BEGIN.match(own))) and not STOP.match(own))
            elif name(c) == "p" and inside:
                para = " ".join("".join(c.itertext()).split())
                if para:
                    out.append((title, para))
            elif name(c) != "title":
                walk(c, title, inside)

    walk(root, "", False)
    return out


class _Headings(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.kind, self.hold, self.skip = "p", [], 0

    def flush(self, kind: str) -> None:
        text = " ".join("".join(self.hold).split())
        if text:
            self.rows.append((self.kind, text))
        self.hold, self.kind = [], kind

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush("h")
        elif tag in ("p", "div", "section", "li", "br", "td"):
            self.flush("p")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]", tag) or tag in ("p", "div", "section", "li"):
            self.flush("p")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.hold.append(data)


def _wanted(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out, title = [], None
    for kind, text in rows:
        if kind == "h":
            title = text if BEGIN.match(text) else None if STOP.match(text) or title is None else title
        elif title is not None:
            out.append((title, text))
    return out


@dataclass
class Node:
    """An element of a page, with what it holds in order: texts and elements."""

    tag: str
    attrs: dict[str, str]
    held: list = field(default_factory=list)

    def inside(self) -> Iterator[Node]:
        for x in self.held:
            if isinstance(x, Node):
                yield x
                yield from x.inside()

    def text(self) -> str:
        return " ".join("".join(x if isinstance(x, str) else f" {x.text()} " if x.tag in BLOCKS else x.text() for x in self.held).split())

    def has(self, *classes: str) -> bool:
        return set(classes) <= set(self.attrs.get("class", "").split())


BLOCKS = frozenset("p div section li td h1 h2 h3 h4 h5 h6".split())
EMPTY = frozenset("br hr img input link meta area base col embed source track wbr".split())
DEEPEST = 200


class _Tree(HTMLParser):
    """Builds the tree of a page; a block ends an open paragraph, an end tag all that is open inside. Beyond ``DEEPEST`` levels elements lie flat."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            block = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag in BLOCKS), 0)
            if self.open[block].tag == "p":
                del self.open[block:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].held.append(node)
        if tag not in EMPTY and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].held.append(data)


def _heads(node: Node, tags: str, direct: bool = False) -> Node | None:
    """The first heading of these tags, if it begins the wanted part."""
    first = next((x for x in (node.held if direct else node.inside()) if isinstance(x, Node) and x.tag in tags.split()), None)
    return first if first is not None and BEGIN.match(first.text()) else None


def _paragraphs(nodes: Iterable[Node], title: Callable[[Node], str | None], paragraph: Callable[[Node], bool], default: str = "Materials and Methods") -> list[tuple[str, str]]:
    """(title, text) of the paragraphs among these nodes, up to a title or a short paragraph that begins another part."""
    out, current = [], default
    for n in nodes:
        said = title(n)
        if said:
            if STOP.match(said):
                break
            current = current if BEGIN.match(said) else said.rstrip(":.")
        if paragraph(n):
            text = n.text()
            if len(text) <= HEADING_CHARS and STOP.match(text):
                break
            if text:
                out.append((current, text))
    return out


def _tagged(tags: str) -> Callable[[Node], str | None]:
    return lambda n: n.text() if n.tag in tags.split() else None


def _after(root: Node, first: Node) -> list[Node]:
    """Elements that follow one within its parent."""
    for parent in (root, *root.inside()):
        for i, x in enumerate(parent.held):
            if x is first:
                return [y for y in parent.held[i + 1 :] if isinstance(y, Node)]
    return []


def _titled_blocks(root: Node) -> list[tuple[str, str]]:
    """Sections named by an attribute or by their own heading."""
    out: list[tuple[str, str]] = []
    taken: set[int] = set()
    for n in root.inside():
        named = n.tag == "section" and re.search(r"materials\s*(?:and|&)?\s*methods", n.attrs.get("data-title", ""), re.I)
        own = n.tag in ("section", "div") and _heads(n, "h1 h2 h3", direct=True)
        classed = n.tag == "section" and n.has("article-section__content") and _heads(n, "h2")
        if (named or own or classed) and id(n) not in taken:
            taken |= {id(x) for x in n.inside()}
            out += _paragraphs(n.inside(), _tagged("h2 h3 h4"), lambda x: x.tag == "p" or x.attrs.get("role") == "paragraph")
    return out


def _typed_section(root: Node) -> list[tuple[str, str]]:
    """A section whose type is declared, with paragraphs by role."""
    n = next((x for x in root.inside() if x.tag == "section" and re.search(r"materials\W*methods", x.attrs.get("data-type", ""), re.I)), None)
    return _paragraphs(n.inside(), _tagged("h3 h4"), lambda x: x.attrs.get("role") == "paragraph") if n else []


def _levelled_blocks(root: Node) -> list[tuple[str, str]]:
    """Blocks with a level in their class."""
    n = next((x for x in root.inside() if x.tag == "div" and x.has("NLM_sec", "NLM_sec_level_1") and _heads(x, "h2")), None)
    return _paragraphs(n.inside(), _tagged("h3 h4"), lambda x: x.tag == "div" and x.has("NLM_p")) if n else []


def _named_block(root: Node) -> list[tuple[str, str]]:
    """A block with a telling id, or the one that a link of that name leads to."""
    ids = {x.attrs["id"]: x for x in reversed(list(root.inside())) if x.tag == "div" and x.attrs.get("id")}
    links = [x.attrs["href"].lstrip("#") for x in root.inside() if x.tag == "a" and x.attrs.get("href", "").startswith("#") and BEGIN.match(x.text())]
    n = next((ids[k] for k in ("methods", "section-2", *links) if k in ids), None)
    return _paragraphs(n.inside(), lambda x: x.text() if x.tag == "span" and x.has("level-4") else None, lambda x: x.tag == "p", "Methods") if n else []


def _outline(root: Node) -> list[tuple[str, str]]:
    """What follows a heading of an outline, up to the next; a paragraph's bold italics are a title."""
    head = next((x for x in root.inside() if x.tag == "h2" and x.has("ejp-article-outline-heading") and BEGIN.match(x.text())), None)
    if head is None:
        return []
    part = list(takewhile(lambda x: not (x.tag == "h2" and x.has("ejp-article-outline-heading")), _after(root, head)))
    bold = lambda x: next((y.text() for y in x.inside() if y.tag == "strong" and any(z.tag == "em" for z in y.inside())), None) if x.tag == "p" else None
    return _paragraphs(part, bold, lambda x: x.tag == "p")


def _onward(root: Node) -> list[tuple[str, str]]:
    """What follows the first heading that begins the part."""
    head = next((x for x in root.inside() if x.tag in ("h1", "h2", "h3", "h4") and BEGIN.match(x.text())), None)
    if head is None:
        return []
    return _paragraphs((y for x in _after(root, head) for y in (x, *x.inside())), _tagged("h1 h2 h3 h4"), lambda x: x.tag == "p", head.text().rstrip(":."))


#: Ways in which pages mark the wanted part, the surest first.
WAYS = (_titled_blocks, _typed_section, _levelled_blocks, _named_block, _outline, _onward)


def from_html(text: str) -> list[tuple[str, str]]:
    """(title, paragraph) of the first way that finds any; else of headings and paragraphs as they come."""
    tree = _Tree()
    tree.feed(text)
    tree.close()
    for way in WAYS:
        got = way(tree.root)
        if got:
            return got
    p = _Headings()
    p.feed(text)
    p.flush("p")
    return _wanted(p.rows)


def from_plain(text: str) -> list[tuple[str, str]]:
    """Paragraphs after a short heading line, or after ``Heading:`` at a paragraph's beginning."""
    rows: list[tuple[str, str]] = []
    for block in re.split(r"\n\s*\n|\x0c", text.replace("\r", "")):
        block = block.strip()
        first, _, rest = block.partition("\n")
        lead = re.match(r"^(\w[\w &]{2,40}):\s+(?=\S)", block)
        if len(first) <= HEADING_CHARS and (BEGIN.match(first) or STOP.match(first)) and not first.rstrip().endswith("."):
            if lead and not rest:
                rows += [("h", lead.group(1)), ("p", block[lead.end() :])]
                continue
            rows.append(("h", first.strip()))
            block = rest
        elif lead and (BEGIN.match(lead.group(1)) or STOP.match(lead.group(1))):
            rows.append(("h", lead.group(1)))
            block = block[lead.end() :]
        if block.strip():
            rows.append(("p", " ".join(block.split())))
    return _wanted(rows)


# Headings inside running text, and what stands around such words where they are no heading.
RUN_BEGIN = re.compile(r"(?<!\w)(?:\d{1,2}(?:\.\d{1,2})?\s+)?(?:materials\s*(?:and|&)\s*methods|experimental\s+(?:procedures|section)|methodology|methods)\b", re.I)
RUN_STOP = re.compile(r"(?<!\w)(?:\d{0,2}\.?\d{0,2}\s*)?(results|discussion|conclusion|references|acknowledgments?|bibliography|supplementary materials|supporting information)\b", re.I)
CITED = "as described in|as previously described|previously reported in|as reported in|according to|in accordance with|see also|see e.g.|has been described"
NO_BEGIN_AFTER = re.compile(r"[),]|\s+(?:in|for|is|of|by|to)\b|\s*(?:was|were)\s+(?:performed|conducted|carried\s+out)|\s+(?:[\d\s,]{5,}|\[\d+\])", re.I)
NO_STOP_BEFORE = re.compile(r"\b(?:the|this|that|these|those|our|their|its|and|of|all|in|similar|reliable|significant|preliminary|previous|current|presented|further|recorded|unpublished)\s+$", re.I)
NO_STOP_AFTER = re.compile(
    r"\s*,|\s*(?:are|were)\s+(?:shown|presented|reported|provided|expressed|described|listed|summari[sz]ed|compared|indicated|given|displayed|illustrated|obtained|observed|analy[sz]ed)\b"
    r"|\s*(?:show|shows|showed|indicate|indicates|indicated|suggest|suggests|suggested)\b|\s*(?:of|from|for|in)\b",
    re.I,
)
ROLES = re.compile(r"writing|project administration|review|editing|funding acquisition|methodology|conceptualization", re.I)
NAMED = re.compile(r"[A-Z][a-z]+ [A-Z]\.")
NEAR, MANY = 50, 5


def from_running(text: str) -> list[tuple[str, str]]:
    """(title, text) of the sections of a text without line structure, from their heading on.

    Candidates for beginnings and ends are found in one pass each; those that their surroundings show to be no heading (citations, phrases
    such as ``methods of``, ``results were shown``) are left out. A section goes to the next end, or to the end of the text; a beginning
    inside a section is none. Sections that are lists of roles or names are left out.
    """

    def begins(m: re.Match) -> bool:
        around = text[max(0, m.start() - NEAR) : m.start()] + "\n" + text[m.end() : m.end() + NEAR]
        return not NO_BEGIN_AFTER.match(text, m.end()) and not re.search(CITED, around, re.I)

    def stops(m: re.Match) -> bool:
        verb = m.group(1).lower() in ("results", "references") and NO_STOP_AFTER.match(text, m.end())
        return not verb and not NO_STOP_BEFORE.search(text[max(0, m.start() - 30) : m.start()])

    ends = [m.start() for m in RUN_STOP.finditer(text) if stops(m)]
    out, free = [], 0
    for m in filter(begins, RUN_BEGIN.finditer(text)):
        if m.start() < free:
            continue
        k = bisect_right(ends, m.start())
        end = ends[k] if k < len(ends) else len(text)
        part = text[m.start() : end].strip()
        if len(ROLES.findall(part)) <= MANY and len(NAMED.findall(part)) <= MANY:
            out.append((m.group().strip(), part))
            free = end
    return list(dict.fromkeys(out))


def grouped_by_span(paragraphs: DataFrame, headings: DataFrame, doc: str, start: str) -> DataFrame:
    """Each paragraph (doc, start, text) with the last heading (doc, start, text) that begins at its place or before: doc, start, heading, text.

    Paragraphs before the first heading have a null one. Null places go with the beginning.
    """
    both = headings.select(doc, F.coalesce(start, F.lit(-1)).alias(start), F.lit(0).alias("k"), F.col("text").alias("heading"), F.lit(None).cast("string").alias("text")).union(
        paragraphs.select(doc, F.coalesce(start, F.lit(-1)).alias(start), F.lit(1).alias("k"), F.lit(None).cast("string").alias("heading"), "text")
    )
    w = Window.partitionBy(doc).orderBy(start, "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("heading", F.last("heading", ignorenulls=True).over(w)).where("k = 1").drop("k")


def wanted(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The first of XML, HTML and plain that finds the section, and what it finds."""
    head = text.lstrip()[:200].lower()
    if head.startswith("<?xml") or head.startswith("<article"):
        got = from_xml(text)
        if got:
            return "xml", got
    if "<" in head and re.search(r"<(?:html|body|h[1-6]|p|div)\b", text, re.I):
        got = from_html(text)
        if got:
            return "html", got
        text = re.sub(r"</?\w[^<>]{0,200}>", "\n\n", text)
    return "plain", from_plain(text) or from_running(text)


def sections(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Paragraphs of the methods section of each article: row_id, format, pos, title, paragraph. Null and empty texts give none."""
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["row_id"], b["text"]):
                if t:
                    form, found = wanted(t)
                    rows += [(k, form, i, title, p) for i, (title, p) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["row_id", "format", "pos", "title", "paragraph"])

    return df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).mapInPandas(run, f"row_id {kind}, format string, pos int, title string, paragraph string")
