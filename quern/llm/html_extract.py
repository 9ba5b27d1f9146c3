"""Main text of web pages by equivalence classes of their tokens.

A page is a sequence of tokens: tags with their path, and texts with theirs.
Over the pages of a host, tokens with the same occurrence vector (how often they
occur on each page) are of one class. A class that recurs on several pages and on
a good share of the host's, and keeps its order and nests within the others, is
template: its tokens delimit the slots that hold what pages differ in. Texts of
the template go; of what remains, slots that mostly hold links over the host's
pages are menus. Elements that HTML itself sets apart (navigation, asides, forms,
footers, scripts and the like) or that are hidden go as well. Where a page has an
``article`` or ``main`` element, the text is what these hold.

Names that a page's author gave count last: a class, role or id that says in full
that a container is an advert, comments, sharing links and so on sets it apart.
Names never decide about headings, paragraphs, list items or cells, nor does a
name that only contains such a word. Headings, items and cells of an article stay
though other pages have them too.

Vectors are never gathered. A vector is known by its length and a sum of hashes
of (page, count), which partial aggregation adds up wherever rows lie, so a host
with any share of all pages costs no more a task than others. Pages of a host
with the same tokens are one page here: copies of an article don't make it
template. Classes are sought over a host and over each section of it, the first
part of a path that goes on, so the templates of a small section count there.
Only tokens on ``SHARE`` of a host's pages are collected, of which there are no
more than its pages' mean number of tokens over ``SHARE``; and only classes with
texts are passed on, as others take nothing away.

Fewer than ``SUPPORT`` different pages of a host are no evidence, and leave all to
the elements and names. Null and empty html give an empty text; a page whose url
has no host is of the host ``''``; repeated rows are treated alike. Work and
memory follow a page's length, whatever is left open in it and however deep it
nests.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quern.llm.common import cut, prepare, released

#: Different pages on which a class must recur, their least share of the host's or section's, and the share of linked characters that makes a slot a menu.
SUPPORT, SHARE, LINKED = 3, 0.5, 0.6

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style textarea title noscript iframe template".split())
VERBATIM = frozenset("xmp listing plaintext".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul xmp".split())
ENDS_P = BLOCK - {"html", "head", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "option", "optgroup"}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of an article that recur from one to the next and belong to it.
PART = HEADING | frozenset("td th caption li dt dd figcaption legend summary".split())
SAME_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main aside nav header footer body form blockquote select".split())
APART = frozenset("nav footer aside form script style noscript template iframe svg select button textarea input option dialog menu object canvas audio video head title search".split())

#: Containers whose class or role may set them apart, the words that do, and words that may follow them.
CONTAINER = frozenset("div section ul ol dl table article details figure center span".split())
LABELS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments commentlist complementary contentinfo consent cookie cookies copyright disclaimer discussion disqus feedback footer gdpr header login masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification notifications pager pagination paywall popup promo promoted promotion recommended related replies respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription toolbar tracking widget".split()
)
NEUTRAL = frozenset("area articles bar block bottom box button buttons container form inner item items left link links list main message outer panel posts right section site slot stories text thread top unit wrap wrapper".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_SEPARATOR = re.compile(r"[-_:]+")
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_SECTION = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*/+([^/?#]+)/+[^/?#]"


def places_of(url: Column) -> tuple[Column, Column]:
    """The numbers of a url's host and of its section, the first part of a path of several; without a section, the host's twice."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host, section = F.lower(F.regexp_extract(url, _HOST, 1)), F.regexp_extract(url, _SECTION, 1)
    return F.xxhash64(host), F.when(section == "", F.xxhash64(host)).otherwise(F.xxhash64(host, section))


def code(*parts: str | int) -> int:
    return xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def named_apart(value: str) -> bool:
    """Whether a word of a class or role says in full that its element isn't article."""
    for word in value.lower().split():
        parts = [p for p in _SEPARATOR.split(word) if p]
        if parts and parts[0] in LABELS and all(p in LABELS or p in NEUTRAL or p.isdigit() for p in parts):
            return True
    return False


def attributes(tag: str, attrs: str) -> tuple[str, bool]:
    """(the class, whether the element is hidden or, being a container, named as no article)."""
    own, apart = "", False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            own = _SPACE.sub(" ", value).strip().lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            apart = True
        elif tag in CONTAINER and name in ("class", "role", "id") and named_apart(value):
            apart = True
    return own, apart


@dataclass
class Block:
    path: int
    text: str
    token: int
    linked: int
    apart: bool
    inside: bool
    part: bool
    heading: bool
    header: bool


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


class _Reader:
    """The open elements of a page, by tag as well, so that no search walks through all of them."""

    def __init__(self):
        self.page = Page()
        # Of an open element: tag, path, apart, inside an article, part, heading, header, link.
        self.stack: list[tuple] = [("", 0, False, False, False, False, False, False)]
        self.where: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]
        self.runs: list[str] = []
        self.linked, self.place = 0, None

    def flush(self) -> None:
        if self.runs:
            text = _SPACE.sub(" ", entities.unescape("".join(self.runs))).strip()
            if text:
                _, path, apart, inside, part, heading, header, _ = self.place
                token = code(path, text)
                self.page.blocks.append(Block(path, text, token, min(self.linked, len(text)), apart, inside, part, heading, header))
                self.page.tokens.append(token)
        self.runs, self.linked, self.place = [], 0, None

    def put(self, text: str) -> None:
        if self.place is None:
            top = self.stack[-1]
            self.place = ("", self.stack[self.blocks[-1]][1], *top[2:])
        self.runs.append(text)
        if self.stack[-1][7]:
            self.linked += len(text.strip())

    def pop_to(self, i: int) -> None:
        if self.blocks[-1] >= i:
            self.flush()
        while len(self.stack) > i:
            tag, path, *_ = self.stack.pop()
            self.page.tokens.append(code("/", path))
            self.where[tag].pop()
            for held in (self.blocks, self.scopes):
                if held[-1] == len(self.stack):
                    held.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 for none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, tag: str) -> None:
        at = self.last((tag,))
        if at and (tag in BLOCK or at > self.blocks[-1]):
            self.pop_to(at)

    def open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.flush()
        closes = SAME_CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        if closes and (at := self.last(closes)) > self.scopes[-1]:
            self.pop_to(at)
        if tag in VOID:
            return
        _, path, apart, inside, part, heading, header, link = self.stack[-1]
        own, named = attributes(tag, attrs) if "=" in attrs or "hidden" in attrs.lower() else ("", False)
        path = code(path, tag, own)
        if tag in ("article", "main") and not named:
            inside = True
        elif tag not in ("html", "body"):
            apart = apart or named or tag in APART
        self.page.tokens.append(path)
        at = len(self.stack)
        self.stack.append((tag, path, apart, inside, part or tag in PART, heading or tag in HEADING, header or tag == "header", link or tag == "a"))
        self.where.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)


def read(source: str | None) -> Page:
    """Blocks and tokens of a page, with repairs for what is left open."""
    source = source or ""
    end, at, reader = len(source), 0, _Reader()
    final = {q: source.rfind(q) for q in "\"'"}
    while at < end:
        start = source.find("<", at)
        if start < 0:
            reader.put(source[at:])
            break
        if start > at:
            reader.put(source[at:start])
        if source.startswith("<!--", start):
            stop = source.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        slash = source.startswith("/", start + 1)
        name = _NAME.match(source, start + 1 + slash)
        if name is None:
            if source[start + 1 : start + 2] in ("!", "?", "/"):
                stop = source.find(">", start)
                at = end if stop < 0 else stop + 1
            else:
                reader.put("<")
                at = start + 1
            continue
        stop = name.end()
        # A tag ends at the first > outside of its values' quotes; where a quote is never closed, at the first > after it.
        while (m := _END.search(source, stop)) is not None and m[1]:
            if final[m[1]] < m.end():
                stop = source.find(">", m.end())
                break
            stop = source.find(m[1], m.end()) + 1
        else:
            stop = m.start() if m else -1
        tag = name[0].lower()
        at = end if stop < 0 else stop + 1
        if stop < 0:
            break
        if slash:
            reader.close(tag)
        elif tag == "br":
            if reader.runs:
                reader.runs.append(" ")
        elif tag in SKIPPED or tag in VERBATIM:
            shut = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if tag in VERBATIM:
                reader.open(tag, source[name.end() : stop])
                reader.put(entities.escape(source[at : shut.start() if shut else end]))
                reader.close(tag)
            else:
                reader.page.tokens.append(code(reader.stack[-1][1], tag))
            at = shut.end() if shut else end
        else:
            reader.open(tag, source[name.end() : stop])
    reader.flush()
    return reader.page


def template_tokens(page: Page, classes: list[list[int]]) -> set[int]:
    """The tokens of those classes that are ordered and nested on this page."""
    wanted = {t for tokens in classes for t in tokens}
    where: dict[int, list[int]] = {}
    for i, token in enumerate(page.tokens):
        if token in wanted:
            where.setdefault(token, []).append(i)
    spans: list[tuple[list[int], list[int]]] = []
    for tokens in classes:
        rows = [where.get(t) for t in tokens]
        if not all(rows) or len({len(r) for r in rows}) > 1:
            continue
        order = [i for rounds in zip(*rows, strict=True) for i in rounds]
        if order == sorted(order):
            spans.append((order, tokens))
    spans.sort(key=lambda s: s[0][0] - s[0][-1])
    valid: list[tuple[list[int], list[int]]] = []
    for order, tokens in spans:
        if all(_nested(order, outer, len(outer_tokens)) for outer, outer_tokens in valid):
            valid.append((order, tokens))
    return {t for _, tokens in valid for t in tokens}


def _nested(inner: list[int], outer: list[int], size: int) -> bool:
    """Whether the positions of a class keep to one slot of another in each of its rounds, or clear of it."""
    slots = np.searchsorted(np.array(outer), np.array(inner))
    inside = slots[(slots > 0) & (slots < len(outer))]
    return len(np.unique(inside % size)) <= 1


def main_text(page: Page, classes: list[list[int]], menus: set[int]) -> str:
    """What stays of a page when template, menus and whatever is set apart are gone."""
    template = template_tokens(page, classes) if classes else set()

    def kept(inside: bool, apart_counts: bool) -> list[str]:
        out = []
        for b in page.blocks:
            if inside and not b.inside or b.apart and apart_counts:
                continue
            if b.token in template and not (b.inside and b.part):
                continue
            if b.header and not (b.inside and b.heading) or not b.inside and b.path in menus:
                continue
            out.append(b.text)
        return out

    if any(b.inside for b in page.blocks):
        return "\n\n".join(kept(True, True) or kept(True, False))
    return "\n\n".join(kept(False, True))


TAG, TEXT, PATH = 0, 1, 2
_COUNT = [("kind", pa.int32()), ("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("linked", pa.int32())]
COUNTED = "host long, section long, page long, counts array<struct<kind:int,token:long,n:int,place:int,linked:int>>"


def _counts(page: Page) -> list[tuple[int, int, int, int, int]]:
    """Each token of a page with how often and where first it occurs, and each of its blocks' paths with their characters and linked ones."""
    texts = {b.token for b in page.blocks}
    seen: dict[int, list[int]] = {}
    for i, token in enumerate(page.tokens):
        if token in seen:
            seen[token][0] += 1
        else:
            seen[token] = [1, i]
    held: dict[int, list[int]] = {}
    for b in page.blocks:
        sizes = held.setdefault(b.path, [0, 0])
        sizes[0] += len(b.text)
        sizes[1] += b.linked
    return [(TEXT if t in texts else TAG, t, n, i, 0) for t, (n, i) in seen.items()] + [(PATH, p, n, 0, linked) for p, (n, linked) in held.items()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        pages, ends = [], [0]
        for source in batch.column(2).to_pylist():
            page = read(source)
            pages.append(xxh64_intdigest(np.array(page.tokens, np.int64).tobytes()) - (1 << 63))
            rows += _counts(page)
            ends.append(len(rows))
        flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(_COUNT), _COUNT, strict=True)], names=[n for n, _ in _COUNT])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["host", "section", "page", "counts"])


def templates(pages: DataFrame) -> DataFrame:
    """host, classes (their tokens in order), menus (paths): a row for each host or section that has any; ``pages`` has url and html.

    A page's counts travel as one row, of which a host keeps one for all copies.
    """
    prepare(pages.sparkSession)
    host, section = places_of(F.col("url"))
    source = pages.select(host.alias("host"), section.alias("section"), F.col("html").cast("string").alias("html"))
    found = source.mapInArrow(released(_counted), COUNTED)
    found = found.groupBy("host", "page").agg(F.first("counts").alias("counts"), F.collect_set("section").alias("sections"))
    # A copy in another section is another page there, and the same page of the host.
    found = found.select(F.explode(F.array_union(F.array("host"), "sections")).alias("host"), "page", "counts").select("host", "page", F.inline("counts"))
    found = found.groupBy("host", "kind", "token").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"),
        F.count("*").alias("support"),
        F.sum("n").alias("chars"),
        F.sum("linked").alias("linked"),
        F.avg("place").alias("place"),
    )
    found = cut(found.where(F.col("support") >= SUPPORT), "tokens")
    most = found.groupBy("host").agg(F.max("support").alias("pages"))
    found = found.join(most, "host").where(F.col("support") >= SHARE * F.col("pages"))
    classes = found.where(F.col("kind") != PATH).groupBy("host", "vector", "support").agg(F.max("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("rows"))
    classes = classes.where(F.col("kind") == TEXT).groupBy("host").agg(F.collect_list(F.col("rows.token")).alias("classes"))
    menus = found.where((F.col("kind") == PATH) & (F.col("linked") >= LINKED * F.col("chars"))).groupBy("host").agg(F.collect_list("token").alias("menus"))
    return classes.join(menus, "host", "full")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with one more column, the main text."""
    made = cut(templates(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))), "templates")
    key, part, classes, menus, more, others = ("_".join([name, x, *pages.columns]) for x in ("host", "section", "classes", "menus", "more", "others"))
    whole = made.select(F.col("host").alias(key), F.col("classes").alias(classes), F.col("menus").alias(menus))
    sections = made.select(F.col("host").alias(part), F.col("classes").alias(more), F.col("menus").alias(others))

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def run(batches):
            for batch in batches:
                rows = zip(*(c.to_pylist() for c in batch), strict=True)
                yield pa.array([main_text(read(source), found or [], set(paths or ())) for source, found, paths in rows], pa.string())

        yield from released(run)(batches)

    def both(one: str, other: str, kind: str) -> Column:
        return F.array_union(F.coalesce(one, F.array().cast(kind)), F.coalesce(other, F.array().cast(kind)))

    host, section = places_of(F.col(url_col))
    joined = pages.withColumn(key, host).withColumn(part, section).join(whole, key, "left").join(sections, part, "left")
    found = text(F.col(html_col).cast("string"), both(classes, more, "array<array<long>>"), both(menus, others, "array<long>"))
    return joined.withColumn(name, found).drop(key, part, classes, menus, more, others)
