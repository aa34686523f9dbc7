"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags with the path of elements they stand in, and its texts with theirs.
Over all distinct pages of a host a token has an occurrence vector, how often it occurs on each page.
Tokens of equal vectors are one class. A class is valid if it has several tokens, each at most once on
a page, and stands on most distinct pages of its host, three at least. Its tokens are ordered by their places,
summed over those pages.

On a page the valid classes are nested to its template: a class whose tokens stand in another order than the
class has is not valid there, and of two that overlap without one lying in a gap of the other the one on
fewer pages is not. What stands between neighbouring tokens of the nested classes are the slots, and the
main text is what the slots hold: inside an article on pages that have one, anywhere in the body on others.
A heading of the template stays where the slots that it is set over hold a text other than links.

Texts inside elements for menus, headers, footers, sidebars, notices, adverts, forms or comments are not
main text, whatever the template. These are told by element name, role, or a class that is as a whole such a
name or is made of such words and words of layout only (``share-bar``, not ``share-price``); ids count so on
containers, inside an article only a few whole ones. Inside headings and paragraphs only a whole class
counts.

Pages of one sequence of texts are one page, and so are near copies (``near_dedup``: three quarters of
their shingles in common), so that copies cannot make a template of what they say; pages that share
that much by their template alone are taken for copies too and keep their texts. Near copies are only
looked for on hosts where a text would be template without.

An occurrence vector is summed as two halves of a hash of (page, count), so that no list of pages is
gathered anywhere; sums are combined before the shuffle, which keeps a hot host light. A template
has at most twice as many tokens as a page, and is joined to the pages by Spark's choice of join.

Edge cases: null or empty html gives an empty text; a page without a host, or whose host has
fewer than three distinct pages, has an empty template; unclosed and misnested tags are closed by the
next block or by the end of an outer element. A page is read in time and memory linear in its length, however
deep its elements are nested; one page is held in one task. Repeated rows have a row each. An empty table gives an
empty one. Columns named like its own keep their names and values, but for ``text``, which is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm.columns import apart
from lagwise.llm.near_dedup import near_duplicates
from lagwise.session import materialize

# Kinds of elements.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = {"article", "main"}
LEFT_OUT = set(
    "nav header footer aside form head title button select textarea noscript template svg iframe canvas object menu dialog input".split()
)
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
LEFT_OUT_WORDS = set(
    "nav navbar navigation menu sidebar footer breadcrumb breadcrumbs ad ads advert adverts advertisement sponsor sponsored promo banner "
    "cookie cookies consent notice popup modal newsletter subscribe signup share sharing social related recommended comment comments reply "
    "replies disqus widget toolbar pagination pager login search".split()
)
LEFT_OUT_NAMES = {"header", "site-header", "page-header", "masthead", "topbar", "site-title"}
#: Words that say where something stands or what holds it; with the words above they make a name.
LAYOUT_WORDS = set(
    "area articles article bar block body bottom box button buttons container content entry form group holder icons inner item items left link "
    "links list main outer page panel post posts region right row section site slot stories top unit widget widgets wrap wrapper".split()
)
#: Elements that made-up names can tell; others only by a whole class.
CONTAINERS = set("div section ul ol dl table details fieldset center".split())
#: Elements whose id is made from their own words as often as not.
WORDED = set("h1 h2 h3 h4 h5 h6 p pre code figcaption summary a span".split())
#: Whole ids that leave out a container inside an article, where ids are made from headings.
LEFT_OUT_IDS_INSIDE = set("navbar sidebar footer breadcrumb breadcrumbs newsletter subscribe comments disqus".split())
LISTS = {"ul", "ol", "dl", "table"} | CONTENT
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Element(NamedTuple):
    tag: str
    path: int
    left_out: bool
    content: bool


class Block(NamedTuple):
    """A text with the number of the path it stands in."""

    text: str
    path: int
    left_out: bool
    content: bool
    level: int  # of a heading, else 0
    linked: bool  # nothing but links

    def token(self) -> int:
        return number(f"{self.path}#{self.text}")


class Place(NamedTuple):
    """A token's class, its place in it and the pages that have it."""

    kind: int
    place: int
    support: int


def number(token: str) -> int:
    """Signed 64-bit number of a token."""
    value = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id is such a name, or is made of such words and words of layout alone."""
    if name in LEFT_OUT_NAMES or name in LEFT_OUT_WORDS:
        return True
    parts = {p for p in re.split(r"[-_]+", name) if p and not p[0].isdigit()}
    return not LEFT_OUT_WORDS.isdisjoint(parts) and parts <= LEFT_OUT_WORDS | LAYOUT_WORDS


def _named_left_out(tag: str, attributes: dict[str, str], inside: bool, worded: bool, listing: bool) -> bool:
    """Whether attributes tell that an element is not main text; ``inside`` an article, a ``worded`` element, a ``listing``."""
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    if "hidden" in attributes or attributes.get("role", "").lower() in LEFT_OUT_ROLES or attributes.get("aria-hidden") == "true":
        return True
    names = attributes.get("class", "").lower().split()
    ids = attributes.get("id", "").lower().split()
    if listing:
        return False  # a comment in a listing, say, has that class
    if worded or tag in WORDED:
        return any(n in LEFT_OUT_NAMES or n in LEFT_OUT_WORDS for n in names)
    if inside:
        if any(n in LEFT_OUT_IDS_INSIDE for n in ids):
            return True
    else:
        names += ids
    if tag not in CONTAINERS:
        return any(n in LEFT_OUT_NAMES or n in LEFT_OUT_WORDS for n in names)
    return any(_names_boilerplate(n) for n in names)


def _marks(page: str) -> Iterator[re.Match]:
    """Tags, comments and scripts of a page in order."""
    last, at = page.rfind(">"), 0
    while (at := page.find("<", at)) >= 0:
        if at > last and (at := page.find("<!--", at)) < 0:
            return  # no tag ends any more
        mark = _MARK.match(page, at)
        if mark:
            yield mark
        at = mark.end() if mark else at + 1


def walk(page: str | None) -> Iterator[str | Block]:
    """Tags of blocks (number of the path above and name) and texts of a page, in order."""
    stack: list[Element] = [Element("", 0, False, False)]
    places: dict[str, list[int]] = {}  # of the open elements of each name
    held: list[str] = []
    unlinked = False

    def is_open(names) -> bool:
        return any(places.get(n) for n in names)

    def end_block() -> Iterator[Block]:
        nonlocal unlinked
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            top = stack[-1]
            level = next((k for k in range(1, 7) if places.get(f"h{k}")), 0)
            yield Block(text, top.path, top.left_out, top.content, level, not unlinked)
        held.clear()
        unlinked = False

    def close(names, within) -> None:
        """Close the innermost element of these names, unless one of ``within`` stands in it."""
        at = max((places[n][-1] for n in names if places.get(n)), default=0)
        if at and at > max((places[n][-1] for n in within if places.get(n)), default=0):
            for element in stack[at:]:
                places[element.tag].pop()
            del stack[at:]

    def take(text: str) -> None:
        nonlocal unlinked
        if text and not stack[-1].left_out:
            held.append(entities.unescape(text))
            unlinked |= not places.get("a") and not text.isspace()

    page = page or ""
    at = 0
    for mark in _marks(page):
        take(page[at : mark.start()])
        at = mark.end()
        tag = (mark[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            yield from end_block()
        if mark[2]:
            close((tag,), () if tag in BLOCKS else BLOCKS)
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if tag == "body":
            close(("head",), ())
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], LISTS)
        elif tag in BLOCKS:
            close(("p",), BLOCKS - {"p"})
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(mark[4])} if mark[4] else {}
        above = stack[-1]
        left_out = above.left_out or tag in LEFT_OUT
        if attributes and not left_out:
            left_out = _named_left_out(tag, attributes, above.content, is_open(WORDED), is_open(("pre", "code")))
        path = above.path
        if tag in BLOCKS:
            key = f"{path}/{tag}" + "".join(f".{c}" for c in attributes.get("class", "").split())
            path = number(key)
            yield key
        places.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, path, left_out, above.content or tag in CONTENT))
    take(page[at:])
    yield from end_block()


def read(page: str | None) -> tuple[list[Block], Counter]:
    """Blocks of text of a page in order, and how often each tag token occurs."""
    blocks, tags = [], Counter()
    for item in walk(page):
        if isinstance(item, Block):
            blocks.append(item)
        else:
            tags[item] += 1
    return blocks, tags


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _key(blocks: list[Block]) -> int:
    """Number of a page's sequence of blocks."""
    return number(" ".join(str(b.token()) for b in blocks))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page (host, html): host, key, an order among pages of one key, and its tokens."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("path", pa.string()), ("n", pa.int32()), ("at", pa.int32())]))
    for batch in batches:
        keys, orders, tokens = [], [], []
        for html in batch.column(1).to_pylist():
            counts, blocks = {}, []
            for at, item in enumerate(walk(html)):
                if isinstance(item, Block):
                    blocks.append(item)
                    if item.left_out:
                        continue
                path = None if isinstance(item, Block) else item
                token = number(path) if path else item.token()
                counts.setdefault(token, {"token": token, "path": path, "n": 0, "at": at})["n"] += 1
            keys.append(_key(blocks))
            orders.append(number(" ".join(f"{t} {c['n']} {c['at']}" for t, c in sorted(counts.items()))))
            tokens.append(list(counts.values()))
        arrays = [batch.column(0), pa.array(keys, type=pa.int64()), pa.array(orders, type=pa.int64()), pa.array(tokens, type=kind)]
        yield pa.record_batch(arrays, names=["host", "key", "order", "tokens"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a batch: halves of the summed vector, pages, most on a page, summed places."""
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for host, page, tokens in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for t in tokens:
                hashed = xxhash.xxh64_intdigest(f"{page} {t['n']}".encode())
                seen = found.setdefault((host, t["token"]), [t["path"], 0, 0, 0, 0, 0])
                seen[1] += hashed >> 32
                seen[2] += hashed & 0xFFFFFFFF
                seen[3] += 1
                seen[4] = max(seen[4], t["n"])
                seen[5] += t["at"]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        rows = [(*key, *value) for key, value in found.items()]
        names = ["host", "token", "path", "high", "low", "pages", "most", "place"]
        yield pa.record_batch([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page (host, html): host, key and the text of its blocks."""
    for batch in batches:
        pages = [read(html)[0] for html in batch.column(1).to_pylist()]
        texts = pa.array(["\n".join(b.text for b in blocks) for blocks in pages], type=pa.string())
        yield pa.record_batch([batch.column(0), pa.array([_key(blocks) for blocks in pages], type=pa.int64()), texts], names=["host", "key", "text"])


def _distinct(rows: DataFrame) -> DataFrame:
    """host, key and tokens of each distinct page of a host."""
    read_rows = rows.mapInArrow(_tokens, "host string, key long, order long, tokens array<struct<token:long,path:string,n:int,at:int>>")
    return read_rows.groupBy("host", "key").agg(F.min_by("tokens", "order").alias("tokens"))


def _valid(pages: DataFrame, share: float, least: int) -> DataFrame:
    """Valid classes over pages (host, key, tokens) that are all distinct."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    stats = (
        pages.mapInArrow(_occurrences, "host string, token long, path string, high long, low long, pages long, most long, place long")
        .groupBy("host", "token")
        .agg(F.max("path").alias("path"), *[F.sum(c).alias(c) for c in ("high", "low", "pages", "place")], F.max("most").alias("most"))
        .where((F.col("most") == 1) & (F.col("pages") >= least))
        .join(sizes, "host").where(F.col("pages") > F.col("size") * share)
    )
    several = stats.groupBy("host", "high", "low").agg(F.count("*").alias("tokens")).where("tokens > 1")
    return stats.join(several, ["host", "high", "low"], "left_semi").select("host", "high", "low", "token", "path", "place", F.col("pages").alias("support"))


def classes(pages: DataFrame, html: str = "html", url: str = "url", share: float = 0.5, least: int = 3) -> DataFrame:
    """Tokens of the valid classes: host, class (two halves), token, path (of a tag), place in the class and support.

    Hosts whose classes hold a text are counted again with one page of each group of near copies.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).where("host IS NOT NULL")
    distinct = materialize(_distinct(rows), "page-tokens")
    found = materialize(_valid(distinct, share, least), "classes")
    hosts = found.where("path IS NULL").select("host").distinct()
    if hosts.isEmpty():
        return found
    rows = rows.join(hosts, "host", "left_semi")
    texts = rows.mapInArrow(_texts, "host string, key long, text string").groupBy("host", "key").agg(F.min("text").alias("text"))
    texts = materialize(texts.withColumn("doc_id", F.xxhash64("host", "key")), "page-texts")
    groups = near_duplicates(texts.select("doc_id", "text")).select("doc_id", "component_id")
    first = texts.join(groups, "doc_id").groupBy("host", "component_id").agg(F.min("key").alias("key")).select("host", "key")
    again = _valid(distinct.join(first, ["host", "key"], "left_semi"), share, least)
    return found.join(hosts, "host", "left_anti").select(*found.columns).union(materialize(again, "classes"))


def templates(pages: DataFrame, **settings) -> DataFrame:
    """host, tokens: the valid classes of each host as its tokens with their class, place and support."""
    token = F.struct("token", F.xxhash64("high", "low").alias("kind"), "place", "support")
    return classes(pages, **settings).groupBy("host").agg(F.sort_array(F.collect_set(token)).alias("_tokens"))


def nested(tokens: list[int], template: dict[int, Place]) -> list[int]:
    """Places of a page's tokens that belong to classes that are in order on the page and nest."""
    found: dict[int, list[int]] = {}
    for at, token in enumerate(tokens):
        if token in template:
            found.setdefault(template[token].kind, []).append(at)
    spans = []
    for kind, own in found.items():
        order = [template[tokens[at]].place for at in own]
        if all(x < y for x, y in zip(order, order[1:])):  # a token that stands twice breaks the order as well
            spans.append((own[0], -own[-1], template[tokens[own[0]]].support, kind))
    kept, around = set(), []
    for span in sorted(spans):
        start, end, support, kind = span[0], -span[1], span[2], span[3]
        while around and around[-1][0] < start:
            around.pop()
        outer = len(around)  # spans around this place end one after another, so those that it crosses are the innermost
        while outer and around[outer - 1][0] < end:
            outer -= 1
        if any(a[1] >= support for a in around[outer:]):
            continue
        kept.difference_update(a[2] for a in around[outer:])
        del around[outer:]
        kept.add(kind)
        around.append((end, support, kind))
    return sorted(at for kind in kept for at in found[kind])


def main_text(page: str | None, template: dict[int, Place]) -> str:
    """Texts in the slots of a page that are main text, one per line."""
    items = [item for item in walk(page) if not isinstance(item, Block) or not item.left_out]
    template = dict(template)
    fixed = set(nested([item.token() if isinstance(item, Block) else number(item) for item in items], template)) if template else set()
    inside = any(isinstance(item, Block) and item.content for item in items)
    texts: list[str] = []
    filled = [False] * 7  # whether a text stands behind, before the next heading of that level or a higher one
    for at in range(len(items) - 1, -1, -1):
        block = items[at]
        if not isinstance(block, Block) or (inside and not block.content):
            continue
        if at not in fixed or (block.level and filled[block.level]):
            texts.append(block.text)
        if block.level:
            # a heading ends the sections of its level and below; to those above it is part of what they hold
            filled[block.level :] = [False] * (7 - block.level)
        elif at not in fixed and not block.linked:
            filled = [True] * 7
    return "\n".join(reversed(texts))


def extracted(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text", share: float = 0.5, least: int = 3) -> DataFrame:
    """``pages`` with their main text; a column of that name is replaced."""
    pages, restore = apart(pages.drop(text), "_host", "_tokens")
    found = templates(pages, html=html, url=url, share=share, least=least)
    joined = pages.withColumn("_host", host_of(F.col(url))).join(found.withColumnRenamed("host", "_host"), "_host", "left").drop("_host")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, known = [], {}
            for page, tokens in zip(batch.column(names.index(html)).to_pylist(), batch.column(names.index("_tokens")).to_pylist()):
                key = tuple(t["token"] for t in tokens or ())
                if key not in known:
                    known[key] = {t["token"]: Place(t["kind"], t["place"], t["support"]) for t in tokens or ()}
                texts.append(main_text(page, known[key]))
            kept = [(n, c) for n, c in zip(names, batch.columns) if n != "_tokens"]
            yield pa.record_batch([*[c for _, c in kept], pa.array(texts, type=pa.string())], names=[*[n for n, _ in kept], text])

    return restore(joined.select(*pages.columns, "_tokens").mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())])))
