"""Main text of web pages by a site style tree.

Each page is parsed to blocks of text, each under a style node: the chain of tags
and classes that leads to it. The trees of all pages of a site are merged; a site is a
host, or the hosts of few pages of one domain. What a
page shows in a branch is worth the less the more of the site's distinct pages show
the same there (entropy of contents over pages), and a branch whose layout differs
from page to page is worth more (entropy of its presentation styles). Importance is
summed from the leaves up over whole branches; a branch is noise if neither it nor
any branch below it reaches LOW, and is removed from each page.

Presentation also speaks before any statistics do. Branches that their tags, roles,
states or whole class names mark as menus, headers, footers, sidebars, notices, adverts,
forms or comments are of no importance, for such things may also differ from page to
page, or stand on a host's only page. If a page has an article or main element, its text
is what lies in it, and elements there without class or id are always content.
`marks=False` switches all of this off and leaves the decision to entropy alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import batches, materialize, small

#: Below LOW a branch is noise; weight of content against presentation; levels of the style tree (deeper elements count as the last).
LOW, CONTENT, DEPTH = 0.6, 0.9, 64
#: Hosts of fewer distinct pages tell little: they are merged with their like under the last two labels of their names.
PAGES = 16

# A quote that is never closed is a character like others, so its tag ends at the next bracket.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"]*+"|'[^']*+'|["'])*+)>""", re.DOTALL)
_ATTR = re.compile(r"""(?<![a-zA-Z\-])([a-zA-Z\-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without text of their own, whatever they hold.
MUTE = frozenset("head script style noscript template iframe object svg math canvas audio video textarea input".split())
SKIPPED = frozenset("form button select option nav footer aside dialog menu".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription comment comments replies respond disqus related recommended share sharing social widget toolbar masthead".split()
)
#: Elements that no class or id makes noise.
WHOLE = frozenset("html body main article".split())
#: Start tags that end an open paragraph, and those that end an open one of their group.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = [frozenset(x.split()) for x in ("li", "dt dd", "tr", "td th", "option", "thead tbody tfoot")]
_SCOPE = frozenset("ul ol table dl article section div main body".split())


def _noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether tag, role or state make a branch noise."""
    if tag in SKIPPED or (tag == "header" and not inside) or attrs.get("role") in SKIPPED_ROLES:
        return True
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def _noise_name(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether a whole class or id makes a branch noise; names that merely contain such a word are left to the style tree."""
    if tag in WHOLE:
        return False
    names = set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())
    return bool(names & NOISE) or (not inside and "header" in names)


class Block(NamedTuple):
    """plain: in article or main, with no class or id below it; marked: of no importance by its presentation."""

    node: int
    text: str
    plain: bool
    marked: bool


class Open(NamedTuple):
    """An open element. skipped: 0 no, 1 by name, 2 by tag, role or state, 3 without text; up: the nodes above."""

    tag: str
    node: int
    up: tuple[int, ...]
    skipped: int
    inside: bool
    styled: bool


def parse(page: str | None, marks: bool = True) -> tuple[list[Block], dict[int, tuple[tuple[int, ...], str]]]:
    """Blocks in page order, and for each style node (nodes above it, layout: its child tags).

    An outermost article or main is read also within a branch that only its class
    or id marks as noise.
    """
    page = page or ""
    root = Open("", 0, (), 0, False, False)
    stack: list[Open] = []
    blocks: list[tuple[Block, bool]] = []
    tree: dict[int, tuple[tuple[int, ...], list[str]]] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                top = next((s for s in reversed(stack) if s.tag not in INLINE), root)
                tree.setdefault(top.node, (top.up, []))
                blocks.append((Block(top.node, joined, marks and top.inside and not top.styled, marks and top.skipped > 0), top.inside))

    def close(n: int) -> None:
        if any(s.tag not in INLINE for s in stack[n:]):
            flush()
        del stack[n:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1].skipped == 3):
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].tag == tag:
                    close(n)
                    break
            continue
        if tag in CLOSES_P:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].tag == "p":
                    close(n)
                    break
                if stack[n].tag not in INLINE:
                    break
        for group in SIBLINGS:
            if tag in group:
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n].tag in group:
                        close(n)
                        break
                    if stack[n].tag in _SCOPE:
                        break
        if tag not in INLINE:
            flush()
        elif tag == "br" and not (stack and stack[-1].skipped == 3):
            text.append(" ")
        attrs = {a.lower(): html.unescape(b or c or d) for a, b, c, d in _ATTR.findall(m[3])} if m[3] else {}
        if re.search(r"(?:^|\s)hidden(?:\s|$|=|/)", m[3]):
            attrs["hidden"] = ""
        parent = stack[-1] if stack else root
        main = tag in ("article", "main") or attrs.get("role") in ("main", "article")
        inside = parent.inside or main
        skipped = 0 if main and not parent.inside and parent.skipped == 1 else parent.skipped
        if skipped < 2 and marks:
            if _noise(tag, attrs, inside):
                skipped = 2
            elif not skipped and not main and _noise_name(tag, attrs, inside):
                skipped = 1
        if tag in INLINE and skipped > parent.skipped:
            skipped = 3  # within a block of text: the rest of the block stays together
        if tag in MUTE:
            skipped = 3
        if tag in RAW and tag not in VOID:
            shut = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, at)
            at = shut.start() if shut else end
            skipped = 3
        if tag in VOID:
            continue
        name = _DIGITS.sub("#", " ".join(filter(None, (attrs.get("class"), attrs.get("id")))))
        node, up = parent.node, parent.up
        if tag not in INLINE and skipped < 3:
            tree.setdefault(parent.node, (parent.up, []))[1].append(tag)
            if len(up) < DEPTH:
                node, up = _long(f"{parent.node}/{tag}.{name}"), (*up, parent.node)
        stack.append(Open(tag, node, up, skipped, inside, parent.styled or (inside and not main and bool(name))))
    close(0)
    flush()
    scoped = marks and any(inside and not b.marked for b, inside in blocks)
    return [b._replace(marked=b.marked or (scoped and not inside)) for b, inside in blocks], {k: (up, " ".join(v)) for k, (up, v) in tree.items()}


_HOST = re.compile(r"://([^/?#]*)")
_PARSED = "page_id long, url string, host long, domain long, page_key long, blocks array<struct<node:long,text:string,plain:boolean,marked:boolean,content:long>>, tree array<struct<node:long,up:array<long>,style:long>>"
_BLOCK = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string()), ("plain", pa.bool_()), ("marked", pa.bool_()), ("content", pa.int64())]))
_TREE = pa.list_(pa.struct([("node", pa.int64()), ("up", pa.list_(pa.int64())), ("style", pa.int64())]))


def _long(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def _parse_all(marks: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            hosts, domains, keys, blocks, trees = [], [], [], [], []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m = _HOST.search(url or "")
                found, tree = parse(page, marks)
                host = m[1].lower() if m else ""
                hosts.append(_long(host))
                domains.append(_long("." + ".".join(host.split(".")[-2:])))
                keys.append(_long("\n".join([x.text for x in found if not x.marked] or [x.text for x in found])))
                blocks.append([{"node": x.node, "text": None if x.marked else x.text, "plain": x.plain, "marked": x.marked, "content": _long(x.text)} for x in found])
                trees.append([{"node": n, "up": list(up), "style": _long(s)} for n, (up, s) in tree.items()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hosts, pa.int64()), pa.array(domains, pa.int64()), pa.array(keys, pa.int64()), pa.array(blocks, _BLOCK), pa.array(trees, _TREE)],
                names=["page_id", "url", "host", "domain", "page_key", "blocks", "tree"],
            )

    return run


def sited(parsed: DataFrame) -> DataFrame:
    """`parsed` with the site of each page: its host if that has PAGES distinct pages, else its domain."""
    large = parsed.groupBy("host").agg(F.count_distinct("page_key").alias("pages")).where(F.col("pages") >= PAGES)
    large = materialize(large.select("host", F.lit(True).alias("large")), "hosts")
    return parsed.join(small(large), "host", "left").withColumn("site", F.when(F.col("large"), F.col("host")).otherwise(F.col("domain"))).drop("large")


def importance(parsed: DataFrame) -> DataFrame:
    """(site, node, up, importance) of each style node, over the distinct pages of its site.

    Content: of all that pages show in the branch, the mean of 1 - log(k) / log(pages), k being
    the pages that show the same there. Presentation: the entropy of the layouts, to the base
    of the site's pages. On a site's only page all content counts as its own. A site may hold any share
    of the pages: all is counted by partial aggregates.
    """
    pages = parsed.groupBy("site").agg(F.count_distinct("page_key").alias("pages"))
    bits = lambda k: F.when(F.col("pages") > 1, F.log(k) / F.log("pages")).otherwise(0.0)
    seen = parsed.select("site", "page_key", F.explode("blocks").alias("b")).select("site", "page_key", "b.node", "b.content").distinct()
    contents = seen.groupBy("site", "node", "content").agg(F.count(F.lit(1)).alias("k")).join(pages, "site")
    leaves = contents.groupBy("site", "node").agg(F.sum("k").alias("shown"), F.sum(F.col("k") * (1 - bits("k"))).alias("worth"))
    nodes = parsed.select("site", "page_key", F.explode("tree").alias("t")).select("site", "page_key", "t.node", "t.up", "t.style").distinct()
    layouts = nodes.groupBy("site", "node", "up", "style").agg(F.count(F.lit(1)).alias("k"))
    share = layouts.join(pages, "site").withColumn("p", F.col("k") / F.col("pages"))
    styles = share.groupBy("site", "node", "up").agg(F.sum(-F.col("p") * bits("p")).alias("styles"))
    branch = F.explode(F.concat("up", F.array("node"))).alias("node")
    content = leaves.join(styles, ["site", "node"]).select("site", branch, "shown", "worth").groupBy("site", "node").agg((F.sum("worth") / F.sum("shown")).alias("content"))
    return styles.join(content, ["site", "node"]).select("site", "node", "up", (CONTENT * F.col("content") + (1 - CONTENT) * F.least("styles", F.lit(1.0))).alias("importance"))


def noise_nodes(parsed: DataFrame) -> DataFrame:
    """(site, node): the nodes that neither themselves nor below reach LOW."""
    branch = F.explode(F.concat("up", F.array("node"))).alias("node")
    best = importance(parsed).select("site", branch, "importance").groupBy("site", "node").agg(F.max("importance").alias("best"))
    return best.where(F.col("best") < LOW).select("site", "node")


def parsed_pages(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(page_id, url, host, domain, page_key, blocks, tree) of each row of `pages`."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(_parse_all(marks), _PARSED)


def extract(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages` (page_id, url, html).

    Blocks are joined by a line feed; white space within is one space. Null and
    empty html gives an empty text; pages without a host are one site. Repeated rows are
    returned as often; other columns are not read. Very long pages are read whole. `marks`: whether
    presentation alone may mark a branch as noise or content (see above).
    """
    parsed = sited(materialize(parsed_pages(pages, marks).withColumn("row", F.monotonically_increasing_id()), "parsed"))
    noise = materialize(noise_nodes(parsed), "noise")
    open_to_doubt = F.filter("blocks", lambda b: ~b["plain"] & ~b["marked"])
    asked = parsed.select("row", "site", F.explode(F.array_distinct(F.transform(open_to_doubt, lambda b: b["node"]))).alias("node"))
    hits = materialize(asked.join(small(noise), ["site", "node"]).groupBy("row").agg(F.collect_set("node").alias("gone")), "gone")
    kept = F.filter("blocks", lambda b: ~b["marked"] & (b["plain"] | ~F.coalesce(F.array_contains("gone", b["node"]), F.lit(False))))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    joined = parsed.join(small(hits, F.size("gone") * 8 + 16), "row", "left")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
