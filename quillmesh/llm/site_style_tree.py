"""Main-text extraction with a site style tree.

Pass 1 parses every page and emits, for each style node (the chain of tags with their class, id
and role from the root), a hash of its presentation (the sequence of child styles), a hash of its
content (all text below it) and the length of that text.  Spark merges the pages of a host into the
host's style tree: the importance of a node is the mean of the normalised entropies of its
presentations and of its contents over the pages that hold it.  What the markup declares as page
furniture (menus, headers, footers, sidebars, notices, adverts), and what stands beside an article,
goes unless it is more important than the host's content branch, the most important of the other
nodes that hold ``BRANCH`` of the text; any other branch goes where its contents hardly vary.  So
the tree decides and the names only move the bar.  Pass 2 parses the pages again without the unimportant branches.  Scripts, form
controls, hidden elements and reader comments go by what they are: comments vary like articles.

Pages of a host with the same style nodes and contents count once, so copies carry no weight.
Hosts of fewer than ``OWN_PAGES`` distinct pages are merged into one tree.  Where even that has fewer
than ``MIN_PAGES`` there is no evidence: declared furniture goes, and so does what is beside an article.  Sums run over (host, node, hash)
keys, so the rows of a hot host spread by content and are pre-aggregated before the shuffle.  The
table of verdicts is broadcast only while its counted rows stay under ``BROADCAST_NODES``;
otherwise the pages are joined by host.

Both parses are linear in the page's length: no token is scanned twice, and elements nested deeper
than ``MAX_DEPTH`` belong to their ancestor at that depth, with all of their text.

Nulls and edges: null or empty html gives empty text; a null url is a host of its own; repeated
page ids are separate rows; an empty table gives an empty result; only the three named columns are
read.  A page whose text would vanish by importance alone keeps it.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, ship

#: Distinct pages that a verdict needs, and those that a host needs for a tree of its own.
MIN_PAGES, OWN_PAGES = 5, 20
#: Share of the content's entropy in a node's importance; the rest is the presentation's.
CONTENT_WEIGHT = 0.5
#: Share of a host's text that a node holds to count as its content branch.
BRANCH = 0.25
#: An undeclared node of more uniform content than this goes (entropies, nine parts of content to one of presentation).
UNIFORM, UNIFORM_WEIGHT = 0.3, 0.9
#: Verdicts that may be broadcast (16 bytes each and the host's name).
BROADCAST_NODES = 200_000
#: Depth from which elements are part of their ancestor; browsers draw the line there too.
MAX_DEPTH = 512

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not markup; the first group isn't text of the page either.
RAW = frozenset("script style noscript template iframe textarea title svg math object select option xmp noembed noframes".split())
#: Elements that are controls or media, and so never text of an article.
CONTROLS = frozenset("form button dialog head fieldset label datalist canvas audio video map".split())
#: Elements that are declared page furniture.
FURNITURE = frozenset("nav footer aside menu".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that close an open paragraph.
CLOSES_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption col colgroup body head html link option optgroup title".split())
#: Open elements that a start tag of the same family closes.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where the search for an open element to close ends.
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
SECTIONS = frozenset("html body article main section div aside nav header footer table td th form blockquote ul ol dl figure".split())

#: Words of class, id and role values that declare page furniture.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead topbar toolbar "
    "share sharing social follow subscribe newsletter signup login related recommended "
    "pagination pager skip search contentinfo complementary copyright disclaimer".split()
)
HEADERS = frozenset("header siteheader pageheader".split())
#: Words that declare reader comments, or something that isn't shown.
UNREAD = frozenset("comment comments reply replies respond discussion disqus hidden".split())

#: Every alternative ends at once where it fails: possessive repeats never go back.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+(?=[\s/>"']|$)""", re.I)
NAME = re.compile(r"[a-z]+")
#: Class words that tell of a layout with or without furniture, not of furniture.
LAYOUT = re.compile(r"(?:no|has|have|with|without|is|not|js|hide|show)-")


class Verdicts(NamedTuple):
    """Style nodes of a host that go, and what stays though it is declared furniture or beside an article."""

    low: frozenset[int]
    cleared: frozenset[int]


class Node:
    """An element: its style (``path``), what its markup says of it, and its texts and children in order.

    ``None`` among the items begins or ends a block.
    """

    __slots__ = ("tag", "label", "path", "parent", "declared", "unread", "article", "holds", "plain", "items")

    def __init__(self, tag: str, label: str, path: int, parent: Node | None) -> None:
        self.tag, self.label, self.path, self.parent = tag, label, path, parent
        self.declared = self.unread = self.article = self.holds = self.plain = False
        self.items: list[str | Node | None] = []


def _hash(text: str) -> int:
    """64 bits of a string, the same on every machine."""
    raw = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1], 0x9E3779B9)) - (1 << 63)


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """Label suffix of an element, whether its attributes declare furniture, and whether nobody reads it as text."""
    found = {m[1].lower(): next((x for x in (m[2], m[3], m[4]) if x is not None), "") for m in ATTR.finditer(raw)}
    names = " ".join(found[k].lower() for k in ("class", "id", "role") if k in found)
    tokens = names.replace("_", "-").split()
    parts = {t for token in tokens if not LAYOUT.match(token) for t in (token, *NAME.findall(token))}
    unread = bool(parts & UNREAD) or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    unread |= "display:none" in found.get("style", "").replace(" ", "").lower()
    return ("." + ".".join(NAME.findall(names)) if names else ""), bool(parts & MARKED) or bool(parts & HEADERS) and "h1" not in parts, unread


def parse(page: str) -> Node:
    """The page's elements as a tree; the root has no tag."""
    root = Node("", "", 0, None)
    stack = [root]
    count: dict[str, int] = {}  # open elements of each tag
    beyond: dict[str, int] = {}  # those below MAX_DEPTH
    known: dict[tuple[int, str], int] = {}
    seen: dict[str, tuple[str, bool, bool]] = {}
    at, end = 0, len(page)

    def close(k: int) -> None:
        for node in stack[k:]:
            count[node.tag] -= 1
        del stack[k:]

    def close_open(tags: tuple[str, ...], barriers: frozenset[str] | set[str] | tuple, last: str = "") -> None:
        if any(count.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    done = stack[k].tag != last
                    close(k)
                    if done:
                        return
                elif stack[k].tag in barriers:
                    return

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", m.start()):
                stack[-1].items.append(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            if beyond.get(tag):
                beyond[tag] -= 1
            elif count.get(tag):
                limit = SECTIONS if tag not in BLOCKS or tag == "p" else ()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in limit:
                        break
            if tag in BLOCKS:
                stack[-1].items.append(None)
            continue
        if tag in CLOSES_P:
            close_open(("p",), SECTIONS)
        if tag in SAME:
            close_open(SAME[tag], BARRIERS[tag], "" if tag != "tr" else "td")
            if tag == "tr":
                close_open(("tr",), BARRIERS[tag])
        if tag == "body":
            close(next((k for k, n in enumerate(stack) if n.tag not in ("", "html")), len(stack)))
        if tag in RAW:
            if not raw.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if tag in BLOCKS:
            stack[-1].items.append(None)
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            continue
        if len(stack) > MAX_DEPTH:
            beyond[tag] = beyond.get(tag, 0) + 1
            continue
        if raw:
            if raw not in seen:
                seen[raw] = _attributes(raw)
            suffix, declared, unread = seen[raw]
        else:
            suffix, declared, unread = "", False, False
        up = stack[-1]
        key = (up.path, tag + suffix)
        path = known.get(key)
        if path is None:
            path = known[key] = _hash(f"{up.path}/{key[1]}")
        node = Node(tag, key[1], path, up)
        node.article = up.article or tag in ("article", "main")
        node.plain = not suffix
        if tag not in ("html", "body"):
            node.unread = unread or tag in CONTROLS
            node.declared = tag in FURNITURE or tag == "header" and not up.article or declared and tag != "main"
        if node.article and not up.article:
            above: Node | None = up
            while above and not above.holds:
                above.holds, above = True, above.parent
        up.items.append(node)
        stack.append(node)
        count[tag] = count.get(tag, 0) + 1
    return root


def _suspect(node: Node, root: Node) -> bool:
    """Declared furniture, or beside the page's article."""
    return node.declared or root.holds and not node.article and not node.holds


class Style(NamedTuple):
    """A style node of one page."""

    node: int
    suspect: bool
    shown: int
    held: int
    size: int


def style_nodes(page: str) -> list[Style]:
    """Presentation, content and length of text of every style node of a page, furniture of comments left out."""
    shown: dict[int, list[str]] = {}
    held: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    suspect: dict[int, bool] = {}
    root = parse(page)
    inner: dict[int, tuple[list[int], int]] = {}  # of an element: hashes of what it holds, length
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo += [(x, False) for x in node.items if isinstance(x, Node) and not x.unread]
            continue
        marks, n, labels = [], 0, shown.setdefault(node.path, [])
        for x in node.items:
            if isinstance(x, str):
                if text := x.strip():
                    marks.append(_hash(text))
                    n += len(text)
            elif x is not None and not x.unread:
                below, length = inner.pop(id(x))
                marks.append(below)
                n += length
                if not labels or labels[-1] != x.label:
                    labels.append(x.label)
        own = _hash(repr(marks)) if marks else 0
        inner[id(node)] = own, n
        held.setdefault(node.path, []).append(own)
        size[node.path] = size.get(node.path, 0) + n
        suspect[node.path] = _suspect(node, root) or bool(suspect.get(node.path))
    return [Style(p, suspect[p], _hash("|".join(labels)), _hash(repr([x for x in held[p] if x])), size[p]) for p, labels in shown.items() if p]


def _clean(run: str) -> str:
    return " ".join((entities.unescape(run) if "&" in run else run).split())


def main_text(page: str | None, verdicts: Verdicts | None = None) -> str:
    """The article's text by the verdicts of the site's style tree; without any, declared furniture goes.

    Where the names of classes and ids would leave nothing, only tags and verdicts decide.
    """
    if not page:
        return ""
    root = parse(page)
    return _main_text(root, verdicts, True) or _main_text(root, verdicts, False)


def _main_text(root: Node, verdicts: Verdicts | None, by_name: bool) -> str:
    found: list[tuple[bool, bool, str]] = []  # article's text, of low importance, text of a block
    run: list[str] = []
    state = (False, False)

    def flush() -> None:
        if run:
            if text := _clean("".join(run)):
                found.append((*state, text))
            run.clear()

    def goes(node: Node) -> bool:
        if node.unread and (by_name or node.tag in CONTROLS):
            return True
        if verdicts is None:
            return node.declared and (by_name or node.tag in FURNITURE or node.tag == "header")
        return _suspect(node, root) and node.path not in verdicts.cleared

    todo: list[tuple[Node, int, bool, bool]] = [(root, 0, root.article, False)]
    while todo:
        node, k, inside, low = todo.pop()
        while k < len(node.items):
            x = node.items[k]
            k += 1
            if x is None:
                flush()
            elif isinstance(x, str):
                if (inside, low) != state:
                    flush()
                    state = (inside, low)
                run.append(x)
            elif not goes(x):
                todo.append((node, k, inside, low))
                # Plain elements of an article are its text; importance judges everything else.
                judged = not (x.article and x.plain) and x.tag not in ("html", "body", "article", "main")
                inside = inside or x.article or verdicts is not None and not x.holds and x.path in verdicts.cleared
                node, k, low = x, 0, low or judged and verdicts is not None and x.path in verdicts.low
    flush()
    if root.holds and any(a for a, _, _ in found):
        found = [x for x in found if x[0]]
    kept = [x for x in found if not x[1]] or found
    return " ".join(text for _, _, text in kept)


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without user and port; an empty string if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#\s]*)", 1))


#: Name of the tree of all small hosts; no host is called so.
SMALL = "*"


def _style_rows(pages: DataFrame) -> DataFrame:
    """(host, copy, node, suspect, shown, held, size), one row per style node of each distinct page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = style_nodes(page or "")
                copy = _hash(repr(found))
                rows += [(host, copy, *x) for x in found]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["host", "copy", "node", "suspect", "shown", "held", "size"])

    return pages.select("host", "html").mapInArrow(run, "host string, copy long, node long, suspect boolean, shown long, held long, size long").distinct()


def low_bar() -> Column:
    """What declared furniture must exceed to stay: the content branch's importance, if there is one."""
    return F.coalesce("branch", F.lit(float("inf")))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, low, cleared): the verdicts of each host's style tree, of the small hosts' common tree where that is theirs.

    Hosts without evidence have no row.
    """
    rows = materialize(_style_rows(pages), "style-rows")
    sizes = rows.select("host", "copy").distinct().groupBy("host").agg((F.count("*") < OWN_PAGES).alias("small"))
    sizes = materialize(sizes, "hosts")
    sited = rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_NODES else sizes, "host").withColumn("site", F.when(F.col("small"), F.lit(SMALL)).otherwise(F.col("host")))
    counts = sited.groupBy("site", "node", "shown", "held").agg(F.count("*").alias("c"), F.max("suspect").alias("suspect"), F.sum("size").alias("size"))
    counts = materialize(counts, "style-counts")

    def entropy(name: str) -> DataFrame:
        """H = ln m - sum(c ln c) / m of the values of a hash, normalised by ln m."""
        m = F.sum("c").cast("double")
        by = counts.groupBy("site", "node", name).agg(F.sum("c").alias("c"), F.max("suspect").alias("suspect"), F.sum("size").alias("size"))
        spread = (1 - F.sum(F.col("c") * F.ln("c")) / (m * F.ln(F.greatest(m, F.lit(2.0))))).alias(f"{name}_entropy")
        return by.groupBy("site", "node").agg(m.alias("m"), spread, F.max("suspect").alias("suspect"), F.sum("size").alias("size"))

    both = entropy("held").join(entropy("shown").select("site", "node", "shown_entropy"), ["site", "node"])
    mean = lambda w: w * F.col("held_entropy") + (1 - w) * F.col("shown_entropy")
    judged = materialize(both.withColumns({"importance": mean(CONTENT_WEIGHT), "variety": mean(UNIFORM_WEIGHT)}), "importance")
    # The whole text of a site is what its widest node holds, which is the outermost element.
    whole = judged.groupBy("site").agg(F.max("size").alias("whole"))
    branch = judged.join(whole, "site").where(~F.col("suspect") & (F.col("size") >= BRANCH * F.col("whole"))).groupBy("site").agg(F.max("importance").alias("branch"))
    told = judged.where(F.col("m") >= MIN_PAGES).join(branch, "site", "left")
    low = F.when(F.col("suspect"), F.col("importance") <= low_bar() + 1e-9).otherwise(F.col("variety") < UNIFORM)
    sets = told.groupBy("site").agg(F.collect_set(F.when(~F.col("suspect") & low, F.col("node"))).alias("low"), F.collect_set(F.when(F.col("suspect") & ~low, F.col("node"))).alias("cleared"))
    sets = materialize(sets, "verdicts")
    own = sizes.where(~F.col("small")).select("host").join(sets.withColumnRenamed("site", "host"), "host")
    shared = sizes.where("small").select("host").join(F.broadcast(sets.where(F.col("site") == SMALL).drop("site")))  # one row
    return own.unionAll(shared)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, main text and its length in code points."""
    ship(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    hosted = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    told = materialize(style_tree(hosted), "style-tree")
    size = told.agg(F.coalesce(F.sum(F.size("low") + F.size("cleared") + 4), F.lit(0))).first()[0]
    joined = hosted.join(F.broadcast(told) if size <= BROADCAST_NODES else told, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            verdicts: dict[str, Verdicts | None] = {}
            hosts, low, cleared = batch.column(2).to_pylist(), batch.column(4), batch.column(5)
            for k, page in enumerate(batch.column(3).to_pylist()):
                if hosts[k] not in verdicts:
                    verdicts[hosts[k]] = Verdicts(frozenset(low[k].as_py()), frozenset(cleared[k].as_py())) if low[k].is_valid else None
                texts.append(main_text(page, verdicts[hosts[k]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"]
            )

    return joined.select("id", "url", "host", "html", "low", "cleared").mapInArrow(read, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
