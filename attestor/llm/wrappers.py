"""Main text of web pages by wrapper induction.

Pages of one host are aligned, as trees of their block elements, with a reference page of the
host by simple tree matching: the one of a few references that shares most elements with the
page. A slot is a node of the reference and a place in it. A slot that holds one text on
(nearly) all pages that have the element around it is template; a slot whose text varies is
content. Elements that are never part of an article by their meaning, such as menus, footers,
forms and scripts, are left out beforehand, and an ``article`` or ``main`` element bounds the
content where a page has one.

A page is parsed once, in Spark tasks. Its blocks are stored with the slot they align with;
which slots are template is an aggregation over all pages of a host, and taking those
blocks out again is a join. Only a few trees per host are sent to the pages.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.url_trust import host_of
from attestor.session import materialize

MIN_BODIES = 2  # different pages around a constant slot before it counts as template
ARTICLE_BODIES = 20  # the same for a slot inside an article or main element
SHARE = 0.95  # of them that must have the slot
COPIED = 0.7  # fewer than ARTICLE_BODIES pages with more of their text constant are copies of each other
REFERENCES = 3  # pages that may stand for a host, as its pages need not be all of one kind
REFERENCE_PAGES = 20  # pages of a host for each of them
TABLE_CELLS = 1 << 22  # larger tables are halved until they fit; the result is the same

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
# Elements, roles and usual whole class names or ids of what is not the article.
_HIDDEN = frozenset(
    "head title script style noscript template iframe object svg canvas audio video button select textarea "
    "nav menu aside footer dialog".split()
)
_HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
_HIDDEN_NAMES = frozenset(
    "ad ads advert adverts advertisement ad-banner ad-container ad-slot banner sponsor sponsored promo sidebar side-bar "
    "aside menu main-menu nav navbar nav-menu navigation main-nav main-navigation site-nav breadcrumb breadcrumbs header "
    "site-header page-header masthead footer site-footer page-footer cookie cookies cookie-banner cookie-notice "
    "cookie-consent consent gdpr notice notices alert popup modal newsletter newsletter-signup subscribe share sharing "
    "share-buttons social social-links social-share comment comments comment-list comments-area comment-respond disqus "
    "disqus_thread replies respond related related-posts related-articles form search search-form widget widget-area".split()
)


class Node:
    __slots__ = ("label", "children", "number", "kind")

    def __init__(self, label: str, number: int):
        self.label, self.children, self.number, self.kind = label, [], number, -1


class _Reader(HTMLParser):
    """Tree of block elements, and text blocks with the element they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", 0)
        self.count = 1
        # tag, node, inside an article, left out, left out since the article began, in a form
        self.stack: list[tuple] = [("", self.root, False, False, False, False)]
        self.depth: dict[str, int] = {}
        self.words: list[str] = []
        self.blocks: list[tuple[int, str, bool, bool, bool, bool]] = []  # node, text and the flags above

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            _, node, *flags = self.stack[-1]
            self.blocks.append((node.number, text, *flags))

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br" or tag in _VOID:
            if tag == "hr":
                self.flush()
            self.words.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
            if tag in _CLOSES_P and self.depth.get("p"):
                self.close_to({"p"}, _CLOSES_P - {"p"})
            if tag in _SAME:
                self.close_to(_SAME[tag], {"ul", "ol", "dl", "table", "div", "article", "section"})
        _, parent, article, out, inner, form = self.stack[-1]
        shut, given = tag in _HIDDEN or (tag == "header" and not article), {}
        if attrs:
            given = {k: v or "" for k, v in attrs}
            if "hidden" in given or given.get("role", "").lower() in _HIDDEN_ROLES:
                shut = True
            elif tag not in ("html", "body", "article", "main"):
                names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
                shut = shut or any(n in _HIDDEN_NAMES for n in names)
        node = parent
        if tag in _BLOCK or shut:
            if shut and not out:
                self.flush()
            node = Node(f"{tag}.{given.get('class', '')[:32]}", self.count)
            self.count += 1
            parent.children.append(node)
        if not article and tag in ("article", "main"):
            article, inner = True, False
        self.stack.append((tag, node, article, out or shut, inner or shut, form or tag == "form"))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def pop(self) -> None:
        if self.stack[-1][1] is not self.stack[-2][1]:
            self.flush()
        tag = self.stack.pop()[0]
        self.depth[tag] -= 1

    def close_to(self, tags: set[str], bounds: set[str]) -> None:
        """Close up to the innermost of ``tags``, if none of ``bounds`` is further in."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in bounds:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        if self.depth.get(tag):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        self.words.append(data)


def _without_forms(blocks: list[tuple]) -> list[tuple]:
    """Blocks outside forms; all of them if forms hold most of their text, as a form may
    wrap a whole page."""
    inside = sum(len(b[1]) for b in blocks if b[5])
    return blocks if 2 * inside > sum(len(b[1]) for b in blocks) else [b for b in blocks if not b[5]]


def read_page(html: str | None) -> tuple[Node, list[tuple[int, str, bool]]]:
    """Tree of a page and its candidate blocks ``(node, text, inside an article)``.

    These are the blocks of its ``article`` or ``main`` elements, or all that are not left out
    if it has no text in such an element. What is around an article leaves it out only if
    another article stands elsewhere.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    inside = _without_forms([b for b in reader.blocks if b[2] and not b[4]])
    found = [b for b in inside if not b[3]] or inside or _without_forms([b for b in reader.blocks if not b[3]])
    return reader.root, [b[:3] for b in found]


def write_tree(root: Node) -> str:
    """Lines of depth and label in document order."""
    out, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {node.label}")
        todo += [(c, depth + 1) for c in reversed(node.children)]
    return "\n".join(out)


def load_tree(text: str) -> Node:
    path: list[Node] = []
    for number, line in enumerate(text.split("\n")):
        depth, _, label = line.partition(" ")
        node = Node(label, number)
        del path[int(depth) :]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    nodes = [root]
    for node in nodes:
        nodes += node.children
    return nodes


class Kinds:
    """Numbers of subtrees: equal subtrees have the same one. ``sizes`` counts their nodes."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.sizes: list[int] = []

    def name(self, nodes: list[Node]) -> None:
        for node in reversed(nodes):
            key = (node.label, *[c.kind for c in node.children])
            kind = self.known.get(key)
            if kind is None:
                kind = self.known[key] = len(self.sizes)
                self.sizes.append(1 + sum(self.sizes[c.kind] for c in node.children))
            node.kind = kind


class Reference:
    """A reference page: its tree, how often it has each label, and the parent of each node."""

    def __init__(self, text: str):
        self.root = load_tree(text)
        self.nodes = _in_order(self.root)
        self.labels = Counter(n.label for n in self.nodes)
        self.parent = {c.number: n.number for n in self.nodes for c in n.children}
        self.inner = {n.number for n in self.nodes if n.children} | {0}

    def likeness(self, labels: Counter) -> int:
        return sum(min(n, self.labels[k]) for k, n in labels.items())


class _Matching:
    """Simple tree matching of a page and a reference whose subtrees are numbered alike."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.scores: dict[tuple[int, int], int] = {}

    def score(self, a: Node, b: Node) -> int:
        """Largest number of matched nodes, roots included; 0 if the roots differ in label."""
        if a.label != b.label:
            return 0
        if a.kind == b.kind:  # equal subtrees match whole
            return self.sizes[a.kind]
        if not a.children or not b.children:
            return 1
        key = (a.kind, b.kind)
        found = self.scores.get(key)
        if found is None:
            head, tail, xs, ys = self.trimmed(a, b)
            found = 1 + head + tail + (int(self.last_row(xs, ys)[-1]) if xs and ys else 0)
            self.scores[key] = found
        return found

    def trimmed(self, a: Node, b: Node) -> tuple[int, int, list[Node], list[Node]]:
        """Scores of the equal children at both ends, and the children between them.

        An equal pair scores the most that either side can, so matching it loses nothing.
        """
        xs, ys = a.children, b.children
        most = min(len(xs), len(ys))
        i = 0
        while i < most and xs[i].kind == ys[i].kind:
            i += 1
        j = 0
        while j < most - i and xs[-1 - j].kind == ys[-1 - j].kind:
            j += 1
        ends = xs[:i], xs[len(xs) - j :]
        return *(sum(self.sizes[x.kind] for x in e) for e in ends), xs[i : len(xs) - j], ys[i : len(ys) - j]

    def gains(self, xs: list[Node], ys: list[Node]) -> Iterator[np.ndarray]:
        """Scores of each of ``xs`` with all ``ys``; children of one kind are scored once."""
        kinds = {y.kind: y for y in ys}
        place = {k: i for i, k in enumerate(kinds)}
        where = np.array([place[y.kind] for y in ys])
        rows: dict[int, np.ndarray] = {}
        for x in xs:
            if x.kind not in rows:
                rows[x.kind] = np.array([self.score(x, y) for y in kinds.values()])[where]
            yield rows[x.kind]

    def rows(self, xs: list[Node], ys: list[Node]) -> Iterator[np.ndarray]:
        """Rows of the table of best scores of the first children of both lists."""
        row = np.zeros(len(ys) + 1, np.int64)
        yield row
        for gain in self.gains(xs, ys):
            best = row.copy()
            np.maximum(best[1:], row[:-1] + gain, out=best[1:])
            row = np.maximum.accumulate(best)
            yield row

    def last_row(self, xs: list[Node], ys: list[Node]) -> np.ndarray:
        for row in self.rows(xs, ys):
            pass
        return row

    def pairs(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """Matched children of two lists that are best in sum."""
        if not xs or not ys:
            return []
        if len(xs) > 1 and len(xs) * len(ys) > TABLE_CELLS:
            half = len(xs) // 2
            ahead = self.last_row(xs[:half], ys)
            behind = self.last_row(xs[half:][::-1], ys[::-1])[::-1]
            cut = int(np.argmax(ahead + behind))
            return self.pairs(xs[:half], ys[:cut]) + self.pairs(xs[half:], ys[cut:])
        table = list(self.rows(xs, ys))
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out


def align(page: Node, reference: Node, kinds: Kinds | None = None) -> dict[int, int]:
    """Number in ``reference`` of every matched node of ``page``, by simple tree matching:
    roots match if their labels are equal, and child lists are matched in order for the
    largest number of matched nodes. ``kinds`` has named both trees already."""
    if kinds is None:
        kinds = Kinds()
        kinds.name(_in_order(reference))
        kinds.name(_in_order(page))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # trees may be deep
    matching = _Matching(kinds.sizes)
    found: dict[int, int] = {}
    todo = [(page, reference)] if page.label == reference.label else []
    while todo:
        a, b = todo.pop()
        found[a.number] = b.number
        if a.kind == b.kind:
            todo += zip(a.children, b.children, strict=True)
        elif a.children and b.children:
            _, _, xs, ys = matching.trimmed(a, b)
            head = next((i for i, (x, y) in enumerate(zip(a.children, b.children, strict=False)) if x.kind != y.kind), min(len(a.children), len(b.children)))
            tail = len(a.children) - head - len(xs)
            todo += zip(a.children[:head], b.children[:head], strict=True)
            todo += zip(a.children[len(a.children) - tail :], b.children[len(b.children) - tail :], strict=True)
            todo += [(x, y) for x, y in matching.pairs(xs, ys) if x.label == y.label]
    return found


def _references(pages: DataFrame) -> DataFrame:
    """``host, trees``: trees of at most ``REFERENCES`` pages per host, the first ones in the
    order of a checksum within as many classes of it; one for each ``REFERENCE_PAGES`` pages,
    so that enough pages share a reference."""
    key = F.xxhash64("page_id", "html")
    keyed = pages.where("host <> ''").select("host", "page_id", "html", key.alias("_h"))
    first = keyed.groupBy("host", F.pmod("_h", F.lit(REFERENCES))).agg(F.min("_h").alias("_h"), F.count(F.lit(1)).alias("n"))
    hosts = first.groupBy("host").agg(F.sort_array(F.collect_list("_h")).alias("_all"), F.sum("n").alias("n"))
    wanted = F.slice("_all", 1, F.greatest(F.lit(1), F.floor(F.col("n") / REFERENCE_PAGES)).cast("int"))
    chosen = materialize(hosts.select("host", F.explode(wanted).alias("_h")))
    rows = keyed.join(chosen, ["host", "_h"]).dropDuplicates(["host", "_h"]).select("host", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [write_tree(read_page(x)[0]) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], ["host", "tree"])

    trees = rows.mapInArrow(run, "host string, tree string").groupBy("host")
    return materialize(trees.agg(F.array_sort(F.collect_set("tree")).alias("trees")))


_ENTRY = "array<struct<node:bigint,place:bigint,parent:bigint,article:boolean,sum:bigint,text:string>>"


def _blocks(pages: DataFrame) -> DataFrame:
    """Replace html by ``blocks``, the text blocks in order with slot and checksum, ``ref``, the
    reference that the slots belong to, and ``nodes``, its inner nodes that the page has."""
    kinds_ = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kinds_['page_id']}, url {kinds_['url']}, host string, ref int, body bigint, nodes array<bigint>, blocks {_ENTRY}"
    entry = pa.list_(pa.struct([("node", pa.int64()), ("place", pa.int64()), ("parent", pa.int64()), ("article", pa.bool_()), ("sum", pa.int64()), ("text", pa.string())]))
    digest = lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, tuple[Kinds, list[Reference]]] = {}
        for batch in batches:
            out, bodies, refs, seen = [], [], [], []
            trees = batch.column("trees")
            for i, (html, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                root, blocks = read_page(html)
                slots, ref, parents, inner = {}, 0, {}, set()
                if blocks and trees[i].is_valid:
                    if host not in loaded:
                        if len(loaded) >= 200:
                            loaded.clear()
                        kinds, known = Kinds(), [Reference(t) for t in trees[i].as_py()]
                        for r in known:
                            kinds.name(r.nodes)
                        loaded[host] = kinds, known
                    kinds, known = loaded[host]
                    nodes = _in_order(root)
                    labels = Counter(n.label for n in nodes)
                    ref = max(range(len(known)), key=lambda k: (known[k].likeness(labels), -k))
                    kinds.name(nodes)
                    slots, parents, inner = align(root, known[ref].root, kinds), known[ref].parent, known[ref].inner
                    if len(kinds.sizes) > 100_000:  # kinds of pages seen before are not needed again
                        del loaded[host]
                used: dict[int, int] = {}
                rows = []
                for node, text, article in blocks:
                    place = used[node] = used.get(node, -1) + 1
                    slot = slots.get(node, -1)
                    rows.append({"node": slot, "place": place, "parent": parents.get(slot, 0), "article": article, "sum": digest(text), "text": text})
                out.append(rows)
                refs.append(ref)
                seen.append(sorted(inner.intersection(slots.values())))
                bodies.append(digest("\n".join(b[1] for b in blocks)))
            columns = [batch.column(c) for c in ("page_id", "url", "host")]
            columns += [pa.array(refs, pa.int32()), pa.array(bodies, pa.int64()), pa.array(seen, pa.list_(pa.int64())), pa.array(out, entry)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "ref", "body", "nodes", "blocks"])

    return materialize(pages.mapInArrow(run, schema))


def template_slots(blocks: DataFrame, min_bodies: int = MIN_BODIES, share: float = SHARE, article_bodies: int = ARTICLE_BODIES) -> DataFrame:
    """``host, ref, slots``: slots that hold one text on at least ``share`` of the different
    pages that have the element around them, if these are enough. Copies of a page count once.

    Inside an ``article`` or ``main`` element ``article_bodies`` pages are enough, elsewhere
    ``min_bodies``; but where fewer than ``article_bodies`` pages have more than ``COPIED`` of their text in
    such slots, they are near copies of each other and keep it.
    """
    pair = F.transform("blocks", lambda b: F.struct(b["node"], b["place"], b["parent"], b["article"], b["sum"], F.char_length(b["text"]).alias("size")))
    once = blocks.where("host <> ''").groupBy("host", "ref", "body").agg(F.min(F.struct("nodes", pair.alias("b"))).alias("p"))
    once = materialize(once.select("host", "ref", "p.nodes", "p.b"))
    around = once.select("host", "ref", F.explode("nodes").alias("parent")).groupBy("host", "ref", "parent").agg(F.count(F.lit(1)).alias("n"))
    seen = once.select("host", "ref", F.explode("b").alias("s")).select("host", "ref", "s.*").where("node >= 0")
    held = seen.groupBy("host", "ref", "node", "place").agg(
        F.count(F.lit(1)).alias("m"), F.min("sum").alias("lo"), F.max("sum").alias("hi"),
        F.max("parent").alias("parent"), F.bool_or("article").alias("article"), F.sum("size").alias("size"),
    )
    enough = F.when(F.col("article"), article_bodies).otherwise(min_bodies)
    fixed = held.join(around, ["host", "ref", "parent"]).where((F.col("m") >= share * F.col("n")) & (F.col("m") >= enough))
    fixed = materialize(fixed.where("lo = hi").select("host", "ref", "node", "place", "size"))
    whole = held.groupBy("host", "ref").agg(F.sum("size").alias("all"))
    pages = once.groupBy("host", "ref").agg(F.count(F.lit(1)).alias("pages"))
    slots = fixed.groupBy("host", "ref").agg(F.collect_set(F.struct("node", "place")).alias("slots"), F.sum("size").alias("constant"))
    slots = slots.join(whole, ["host", "ref"]).join(pages, ["host", "ref"])
    templated = (F.col("pages") >= article_bodies) | (F.col("constant") <= COPIED * F.col("all"))
    return materialize(slots.where(templated).select("host", "ref", "slots"))


def extracted(df: DataFrame, min_bodies: int = MIN_BODIES, share: float = SHARE, article_bodies: int = ARTICLE_BODIES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``df(page_id, url, html, ...)``.

    White space inside a block becomes one space, blocks are joined by a line feed in page
    order. Null or empty html gives an empty text; a page whose url has no host is aligned
    with nothing and keeps all its candidate blocks. Repeated rows repeat; an empty table
    gives an empty result; other columns are not looked at.
    """
    pages = df.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    blocks = _blocks(pages.join(_references(pages), "host", "left").select("page_id", "url", "host", "html", "trees"))
    fixed = template_slots(blocks, min_bodies, share, article_bodies)
    told = blocks.join(fixed, ["host", "ref"], "left")
    slot = lambda b: F.struct(b["node"].alias("node"), b["place"].alias("place"))
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("slots", slot(b)), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return told.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
