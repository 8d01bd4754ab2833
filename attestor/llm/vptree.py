"""Nearest neighbours with vantage-point trees per shard.

Vectors are dealt to the nearest of some pivots; a cell with more rows than a shard gets pivots
of its own among its rows, and so on, until cells are shards. Every row is indexed, in exactly
one shard, and each shard is one vantage-point tree. A query first goes down to the shard it
lies in, which gives it a radius, and then down again into every cell whose members can be
within that radius. In a tree, a side is left out if the triangle inequality shows that it is
farther than the radius, relaxed by ``factor``: a side is skipped when its bound times the
factor exceeds the radius. Factor one is exact.

The pivots of the first level are on the driver; those of deeper levels stand in a stored
table, one row per cell. Queries of a shard are cut into blocks, and one task works on one
shard and one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.session import materialize

NEIGHBOURS = 10
SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK_QUERIES = 1024
MAX_PIVOTS = 256  # of one cell; bounds what the driver and a task hold of the pivots
MAX_LEVELS = 6  # deeper cells, of rows that no pivot tells apart, are cut by hash
CHUNK_ROWS = 32768  # rows of a cell that one task deals to its pivots
SLACK = 1e-9


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added up in the order of the components."""
    total = np.zeros((len(queries), len(points)))
    for i in range(queries.shape[1]):
        gap = queries[:, i, None] - points[None, :, i]
        total += gap * gap
    return np.sqrt(total)


class Tree:
    """Vantage-point tree over the rows of a matrix."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.points, self.leaf = ids, points, leaf
        self.root = self._grow(np.argsort(ids, kind="stable"))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # The row farthest from the first one lies at the border, where balls cut well.
        away = distances(self.points[rows[:1]], self.points[rows])[0]
        chosen = int(np.argmax(away))
        point, rest = rows[chosen], np.delete(rows, chosen)
        far = distances(self.points[[point]], self.points[rest])[0]
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        sides = [(float(far[part[0]]), float(far[part[-1]]), self._grow(rest[part])) for part in (order[:half], order[half:])]
        return point, sides

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``k`` nearest rows without its own id, within ``radius`` at first.

        Returns distances and ids; free places have an infinite distance.
        """
        near = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)

        def limit(q):
            return np.minimum(near[q, -1], radius[q])

        def offer(q, rows, far):
            far = np.where(own[q][:, None] == self.ids[rows][None, :], np.inf, far)
            all_far = np.hstack([near[q], far])
            all_ids = np.hstack([who[q], np.broadcast_to(self.ids[rows], far.shape)])
            order = np.lexsort((all_ids, all_far), axis=-1)[:, :k]
            near[q] = np.take_along_axis(all_far, order, 1)
            who[q] = np.take_along_axis(all_ids, order, 1)

        def visit(node, q):
            if len(q) == 0:
                return
            if isinstance(node, np.ndarray):
                for at in range(0, len(q), 256):
                    part = q[at : at + 256]
                    offer(part, node, distances(queries[part], self.points[node]))
                return
            point, sides = node
            far = distances(queries[q], self.points[[point]])
            offer(q, np.array([point]), far)
            far = far[:, 0]
            bound = [np.maximum(np.maximum(low - far, far - high), 0.0) for low, high, _ in sides]
            first = np.where(bound[0] <= bound[1], 0, 1)
            for turn in (0, 1):  # the nearer side of each query, then the other one
                for side in (0, 1):
                    mine = first == (side if turn == 0 else 1 - side)
                    open_ = bound[side] * factor <= limit(q) * (1 + SLACK) + SLACK
                    visit(sides[side][2], q[mine & open_])

        if len(self.ids):
            visit(self.root, np.arange(len(queries)))
        return near, who


def _clean(df: DataFrame) -> DataFrame:
    """``id, v`` of the rows that take part."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bounds(far: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance from queries to the members of cells, by the distances ``far`` to the pivots.

    Members lie between ``low`` and ``high`` from their pivot and are nearer to it than to
    another one, so half of what a pivot is farther than the nearest is a bound as well.
    """
    ball = np.maximum(far - high, low - far)
    return np.maximum(ball, (far - far.min(axis=1, keepdims=True)) / 2)


def _dealt(ids: pa.Array, v: pa.Array, pivots: np.ndarray, base: int) -> pa.RecordBatch:
    """Rows with the nearest pivot's ``cell``, its number in the parent and the distance ``away``."""
    far = distances(_matrix(v, pivots.shape[1]), pivots)
    local = far.argmin(axis=1)
    columns = [ids, v, pa.array(base + local, pa.int64()), pa.array(local, pa.int32()), pa.array(far[np.arange(len(local)), local])]
    return pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "local", "away"])


DEALT = "id bigint, v array<double>, cell bigint, local int, away double"
DEALT_ARROW = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int64()), ("local", pa.int32()), ("away", pa.float64())])


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Deal all rows to the cells 1, 2, .. of the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _dealt(batch.column("id"), batch.column("v"), pivots, 1)

    return rows.select("id", "v").mapInArrow(run, DEALT)


def _joined(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _assign_below(rows: DataFrame, nodes: DataFrame, fan: int) -> DataFrame:
    """Deal the rows of split cells to their children, in chunks of bounded size.

    The children of a cell have the numbers from ``fan * cell + 1`` on.
    """
    parts = nodes.select("cell", F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("parts"))
    chunks = rows.join(parts, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pivots = nodes.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), "pivots")

    def run(key, members: pa.Table, node: pa.Table) -> pa.Table:
        if members.num_rows == 0 or node.num_rows == 0:
            return pa.Table.from_batches([], DEALT_ARROW)
        ids, v = _joined(members.column("id")), _joined(members.column("v"))
        centres = np.array(node.column("pivots")[0].as_py())
        return pa.Table.from_batches([_dealt(ids, v, centres, fan * key[0].as_py() + 1)])

    left = chunks.select("cell", "chunk", "id", "v").groupBy("cell", "chunk")
    return left.cogroup(pivots.groupBy("cell", "chunk")).applyInArrow(run, DEALT)


def _pivots_of(rows: DataFrame, sizes: DataFrame, shard_rows: int, fan: int) -> DataFrame:
    """``cell, n, pivots`` of the cells with more than ``shard_rows`` rows."""
    wanted = F.least(F.lit(fan).cast("bigint"), F.ceil(F.col("n") / shard_rows))
    large = sizes.where(F.col("n") > shard_rows).withColumn("wanted", wanted)
    order = Window.partitionBy("cell").orderBy(F.xxhash64("cell", "id"), "id")
    first = rows.join(large, "cell").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fan).where("_r <= wanted")
    gathered = first.groupBy("cell").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("_r", "v"))).alias("_p"))
    return gathered.select("cell", "n", F.transform("_p", lambda p: p["v"]).alias("pivots"))


def _balls(dealt: DataFrame, fan: int) -> DataFrame:
    """``parent, balls``: number, least and largest distance of the members of each child."""
    child = dealt.groupBy("cell", "local").agg(F.min("away").alias("low"), F.max("away").alias("high"))
    parent = F.expr(f"(cell - 1) div {fan}").alias("parent")
    return child.groupBy(parent).agg(F.collect_list(F.struct("local", "low", "high")).alias("balls"))


@dataclass
class Index:
    """Pivots and reaches of the first level, of deeper levels as tables, and the shards."""

    dim: int
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    levels: list[DataFrame]  # cell, pivots, balls
    sizes: DataFrame  # cell, n, salts
    shards: DataFrame  # cell, salt, ids, points
    fan: int


def _limits(balls, fan: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(fan, np.inf), np.full(fan, -np.inf)  # children without members are never reached
    for ball in balls:
        low[ball["local"]], high[ball["local"]] = ball["low"], ball["high"]
    return low, high


def build(rows: DataFrame, dim: int, k: int, shard_rows: int = SHARD_ROWS, fan: int = MAX_PIVOTS) -> Index:
    """Index of ``rows(id, v)``, at most ``fan`` pivots a cell."""
    n = rows.count()
    wanted = int(min(fan, max(1, n // shard_rows)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = np.array([r["v"] for r in chosen])
    placed = materialize(_assign(_few_of_each(rows, k), pivots))
    top = _balls(placed, fan).first()
    low, high = _limits(top["balls"], len(pivots))
    leaves, levels = [], []
    for _ in range(MAX_LEVELS - 1):
        sizes = materialize(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
        if sizes.where(F.col("n") > shard_rows).isEmpty():
            break
        nodes = materialize(_pivots_of(placed, sizes, shard_rows, fan))
        leaves.append(placed.join(nodes.select("cell"), "cell", "left_anti"))
        placed = materialize(_assign_below(placed, nodes, fan))
        balls = _balls(placed, fan).withColumnRenamed("parent", "cell")
        levels.append(materialize(nodes.drop("n").join(balls, "cell")))
    members = leaves[0] if leaves else placed
    for more in [*leaves[1:], placed] if leaves else []:
        members = members.unionByName(more)
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes.withColumn("salts", F.ceil(F.col("n") / shard_rows).cast("int")))
    salted = members.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        points = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "salt": pdf["salt"].iloc[:1], "ids": [pdf["id"].to_numpy().tobytes()], "points": [points.tobytes()]})

    shards = salted.select("id", "v", "cell", "salt").groupBy("cell", "salt").applyInPandas(store, "cell bigint, salt int, ids binary, points binary")
    return Index(dim, pivots, low, high, levels, sizes, materialize(shards), fan)


ROUTED = "q bigint, id bigint, v array<double>, radius double, home bigint, cell bigint"
ROUTED_ARROW = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("radius", pa.float64()), ("home", pa.int64()), ("cell", pa.int64())])


def _reached(batch, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, base: int, factor: float) -> pa.RecordBatch:
    """Queries with the cells they go to: those within their radius, or the nearest if they have none."""
    far = distances(_matrix(_plain(batch.column("v")), pivots.shape[1]), pivots)
    radius = _plain(batch.column("radius")).to_numpy(zero_copy_only=False)
    low, high = low[: len(pivots)], high[: len(pivots)]
    reach = _bounds(far, low, high) * factor <= radius[:, None] * (1 + SLACK) + SLACK
    first = np.isnan(radius)
    reach[first] = False
    reach[first, np.where(np.isfinite(low), far, np.inf)[first].argmin(axis=1)] = True
    take, cell = np.nonzero(reach & np.isfinite(low))
    columns = [_plain(batch.column(c)).take(pa.array(take)) for c in ("q", "id", "v", "radius", "home")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(base + cell, pa.int64())], ["q", "id", "v", "radius", "home", "cell"])


def _plain(column) -> pa.Array:
    return _joined(column) if isinstance(column, pa.ChunkedArray) else column


def _route(index: Index, queries: DataFrame, factor: float) -> DataFrame:
    """``q, id, v, radius, home, cell``: queries at the shard cells they must see.

    A query with a NaN ``radius`` goes to the one cell it lies in.
    """
    pivots, nearest_of, farthest_of, fan = index.pivots, index.low, index.high, index.fan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _reached(batch, pivots, nearest_of, farthest_of, 1, factor)

    at = queries.select("q", "id", "v", "radius", "home").mapInArrow(run, ROUTED)
    done = None
    for nodes in index.levels:
        at = materialize(at)
        settled = at.join(nodes.select("cell"), "cell", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        below = at.join(nodes.select("cell"), "cell", "left_semi")
        parts = below.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("parts"))
        below = below.join(parts, "cell").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts")
        spread = nodes.join(parts, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def down(key, asked: pa.Table, node: pa.Table) -> pa.Table:
            if asked.num_rows == 0 or node.num_rows == 0:
                return pa.Table.from_batches([], ROUTED_ARROW)
            base = fan * key[0].as_py() + 1
            low, high = _limits(node.column("balls")[0].as_py(), fan)
            return pa.Table.from_batches([_reached(asked, np.array(node.column("pivots")[0].as_py()), low, high, base, factor)])

        at = below.groupBy("cell", "chunk").cogroup(spread.groupBy("cell", "chunk")).applyInArrow(down, ROUTED)
    return at if done is None else done.unionByName(at)


def _few_of_each(rows: DataFrame, k: int) -> DataFrame:
    """Rows that can be among the ``k`` nearest of any query: of equal vectors those with the
    ``k + 1`` smallest ids (one may be the query's own), and ``k`` rows of an id at most."""
    same = Window.partitionBy("v", "id").orderBy("id")
    rows = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    equal = Window.partitionBy("v").orderBy("id")
    return rows.withColumn("_r", F.dense_rank().over(equal)).where(F.col("_r") <= k + 1).drop("_r")


def _searched(index: Index, routed: DataFrame, k: int, factor: float) -> DataFrame:
    """``q, query_id, vec_id, score`` of up to ``k`` rows for every query sent to a shard."""
    salts = index.sizes.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    sent = materialize(routed.join(salts, "cell"))
    blocks = sent.groupBy("cell", "salt").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    asked = sent.join(blocks, ["cell", "salt"]).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
    shards = index.shards.join(blocks, ["cell", "salt"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dim = index.dim

    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if len(shard) == 0 or len(asked) == 0:
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype({"q": "int64", "query_id": "int64", "vec_id": "int64"})
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in shard["ids"]])
        points = np.concatenate([np.frombuffer(x, np.float64) for x in shard["points"]]).reshape(-1, dim)
        own, queries = asked["id"].to_numpy(), np.stack(asked["v"].to_numpy())
        radius = asked["radius"].fillna(np.inf).to_numpy()
        near, who = Tree(ids, points).search(own, queries, k, factor, radius)
        query, place = np.nonzero(np.isfinite(near))
        return pd.DataFrame({"q": asked["q"].to_numpy()[query], "query_id": own[query], "vec_id": who[query, place], "score": near[query, place]})

    keys = ["cell", "salt", "block"]
    return shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "q bigint, query_id bigint, vec_id bigint, score double")


def _at_home(index: Index, rows: DataFrame, every: int) -> DataFrame:
    """The query rows, numbered, in the one cell each lies in."""
    none = F.lit(float("nan"))
    asked = rows.where(F.col("id") % every == 0).withColumn("q", F.monotonically_increasing_id())
    asked = materialize(asked.withColumns({"radius": none, "home": F.lit(0).cast("bigint")}))
    return materialize(_route(index, asked, 1.0).withColumn("home", F.col("cell")))


def _abroad(index: Index, home: DataFrame, found: DataFrame, k: int, factor: float) -> DataFrame:
    """The queries at all other cells within the distance of their ``k``-th row so far."""
    ordered = Window.partitionBy("q").orderBy("score", "vec_id")
    kth = found.withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") == k).select("q", F.col("score").alias("_s"))
    asked = home.join(kth, "q", "left").withColumn("radius", F.coalesce("_s", F.lit(float("inf"))))
    return _route(index, asked, factor).where("cell <> home")


def nearest(
    df: DataFrame, every: int = 100, k: int = NEIGHBOURS, factor: float = 1.0, shard_rows: int = SHARD_ROWS, fan: int = MAX_PIVOTS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``df(vec_id, embedding, ...)``
    to each row whose id is divisible by ``every``, nearest first, ties to the smaller id.

    Every such row is a query of its own with its own ranks, also where rows share an id. Rows
    with the query's own id are no candidates; other rows are, repeated ones repeatedly, but of
    equal vectors only the few that can be among the nearest are indexed. Rows without an id, and null, zero or
    not wholly finite vectors take no part; neither do vectors whose length differs from
    that of the vector with the smallest id. A query with fewer candidates gets all of
    them; an empty table gives an empty result; other columns are not looked at.
    """
    rows = _clean(df)
    first = rows.agg(F.min(F.struct("id", F.size("v").alias("dim"))).alias("f")).first()["f"]
    if first is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == first["dim"])
    index = build(rows, first["dim"], k, shard_rows, fan)
    home = _at_home(index, rows, every)
    found = materialize(_searched(index, home, k, factor))
    both = found.unionByName(_searched(index, _abroad(index, home, found, k, factor), k, factor))
    ordered = Window.partitionBy("q").orderBy("score", "vec_id")
    return both.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rows_in_reach(df: DataFrame, every: int = 100, k: int = NEIGHBOURS, shard_rows: int = SHARD_ROWS, fan: int = MAX_PIVOTS) -> DataFrame:
    """``q, n``: rows of the shards that each query of an exact search is sent to (for tuning)."""
    rows = _clean(df)
    dim = rows.select(F.size("v").alias("dim")).first()["dim"]
    index = build(rows, dim, k, shard_rows, fan)
    home = _at_home(index, rows, every)
    found = materialize(_searched(index, home, k, 1.0))
    visits = home.select("q", "cell").unionByName(_abroad(index, home, found, k, 1.0).select("q", "cell"))
    return visits.join(index.sizes, "cell").groupBy("q").agg(F.sum("n").alias("n"))


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""
