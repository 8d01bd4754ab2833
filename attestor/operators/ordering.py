"""Deterministic randomness and ranking without one-task-per-group windows.

Every random choice of the library is an md5 order over ids, so a result can be
replayed by any SQL engine. Every rank or running total over a group of unknown
size is computed in two levels: a window inside small *buckets* of the ordering
key, plus the totals of the earlier buckets. A group holding a third of all rows is
therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKETS = 65536  # four hexadecimal digits of the md5
RANK_BUCKET = 65536  # rows per bucket when the key is itself a dense rank


def order_hash(seed, *parts) -> Column:
    """md5 over ``seed:part:part...``; the library's only source of randomness."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", seed_col.cast("string"), *[c.cast("string") for c in columns]))


def hash_int(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a BIGINT."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(digest: Column) -> Column:
    """Uniform, order-preserving bucket of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def score_bucket(score: Column, per_octave: int = 256) -> Column:
    """Order-preserving bucket of a finite number, piecewise linear in each power of two.

    At ``per_octave=256`` one bucket holds at most 2**15 distinct 32-bit floats, which
    bounds every window over distinct scores whatever their distribution.
    """
    value = score.cast("double")
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    position = (octave + size / F.pow(F.lit(2.0), octave) - 1 + 1100) * per_octave
    level = F.floor(position).cast("bigint") + 1
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, level).otherwise(-level)


def running_totals(
    df: DataFrame,
    *,
    by: list[str],
    bucket: str,
    order: list[str],
    totals: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Add, per output name, the total of an expression over the strictly earlier rows.

    ``bucket`` must be monotone in ``order``. Windows span one bucket only; the second
    level sees one row per (group, bucket). The input is read by both levels, so callers
    materialize it when it is more than a scan or one aggregation.
    """
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = (Window.unboundedPreceding, -1)
    scope = [*by, bucket]
    local = Window.partitionBy(*scope).orderBy(*[turn(c) for c in order]).rowsBetween(*before)
    across = Window.partitionBy(*by).orderBy(turn(bucket)).rowsBetween(*before)

    sized = df.groupBy(*scope).agg(*[F.sum(expr).alias(f"_{name}_sum") for name, expr in totals.items()])
    offsets = sized.select(
        *scope,
        *[F.coalesce(F.sum(f"_{name}_sum").over(across), F.lit(0)).alias(f"_{name}_skip") for name in totals],
    )
    inside = df.select(
        "*", *[F.coalesce(F.sum(expr).over(local), F.lit(0)).alias(f"_{name}_run") for name, expr in totals.items()]
    )
    joined = inside.join(offsets, scope)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_{name}_run") + F.col(f"_{name}_skip")).alias(name) for name in totals],
    )


def hash_rank(df: DataFrame, *, by: list[str], seed, parts: list[str], rank: str, ties: list[str] | None = None) -> DataFrame:
    """1-based rank of every row in md5 order within ``by``."""
    staged = df.withColumn("_h", order_hash(seed, *parts)).withColumn("_hb", hash_bucket(F.col("_h")))
    ranked = running_totals(
        staged, by=by, bucket="_hb", order=["_h", *(ties or parts)], totals={rank: F.lit(1).cast("bigint")}
    )
    return ranked.withColumn(rank, F.col(rank) + 1).drop("_h", "_hb")


def stable_rank(df: DataFrame, *, by: list[str], key: str, rank: str, bucket: Column | None = None) -> DataFrame:
    """1-based rank by a unique numeric key within ``by``, numeric order."""
    staged = df.withColumn("_kb", score_bucket(F.col(key), per_octave=16384) if bucket is None else bucket)
    ranked = running_totals(staged, by=by, bucket="_kb", order=[key], totals={rank: F.lit(1).cast("bigint")})
    return ranked.withColumn(rank, F.col(rank) + 1).drop("_kb")


def average_ranks(rows: DataFrame, *, by: list[str], score: str, rank: str = "rank") -> DataFrame:
    """Average-tie rank of every row within ``by``.

    Ties are combined before ranking, so a value shared by very many rows is one row in
    the window; the lookup back is an equi-join on the value.
    """
    blocks = rows.groupBy(*by, F.col(score).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    blocks = blocks.withColumn("_b", score_bucket(F.col("_v")))
    placed = running_totals(blocks, by=by, bucket="_b", order=["_v"], totals={"_below": F.col("_n")})
    ranked = placed.select(*by, "_v", (F.col("_below") + (F.col("_n") + 1) / 2).alias(rank))
    return rows.withColumn("_v", F.col(score)).join(ranked, [*by, "_v"]).drop("_v")


def running_positives(rows: DataFrame, *, by: list[str], score: str, positive: str) -> DataFrame:
    """Positives and rows at or above each distinct score, best score first."""
    blocks = rows.groupBy(*by, score).agg(F.sum(positive).alias("_p"), F.count(F.lit(1)).alias("_n"))
    blocks = blocks.withColumn("_b", score_bucket(F.col(score)))
    placed = running_totals(
        blocks, by=by, bucket="_b", order=[score], totals={"_pa": F.col("_p"), "_na": F.col("_n")}, descending=True
    )
    return placed.select(*by, score, (F.col("_pa") + F.col("_p")).alias("n_positive"), (F.col("_na") + F.col("_n")).alias("n_rows"))
