"""Stratified splits, label permutation and subsampling in hash order.

Units are ranked once. The first part of that order is the *pool*, a fixed train /
select / held-out division shared by every concept. A concept's own stratified split
takes the first units of each of its two classes in the same order, so it differs from
the pool only by its positives and by the short stretch of ranks between the pool's
cut and the concept's cut (about the square root of the number of units). Only those
rows are ever materialised per concept; units x concepts never is.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.ordering import RANK_BUCKET, hash_rank, order_hash, running_totals
from attestor.session import materialize


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def class_cuts(n: Column, test_fraction: float, held_out_fraction: float) -> tuple[Column, Column]:
    """(held-out size, test size) of a class of ``n`` members; held-out is part of test."""
    test = F.greatest(F.lit(1), F.least(n - 1, half_up(F.lit(float(test_fraction)) * n)))
    held = F.when(
        test >= 2, F.greatest(F.lit(1), F.least(test - 1, half_up(F.lit(float(held_out_fraction)) * test)))
    ).otherwise(F.lit(0))
    return held.cast("bigint"), test.cast("bigint")


@dataclass(frozen=True)
class Pool:
    """Cut points of the shared unit order; membership is a local test on the unit id."""

    seed: str
    n_units: int
    held_cut: int
    test_cut: int
    held_key: str  # md5:id of the last held-out unit
    test_key: str

    def _key(self, unit_id: Column) -> Column:
        return F.concat_ws(":", order_hash(self.seed, unit_id), unit_id.cast("string"))

    def in_test(self, unit_id: Column) -> Column:
        """Is the unit in the test part (held-out or selection)? From the id alone."""
        return self._key(unit_id) <= F.lit(self.test_key)

    def in_held(self, unit_id: Column) -> Column:
        return self._key(unit_id) <= F.lit(self.held_key)

    def part(self, unit_id: Column) -> Column:
        """'held', 'select' or 'train' from the id alone, so features need no join."""
        return (
            F.when(self.in_held(unit_id), F.lit("held"))
            .when(self.in_test(unit_id), F.lit("select"))
            .otherwise(F.lit("train"))
        )

    def part_of_rank(self, rank: Column) -> Column:
        return part_of(rank, F.lit(self.held_cut), F.lit(self.test_cut))


def part_of(rank: Column, held_cut: Column, test_cut: Column) -> Column:
    return (
        F.when(rank <= held_cut, F.lit("held")).when(rank <= test_cut, F.lit("select")).otherwise(F.lit("train"))
    )


def rank_units(units: DataFrame, seed, *, repeats: int | None = None) -> DataFrame:
    """(unit_id, unit_rank): position of every unit in the shared order.

    With ``repeats`` there is one order per ``repeat``, seeded by ``seed:repeat``.
    """
    rows = units.select("unit_id", F.col("unit_id").cast("string").alias("_sid"))
    by = []
    if repeats is not None:
        rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        by, seed = ["repeat"], F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"))
    ranked = hash_rank(rows, by=by, seed=seed, parts=["unit_id"], rank="unit_rank", ties=["_sid"])
    return materialize(ranked.drop("_sid"))


def make_pools(
    ranked: DataFrame, *, seed, test_fraction: float, held_out_fraction: float, repeats: int | None = None
) -> list[Pool]:
    """Fix the cuts of each order's pool: one count and two single-row lookups per order."""
    wanted = ranked if repeats is None else ranked.where(F.col("repeat") == 0)
    n = wanted.count()
    test_cut = max(1, min(n - 1, math.floor(test_fraction * n + 0.5)))
    held_cut = max(1, min(test_cut - 1, math.floor(held_out_fraction * test_cut + 0.5))) if test_cut >= 2 else 0
    seeds = [str(seed)] if repeats is None else [f"{seed}:{r}" for r in range(repeats)]
    number = F.lit(0) if repeats is None else F.col("repeat")
    edges = ranked.where(F.col("unit_rank").isin([held_cut, test_cut])).select(
        number.alias("no"), "unit_rank", F.col("unit_id").cast("string").alias("sid")
    )
    found = {(r["no"], r["unit_rank"]): r["sid"] for r in edges.collect()}

    def key(no: int, cut: int) -> str:
        sid = found.get((no, cut))
        return "" if sid is None else f"{hashlib.md5(f'{seeds[no]}:{sid}'.encode()).hexdigest()}:{sid}"

    return [Pool(s, n, held_cut, test_cut, key(i, held_cut), key(i, test_cut)) for i, s in enumerate(seeds)]


def make_pool(ranked: DataFrame, *, seed, test_fraction: float, held_out_fraction: float) -> Pool:
    return make_pools(ranked, seed=seed, test_fraction=test_fraction, held_out_fraction=held_out_fraction)[0]


def split_positives(
    positives: DataFrame,
    ranked: DataFrame,
    pool: Pool,
    *,
    keys: list[str],
    test_fraction: float,
    held_out_fraction: float,
    order_keys: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stratified split of every concept, described by its positives only.

    Returns ``(parts, cuts)``: ``parts`` has one row per positive with its ``part``;
    ``cuts`` has one row per concept with class sizes and the unit ranks at which its
    negatives stop being held-out and test.
    """
    placed = materialize(positives.select(*keys, "unit_id").join(ranked, [*(order_keys or []), "unit_id"]))
    placed = placed.withColumn("_rb", F.floor((F.col("unit_rank") - 1) / RANK_BUCKET).cast("bigint"))
    placed = running_totals(
        placed, by=keys, bucket="_rb", order=["unit_rank"], totals={"pos_before": F.lit(1).cast("bigint")}
    ).drop("_rb")

    n = F.lit(pool.n_units).cast("bigint")
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pos")).withColumn("n_neg", n - F.col("n_pos"))
    held_pos, test_pos = class_cuts(F.col("n_pos"), test_fraction, held_out_fraction)
    held_neg, test_neg = class_cuts(F.col("n_neg"), test_fraction, held_out_fraction)
    splittable = (test_pos >= 2) & (test_neg >= 2)
    sizes = sizes.where((F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)).select(
        *keys,
        "n_pos",
        "n_neg",
        test_pos.alias("test_pos"),
        test_neg.alias("test_neg"),
        F.when(splittable, held_pos).otherwise(F.lit(0)).cast("bigint").alias("held_pos"),
        F.when(splittable, held_neg).otherwise(F.lit(0)).cast("bigint").alias("held_neg"),
    )

    sized = materialize(placed.join(sizes, keys))
    neg_before = F.col("unit_rank") - 1 - F.col("pos_before")
    shifted = sized.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in sizes.columns if c not in keys],
        F.sum((neg_before <= F.col("held_neg") - 1).cast("bigint")).alias("_held_shift"),
        F.sum((neg_before <= F.col("test_neg") - 1).cast("bigint")).alias("_test_shift"),
    )
    cuts = shifted.select(
        *keys,
        "n_pos",
        "n_neg",
        (F.col("test_pos") - F.col("held_pos")).alias("select_pos"),
        (F.col("test_neg") - F.col("held_neg")).alias("select_neg"),
        "held_pos",
        "held_neg",
        F.when(F.col("held_neg") > 0, F.col("held_neg") + F.col("_held_shift"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("held_cut"),
        (F.col("test_neg") + F.col("_test_shift")).alias("test_cut"),
    )
    parts = sized.select(
        *keys, "unit_id", "unit_rank", part_of(F.col("pos_before") + 1, F.col("held_pos"), F.col("test_pos")).alias("part")
    )
    return parts, cuts


def split_members(
    parts: DataFrame, cuts: DataFrame, ranked: DataFrame, pool: Pool, keys: list[str], order_keys: list[str] | None = None
) -> DataFrame:
    """Rows in which a concept differs from the pool.

    ``pos_*`` marks the concept's own positives; ``neg_*`` corrects the pool's count of
    negatives: -1 for a pool unit that is not this concept's negative, +1 for the
    reverse.
    """
    zone = pool.part_of_rank(F.col("unit_rank"))
    own = F.col("part")

    def flag(condition: Column) -> Column:
        return condition.cast("bigint")

    positive_rows = parts.select(
        *keys,
        "unit_id",
        flag(own == "select").alias("pos_select"),
        flag(own == "held").alias("pos_held"),
        (-flag(zone == "select")).alias("neg_select"),
        (-flag(zone == "held")).alias("neg_held"),
    )

    def stretch(cut: Column, base: int) -> Column:
        low, high = F.least(cut, F.lit(base)), F.greatest(cut, F.lit(base))
        return F.when(low < high, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))

    band = cuts.select(
        *keys,
        "held_cut",
        "test_cut",
        F.explode(
            F.array_union(
                stretch(F.col("held_cut"), pool.held_cut), stretch(F.col("test_cut"), pool.test_cut)
            )
        ).alias("unit_rank"),
    ).join(ranked, [*(order_keys or []), "unit_rank"])
    band = band.join(parts.select(*keys, "unit_id"), [*keys, "unit_id"], "left_anti")
    actual = part_of(F.col("unit_rank"), F.col("held_cut"), F.col("test_cut"))
    zero = F.lit(0).cast("bigint")
    band_rows = band.select(
        *keys,
        "unit_id",
        zero.alias("pos_select"),
        zero.alias("pos_held"),
        (flag(actual == "select") - flag(zone == "select")).alias("neg_select"),
        (flag(actual == "held") - flag(zone == "held")).alias("neg_held"),
    )
    arms = ["pos_select", "pos_held", "neg_select", "neg_held"]
    useful = F.greatest(*[F.abs(F.col(a)) for a in arms]) > 0
    return positive_rows.unionByName(band_rows).where(useful)


def stratified_assignment(labels: DataFrame, *, keys: list[str], test_fraction: float, held_out_fraction: float, seed) -> DataFrame:
    """Explicit split of a labeled table ``(keys, unit_id, y)``: every row gets a ``part``.

    For data already at concept x unit grain (a single concept, a text benchmark). The
    probing operators use :func:`split_positives` instead and never build this table.
    """
    placed = hash_rank(labels, by=[*keys, "y"], seed=seed, parts=["unit_id"], rank="class_rank")
    sizes = labels.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("_n"))
    held, test = class_cuts(F.col("_n"), test_fraction, held_out_fraction)
    sizes = sizes.select(*keys, "y", "_n", held.alias("_held"), test.alias("_test"))
    ready = sizes.groupBy(*keys).agg(F.min("_n").alias("_least"), F.min("_test").alias("_least_test"))
    sized = placed.join(sizes, [*keys, "y"]).join(ready, keys).where(F.col("_least") >= 2)
    held_cut = F.when(F.col("_least_test") >= 2, F.col("_held")).otherwise(F.lit(0))
    return sized.select(
        *labels.columns, "class_rank", part_of(F.col("class_rank"), held_cut, F.col("_test")).alias("part")
    )


def permute_labels(labels: DataFrame, *, draws: int, seed) -> DataFrame:
    """Move whole label sets between labeled units, once per draw.

    The i-th labeled unit of a fixed hash order receives the labels of the i-th unit of
    the draw's own order. Counts per concept and label co-occurrence are unchanged.
    """
    units = materialize(labels.select("unit_id").distinct())
    fixed = hash_rank(units, by=[], seed=f"{seed}:receiver", parts=["unit_id"], rank="slot")
    drawn = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    shuffled = hash_rank(drawn, by=["draw"], seed=f"{seed}:giver", parts=["draw", "unit_id"], rank="slot")
    moves = shuffled.withColumnRenamed("unit_id", "giver").join(
        fixed.withColumnRenamed("unit_id", "receiver"), "slot"
    )
    return moves.join(labels.withColumnRenamed("unit_id", "giver"), "giver").select(
        "draw", F.col("receiver").alias("unit_id"), "concept_id"
    )


def subsample_positives(positives: DataFrame, *, targets: list[int], repeats: int, seed) -> DataFrame:
    """For every (target, repeat) keep ``target`` positives in that repeat's hash order."""
    rows = positives.select("concept_id", "unit_id").withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    ranked = hash_rank(rows, by=["concept_id", "repeat"], seed=seed, parts=["repeat", "unit_id"], rank="_order")
    wanted = F.array(*[F.lit(int(t)) for t in targets])
    return ranked.select(
        "concept_id", "repeat", "unit_id", F.explode(F.filter(wanted, lambda t: t >= F.col("_order"))).alias("target")
    )


def contiguous_slices(df: DataFrame, *, key: str, n_slices: int) -> DataFrame:
    """Slice i of n over a stable key: every slice has ceil(N/n) rows, the last fewer."""
    from attestor.operators.ordering import stable_rank

    ranked = stable_rank(df, by=[], key=key, rank="_row")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.ceil(total / F.lit(n_slices))
    return ranked.withColumn("slice_id", F.floor((F.col("_row") - 1) / size).cast("int")).drop("_row")
