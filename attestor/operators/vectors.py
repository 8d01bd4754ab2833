"""Dense vectors: normalization, TopK encoding, decoding, pooling, reconstruction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-8
MAX_BROADCAST_BYTES = 512 * 1024 * 1024


def squared_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_norm(difference(a, b)))


def norm_stats(vectors: DataFrame) -> DataFrame:
    """One row: per-dimension mean, mean L2 norm of centered vectors, row count.

    Two scans because the scale needs the mean. The mean is a vector summarizer, merged
    map-side; nothing is exploded.
    """
    first = vectors.agg(
        vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("mean"), F.count(F.lit(1)).alias("n_total")
    )
    second = (
        vectors.select("vec", first.select("mean").scalar().alias("_mean"))
        .select(F.sqrt(squared_norm(difference(F.col("vec"), F.col("_mean")))).alias("_norm"))
        .agg(F.avg("_norm").alias("scale"))
    )
    return first.select("mean", second.scalar().alias("scale"), "n_total")


def normalize(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """(vec - mean) / max(scale, 1e-8); the one-row stats arrive as scalar subqueries."""
    scaled = vectors.withColumns({"_mean": stats.select("mean").scalar(), "_scale": stats.select("scale").scalar()})
    missing = F.raise_error(F.lit("no normalization stats; compute norm_stats first")).cast("array<double>")
    floored = F.greatest(F.col("_scale"), F.lit(FLOOR))
    ready = scaled.withColumn("_floor", floored).withColumn("_centered", difference(F.col("vec"), F.col("_mean")))
    value = F.transform("_centered", lambda x: x / F.col("_floor"))
    return ready.withColumn("vec", F.when(F.col("_scale").isNull(), missing).otherwise(value)).drop(
        "_mean", "_scale", "_floor", "_centered"
    )


def unit_rows(dictionary: DataFrame) -> DataFrame:
    """Decoder rows scaled to unit length, length floored at 1e-8."""
    size = F.greatest(F.sqrt(squared_norm(F.col("w_dec"))), F.lit(FLOOR))
    return dictionary.withColumn("w_dec", F.transform("w_dec", lambda x: x / size))


class Dictionary:
    """Model weights, read by the driver in blocks small enough to broadcast.

    The weights are a model parameter, not data. Blocks are cut along the sorted feature
    ids, whatever ids there are, and only one block is on the driver at a time; the driver
    checks that the blocks add up to the table.
    """

    def __init__(self, table: DataFrame, b_dec: list[float], max_bytes: int = MAX_BROADCAST_BYTES):
        self.n_dims = int(table.agg(F.max(F.size("w_enc")).alias("m")).first()["m"])
        self.b_dec = np.asarray(b_dec, dtype=float)
        per_feature = 16 * self.n_dims + 16
        self.block_rows = max(1, max_bytes // per_feature)
        self.table = table
        self.ids = np.sort(table.select("feature_idx").toPandas()["feature_idx"].to_numpy())
        self.n_features = len(self.ids)
        if len(np.unique(self.ids)) != self.n_features:
            raise ValueError("a feature id occurs more than once in the dictionary")

    @property
    def n_blocks(self) -> int:
        return -(-self.n_features // self.block_rows)

    def bounds(self) -> list[tuple[int, int]]:
        """First and last feature id of every block."""
        starts = range(0, self.n_features, self.block_rows)
        return [(int(self.ids[a]), int(self.ids[min(a + self.block_rows, self.n_features) - 1])) for a in starts]

    def blocks(self) -> Iterator[dict]:
        read = 0
        for first, last in self.bounds():
            rows = self.table.where(F.col("feature_idx").between(first, last)).orderBy("feature_idx").toPandas()
            read += len(rows)
            yield {
                "idx": rows["feature_idx"].to_numpy(dtype=np.int32),
                "w_enc": np.stack(rows["w_enc"].map(np.asarray)).astype(float),
                "b_enc": rows["b_enc"].to_numpy(dtype=float),
                "w_dec": np.stack(rows["w_dec"].map(np.asarray)).astype(float),
            }
        if read != self.n_features:
            raise ValueError(f"the blocks hold {read} features, the dictionary {self.n_features}")


def _top_k(h: np.ndarray, idx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the positive entries among each row's k largest."""
    if k < h.shape[1]:
        order = np.lexsort((np.broadcast_to(idx, h.shape), -h), axis=1)[:, :k]
    else:
        order = np.broadcast_to(np.arange(h.shape[1]), h.shape)
    values = np.take_along_axis(h, order, axis=1)
    rows, cols = np.nonzero(values > 0)
    return rows, idx[order[rows, cols]], values[rows, cols]


def topk_encode(
    vectors: DataFrame, dictionary: Dictionary, k: int, *, features: list[int] | None = None
) -> DataFrame:
    """Sparse features ``(unit_id, feature_idx, act)``: k largest pre-activations, clamped at 0.

    One matrix product per Arrow batch. ``features`` keeps only the requested ones
    before anything leaves the task. With several blocks, each block's k best candidates
    are merged, which is exact.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["unit_id"].dataType.simpleString()
    keep = None if features is None else np.asarray(sorted(features), dtype=np.int32)
    merged, single = None, dictionary.n_blocks == 1
    for block in dictionary.blocks():
        shared = spark.sparkContext.broadcast({**block, "b_dec": dictionary.b_dec})

        def encode(batches: Iterator[pd.DataFrame], shared=shared, single=single) -> Iterator[pd.DataFrame]:
            w = shared.value
            for batch in batches:
                if batch.empty:
                    continue
                x = np.stack(batch["vec"].map(np.asarray)).astype(float) - w["b_dec"]
                rows, idx, act = _top_k(x @ w["w_enc"].T + w["b_enc"], w["idx"], k)
                if keep is not None and single:
                    mask = np.isin(idx, keep)
                    rows, idx, act = rows[mask], idx[mask], act[mask]
                yield pd.DataFrame(
                    {"unit_id": batch["unit_id"].to_numpy()[rows], "feature_idx": idx, "act": act}
                )

        part = vectors.select("unit_id", "vec").mapInPandas(encode, f"unit_id {id_type}, feature_idx int, act double")
        merged = part if merged is None else merged.unionByName(part)
    if not single:
        best = Window.partitionBy("unit_id").orderBy(F.col("act").desc(), F.col("feature_idx"))
        merged = merged.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
        if features is not None:
            merged = merged.where(F.col("feature_idx").isin([int(f) for f in features]))
    return merged


def decode(features: DataFrame, units: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Reconstruction ``(unit_id, vec)``: sum of act * decoder row, plus the bias.

    At most k rows per unit are gathered, then multiplied batch-wise. A unit without
    active features reconstructs to the bias.
    """
    spark = features.sparkSession
    id_type = units.schema["unit_id"].dataType.simpleString()
    gathered = features.groupBy("unit_id").agg(F.collect_list(F.struct("feature_idx", "act")).alias("active"))
    rows = units.select("unit_id").join(gathered, "unit_id", "left").select(
        "unit_id",
        F.coalesce(F.col("active.feature_idx"), F.array().cast("array<int>")).alias("idx"),
        F.coalesce(F.col("active.act"), F.array().cast("array<double>")).alias("act"),
    )
    bias = dictionary.b_dec
    parts, single = None, dictionary.n_blocks == 1
    for block in dictionary.blocks():
        shared = spark.sparkContext.broadcast({"idx": block["idx"], "w_dec": block["w_dec"]})

        def rebuild(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known, w = shared.value["idx"], shared.value["w_dec"]
            for batch in batches:
                out = np.tile(bias, (len(batch), 1)) if single else np.zeros((len(batch), len(bias)))
                sizes = batch["idx"].map(len).to_numpy()
                at = np.repeat(np.arange(len(batch)), sizes)
                idx = np.concatenate([np.asarray(v, dtype=int) for v in batch["idx"]]) if len(batch) else np.array([], int)
                act = np.concatenate([np.asarray(v, dtype=float) for v in batch["act"]]) if len(batch) else np.array([])
                mine = np.isin(idx, known)
                np.add.at(out, at[mine], act[mine, None] * w[np.searchsorted(known, idx[mine])])
                yield pd.DataFrame({"unit_id": batch["unit_id"], "vec": list(out)})

        part = rows.mapInPandas(rebuild, f"unit_id {id_type}, vec array<double>")
        parts = part if parts is None else parts.unionByName(part)
    if single:
        return parts
    # each task holds one block; the blocks' shares of a unit are added up map-side
    total = vector_to_array(Summarizer.sum(array_to_vector("vec")))
    summed = parts.groupBy("unit_id").agg(total.alias("vec"))
    return summed.withColumn("vec", F.zip_with("vec", F.array(*[F.lit(float(v)) for v in bias]), lambda x, y: x + y))


def reconstruction_metrics(
    vectors: DataFrame,
    features: DataFrame,
    rebuilt: DataFrame,
    dictionary: DataFrame,
    *,
    dead_threshold: float = 1e-3,
    by: list[str] | None = None,
) -> DataFrame:
    """Error, explained variance, sparsity and dead-feature share, optionally per layer.

    Per-unit sums, then one algebraic aggregate; the variance is over all elements with
    the Bessel factor, floored at 1e-8.
    """
    by = by or []
    fired = features.groupBy("unit_id").agg(F.sum((F.col("act") > 0).cast("bigint")).alias("l0"))
    joined = vectors.join(rebuilt.select("unit_id", F.col("vec").alias("hat")), "unit_id").join(fired, "unit_id", "left")
    per_unit = joined.select(
        "unit_id",
        *by,
        F.size("vec").cast("bigint").alias("m"),
        F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("s"),
        squared_norm(F.col("vec")).alias("ss"),
        squared_norm(difference(F.col("vec"), F.col("hat"))).alias("se"),
        F.coalesce("l0", F.lit(0)).alias("l0"),
    )
    sums = per_unit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("m").alias("n_el"),
        F.sum("s").alias("sx"),
        F.sum("ss").alias("sxx"),
        F.sum("se").alias("sse"),
        F.avg("l0").alias("mean_l0"),
    )
    d = dictionary.agg(F.count(F.lit(1)).alias("d")).scalar()
    n = sums.select(*by, F.col("n_samples").alias("_n"))
    active = features.where(F.col("act") > 0).join(vectors.select("unit_id", *by), "unit_id")
    rates = active.groupBy(*by, "feature_idx").agg(F.count(F.lit(1)).alias("_fired"))
    rates = rates.join(n, by) if by else rates.withColumn("_n", n.select("_n").scalar())
    alive = rates.groupBy(*by).agg(
        F.sum((F.col("_fired") / F.col("_n") >= F.lit(dead_threshold)).cast("bigint")).alias("_alive")
    )
    if by:
        full = sums.join(alive, by, "left")
        alive_col = F.coalesce("_alive", F.lit(0))
    else:
        full = sums
        alive_col = F.coalesce(alive.select("_alive").scalar(), F.lit(0))
    mse = F.col("sse") / F.col("n_el")
    mean = F.col("sx") / F.col("n_el")
    var = F.greatest(
        (F.col("sxx") / F.col("n_el") - mean * mean) * (F.col("n_el") / (F.col("n_el") - 1)), F.lit(FLOOR)
    )
    return full.select(
        *by,
        "n_samples",
        mse.alias("mse"),
        (1 - mse / var).alias("frac_variance_explained"),
        "mean_l0",
        (F.col("mean_l0") / d).alias("mean_l0_frac"),
        ((d - alive_col) / d).alias("dead_fraction"),
    )


def pool_tokens(tokens: DataFrame, *, pooling: str = "mean", drop_first: bool = True, drop_last: bool = True) -> DataFrame:
    """Unit vectors from token vectors ``(unit_id, pos, is_pad, vec)``.

    ``mean`` skips padding and, as asked, the first and last real token; an empty
    remainder pools to zeros. ``cls`` is the first token.
    """
    if pooling == "none":
        return tokens
    if pooling == "cls":
        return tokens.groupBy("unit_id").agg(F.min_by("vec", "pos").alias("vec"))
    if pooling != "mean":
        raise ValueError(f"unknown pooling {pooling!r}")
    real = tokens.where(~F.col("is_pad"))
    edges = real.groupBy("unit_id").agg(
        F.min("pos").alias("_first"), F.max("pos").alias("_last"), F.max(F.size("vec")).alias("_m")
    )
    marked = real.join(edges, "unit_id")
    inner = F.lit(True)
    if drop_first:
        inner = inner & (F.col("pos") != F.col("_first"))
    if drop_last:
        inner = inner & (F.col("pos") != F.col("_last"))
    pooled = marked.where(inner).groupBy("unit_id").agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))).alias("vec")
    )
    zeros = F.transform(F.sequence(F.lit(1), F.col("_m")), lambda _: F.lit(0.0))
    return edges.join(pooled, "unit_id", "left").select("unit_id", F.coalesce("vec", zeros).alias("vec"))
