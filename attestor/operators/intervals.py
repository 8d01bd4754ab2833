"""Interval joins, window generation, gene claims.

Overlap is an equi-join on bins. Every interval has a *level* by its length, so that it
spans at most two bins of that level. A pair meets at the coarser of its two levels:
either the left interval stands at its own level and the right one is looked up there
(role A), or the other way round (role B). Both sides therefore explode to at most two
rows per level that occurs on the other side; a two-megabase gene or window costs a few
rows, and short elements keep small bins. A pair is emitted only in the bin where its
overlap starts, so no DISTINCT is needed and each overlapping pair appears once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import parse_window_id, stable_gene_id, window_id
from attestor.session import materialize

BROADCAST_ROWS = 50_000  # binned intervals that may be sent to every task
LEVEL_BITS = 2  # bins of the next level are 4 times wider


def _level(length: Column, bin_size: int) -> Column:
    """Smallest level whose bins are at least as long as the interval."""
    ratio = F.greatest(length, F.lit(1)) / F.lit(float(bin_size))
    return F.greatest(F.lit(0), F.ceil(F.log2(ratio) / LEVEL_BITS)).cast("int")


def _width(level: Column, bin_size: int) -> Column:
    return (F.lit(bin_size) * F.pow(F.lit(2.0), level * LEVEL_BITS)).cast("bigint")


def _bins(df: DataFrame, other_levels: DataFrame, bin_size: int, *, own_role: str, strict: bool) -> DataFrame:
    """One row per (level, role, bin) an interval ``_s.._e`` of level ``_own`` takes part in."""
    role = "B" if own_role == "A" else "A"
    staged = df.withColumn("_levels", other_levels.select("levels").scalar())
    coarser = F.filter(
        F.coalesce("_levels", F.array().cast("array<int>")),
        lambda x: (x > F.col("_own")) if strict else (x >= F.col("_own")),
    )
    stands = F.array(F.struct(F.col("_own").alias("level"), F.lit(own_role).alias("role")))
    visits = F.transform(coarser, lambda x: F.struct(x.alias("level"), F.lit(role).alias("role")))
    placed = staged.withColumn("_at", F.explode(F.concat(stands, visits))).drop("_levels")
    placed = placed.withColumn("_w", _width(F.col("_at.level"), bin_size))
    first, last = F.floor(F.col("_s") / F.col("_w")), F.floor((F.col("_e") - 1) / F.col("_w"))
    return placed.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    *,
    bin_size: int = 256,
    left_cols: tuple[str, str, str] = ("chrom", "start", "end"),
    right_cols: tuple[str, str, str] = ("chrom", "start", "end"),
    left_length: int | None = None,
) -> DataFrame:
    """Every overlapping pair of half-open intervals once; columns of both sides.

    Columns of ``right`` other than its interval must not clash with ``left``; its
    interval comes back as ``r_start``, ``r_end``. Empty or reversed intervals never
    overlap. ``left_length`` is the length of all left intervals, if they have one, as
    points do; the left side is then read once.

    The binned right side is stored. Up to ``BROADCAST_ROWS`` rows of it, counted, are sent
    to the left side, which is then not shuffled. Otherwise a sort-merge join is asked for:
    size estimates do not see exploded bins, and AQE splits crowded bins of such a join.
    """
    lc, ls, le = left_cols
    rc, rs, re_ = right_cols
    extra = [c for c in right.columns if c not in right_cols]
    lf = left.where(F.col(ls) < F.col(le)).withColumns(
        {"_chrom": F.col(lc), "_s": F.col(ls).cast("bigint"), "_e": F.col(le).cast("bigint")}
    )
    rf = right.where(F.col(rs) < F.col(re_)).select(
        F.col(rc).alias("_chrom"), F.col(rs).cast("bigint").alias("_s"), F.col(re_).cast("bigint").alias("_e"), *extra
    )
    own = _level(F.col("_e") - F.col("_s"), bin_size)
    lf, rf = lf.withColumn("_own", own), rf.withColumn("_own", own)
    # a few levels per side, whatever the number of intervals
    if left_length is None:
        lf_levels = lf.agg(F.collect_set("_own").alias("levels"))
    else:
        one = F.array(_level(F.lit(left_length).cast("bigint"), bin_size))
        lf_levels = left.sparkSession.range(1).select(one.alias("levels"))
    rb = _bins(rf, lf_levels, bin_size, own_role="B", strict=False).select(
        *extra, "_chrom", F.col("_s").alias("r_start"), F.col("_e").alias("r_end"), "_bin",
        F.col("_at.level").alias("_level"), F.col("_at.role").alias("_role"),
    )
    rb = materialize(rb)
    rf_levels = rb.where(F.col("_role") == "B").agg(F.collect_set("_level").alias("levels"))
    lb = _bins(lf, rf_levels, bin_size, own_role="A", strict=True).select(
        *left.columns, "_chrom", "_s", "_e", "_w", "_bin", F.col("_at.level").alias("_level"), F.col("_at.role").alias("_role")
    )
    keys = ["_chrom", "_level", "_role", "_bin"]
    joined = lb.join(F.broadcast(rb), keys) if rb.count() <= BROADCAST_ROWS else lb.hint("merge").join(rb, keys)
    hit = (
        (F.col("_s") < F.col("r_end"))
        & (F.col("_e") > F.col("r_start"))
        & (F.col("_bin") == F.floor(F.greatest(F.col("_s"), F.col("r_start")) / F.col("_w")))
    )
    return joined.where(hit).select(*left.columns, "r_start", "r_end", *extra)


def label_windows(windows: DataFrame, elements: DataFrame) -> DataFrame:
    """``windows`` plus the union of classes of all overlapping elements; empty set kept."""
    flat = elements.select("chrom", "start", "end", F.explode("classes").alias("_class")).distinct()
    spans = windows.select("window_id", "chrom", "start", "end")
    hits = overlap_join(spans, flat).groupBy("window_id").agg(
        F.array_sort(F.collect_set("_class")).alias("classes")
    )
    return windows.join(hits, "window_id", "left").withColumn(
        "classes", F.coalesce("classes", F.array().cast("array<string>"))
    )


def window_labels(windows: DataFrame, elements: DataFrame) -> DataFrame:
    """Normalized (unit_id, concept_id) labels for the probing operators."""
    flat = elements.select("chrom", "start", "end", F.explode("classes").alias("concept_id")).distinct()
    spans = windows.select(F.col("window_id").alias("unit_id"), "chrom", "start", "end")
    return overlap_join(spans, flat).select("unit_id", "concept_id").distinct()


def overlapping_genes(windows: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per (window, overlapping gene); windows without a gene keep a NULL row."""
    spans = windows.select("window_id", "chrom", "start", "end")
    hits = overlap_join(spans, genes.select("gene_id", "chrom", "start", "end"))
    return windows.select("window_id").join(hits.select("window_id", "gene_id"), "window_id", "left")


def points_in_windows(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Points ``(chrom, pos, ...)`` (1-based) inside half-open windows; overlapping windows all match."""
    placed = points.withColumn("_s", F.col("pos") - 1).withColumn("_e", F.col("pos"))
    out = overlap_join(placed, windows, left_cols=("chrom", "_s", "_e"), left_length=1)
    return out.drop("_s", "_e", "r_start", "r_end")


def own_gene_labels(windows: DataFrame) -> DataFrame:
    """Windows generated per gene already carry their label."""
    return windows.select(F.col("window_id").alias("unit_id"), F.col("gene_id").alias("concept_id"))


def tile_chromosomes(chroms: DataFrame, *, size: int, stride: int, offset: int = 0) -> DataFrame:
    """Fixed windows over ``(chrom, length)``; a trailing partial window is dropped."""
    if not 0 <= offset < stride:
        raise ValueError(f"offset must lie in [0, {stride}), got {offset}")
    last = F.col("length") - size
    starts = F.when(last >= offset, F.sequence(F.lit(offset).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint")))
    tiles = chroms.select("chrom", F.explode(starts).alias("start")).withColumn("end", F.col("start") + size)
    return tiles.select(window_id(F.col("chrom"), F.col("start"), F.col("end")).alias("window_id"), "chrom", "start", "end")


def tile_genes(genes: DataFrame, chroms: DataFrame, *, size: int, stride: int, flank: int = 2000) -> DataFrame:
    """Windows over each gene plus flanks, clipped to the chromosome; ids carry the gene."""
    placed = genes.join(chroms, "chrom")
    low = F.greatest(F.lit(0), F.col("start") - flank).cast("bigint")
    last = (F.least(F.col("length"), F.col("end") + flank) - size).cast("bigint")
    starts = F.when(last >= low, F.sequence(low, last, F.lit(stride).cast("bigint")))
    tiles = placed.select("gene_id", "chrom", F.explode(starts).alias("start")).withColumn("end", F.col("start") + size)
    name = window_id(F.col("chrom"), F.col("start"), F.col("end"), F.col("gene_id"))
    return tiles.select(name.alias("window_id"), "chrom", "start", "end", "gene_id")


def remap_gene_ids(external: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes keyed by the caller's own ids, matched on the stable id.

    Two external ids with one stable id are both kept and flagged.
    """
    keyed = external.select(F.col("gene_id").alias("external_id")).distinct().withColumn(
        "_stable", stable_gene_id(F.col("external_id"))
    )
    shared = Window.partitionBy("_stable")
    keyed = keyed.withColumn("shares_stable_id", F.count(F.lit(1)).over(shared) > 1)
    return keyed.join(genes.withColumn("_stable", stable_gene_id(F.col("gene_id"))), "_stable").drop("_stable")


def genomic_verdicts(
    claims: DataFrame,
    evidence: DataFrame,
    genes: DataFrame,
    *,
    max_claims: int = 5,
    confirmed_rate: float = 0.5,
) -> DataFrame:
    """Verdict per feature: do its top windows fall inside a claimed gene?

    ``claims`` has one (feature_idx, gene_id) row per claim, duplicates counted as passed,
    and a NULL gene for a feature without claims; ``evidence`` has the top windows
    (feature_idx, window_id, optionally rank). Unparsable window ids are dropped.

    ``evidence`` of the result lists every ranked window with all genes that it overlaps,
    claimed or not, so that a status can be checked; windows without a gene stay. Windows
    are in the order of their rank, else of their id.
    """
    place = parse_window_id(F.col("window_id"))
    rank = F.col("rank").cast("bigint") if "rank" in evidence.columns else F.lit(0).cast("bigint")
    spans = evidence.select("feature_idx", "window_id", rank.alias("_rank"), place.alias("p")).where(F.col("p").isNotNull())
    spans = materialize(
        spans.select("feature_idx", "window_id", "_rank", F.element_at(F.split("p.chrom", ":"), -1).alias("chrom"), "p.start", "p.end")
    )
    counts = claims.groupBy("feature_idx").agg(F.count("gene_id").alias("n_claims"))
    wanted = claims.where(F.col("gene_id").isNotNull()).select(
        "feature_idx", stable_gene_id(F.col("gene_id")).alias("_stable")
    ).distinct()
    known = genes.select("gene_id", stable_gene_id(F.col("gene_id")).alias("_stable"), "chrom", "start", "end")
    hits = materialize(overlap_join(spans.drop("_rank"), known).select("feature_idx", "window_id", "gene_id", "_stable"))
    found = hits.groupBy("feature_idx", "window_id").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))
    told = spans.select("feature_idx", "window_id", "_rank").join(found, ["feature_idx", "window_id"], "left")
    listed = F.array_sort(F.collect_list(F.struct("_rank", "window_id", F.coalesce("genes", F.array().cast("array<string>")).alias("genes"))))
    shown = told.groupBy("feature_idx").agg(F.transform(listed, lambda w: F.struct(w["window_id"].alias("window_id"), w["genes"].alias("genes"))).alias("evidence"))
    matched = hits.join(wanted, ["feature_idx", "_stable"], "left_semi").select("feature_idx", "window_id").distinct()
    per_feature = spans.groupBy("feature_idx").agg(F.count(F.lit(1)).alias("n_windows"))
    matches = matched.groupBy("feature_idx").agg(
        F.count(F.lit(1)).alias("_m"), F.array_sort(F.collect_list("window_id")).alias("_matched")
    )
    rows = counts.join(per_feature, "feature_idx", "left").join(matches, "feature_idx", "left").join(shown, "feature_idx", "left")
    n_claims = F.col("n_claims")
    m, n = F.coalesce("_m", F.lit(0)), F.coalesce("n_windows", F.lit(0))
    rate = F.coalesce(F.try_divide(m, n), F.lit(0.0))
    promiscuous = n_claims > max_claims
    status = (
        F.when(n_claims == 0, "unverifiable")
        .when(promiscuous, "spurious")
        .when(rate >= confirmed_rate, "confirmed")
        .when(rate > 0, "plausible")
        .otherwise("spurious")
    )
    reason = (
        F.when(n_claims == 0, F.lit("no claimed genes"))
        .when(promiscuous, F.format_string("claimed by %d genes, more than %d", n_claims, F.lit(max_claims)))
        .otherwise(F.format_string("%d of %d top windows lie in a claimed gene", m, n))
    )
    unchecked = (n_claims == 0) | promiscuous
    none = F.array().cast("array<string>")
    return rows.select(
        "feature_idx",
        status.alias("status"),
        reason.alias("reason"),
        "n_claims",
        F.when(unchecked, F.lit(0.0)).otherwise(rate).alias("match_rate"),
        m.alias("n_windows_matched"),
        F.when(unchecked, none).otherwise(F.coalesce("_matched", none)).alias("matched_windows"),
        F.coalesce("evidence", F.array().cast("array<struct<window_id:string,genes:array<string>>>")).alias("evidence"),
    )


def lift_positions(positions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Convert 1-based positions between builds; NULL unless exactly one hit, same chromosome.

    ``blocks`` has (src_chrom, src_start, src_end, dst_chrom, dst_start, dst_size, strand).
    """
    spans = blocks.select(
        F.col("src_chrom").alias("chrom"), F.col("src_start").alias("start"), F.col("src_end").alias("end"),
        "dst_chrom", "dst_start", "strand", "dst_size",
    )
    keyed = positions.select("chrom", "pos").distinct()
    hits = points_in_windows_with_bounds(keyed, spans)
    shift = F.col("pos") - 1 - F.col("r_start")
    forward = F.col("dst_start") + shift
    # blocks on the reverse strand are stored in reverse-strand coordinates
    lifted = F.when(F.col("strand") == "-", F.col("dst_size") - 1 - forward).otherwise(forward) + 1
    one = hits.groupBy("chrom", "pos").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("dst_chrom").alias("_dst"),
        F.first(lifted).alias("_lift"),
        F.first("strand").alias("_strand"),
    )
    good = (F.col("_n") == 1) & (F.col("_dst") == F.col("chrom"))
    return positions.join(one, ["chrom", "pos"], "left").select(
        *positions.columns,
        F.when(good, F.col("_lift")).cast("bigint").alias("lifted_pos"),
        F.when(good, F.col("_strand")).alias("lifted_strand"),
    )


def points_in_windows_with_bounds(points: DataFrame, spans: DataFrame) -> DataFrame:
    placed = points.withColumn("_s", F.col("pos") - 1).withColumn("_e", F.col("pos"))
    return overlap_join(placed, spans, left_cols=("chrom", "_s", "_e")).drop("_s", "_e")
