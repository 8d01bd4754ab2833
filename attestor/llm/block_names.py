"""Exact deduplication by deterministic block naming; DataFrame functions only.

A text is normalized, cut into blocks of a fixed size, and every block is replaced by an
integer name: blocks are dealt into numbered bins by a checksum and sorted inside their bin,
and the name is bin and place. Different blocks never share a name, equal blocks always do.
Adjacent names are then paired and each pair is named in the same way, until one name is
left: the identity of the text. No checksum decides that two texts are equal.

Texts whose length and checksum no other text has cannot equal any other text, so only the
rest is cut into blocks; that keeps the blocks of unique texts out of the shuffles.

Hot groups: blocks, pairs and identities are reduced to distinct values map-side before
they are named; names are joined back to rows by equality of keys, where both sides are
plain shuffles that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.session import materialize

WHITE = " \t\n\x0b\f\r"
BLOCK = 4096
BINS = 1 << 43
PLACES = 1 << 20


def normalized(text: Column) -> Column:
    """The text without white space ``[\\x20\\x09-\\x0D]``; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Name of every distinct key: bin by checksum, place by sorting inside the bin."""
    binned = distinct.withColumn("_bin", F.pmod(F.xxhash64(*keys), F.lit(BINS)))
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(*keys)) - 1
    fits = F.when(F.col("_place") < PLACES, F.col("_bin") * PLACES + F.col("_place"))
    return binned.withColumn("_place", place).select(
        *keys, F.coalesce(fits, F.raise_error(F.lit("a bin of block names is full"))).cast("bigint").alias("name")
    )


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace ``keys`` of every row by their name."""
    names = materialize(_names(rows.select(*keys).distinct(), keys))
    return materialize(rows.join(names, keys).select("_row", "_pos", "_last", "name"))


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Collision-free identity per row of ``texts(_row, _norm)``.

    Returns ``_row, level, name``: two rows agree in level and name exactly when their
    texts are equal. An empty text is one empty block. ``_row`` must be unique.
    """
    # One pass over a text gives all its blocks; cutting them one by one would walk it anew each time.
    parts = F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    parts = F.when(F.col("_norm") == "", F.array(F.lit(""))).otherwise(parts)
    cut = texts.select("_row", parts.alias("_parts")).select("_row", (F.size("_parts") - 1).alias("_last"), F.posexplode("_parts").alias("_pos", "_block"))
    current = _named(cut, ["_block"])
    longest = current.agg(F.max("_last")).first()[0] or 0
    done = []
    for level in range(longest.bit_length() + 1):
        # A row with one name left keeps it; the rest is paired.
        done.append(current.where("_last = 0").select("_row", F.lit(level).alias("level"), "name"))
        if level == longest.bit_length():
            break
        halves = [F.expr(f"{c} div 2").cast("int").alias(c) for c in ("_pos", "_last")]
        sides = [F.max(F.when(F.col("_pos") % 2 == s, F.col("name"))).alias(n) for s, n in ((0, "_left"), (1, "_right"))]
        pairs = current.where("_last > 0").groupBy("_row", *halves).agg(*sides)
        current = _named(materialize(pairs.withColumn("_right", F.coalesce("_right", F.lit(-1)))), ["_left", "_right"])
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _annotated(df: DataFrame, carry: list[str]) -> DataFrame:
    """Rows with their own number and, where another row might be equal, their text."""
    norm = normalized(F.col("text"))
    sized = df.select(
        F.col("doc_id").alias("_doc"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"),
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("_points"),
        norm.alias("_norm"),
    ).withColumns({"_len": F.char_length("_norm"), "_sum": F.xxhash64("_norm")})
    shared = materialize(sized.groupBy("_len", "_sum").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    marked = sized.join(shared.withColumn("_hit", F.lit(True)), ["_len", "_sum"], "left")
    return materialize(
        marked.select(
            F.monotonically_increasing_id().alias("_row"),
            "_doc",
            "_carry",
            "_points",
            F.sha2(F.col("_norm"), 256).alias("_sha"),
            F.when(F.col("_hit"), F.col("_norm")).alias("_norm"),
        )
    )


def _resolved(rows: DataFrame, block: int) -> DataFrame:
    """``_row, _best, _size`` of the annotated rows that may have an equal: the struct of the
    row that stays and the size of the group."""
    open_rows = rows.where(F.col("_norm").isNotNull())
    names = identities(open_rows.select("_row", "_norm"), block)
    named = materialize(open_rows.select("_row", "_doc", "_points").join(names, "_row"))
    best = F.min(F.struct(-F.col("_points"), F.col("_doc").isNull(), F.col("_doc"), F.col("_row"))).alias("_best")
    groups = materialize(named.groupBy("level", "name").agg(best, F.count(F.lit(1)).alias("_size")))
    return materialize(named.select("_row", "level", "name").join(groups, ["level", "name"]).select("_row", "_best", "_size"))


def exact_groups(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df(doc_id, text, ...)`` with the row that stands for its text.

    Texts are equal when identical after deleting white space. Of equal texts the row with
    the most code points in the original text stays, then the smallest ``doc_id`` (a null
    ``doc_id`` comes last), then one of several identical rows. Returns ``doc_id, keep_id,
    group_size, kept, text_sha256``. Null texts are empty texts, and all of them are equal;
    an empty table gives an empty result; further columns of ``df`` are not looked at.
    """
    rows = _annotated(df, [])
    alone = rows.where(F.col("_norm").isNull()).select(
        F.col("_doc").alias("doc_id"),
        F.col("_doc").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    shared = rows.where(F.col("_norm").isNotNull()).drop("_norm").join(_resolved(rows, block), "_row")
    return alone.unionByName(
        shared.select(
            F.col("_doc").alias("doc_id"),
            F.col("_best._doc").alias("keep_id"),
            F.col("_size").alias("group_size"),
            (F.col("_best._row") == F.col("_row")).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def deduplicated(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows are taken out by the stored list of those that go, so texts are only shuffled if
    that list is long.
    """
    columns = df.columns
    rows = _annotated(df, columns)
    gone = materialize(_resolved(rows, block).where(F.col("_best._row") != F.col("_row")).select("_row"))
    kept = rows.join(gone, "_row", "left_anti")
    return kept.select(*[F.col(f"_carry.c{i}").alias(c) for i, c in enumerate(columns)])


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r
"""
