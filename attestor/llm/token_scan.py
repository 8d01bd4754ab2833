"""Token counts of documents in flat, unindexed token files.

A token file is nothing but ids of a fixed width, little-endian, with an end-of-document id
behind every document. Files are cut into blocks of a fixed size that tasks read as byte
ranges; each block is searched for the end id in one vectorized comparison of aligned ids.
A document may begin in one block and end many blocks later: a prefix scan over the blocks
of a file carries the last end before each block, and the number of ends, across.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm import byte_bpe
from attestor.llm.batches import slices, text_bytes
from attestor.session import fresh_path, materialize

BLOCK_TOKENS = 1 << 20
END_ID = 50256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(df: DataFrame, ranks_path: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encode texts into one token file per task; returns ``file_no, path, n_bytes``.

    Files go to the shared folder under names of their own, and only files of tasks that
    ended are returned, so a task that is run again leaves at most an unused file.
    """
    ranks = set(byte_bpe.load_ranks(ranks_path).values())
    if max([end_id, *ranks]) >= 256**width or end_id in ranks:
        raise ValueError(f"ids up to {max([end_id, *ranks])} and end id {end_id} do not fit {width} bytes, or the end id is a token")
    folder = fresh_path(df.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = byte_bpe.tool(ranks_path)[1]
        number, path = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.bin"
        system, name = _open(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        size, end = 0, np.array([end_id], f"<u{width}")
        with system.open_output_stream(name) as out:
            for batch in slices(batches, "_text"):
                ids, bounds = cache.texts(*text_bytes(batch.column("_text")))
                closed = np.insert(ids.astype(end.dtype), bounds[1:], end[0]).tobytes()
                out.write(closed)
                size += len(closed)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, path, size)], ["file_no", "path", "n_bytes"])

    return materialize(df.select(F.col("text").alias("_text")).mapInArrow(run, "file_no bigint, path string, n_bytes bigint"))


def scan_token_files(files: DataFrame, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file_no, doc_no, start, n_tokens, closed`` per document of ``files(file_no, path, n_bytes)``.

    ``n_tokens`` leaves out the end id; positions are in tokens from the start of the file.
    Tokens behind the last end are one more document that is not ``closed``. Empty files
    hold no document. A file must hold whole ids.
    """
    step = block_tokens * width
    whole = F.when(F.col("n_bytes") % width == 0, F.col("n_bytes"))
    sized = files.select("file_no", "path", F.coalesce(whole, F.raise_error(F.lit("a token file ends inside an id"))).cast("bigint").alias("n_bytes"))
    last = F.floor((F.col("n_bytes") - 1) / step)
    blocks = sized.where("n_bytes > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _open(row["path"])
                at = row["block"] * step
                with system.open_input_file(name) as source:
                    ids = np.frombuffer(source.read_at(min(step, row["n_bytes"] - at), at), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + row["block"] * block_tokens
                columns = [[row["file_no"]], [row["block"]], [ends.tolist()]]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_no", "block", "ends"])

    spread = blocks.repartition("path", "block")
    found = materialize(spread.select("file_no", "path", "n_bytes", "block").mapInArrow(run, "file_no bigint, block bigint, ends array<bigint>"))
    before = Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("file_no", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    carried = slim.select(
        "file_no", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"),
    )
    docs = found.join(carried, ["file_no", "block"]).select("file_no", "skip", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.element_at("ends", F.col("i")) + 1)
    closed = docs.select("file_no", (F.col("skip") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = slim.groupBy("file_no").agg(F.sum("n").alias("doc_no"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    tail = totals.join(sized.select("file_no", (F.col("n_bytes") / width).cast("bigint").alias("size")), "file_no").where("start < size")
    return closed.unionByName(tail.select("file_no", "doc_no", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def token_counts(df: DataFrame, ranks_path: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Write all texts of ``df(text, ...)`` to token files and count them back from there.

    One row per document in the order of its file. Null and empty texts are documents of
    no tokens; repeated rows are documents of their own. An empty table gives an empty
    result; other columns are not looked at.
    """
    return scan_token_files(write_token_files(df, ranks_path, end_id, width), end_id, width)
