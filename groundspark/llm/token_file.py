"""Token ids in Parquet list columns (operator 7).

One row per document: part, doc_id, begin (ids before it in its part),
n_tokens, ids.  Rows are in ascending doc_id order within a part, and parts
hold ascending ranges of doc_id.  ids are delta packed (no dictionary), the
short columns keep their dictionaries; row groups and pages are small, and the
writer adds page indexes, so a reader of some documents or of some columns
touches only their pages.

Defined results: a null or empty text has the end id alone; a null doc_id
comes first; rows of one doc_id stand beside each other in any order, and
repeated rows as often as they occur; an empty table
gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: End id that closes each document.
END = 0
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2000
SCHEMA = "part int, doc_id long, begin long, n_tokens long, ids array<int>"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END, n_parts: int | None = None) -> None:
    """Encode every document once and write its ids at path."""
    spark = docs.sparkSession
    tok = tokenizer or bpe.default_tokenizer()

    def run(batches):
        enc = bpe.kept_encoder((tok, "library"), lambda: bpe.library_encoder(tok, bpe.Vocabulary(tok)))
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in common.chunks(batch):
                ids, n = enc.texts(common.texts_of(piece))
                ends = np.cumsum(n)
                if end is not None:
                    ids, n, ends = np.insert(ids, ends, end), n + 1, ends + np.arange(1, len(n) + 1)
                begin = before + ends - n
                before += int(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), piece.column(0), pa.array(begin), pa.array(n), lists], ["part", "doc_id", "begin", "n_tokens", "ids"])

    # The random key splits a doc_id that many rows carry (null among them); only doc_ids are read to find the ranges.
    d = common.documents(docs).repartitionByRange(n_parts or common.parts(spark), F.col("doc_id").asc_nulls_first(), F.rand(7)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text"))
    (
        d.mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", 1)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", "false")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def read_ids(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "ids"), first: int | None = None, last: int | None = None) -> DataFrame:
    """Some columns of the documents first <= doc_id <= last; the bounds reach the pages."""
    d = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        d = d.where(F.col("doc_id") >= first)
    if last is not None:
        d = d.where(F.col("doc_id") <= last)
    return d.select(*columns)


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    d = spark.read.schema(SCHEMA).parquet(path)
    totals = d.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part, a few thousand at most
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches):
        for b in batches:
            ids = b.column(4)
            at, raw = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8))
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(crc, pa.int64())], ["part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    got = d.mapInArrow(run, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return got.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-ids")
    write_ids(common.table(spark, sf_dir, "documents"), path)
    return index(spark, path)
