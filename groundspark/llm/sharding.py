"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (operator 2).

Rows lie in buckets by a hash of all their columns and of an ordinal that
tells equal rows apart, so every row has draws of its own, however often it is
repeated.  The driver draws the matrix bucket x shard of row counts as a random
permutation of all rows would give it (multivariate hypergeometric, one bucket
after the other), from the buckets' row counts alone.  Each bucket is then
permuted on its own, its first rows go to shard 0 as the matrix says, the next
to shard 1 and so on, and each shard is permuted again.  All row work is
DataFrame functions; texts are read once and only their size and checksum move.

Equal rows are counted (with partial sums) and dealt out again in pieces of
PIECE rows, so a row that makes up a third of the table is in no task alone.

The law is `rows`: shards differ by one row at most.  It spreads rows
uniformly, so equal texts (a group) are not kept in one shard.

Defined results: a null text has size 1 and the checksum of no bytes; null
doc_ids and repeated rows are rows like any other; an empty table gives no
rows.  The result depends on the rows, the seed and the number of shards, not
on the partitions of the input.  Columns are taken by position, so names that
clash with shard, slot or each other have no effect.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N_SHARDS, SEED = 16, 20240229
#: Rows of a bucket at least, and most buckets: the matrix has at most MOST_BUCKETS x shards cells.
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 14
#: Equal rows that are told apart in one piece.
PIECE = 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows that are drawn without replacement are good.

    Inversion from logarithms of the ratios of neighbouring probabilities, 12
    standard deviations around the mode (what lies beyond has a probability
    below 1e-30), in double precision and alike for all sizes.
    """
    if n == 0 or good == 0 or bad == 0:
        return min(n, good)
    total = good + bad
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    mode = (n + 1) * (good + 1) // (total + 2)
    lo, hi = max(0, n - bad, mode - int(12 * sd) - 12), min(n, good, mode + int(12 * sd) + 12)
    k = np.arange(lo, hi, dtype=np.float64)
    ratio = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    w = np.r_[0.0, np.cumsum(ratio)]
    p = np.cumsum(np.exp(w - w.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def matrix(rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each bucket that go to each shard, as under a uniform permutation of all rows."""
    rng, total = np.random.default_rng(seed), sum(rows)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    out = []
    for n in rows:
        row, rest, left = [], sum(room), n
        for s in range(n_shards):
            k = hypergeometric(rng, room[s], rest - room[s], left)
            row.append(k)
            rest, left = rest - room[s], left - k
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """df with `_o`: 0, 1, ... within each group of equal rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    pieces = groups.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {PIECE}"))))
    pieces = pieces.repartition(*[F.col(c) for c in df.columns], "_p")
    size = F.least(F.lit(PIECE).cast("long"), F.col("_n") - F.col("_p") * PIECE)
    return pieces.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), size - 1))).select(*df.columns, (F.col("_p") * PIECE + F.col("_i")).alias("_o"))


def shard_rows(df: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard (0 .. n_shards - 1) and slot (0 .. size of the shard - 1).

    df should be narrow (it moves three times) and is read twice; its columns
    are of types that can be grouped.
    """
    spark, names = df.sparkSession, df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def draw(step: int) -> Column:
        return F.xxhash64(F.lit(seed * 8 + step), *plain.columns, "_o")

    n = plain.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    b, _ = common.stored(numbered(plain).withColumn("_b", F.pmod(draw(0), F.lit(buckets)).cast("int")), "buckets")
    tie = [draw(3), *[F.col(k) for k in plain.columns], F.col("_o")]
    rows = {r["_b"]: r["count"] for r in b.groupBy("_b").count().collect()}  # at most MOST_BUCKETS rows
    cuts = matrix([rows.get(i, 0) for i in range(buckets)], n_shards, seed)
    ends = [np.cumsum(c).tolist() for c in cuts]
    m = spark.createDataFrame(list(enumerate(ends)), "_b int, _ends array<long>")  # at most MOST_BUCKETS rows
    # Permute in the bucket; a row's shard is how many ends its place has reached.
    at = b.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(draw(1), *tie)))
    to = at.join(F.broadcast(m), "_b").withColumn("_s", F.size(F.filter("_ends", lambda e: e < F.col("_r"))))
    # Permute in the shard: cells by the leading bits of a second draw, rows of a cell by all of them.
    cells = max(1, buckets // n_shards)
    to = to.drop("_b", "_r", "_ends").withColumn("_u", draw(2)).withColumn("_cell", F.expr(f"cast(floor((_u / 18446744073709551616D + 0.5D) * {cells}) as int)"))
    ranked = to.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_cell").orderBy("_u", *tie)))
    sizes = to.groupBy("_s", "_cell").agg(F.count("*").alias("_n"))
    base = sizes.select("_s", "_cell", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_cell")) - F.col("_n")).alias("_base"))
    out = ranked.join(F.broadcast(base), ["_s", "_cell"])  # at most MOST_BUCKETS cells
    return out.select(*plain.columns, "_s", (F.col("_base") + F.col("_k") - 1).alias("_slot")).toDF(*names, "shard", "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = common.documents(common.table(spark, sf_dir, "documents"))
    slim, _ = common.stored(d.select("doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32("text").alias("text_crc32")), "rows")
    s = shard_rows(slim)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
