"""Lines that many documents share (operator 3), by DataFrame functions alone.

Defined results: a null or empty text is one empty line.  A line's key is the
line without the white space at both ends and with A-Z in lower case; shorter
keys than `min_chars` never go.  Documents are counted by distinct doc_id (a
null counts as the least long).  Rows with equal doc_id and text get the
same result; rows with equal doc_id and different texts count as one document
and each keeps the places of its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_DOCS = 40, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    cut = F.btrim(line, F.lit(common.ASCII_SPACE))
    return F.when(F.length(cut) == F.octet_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """id, no_id, c (with id, the row's key in shuffles), lines."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    return d.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.crc32("text").alias("c"), F.split("text", "\n", -1).alias("lines"), *d.columns[2:])


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """id, c, p (place), h and g (128 bits of the key's hash): a row for each line whose key is long enough."""
    lines = _keyed(docs).select("id", "c", F.posexplode("lines").alias("p", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("id", "c", "p", line_key(F.col("line")).alias("k"))
    return keys.where(F.length("k") >= min_chars).select("id", "c", "p", F.xxhash64("k").alias("h"), F.xxhash64(F.lit(7), "k").alias("g"))


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, c, at (places of the lines to drop): a row for each document that loses any.

    Long lines go once to a table of hashes in the shared folder: counting and
    matching then read 40 bytes a line, not the texts.  Distinct documents are
    counted with partial sums by (key, document) and by key, and the few keys
    over the threshold are joined back, so a key that most documents hold is
    never gathered in one task (Spark splits that key's side of the join).
    """
    e, _ = common.stored(long_lines(docs, min_chars), "lines")
    shared = e.groupBy("h", "g").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    shared, _ = common.stored(shared.select("h", "g", "last"), "shared")  # so that both sides of the join are plain exchanges, which Spark can split
    hit = e.join(shared, ["h", "g"]).where(F.col("id") != F.col("last"))
    return hit.groupBy("id", "c").agg(F.collect_set("p").alias("at"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: Column | None = None) -> DataFrame:
    """doc_id, text (kept lines joined by \\n), n_lines, n_dropped, and carry, per row of docs."""
    docs = common.pick(docs, "doc_id", "text") if carry is None else docs.select("doc_id", "text", carry.alias("carry"))
    d = _keyed(docs, *docs.columns[2:])
    j = d.join(drops(docs, min_chars, min_docs), ["id", "c"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("at"))
    kept = F.when(F.col("at").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get(F.col("lines"), i)))
    return j.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"),
        *docs.columns[2:],
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(common.table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM docs),
k AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM e),
shared AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.last <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY p) FILTER (WHERE s.last IS NULL OR s.last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN shared s ON k.k = s.k GROUP BY k.doc_id
"""
