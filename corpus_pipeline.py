"""Five stages from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result as Parquet in the shared folder and reads it again for the
next.  All but the last return the columns of docs.  A document is a row's
doc_id and text; extra columns, also ones whose names clash or hold dots, pass
through.  An empty table gives an empty one.  Each stage's docstring says what
nulls and repeated rows give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import bpe, common, decontaminate, line_dedup, quality, simhash


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (all columns by position, so that clashing or dotted names have no effect), h (row_key)."""
    common.reach_workers(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    d = plain.select(*[F.col(f"c{names.index(n)}").alias(n) for n in ("doc_id", "text")], F.struct(*plain.columns).alias("row"))
    return d.withColumn("h", common.row_key())


def _back(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("row.*").toDF(*names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go (null and empty texts among them); repeated rows are judged alike."""
    return quality.keep_good(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared long lines go; n_chars follows the text.

    Documents that have no line left stay, as empty texts, and so do null
    texts.  Repeated rows lose the same lines; null doc_ids count as one
    document.
    """
    names = docs.columns
    out = line_dedup.line_dedup(_rows(docs), carry=F.col("row"))
    new = {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("text").cast(docs.schema[names.index("n_chars")].dataType)
    at = {names.index(n): c for n, c in new.items()}
    return out.select(*[at.get(i, F.col("carry")[f"c{i}"]).alias(f"c{i}") for i in range(len(names))]).toDF(*names)


def _by_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on doc_id and the text's hash."""
    k = keys.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    return rows.join(k, rows["doc_id"].eqNullSafe(k["_id"]) & (rows["h"] == k["_h"]), how)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays (a null id only if there is no other), as one row.

    Repeated rows and equal texts are copies; of rows with equal doc_id and
    text the least stays.  Null and empty texts are copies of each other.
    Different texts of one doc_id are different documents.
    """
    rows = _rows(docs)
    stays = _by_key(rows, simhash.near_duplicates(docs), "left_semi")
    return _back(stays.groupBy("doc_id", "h").agg(F.min("row").alias("row")), docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, all of them if repeated; null texts stay."""
    found = decontaminate.leaks(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", "h").distinct()
    return _back(_by_key(_rows(docs), found, "left_anti"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_decode(docs, keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", shared_lines),
    ("near-duplicates", near_copies),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

#: No SQL: prefix-doubled suffix arrays, XXH64 fingerprints and BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs, path = common.stored(out, "stage-" + name.replace(" ", "-"))
    return docs
