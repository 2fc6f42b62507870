"""Tokens of each field of a document (operator 4).

The fields are joined to one string, the string is encoded once, and each
token goes to one field by its character span.  A field's section runs from
its first character to the next field's first character, so a separator
belongs to the field before it and sections leave no gap.

Rule for a token that crosses a boundary (`rule`): "most" - the section that
holds most of its characters, the earliest of several; "first" - the section
of its first character; "last" - the section of its last character.  Each
token counts once, so the fields' counts add up to the document's.

Defined results: a null field is an empty one and has 0 characters, though its
separator may hold a token; repeated rows are counted alike; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

FIELDS, SEPARATOR = ("source", "lang", "text"), "\n"


def char_spans(text: str, ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and last character + 1 of each token; a token inside a character has all of it."""
    ends = np.cumsum(width[ids])
    begins = ends - width[ids]
    raw = text.encode()
    if len(raw) == len(text):
        return begins, ends
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[begins], char[ends - 1] + 1


def owners(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Index of the section that gets each token; sections begin at `starts` (ascending, the first at 0)."""
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        edges = np.r_[begin[i], starts[first[i] + 1 : last[i] + 1], end[i]]
        out[i] = first[i] + int(np.argmax(np.diff(edges)))
    return out


def token_counts(docs: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = FIELDS, separator: str = SEPARATOR, rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """key, field, n_chars, n_tokens: a row for each field of each row of docs."""
    if rule not in ("most", "first", "last"):
        raise ValueError(f"unknown rule {rule!r}")
    path = tokenizer or bpe.default_tokenizer()
    d = common.pick(docs, key, *fields).select(F.col(key).alias("key"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])
    kind = d.schema["key"].dataType
    d = d.select("key", F.concat_ws(separator, *[f"f{i}" for i in range(len(fields))]).alias("text"), F.array(*[F.length(f"f{i}") for i in range(len(fields))]).alias("sizes"))

    def run(batches):
        enc, vocabulary = bpe.kept_encoder((path, "spans"), lambda: (bpe.library_encoder(path, v := bpe.Vocabulary(path)), v))
        width = np.array([len(b) for b in vocabulary.bytes], np.int64)
        for batch in batches:
            for part in common.chunks(batch):
                texts = common.texts_of(part)
                ids, n = enc.texts(texts)
                counts = np.zeros((len(texts), len(fields)), np.int64)
                sizes = np.array(part.column(2).to_pylist(), np.int64).reshape(len(texts), len(fields))
                at = 0
                for k, text in enumerate(texts):
                    begin, end = char_spans(text, ids[at : at + n[k]], width)
                    at += n[k]
                    starts = np.r_[0, np.cumsum(sizes[k, :-1] + len(separator))]
                    counts[k] = np.bincount(owners(begin, end, starts, rule), minlength=len(fields))
                rows = np.repeat(np.arange(len(texts)), len(fields))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(list(fields) * len(texts), pa.string()), pa.array(sizes.ravel()), pa.array(counts.ravel())], ["key", "field", "n_chars", "n_tokens"])

    out = d.mapInArrow(run, f"key {kind.simpleString()}, field string, n_chars long, n_tokens long")
    return out.withColumnRenamed("key", key)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
