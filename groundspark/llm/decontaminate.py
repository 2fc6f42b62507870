"""Benchmark items inside training documents, by BM25 and block-max WAND (operator 6).

The test items are indexed: BM25 impacts, each divided by the item's score
against itself, so a passage that holds all terms of an item scores 1.  Every
document is a row of overlapping passages, each long enough that an item lies
whole in one of them.  A passage is looked up with block-max WAND: postings
are in order of item, in blocks with their largest impact, and an item is
scored only if the blocks' bounds can reach the threshold.  Before that, the
first bound is taken for all words of a document at once: an item can reach
the threshold only if the passage has one of its essential terms (the fewest
of its rarest terms whose rest stays below the threshold), and only if the
impacts of its terms anywhere in the document, and then in the passage, add up
to the threshold.  Passages for which no item passes these bounds are settled.

All items at or over the threshold are verified: the question (all sentences
but the last) must have at least `overlap` of its five-word shingles in the
passage, and so must the answer (the last sentence; with one sentence, the
question is the whole item).  A part of fewer than five words is one shingle.

The benchmark is collected in blocks of at most BLOCK_BYTES of text, and each
block is sent to the workers, which build its index once a process; the
documents are read once for each block.  Document frequencies, mean length and the longest item are counted
over the whole benchmark, so the number of blocks has no effect on results.

Defined results: null or empty documents and items match nothing, nor do
items without a letter or digit; repeated items are reported each; repeated
documents give repeated rows; empty tables give no rows.
"""

from __future__ import annotations

import bisect
import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, SHINGLE = 0.7, 0.8, 5
#: Postings of a block; bytes of item text that are indexed at a time.
BLOCK, BLOCK_BYTES = 64, 8 << 20
#: ASCII apart from letters and digits counts as white space; A-Z were lower-cased before.
PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def terms(text: str) -> list[bytes]:
    return text.lower().encode().translate(PLAIN).split()


def question_and_answer(text: str) -> list[list[bytes]]:
    parts = [p for s in SENTENCE.split(text) if (p := terms(s))]
    return [[t for p in parts[:-1] for t in p], parts[-1]] if len(parts) > 1 else parts


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Index:
    """Impacts of items by term, in blocks."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, whole: tuple[int, int, int, dict[bytes, int]] | None = None):
        """whole: items, words, words of the longest item and items by term of a benchmark that the items are a part of."""
        kept = [(i, t, w) for i, t in items if (w := terms(t or ""))]
        self.items, self.threshold = [i for i, _, _ in kept], threshold
        self.parts = [[shingles(p) for p in question_and_answer(t)] for _, t, _ in kept]
        df = Counter(t for _, _, w in kept for t in set(w))
        n, total, self.longest = len(kept), sum(len(w) for _, _, w in kept), max([1, *(len(w) for _, _, w in kept)])
        if whole:
            n, total, self.longest = whole[:3]
            df = {t: whole[3][t] for t in df}
        mean = total / max(1, n)
        self.term = {t: k for k, t in enumerate(df)}
        self.posts: list[tuple[list[int], list[float]]] = [([], []) for _ in df]
        essential = np.zeros(len(df) + 1, bool)
        for item, (_, _, words) in enumerate(kept):
            tf = Counter(words)
            gain = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for t, f in tf.items()}
            own_score = sum(gain.values())
            rest = 1.0
            for t in sorted(gain, key=lambda t: (df[t], -gain[t], t)):
                k = self.term[t]
                self.posts[k][0].append(item)
                self.posts[k][1].append(gain[t] / own_score)
                if rest >= threshold - 1e-9:
                    essential[k] = True
                    rest -= gain[t] / own_score
        self.essential = essential
        own: list[tuple[list[int], list[float]]] = [([], []) for _ in kept]
        for t, post in enumerate(self.posts):
            for i, w in zip(*post, strict=True):
                own[i][0].append(t)
                own[i][1].append(w)
        self.size = np.array([len(t) for t, _ in own], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat_terms = np.array([t for ts, _ in own for t in ts], np.int64)
        self.flat_weights = np.array([w for _, ws in own for w in ws])
        self.present = np.zeros(len(df) + 1, bool)
        self.most = [max(w) for _, w in self.posts]
        self.blocks = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for _, w in self.posts]

    def reach(self, candidates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The candidates whose impacts over the terms in ids add up to the threshold."""
        if not len(candidates):
            return candidates
        self.present[ids] = True
        self.present[-1] = False  # words of no item
        size = self.size[candidates]
        at = np.arange(int(size.sum())) + np.repeat(self.begin[candidates] - (np.cumsum(size) - size), size)
        total = np.add.reduceat(self.flat_weights[at] * self.present[self.flat_terms[at]], np.cumsum(size) - size)
        self.present[ids] = False
        return candidates[total >= self.threshold - 1e-6]

    def search(self, query: list[int], least: float | None = None) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least the threshold, for distinct terms."""
        least = (self.threshold if least is None else least) - 1e-9
        found, end = [], len(self.items)
        lists = [[self.posts[t][0][0], 0, *self.posts[t], self.most[t], self.blocks[t]] for t in query]
        while True:
            lists.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c[4]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0 or (item := lists[pivot][0]) == end:
                return found
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # Bounds of the blocks that would hold the item, and the first item after any of these blocks.
            bound, after = 0.0, end if pivot + 1 == len(lists) else lists[pivot + 1][0]
            for c in lists[: pivot + 1]:
                p = bisect.bisect_left(c[2], item, c[1])
                if p < len(c[2]):
                    b = p // BLOCK
                    bound += c[5][b]
                    if (b + 1) * BLOCK < len(c[2]):
                        after = min(after, c[2][(b + 1) * BLOCK])
            if bound < least:
                to = max(after, item + 1)
            elif lists[0][0] == item:
                score = sum(c[3][c[1]] for c in lists[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            for c in lists[: pivot + 1]:
                if c[0] < to:
                    c[1] = bisect.bisect_left(c[2], to, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else end

    def matches(self, text: str, overlap: float = OVERLAP) -> dict[int, tuple[float, float]]:
        """item -> (best score, overlap of its weaker part) over the passages of a text, for verified items."""
        words = terms(text)
        ids = np.fromiter(map(self.term.get, words, [-1] * len(words)), np.int64, len(words))
        hits = np.flatnonzero(self.essential[ids])
        if not len(hits):
            return {}
        named = np.unique(np.array([i for t in np.unique(ids[hits]).tolist() for i in self.posts[t][0]], np.int64))
        if not len(named := self.reach(named, ids)):
            return {}
        step = self.longest
        last = max(0, -(-(len(words) - 2 * step) // step))  # of the passages [k * step, (k + 2) * step)
        ks = np.unique(np.r_[hits // step, np.maximum(hits // step - 1, 0)])
        out: dict[int, tuple[float, float]] = {}
        for k in np.unique(np.minimum(ks, last)).tolist():
            part = ids[k * step : (k + 2) * step]
            if not len(self.reach(named, part)):
                continue
            got = self.search(np.unique(part[part >= 0]).tolist())
            if not got:
                continue
            seen = shingles(words[k * step : (k + 2) * step])
            for item, score in got:
                share = min(self._share(p, seen, words[k * step : (k + 2) * step]) for p in self.parts[item])
                if share >= overlap - 1e-9:
                    out[item] = max(out.get(item, (0.0, 0.0)), (score, share))
        return out

    @staticmethod
    def _share(part: set[bytes], seen: set[bytes], words: list[bytes]) -> float:
        one = next(iter(part))
        if len(part) == 1 and (n := one.count(b" ") + 1) < SHINGLE:
            return float(one in shingles(words, n))
        return len(part & seen) / len(part)


def _counts(b: DataFrame) -> DataFrame:
    """term, items (that hold it); for the null term: all items, their words, the words of the longest."""

    def run(batches):
        for batch in batches:
            df, sizes = Counter(), []
            for text in common.texts_of(batch):
                if words := terms(text):
                    df.update(set(words))
                    sizes.append(len(words))
            k = len(df)
            cols = [pa.array([*df, None], pa.binary())] + [pa.array(x, pa.int64()) for x in ([*df.values(), len(sizes)], [0] * k + [sum(sizes)], [0] * k + [max(sizes, default=0)])]
            yield pa.RecordBatch.from_arrays(cols, ["term", "items", "words", "longest"])

    each = b.select("text").mapInArrow(run, "term binary, items long, words long, longest long")
    return each.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def _blocks(benchmark: DataFrame):
    """(item_id, text) lists of about BLOCK_BYTES each, and the whole benchmark's figures; the table is dealt out by a hash of item_id and text."""
    common.reach_workers(benchmark.sparkSession)
    b = common.pick(benchmark, "item_id", "text").where(F.col("text").isNotNull())
    n = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n // (BLOCK_BYTES // 2)))
    if blocks > 1:
        counts, _ = common.stored(_counts(b), "benchmark-terms")
        whole = counts.where(F.col("term").isNull()).first()
    for k in range(blocks):
        part = b if blocks == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        if rows := [(r.item_id, r.text) for r in part.collect()]:  # about BLOCK_BYTES / 2
            figures = None
            if blocks > 1:
                own = _counts(part).where(F.col("term").isNotNull()).select("term")
                figures = (whole.items, whole.words, max(1, whole.longest), {bytes(r.term): r.items for r in counts.join(own, "term", "left_semi").select("term", "items").collect()})
            yield sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), figures


_KEPT: dict[str, Index] = {}


def _kept_index(name: str, build) -> Index:
    """One index for each worker process, so that later tasks of a block find it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = build()
    return _KEPT[name]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, h (row_key), item_id, score (BM25 over the item's own), overlap: a row for each item that a document holds."""
    schema = "doc_id long, h long, item_id long, score double, overlap double"
    spark, d = docs.sparkSession, common.documents(docs)
    d = d.select("doc_id", common.row_key().alias("h"), "text")
    out = None
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent, name=uuid.uuid4().hex):
            index = _kept_index(name, lambda: Index(*sent.value[:1], threshold, *sent.value[1:]))
            for batch in batches:
                rows = []
                for part in ([] if not index.items else common.chunks(batch)):
                    keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for key, text in zip(keys, common.texts_of(part), strict=True):
                        rows += [(*key, index.items[k], *v) for k, v in sorted(index.matches(text, overlap).items())]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()] * 2, strict=True)], ["doc_id", "h", "item_id", "score", "overlap"])

        one = d.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 9).alias("score"), F.round("overlap", 9).alias("overlap"))
