"""Quality rules with suffix-array repetition (operator 10).

The words of many documents form one array in which equal words of different
documents are different symbols.  Prefix doubling sorts its suffixes; only
suffixes whose prefix still occurs twice stay in play, so unrepetitive text is
done after a few steps.  Ranks of all steps give the longest common prefix of
neighbouring suffixes.  The deepest interval of equal prefixes around a suffix
is the longest substring that starts there and occurs elsewhere in the
document; the union of these spans (from `MIN_REPEAT` words up) is the part of
the document that maximal repeats cover.

A document is rejected if the base rules fail, if more than `MAX_COVERED` of
its words lie in repeats of at least MIN_REPEAT words, or if one repeat is
longer than `MAX_REPEAT` words.

Defined results: a null or empty text has no words and fails; repeated rows
are judged alike; a null doc_id is kept as it is; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .wordhash import WordHashes, mix

#: Limits of the method: least repeat in words, largest covered share, longest repeat in words.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 0.3, 100
SYMBOL = re.compile(r"[#*$%&|<>]")
#: Words that are sorted at a time (a longer document is sorted alone).
WORDS = 400_000


def longest_repeats(key: np.ndarray) -> np.ndarray:
    """For each place of key, the length of the longest sequence that starts there and also starts elsewhere."""
    n = len(key)
    if n == 0:
        return np.zeros(0, np.int64)
    sa = np.argsort(key, kind="stable")
    head = np.r_[True, key[sa[1:]] != key[sa[:-1]]]

    def ranked(sa: np.ndarray, head: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place in `at` of the first suffix of each one's group."""
        return at[np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))]

    rank = np.empty(n, np.int64)
    rank[sa] = ranked(sa, head, np.arange(n))
    levels, k = [rank.astype(np.int32)], 1  # one word in four bytes a level, for at most log2 of the longest repeat levels
    # In play: suffixes in groups of two or more, by their places in the array.
    tail = np.r_[head[1:], True]
    at = np.flatnonzero(~(head & tail))
    while len(at):
        own = sa[at]
        nxt = own + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1 - own)
        order = np.lexsort((second, rank[own]))
        own, second = own[order], second[order]
        group = rank[own]
        head = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        sa[at] = own
        rank[own] = ranked(own, head, at)
        k *= 2
        levels.append(rank.astype(np.int32))
        tail = np.r_[head[1:], True]
        at = at[~(head & tail)]
    # Longest common prefix of neighbours with an equal first symbol, from the largest power of two down.
    i, j = sa[:-1], sa[1:]
    same = levels[0][i] == levels[0][j]
    i, j = i[same], j[same]
    size = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + size, j + size
        inside = (a < n) & (b < n)
        eq = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        size += eq << level
    best = np.zeros(n, np.int64)
    np.maximum.at(best, i, size)
    np.maximum.at(best, j, size)
    return best


def covered(best: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Whether each place lies in a repeat of at least `least` (taken as `span` long if given)."""
    start = np.flatnonzero(best >= least)
    step = np.zeros(len(best) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + (best[start] if span is None else span), -1)
    return np.cumsum(step[:-1]) > 0


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])


class Rules:
    NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")

    def __init__(self, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT):
        self.min_repeat, self.max_covered, self.max_repeat = min_repeat, max_covered, max_repeat
        self.hashes = WordHashes()

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        words = [t.encode().split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        out = {"n_words": n, "word_chars": np.array([len(t) - sum(map(t.count, common.ASCII_SPACE)) for t in texts], np.int64)}
        out["n_symbols"] = np.array([sum(map(t.count, "#*$%&|<>")) for t in texts], np.int64)
        out["n_dup_lines"] = np.array([self._dup_lines(t) for t in texts], np.int64)
        rep, cov, top = (np.zeros(len(texts), np.int64) for _ in range(3))
        first = 0
        while first < len(texts):  # groups of about WORDS words
            last = first + max(1, int(np.searchsorted(np.cumsum(n[first:]), WORDS, "right")))
            m = n[first:last]
            key = np.concatenate([self.hashes.of(w) for w in words[first:last]])
            best = longest_repeats(mix(key + np.repeat(np.arange(len(m), dtype=np.uint64), m) * np.uint64(0x9E3779B97F4A7C15)))
            ends = np.cumsum(m)
            rep[first:last] = _sums(covered(best, 3, 3), ends)
            cov[first:last] = _sums(covered(best, self.min_repeat), ends)
            full = np.flatnonzero(m)
            if len(full):
                top[first + full] = np.maximum.reduceat(best, (ends - m)[full])
            first = last
        out |= {"n_repeat_words": rep, "n_covered": cov, "longest_repeat": top}
        out["base_failed"] = (n < 50) | (100 * rep > 50 * n)
        out["kept"] = ~out["base_failed"] & (cov <= self.max_covered * n) & (top <= self.max_repeat)
        return out

    @staticmethod
    def _dup_lines(text: str) -> int:
        if "\n" not in text:
            return 0
        lines = [x for x in text.split("\n") if x.strip(common.ASCII_SPACE)]
        return len(lines) - len(set(lines))


def measure(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """doc_id, the counts, base_failed and kept, per row."""

    def run(batches):
        judge = Rules(**(rules or {}))
        for batch in batches:
            for part in common.chunks(batch):
                got = judge(common.texts_of(part))
                names = [*Rules.NAMES, "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(got[x]) for x in names]], ["doc_id", *names])

    return common.documents(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in Rules.NAMES) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    common.reach_workers(docs.sparkSession)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        judge = Rules(**(rules or {}))
        for batch in batches:
            col = batch.column(at)
            for part in common.chunks(pa.RecordBatch.from_arrays([col, pa.array(range(batch.num_rows))], ["text", "i"])):
                kept = judge(common.texts_of(part))["kept"]
                yield batch.take(part.column(1).filter(pa.array(kept)))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(common.table(spark, sf_dir, "documents"))
