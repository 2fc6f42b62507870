"""Repeated word sequences, removed by recompression (operator 1).

Names.  The words of a text are the symbols of level 0.  Each round first
names runs of equal symbols and then pairs: a bit of a symbol's name makes it
a left or a right one, and a left symbol followed by a right one becomes one
symbol.  A new name is a hash of the parts' names, so equal sequences get equal
names in every document and on every executor without exchange.  Every symbol
carries the span of words that decided it (its own words and the neighbours
that kept it from merging otherwise); wherever those words occur, the symbol
occurs.

Anchors.  A window's anchor is the longest symbol whose deciding span lies in
the window (ties by name); a level-0 word always does, so every window has
one, and equal windows have equal anchors.  The name of the whole document is
the symbol of the last level.

Spark rounds.  (1) Names of anchors and of whole documents are dealt out by
name; a name met once has no repeat, a whole document whose name has an
earlier document is a copy.  (2) Only windows under a repeated anchor, in
documents that are not copies, are hashed (96 bits) and dealt out by hash;
all but the earliest are repeats.  (3) Documents are joined with their repeat
windows and lose the words these cover.  Before each deal a worker reduces
what it holds of one name or hash to a single row (its earliest), and sends
what is already settled past the comparison, so a passage that most documents
share puts no more rows into one group than there are worker chunks.

Two different windows can be taken for equal only if 64-bit hashes of words or
96-bit hashes of windows collide; a collision of names alone costs work, not
correctness.

Defined results: a null or empty text has no words; texts shorter than a
window lose nothing unless covered (they can't be); rows with equal doc_id and
text are one document; of rows with equal doc_id and different texts, equal
windows at one place count as neither earlier; a null doc_id counts as the
least long; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .wordhash import Rolling, WordHashes, mix

WIDTH, ROUNDS = 20, 4
#: Rows that a worker reduces together.
CHUNK_ROWS = 400_000
#: Text that a worker parses at a time.
PART_BYTES = common.CHUNK_BYTES
ROOT = np.uint64(63)  # length code of a whole document's name
LEAST_ID = -(1 << 63)
U = np.uint64


def anchors(h: np.ndarray, doc: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor's name for the window that starts at each place; windows that leave their document get rubbish.

    h: hashes of words; doc: index of the document of each word.
    """
    n = len(h)
    best = [np.zeros(n + 1, U) for _ in range(width)]  # by length of the deciding span, by its first word

    def offer(name: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        span = hi - lo
        key = (np.minimum(size, 62).astype(U) << U(58)) | (mix(name) >> U(6))
        for d in range(width):
            at = np.flatnonzero(span == d)
            np.maximum.at(best[d], lo[at], key[at])

    name, lo, hi, own = h.copy(), np.arange(n), np.arange(n), doc
    first, last = lo.copy(), hi.copy()
    best[0][:n] = (U(1) << U(58)) | (mix(name) >> U(6))
    far = np.int64(1 << 40)  # decided by the end of the document: in no window
    for r in range(rounds):
        if len(name) < 2:
            break
        # Runs of equal symbols get a name, decided by the symbols at both ends; pairs are still made of the single ones,
        # so that a pair doesn't depend on what stands beside it.
        joined = (name[1:] == name[:-1]) & (own[1:] == own[:-1])
        if joined.any():
            head = np.flatnonzero(np.r_[True, ~joined] & np.r_[joined, False])
            tail = np.flatnonzero(np.r_[False, joined] & np.r_[~joined, True])
            made = mix(name[head] + mix((tail - head).astype(U) + U(1000 + r)))
            left = np.where((head > 0) & (own[np.maximum(head - 1, 0)] == own[head]), lo[np.maximum(head - 1, 0)], -far)
            nxt = np.minimum(tail + 1, len(name) - 1)
            right = np.where((nxt > tail) & (own[nxt] == own[tail]), hi[nxt], far)
            l2, h2 = np.minimum(np.minimum.reduceat(np.r_[lo, far], np.c_[head, tail + 1].ravel())[::2], left), np.maximum(np.maximum.reduceat(np.r_[hi, -far], np.c_[head, tail + 1].ravel())[::2], right)
            ok = h2 - l2 < width
            offer(made[ok], (last[tail] - first[head] + 1)[ok], l2[ok], h2[ok])
        # Pairs.
        side = (mix(name + U(r + 1)) & U(1)).astype(bool)  # True: left
        m = len(name)
        same = np.r_[own[1:] == own[:-1], False]
        nxt = np.minimum(np.arange(m) + 1, m - 1)
        starts = side & ~side[nxt] & same
        ends = np.r_[False, starts[:-1]]
        # Who stays alone was decided by the neighbour on its side, too.
        prv = np.maximum(np.arange(m) - 1, 0)
        before = np.r_[False, same[:-1]]
        hi2 = np.where(side & ~starts, np.where(same, np.maximum(hi, hi[nxt]), far), hi)
        lo2 = np.where(~side & ~ends, np.where(before, np.minimum(lo, lo[prv]), -far), lo)
        keep = ~ends
        to = nxt[keep]
        pair = starts[keep]
        made = np.where(pair, mix(name[keep] * U(0x9E3779B97F4A7C15) + mix(name[to] + U(77 + r))), name[keep])
        lo = np.where(pair, np.minimum(lo2[keep], lo2[to]), lo2[keep])
        hi = np.where(pair, np.maximum(hi2[keep], hi2[to]), hi2[keep])
        own, first, last, name = own[keep], first[keep], np.where(pair, last[to], last[keep]), made
        ok = (hi - lo < width) & pair
        offer(name[ok], (last - first + 1)[ok], lo[ok], hi[ok])
    out = best[0]
    for d in range(1, width):  # best symbol within d + 1 words from each place
        out = np.maximum(np.maximum(out, np.r_[out[1:], U(0)]), best[d])
    return out[:n]


class Parser:
    """Texts to word hashes, window hashes and anchors."""

    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, WordHashes()
        self.roll, self.roll2 = Rolling(0x9E3779B97F4A7C15, width), Rolling(0xC2B2AE3D27D4EB4F, width)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [t.encode().split() for t in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return (np.concatenate([self.hashes.of(w) for w in found]) if found else np.empty(0, U)), n

    def first(self, h: np.ndarray) -> np.ndarray:
        return self.roll.windows(h)

    def second(self, h: np.ndarray) -> np.ndarray:
        return (self.roll2.windows(mix(h)) >> U(32)).astype(np.int64)

    def full(self, n: np.ndarray) -> np.ndarray:
        """Whether a whole window starts at each word."""
        ends = np.repeat(np.cumsum(n), n)
        return np.arange(len(ends)) + self.width <= ends


def _named(width: int):
    """Rows (key, id, c, at, n, kind): runs of windows with one anchor (kind 0), whole documents (kind 1).

    settled: the worker has already seen the name elsewhere (kind 0) or in an earlier document (kind 1).
    """

    def run(batches):
        parser = Parser(width)
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for part in common.chunks(batch, most=PART_BYTES):
                texts = common.texts_of(part)
                h, n = parser.words(texts)
                if not len(h):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)
                crc = np.array([zlib.crc32(t.encode()) for t in texts], np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                full = parser.full(n)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                key = anchors(h, doc, width)
                # A window that equals one of the next in the same run of windows.
                w = np.r_[parser.first(h), np.zeros(min(width - 1, len(h)), U)][: len(h)]
                again = np.zeros(len(h), bool)
                for d in range(1, width + 1):
                    eq = (w[d:] == w[:-d]) & full[d:] & full[:-d]
                    again[d:] |= eq
                at = np.flatnonzero(full)
                if len(at):
                    head = np.r_[True, (key[at[1:]] != key[at[:-1]]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]
                    s = np.flatnonzero(head)
                    size = np.diff(np.r_[s, len(at)])
                    i = at[s]
                    settled = np.logical_or.reduceat(again[at], s)
                    # A run goes on over all occurrences of its name; in a long one equal windows may lie farther apart.
                    run_of = np.repeat(np.arange(len(s)), size)
                    far = np.flatnonzero(((size > width + 1) & ~settled)[run_of])
                    if len(far):
                        r, v = run_of[far], w[at[far]]
                        o = np.lexsort((v, r))
                        r, v = r[o], v[o]
                        settled[r[1:][(r[1:] == r[:-1]) & (v[1:] == v[:-1])]] = True
                    held.append((key[i], ids[doc[i]], crc[doc[i]], place[i], size, np.zeros(len(i), np.int64), settled))
                    count += len(i)
                big = np.flatnonzero(n >= width)
                if len(big):
                    ends = np.cumsum(n)
                    roots = np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip((ends - n)[big].tolist(), ends[big].tolist(), strict=True)], U)
                    held.append(((ROOT << U(58)) | (roots >> U(6)), ids[big], crc[big], np.zeros(len(big), np.int64), n[big] - width + 1, np.ones(len(big), np.int64), np.zeros(len(big), bool)))
                    count += len(big)
                if count >= CHUNK_ROWS:
                    yield _settle(held)
                    held, count = [], 0
        if held:
            yield _settle(held)

    return run


def _settle(held: list[tuple]) -> pa.RecordBatch:
    key, ids, crc, at, size, kind, settled = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((at, crc, ids, key))
    key, ids, crc, at, size, kind, settled = (x[order] for x in (key, ids, crc, at, size, kind, settled))
    head = np.r_[True, key[1:] != key[:-1]]
    lone = head & np.r_[head[1:], True]
    start = np.flatnonzero(head)[np.cumsum(head) - 1]
    # The first row of a name compares with other workers' rows; the others of this chunk are settled by it.
    later = (ids > ids[start]) & ~head
    settled = np.where(kind == 1, later, settled | ~lone)
    spread = mix(ids.astype(U) * U(31) + at.astype(U) * U(7) + mix(key))
    k = np.where(head, key, (spread >> U(1)) | (U(1) << U(63)))  # rows that need no comparison are spread
    kind = np.where(head, kind, kind + 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(k.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(crc), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(settled)],
        ["key", "kind", "id", "c", "at", "n", "settled"],
    )


def _windows(width: int):
    """Rows (h, g, id, ac): the earliest window of each hash in a chunk; runs of n later ones have g = -1 - n.  ac is place << 32 | c."""

    def run(batches):
        parser = Parser(width)
        held: list[tuple] = []
        count = 0
        for batch in batches:
            ids, crc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names = batch.schema.names
            runs = batch.column(names.index("runs"))
            for k, text in enumerate(batch.column(names.index("text")).to_pylist()):
                h, _ = parser.words([text])
                w, g = parser.first(h), parser.second(h)
                flat = np.array([(r["at"], r["n"]) for r in runs[k].as_py()], np.int64)
                step = np.zeros(len(w) + 1, np.int64)
                np.add.at(step, flat[:, 0], 1)
                np.add.at(step, flat[:, 0] + flat[:, 1], -1)
                at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                held.append((w[at], g[at], np.full(len(at), ids[k]), np.full(len(at), crc[k]), at))
                count += len(at)
                if count >= CHUNK_ROWS:
                    yield _earliest(held)
                    held, count = [], 0
        if held:
            yield _earliest(held)

    return run


def _earliest(held: list[tuple]) -> pa.RecordBatch:
    w, g, ids, crc, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((crc, at, ids, g, w))
    w, g, ids, crc, at = (x[order] for x in (w, g, ids, crc, at))
    head = np.r_[True, (w[1:] != w[:-1]) | (g[1:] != g[:-1])]
    start = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (ids > ids[start]) | ((ids == ids[start]) & (at > at[start]))
    # Rows of one place (a document listed twice, or several texts of one id) are as early as each other: keep one a text.
    twin = ~head & ~later & np.r_[False, (crc[1:] == crc[:-1]) & ~head[1:]]
    first = ~later & ~twin
    l = np.flatnonzero(later)
    l = l[np.lexsort((at[l], crc[l], ids[l]))]
    ac = (at << 32) | crc
    cols = [w[first], g[first], ids[first], ac[first]]
    if len(l):
        new = np.r_[True, (at[l][1:] > at[l][:-1] + 1) | (ids[l][1:] != ids[l][:-1]) | (crc[l][1:] != crc[l][:-1])]
        s = np.flatnonzero(new)
        e = np.r_[s[1:], len(l)] - 1
        i = l[s]
        more = [mix(ids[i].astype(U) * U(31) + at[i].astype(U)), at[i] - at[l[e]] - 2, ids[i], ac[i]]
        cols = [np.concatenate(x) for x in zip(cols, more, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], ["h", "g", "id", "ac"])


def _cut(width: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            copy, runs = batch.column(names.index("copy")).to_pylist(), batch.column(names.index("runs"))
            n_words, n_removed, sha, kept_texts = [], [], [], []
            for k, text in enumerate(batch.column(names.index("text")).to_pylist()):
                words = text.encode().split()
                kept = words
                if copy[k]:
                    kept = []
                elif runs[k].is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    for r in runs[k].as_py():
                        step[r["at"]] += 1
                        step[r["at"] + r["n"] + width - 1] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                text = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept_texts.append(text.decode())
            cols = [batch.column(names.index("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_texts, pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (keep_text) the kept words, per row of docs."""
    d = common.documents(docs)
    named = d.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"), "text").mapInArrow(_named(width), "key long, kind int, id long, c long, at int, n int, settled boolean")
    by = Window.partitionBy("key", "kind")  # at most one row of each worker chunk
    met = named.select("*", F.count("*").over(by).alias("rows"), F.min("id").over(by).alias("least"))
    root = F.col("kind") % 2 == 1
    hit = met.where(F.when(root, F.col("settled") | (F.col("id") > F.col("least"))).otherwise(F.col("settled") | (F.col("rows") > 1)))
    # A row listed many times has its runs once: distinct rows, dealt out by document, so that no further exchange follows.
    hit = hit.select("id", "c", root.alias("copy"), F.when(~root, F.col("at")).alias("at"), F.when(~root, F.col("n")).alias("n")).repartition("id", "c").distinct()
    marks = hit.groupBy("id", "c").agg(F.max("copy").alias("copy"), F.collect_list(F.when(~F.col("copy"), F.struct("at", "n"))).alias("runs"))
    marks, _ = common.stored(marks, "anchors")
    del named, met, hit
    common.release(docs.sparkSession)

    texts = d.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"), F.crc32("text").alias("c"), "doc_id", "text")
    todo = texts.join(marks.where(~F.col("copy")).select("id", "c", "runs"), ["id", "c"]).select("id", "c", "runs", "text", "doc_id")  # doc_id, so that the texts' exchange is the last join's, too
    sent = todo.mapInArrow(_windows(width), "h long, g long, id long, ac long")
    by = Window.partitionBy("h", "g")  # at most one row of each worker chunk
    at = F.shiftright("ac", 32)
    place = F.struct("id", at)
    ranked = sent.select("*", F.min(place).over(by).alias("least"))
    late = ranked.where((F.col("g") < 0) | (place > F.col("least"))).select("id", F.col("ac").bitwiseAND(0xFFFFFFFF).alias("c"), F.lit(False).alias("copy"), at.cast("int").alias("at"), F.when(F.col("g") < 0, -1 - F.col("g")).otherwise(1).cast("int").alias("n"))
    copies = marks.where("copy").select("id", "c", "copy", F.lit(None).cast("int"), F.lit(None).cast("int"))
    lost = late.union(copies).repartition("id", "c").distinct()
    lost = lost.groupBy("id", "c").agg(F.max("copy").alias("copy"), F.collect_list(F.when(~F.col("copy"), F.struct("at", "n"))).alias("runs"))
    out = texts.join(lost, ["id", "c"], "left").select("doc_id", F.coalesce("copy", F.lit(False)).alias("copy"), "runs", "text")
    return out.mapInArrow(_cut(width, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), keep_text=False)


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM docs WHERE len(w) >= 20),
seq AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM win),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM seq),
lost AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
kept AS (SELECT w.doc_id, w.p, w.word, l.p IS NULL AS stays FROM words w LEFT JOIN lost l ON w.doc_id = l.doc_id AND w.p = l.p),
agg AS (SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS gone, string_agg(word, ' ' ORDER BY p) FILTER (WHERE stays) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(a.gone, 0) AS n_removed, sha256(coalesce(a.t, '')) AS kept_sha256
FROM docs d LEFT JOIN agg a ON d.doc_id = a.doc_id
"""
