"""Near-duplicates by SimHash and meet-in-the-middle ball hashing (operator 9).

Two 64-bit fingerprints that differ in at most 2 bits share a value within
one bit of both.  Every distinct fingerprint therefore emits itself and its 64
one-bit variants; fingerprints that meet on a variant differ in at most 2
bits, which is verified, and each variant links its fingerprints in a chain.
A variant has at most 65 fingerprints, so no group grows with the data, and
copies meet as one fingerprint before anything is emitted.  Components come
from alternating large-star and small-star rounds, each written to the shared
folder.

Near-duplicates of a stated similarity (:func:`near_duplicates`) lie further
apart than 2 bits of 64: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 differ in about 5 to 10.  There each text has TABLES
fingerprints of 64 bits, and every 32-bit half of one is ball hashed on its own;
texts that meet in any half are candidates and are verified on their shingles.
The members of a bucket are compared with one of them (a star), never pair by
pair: copies of one text are all linked to it, and a text has up to 66 buckets a
fingerprint to meet others in.  Equal halves meet as one half before anything is
emitted.  All work is linear in the number of halves.

Fingerprints alone miss some pairs, so an exact search of the shingles follows
(:func:`prefix_pairs`): two sets of similarity 0.8 share one of the first fifth of
their shingles in any common order.  The first order is that of the hashes.  A
shingle of over BUCKET sets is not expanded into pairs: it goes to the end of the
order, and the sets that met in it are dealt again, as often as that helps.  Sets
that hold little but such shingles are compared in blocks, all with all, in
bounded memory; that part alone is quadratic.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; fewer than `width` words are one shingle;
repeated rows share their component; a null doc_id has the smallest id of its
class only if there is no other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .wordhash import Rolling, WordHashes, mix

WIDTH, SEED = 3, 42
#: Near-duplicates: words of a shingle, the similarity as a fraction, fingerprints of a text.
SET_WIDTH, OVER, UNDER, TABLES = 5, 4, 5, 4
#: Sets that may meet in one shingle before it goes to the end of the order; the most such shingles sent to the workers at once.
BUCKET, MOST_HOT = 64, 250_000
#: Orders tried, and the number of shingles in the sets that are left below which no further one is.
ROUNDS, FEW_SHINGLES = 8, 600_000
#: Text of one side of a block of sets that are compared all with all.
BLOCK_BYTES = 2 << 20
#: Bits of the longest parity sketch.
PARITY_BITS = 1 << 15
#: Links beyond which the lookup of a node's least neighbour is a table of its own (the rows don't depend on it).
MANY_LINKS = 1_000_000
#: Text of one side of a tile of candidate pairs.
TILE_BYTES = 4 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, width: int = WIDTH) -> list[int]:
    """XXH64 of each run of `width` words, A-Z lower-cased, joined by one space."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    k = min(width, len(words))
    begin, end = (ends - size + 1)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip(begin, end, strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes (0 for none)."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    h = np.asarray(hashes, "<u8")
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), per row."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(shingle_hashes(t, width)) for t in common.texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return common.documents(docs).mapInArrow(run, "doc_id long, fp long")


def ball_links(fps: DataFrame) -> DataFrame:
    """a, b: pairs of different fingerprints within 2 bits, enough of them to connect all such pairs."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.when(i == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = fps.select("fp", F.explode(flips).alias("v"))
    pair = met.select(F.col("fp").alias("a"), F.lag("fp").over(Window.partitionBy("v").orderBy("fp")).alias("b"))
    return pair.where(F.col("b").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct()


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """node, root (smallest node reachable) for every node of links (a, b)."""
    edges, path = common.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")

    def star(e: DataFrame, large: bool, many: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        if many:  # a table of its own, so that both sides of the join are plain exchanges and Spark can split the rows of a hot root
            least, _ = common.stored(least, "least")
        j = both.join(least, "a")
        if large:  # neighbours above the node go to the least of its neighbourhood
            return j.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return j.select("b", "m").union(least.select("a", "m")).toDF("a", "b").where("a <> b")

    def digest(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = digest(edges)
    while before[0]:
        many = before[0] > MANY_LINKS
        out, new = common.stored(star(star(edges, True, many).distinct(), False, many).distinct(), "links")
        after = digest(out)
        common.drop_path(spark, path)
        edges, path = out, new
        if after == before:
            break
        before = after
    return edges.toDF("node", "root")


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of all documents linked), per row."""
    spark = docs.sparkSession
    own, _ = common.stored(fingerprints(docs, width), "fingerprints")
    reps = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(ball_links(reps.select("fp")), spark)
    linked = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked, _ = common.stored(linked, "classes")
    top = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    label = linked.join(top, "root").select("fp", "component_id")
    return own.join(label, "fp").select("doc_id", "fp", "component_id")


class Shingles:
    """The set of a text's five-word shingles as sorted 64-bit hashes."""

    def __init__(self, width: int = SET_WIDTH):
        self.width, self.hashes, self.rolls = width, WordHashes(), {}

    def __call__(self, text: str) -> np.ndarray:
        h = self.hashes.of(text.encode().translate(LOWER).split())
        k = min(self.width, len(h))
        if not k:
            return np.empty(0, np.uint64)
        if k not in self.rolls:
            self.rolls[k] = Rolling(0x9E3779B97F4A7C15 + 2 * k, k)
        return np.unique(mix(self.rolls[k].windows(h) + np.uint64(k)))


def name_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def parity(shingles: np.ndarray) -> bytes:
    """Bit k is 1 if an odd number of the shingles end in k; about a bit for each shingle."""
    w = min(PARITY_BITS, max(64, 1 << (len(shingles) - 1).bit_length())) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(na: int, pa_: bytes, nb: int, pb: bytes) -> bool:
    """False only if the sets, of these sizes and parities, are less similar than 0.8.

    Sets differ in at least as many shingles as their parities differ in bits,
    and similar ones in a ninth of both at most.
    """
    if UNDER * min(na, nb) < OVER * max(na, nb):
        return False
    x, y = int.from_bytes(pa_, "little"), int.from_bytes(pb, "little")
    m, n = 8 * len(pa_), 8 * len(pb)
    if m < n:
        x, y, m, n = y, x, n, m
    while m > n:
        m //= 2
        x = (x >> m) ^ (x & ((1 << m) - 1))
    return (UNDER + OVER) * (x ^ y).bit_count() <= (UNDER - OVER) * (na + nb)


def _sketches(tables: int):
    """Rows (doc_id, h, s, f, n, p): s names the set of shingles, f are the fingerprints, the first of them operator 9's own, n and p the set's size and parity."""

    def run(batches):
        sets = Shingles()
        for b in batches:
            s, f, n, p = [], [], [], []
            for text in common.texts_of(b):
                x = sets(text)
                s.append(name_of(x))
                n.append(len(x))
                p.append(parity(x))
                h = np.array(shingle_hashes(text), np.uint64)
                f.append(np.array([fingerprint(mix(h + np.uint64(k)) if k else h) for k in range(tables)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.int64()), pa.array(f, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(p, pa.binary())], ["doc_id", "h", "s", "f", "n", "p"])

    return run


def halves(reps: DataFrame, tables: int) -> DataFrame:
    """v, s: the halves of each fingerprint."""
    parts = [F.shiftrightunsigned(F.element_at("f", k // 2 + 1), 32 * (k % 2)).bitwiseAND(0xFFFFFFFF) + F.lit(k << 32) for k in range(2 * tables)]
    return reps.select(F.explode(F.array(*parts)).alias("v"), "s")


def half_balls(own: DataFrame) -> DataFrame:
    """v, s: each half with at most one bit flipped."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.when(i == 32, F.col("v")).otherwise(F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    return own.select(F.explode(flips).alias("v"), "s")


def stars(members: DataFrame, name: str) -> DataFrame:
    """a, b: each member (v, s) of a bucket with the bucket's least one, which has several."""
    centres = members.groupBy("v").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a <> z").select("v", "a")
    centres, _ = common.stored(centres, name)  # a table, so that both sides of the join are plain exchanges, which Spark can split
    return members.join(centres, "v").where("s <> a").select("a", F.col("s").alias("b"))


class Prefix:
    """The shingles of a set that are least in the last of several orders; None if the set is not among those that order is for.

    The first order is that of the hashes.  Each level (shingles in ascending
    order, how many sets met in each) puts the shingles of all levels so far at
    the end, by these counts, for the sets that met in one of its own.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.steps, known = [], {}
        for hot, count in levels:
            known |= dict(zip(hot.tolist(), count.tolist(), strict=True))
            keys = np.array(sorted(known), np.uint64)
            self.steps.append((hot, keys, np.array([known[k] for k in keys.tolist()], np.int64)))

    def __call__(self, shingles: np.ndarray) -> np.ndarray | None:
        n = len(shingles)
        size = n + OVER * n // -UNDER + 1
        least = shingles[:size]
        for hot, keys, counts in self.steps:
            if not (hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least).any():
                return None
            at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
            least = shingles[np.lexsort((shingles, np.where(keys[at] == shingles, counts[at], 0)))[:size]]
        return least


def _prefixes(levels: list, whole: bool):
    """Rows (v, s, n): the shingles v of the prefix of set s, which has n; or (s, text) of the sets that the last level leaves."""

    def run(batches):
        sets, prefix, seen = Shingles(), Prefix(levels), set()
        for batch in batches:
            for b in common.chunks(batch):
                v, s, n, kept = [], [], [], []
                for text in common.texts_of(b):
                    x = sets(text)
                    name = name_of(x)
                    if name in seen:  # copies in one task
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(name)
                    least = prefix(x)
                    if least is not None and len(least):
                        v.append(least.view(np.int64))
                        s.append(name)
                        n.append(len(x))
                        kept.append(text)
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(kept, pa.string())], ["s", "text"])
                elif v:
                    size = [len(x) for x in v]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)), pa.array(np.repeat(np.array(s, np.int64), size)), pa.array(np.repeat(np.array(n, np.int32), size))], ["v", "s", "n"])

    return run


def prefix_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of sets of near sizes that meet in a shingle of their prefixes; and the links (a, b) of the sets that are compared in blocks.

    All pairs of similarity 0.8 or more are among the pairs or connected by the links.
    """
    spark = texts.sparkSession
    levels, known, out = [], set(), None
    least = Window.partitionBy("v").orderBy("s")
    while True:
        rows = texts.mapInArrow(_prefixes(list(levels), False), "v long, s long, n int").select("*", F.lag("s").over(least).alias("p"), F.lead("s").over(least).alias("q"))
        once = rows.where((F.col("p").isNull() & F.col("q").isNotNull()) | (F.col("p") != F.col("s"))).select("v", "s", "n")
        shared, _ = common.stored(once, "shared-shingles")
        hot = shared.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET).orderBy(F.desc("c"), "v").limit(MOST_HOT).collect()
        cool = shared
        if hot:
            keys = F.broadcast(spark.createDataFrame([(r.v,) for r in hot], "v long"))  # at most MOST_HOT
            cool = shared.join(keys, "v", "left_anti")
        x, y = cool.toDF("v", "a", "na"), cool.toDF("v", "b", "nb")
        pairs = x.join(y, "v").where((F.col("a") < F.col("b")) & (UNDER * F.least("na", "nb") >= OVER * F.greatest("na", "nb"))).select("a", "b").distinct()
        pairs, _ = common.stored(pairs, "met")
        out = pairs if out is None else out.union(pairs)
        if not hot:
            return out, spark.createDataFrame([], "a long, b long")
        fresh = {r.v for r in hot} - known
        known |= fresh
        v = np.array([r.v for r in hot], np.int64).view(np.uint64)
        order = np.argsort(v)
        levels.append((v[order], np.array([r.c for r in hot], np.int64)[order]))
        left = shared.join(keys, "v", "left_semi").select("s", "n").distinct().agg(F.sum("n")).first()[0]
        if not fresh or left <= FEW_SHINGLES or len(levels) >= ROUNDS:
            return out, _block_links(texts.mapInArrow(_prefixes(list(levels), True), "s long, text string"))


def _block_links(rows: DataFrame) -> DataFrame:
    """a, b: links that connect all similar sets of rows (s, text), compared all with all in pairs of blocks."""
    own, _ = common.stored(rows.groupBy("s").agg(F.first("text").alias("text")), "left")
    k = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    own = own.withColumn("i", F.pmod(F.xxhash64("s"), F.lit(k)))
    each = own.select("i", "s", "text", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    dealt = each.select((F.least("i", "j") * k + F.greatest("i", "j")).alias("t"), "i", "s", "text")
    return common.stored(dealt.repartition("t").sortWithinPartitions("t").mapInArrow(_all_with_all, "a long, b long"), "block-links")[0]


def _all_with_all(batches):
    """Links (a, b) of similar sets of one tile, of different blocks if it has two; a chain of links stands for more of them."""
    shingles = Shingles()

    def links(rows: list) -> list:
        n = np.array([len(x) for _, _, x in rows])
        block = np.array([i for i, _, _ in rows])
        two = block.min() != block.max()
        ids = np.repeat(np.arange(len(rows)), n)
        u, at = np.unique(np.concatenate([x for _, _, x in rows]), return_inverse=True)
        order = np.argsort(at, kind="stable")
        holders, start = ids[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(u)))])
        ends, root, out = np.cumsum(n), list(range(len(rows))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x in range(len(rows)):
            both = np.bincount(np.concatenate([holders[start[t] : start[t + 1]] for t in at[ends[x] - n[x] : ends[x]].tolist()]), minlength=len(rows))
            hit = (UNDER * both >= OVER * (n[x] + n - both)) & (np.arange(len(rows)) > x)
            for y in np.flatnonzero(hit & (block != block[x]) if two else hit).tolist():
                if find(x) != find(y):
                    root[find(x)] = find(y)
                    out.append((rows[x][1], rows[y][1]))
        return out

    def batch_of(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    tile, rows = None, []
    for batch in batches:
        for t, i, s, text in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
            if t != tile:
                if rows:
                    yield batch_of(links(rows))
                tile, rows = t, []
            rows.append((i, s, shingles(text)))
    if rows:
        yield batch_of(links(rows))


def _possible(batches):
    """The pairs (a, b) whose sizes and parities allow the similarity."""
    for batch in batches:
        a, b, *rest = [batch.column(i).to_pylist() for i in range(6)]
        keep = pa.array([may_be_similar(*x) for x in zip(*rest, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def _verify(batches):
    """Pairs (a, b) of a tile whose texts are similar; a tile's texts (kind 0) come before its pairs."""
    sets, tile, held = Shingles(), None, {}
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        out = []
        for t, kind, a, b, text in zip(*cols, strict=True):
            if t != tile:
                tile, held = t, {}
            if kind == 0:
                held[a] = sets(text)
                continue
            x, y = held[a], held[b]
            if UNDER * min(len(x), len(y)) < OVER * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if UNDER * both >= OVER * (len(x) + len(y) - both):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, tables: int = TABLES) -> DataFrame:
    """doc_id, h (row_key) of the document that stays of each class: the smallest doc_id (null last), then the smallest h.

    Classes are connected by pairs whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more, all of them and no others, but for
    collisions of 64-bit hashes.  Fingerprints give most candidates, the exact
    search of the shingles those they miss.
    """
    spark = docs.sparkSession
    texts = common.documents(docs).select("doc_id", common.row_key().alias("h"), "text")
    rows = texts.mapInArrow(_sketches(tables), "doc_id long, h long, s long, f array<long>, n int, p binary")
    who = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("who")
    reps, _ = common.stored(rows.groupBy("s").agg(who, F.min("f").alias("f"), F.min("n").alias("n"), F.min("p").alias("p")), "sets")

    # The least set of a bucket is its centre: names of sets are hashes, so one order of them serves all buckets, and a text
    # meets the same centre in many of its buckets.  Equal halves are one before anything is emitted.
    own = halves(reps, tables)
    equal = stars(own, "equal-halves")
    distinct, _ = common.stored(own.groupBy("v").agg(F.min("s").alias("s")), "halves")
    # Distinct halves: a bucket holds its own value and the 32 that differ in one bit at most, so no bucket is hot.
    near = half_balls(distinct).select("s", F.min("s").over(Window.partitionBy("v")).alias("a")).where("s <> a").select("a", F.col("s").alias("b"))
    found, linked = prefix_pairs(texts)
    ordered = equal.union(near).union(found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x: reps.select(F.col("s").alias(x), F.col("n").alias("n" + x), F.col("p").alias("p" + x))
    met = ordered.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "pa", "nb", "pb")
    pairs, _ = common.stored(met.mapInArrow(_possible, "a long, b long"), "pairs")
    common.release(spark)
    root = components(_similar(pairs, reps, texts).union(linked), spark)
    classes = reps.join(root, reps["s"] == root["node"], "left").groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("who").alias("who"))
    return classes.select("who.doc_id", "who.h")


def _similar(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is high enough.

    Pairs are dealt into tiles by hashes of both sides, so a text that is in
    many pairs is sent once to each tile that needs it, not once for each pair.
    """
    spark = pairs.sparkSession
    need = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct().join(reps.select("s", "who.doc_id", "who.h"), "s")
    d, e = texts.alias("d"), need.alias("e")
    own = d.join(e, F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d.h") == F.col("e.h"))).groupBy("e.s").agg(F.first("d.text").alias("text"))
    own, _ = common.stored(own, "texts")
    k = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TILE_BYTES))
    tile = F.pmod(F.xxhash64("a"), F.lit(k)) * k + F.pmod(F.xxhash64("b"), F.lit(k))
    dealt = pairs.select(tile.alias("t"), "a", "b")
    sent = dealt.select("t", F.col("a").alias("s")).union(dealt.select("t", "b")).distinct().join(own, "s").select("t", F.lit(0).alias("kind"), F.col("s").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    both = sent.union(dealt.select("t", F.lit(1), "a", "b", F.lit(None).cast("string"))).repartition("t").sortWithinPartitions("t", "kind")
    return common.stored(both.mapInArrow(_verify, "a long, b long"), "links")[0]


def hex_bits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(common.table(spark, sf_dir, "documents"))
    return c.select("doc_id", hex_bits(F.col("fp")).alias("fingerprint"), "component_id")
