"""The pipeline's stages against the brute-force decisions of the operators' own tests."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    leak = text(25)
    line = "This long line is shared by many of the documents here " + text(3)
    rows = [(i, text(120) + ("\n" + line if i < 8 else ""), "en", "s", 0) for i in range(30)]
    rows += [(30, rows[20][1], "en", "s", 0), (31, "too short", "en", "s", 0), (32, text(60) + " " + leak + " " + text(60), "en", "s", 0), (33, None, None, None, None), (34, " ".join([text(30)] * 9), "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d, rows


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    import corpus_pipeline as p

    d, rows = folder
    docs = spark.read.parquet(d + "/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        docs, _ = p.common.stored(out, "t")
        left[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    assert set(left["quality rules"]) == set(range(35)) - {31, 33, 34}
    lines = left["line dedup"]
    assert [i for i in range(8) if "\n" in lines[i].text] == [7] and lines[0].n_chars == len(lines[0].text)
    assert set(left["near-duplicates"]) == set(lines) - {30}
    assert set(left["decontamination"]) == set(left["near-duplicates"]) - {32}
    assert set(left["bpe"]) == set(left["decontamination"])
    assert sorted(map(tuple, p.run(spark, d).collect())) == sorted(map(tuple, left["bpe"].values()))


def crowded(seed=6):
    """Documents for every stage: junk, shared lines, copies and near copies, leaks, null ids and texts, repeated rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    lines = ["This long line stands in many of the documents " + " ".join(words(4)) for _ in range(3)]
    items = [(k, " ".join(words(12)) + "? " + " ".join(words(6)) + ".") for k in range(8)] + [(9, None), (10, "")]
    rows = []
    for i in range(90):
        w = words(rng.randint(20, 160) if i % 6 else rng.randint(120, 260))
        if i % 9 == 0:
            w[5:5] = items[i % 8][1].split()
        if i % 11 == 0:
            w += w[:40] * 2
        text = " ".join(w)
        for line in rng.sample(lines, rng.randint(0, 2)):
            text += "\n" + rng.choice([line, line.upper(), " " + line])
        rows.append((i, text))
        if i % 6 == 0:
            for _ in range(3):
                v = text.split(" ")
                v[rng.randrange(len(v))] = "other"
                rows.append((200 + len(rows), " ".join(v)))
    rows += [(None, rows[4][1]), (None, " ".join(words(70))), (None, " ".join(words(70))), (None, None), (500, None), (501, ""), (7, rows[9][1]), (7, " ".join(words(90))), rows[12], rows[12]]
    return rows, items


def test_every_stage_and_run_against_brute_force(spark, tmp_path):
    """run() and each of its stages against plain Python over the rows that the stage before kept; extra columns pass through."""
    import brute
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from groundspark.llm import bpe

    rows, items = crowded()
    rows = [(i, t, f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    rows[-1] = rows[-2]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda x: sorted(map(tuple, x), key=repr)

    want = [[r for r in rows if brute.good(r[1])]]
    texts = brute.without_shared_lines(want[-1])
    want.append([(r[0], t, r[2], len(t)) for r, t in zip(want[-1], texts)])
    want.append(brute.one_of_each(want[-1]))
    leaks = brute.leaks(want[-1], items)
    want.append([r for r in want[-1] if (r[0], r[1]) not in leaks])
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    want.append([(r[0], *brute.encoded(tok, r[1])) for r in want[-1]])
    assert len(rows) > len(want[0]) > len(want[2]) > len(want[3]) > 40 and want[0] != want[1]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rows_wanted in zip(p.STAGES, want, strict=True):
        docs, _ = p.common.stored(stage(spark, docs, str(tmp_path)), "t")
        assert key(docs.collect()) == key(rows_wanted), name
    assert key(p.run(spark, str(tmp_path)).collect()) == key(want[-1])


def test_stages_pass_clashing_columns_through_and_take_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["Doc_ID", "TEXT", "a.b", "doc_id", "text", "h", "row", "shard", "_id"]
    text = " ".join(f"v{i}" for i in range(60))
    whole = spark.createDataFrame([("x", "y", 1, 5, text, 2, 3, 4, 6), ("x", "y", 1, 6, text + " more", 2, 3, 4, 6)], "a string, b string, c int, d long, e string, f int, g int, i int, j int").toDF(*names)
    for docs, n in ((whole, 1), (whole.limit(0), 0)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == names
                docs, _ = p.common.stored(out, "t")
        got = docs.collect()
        assert [tuple(r) for r in got] == [("x", "y", 1, 5, text, 2, 3, 4, 6)][:n]
        assert out.count() == n


def test_near_copies_of_similarity_0_8(spark):
    """Groups of near copies: the classes of all pairs of similarity 0.8, and never a pair below it."""
    import brute

    import corpus_pipeline as p

    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}v{rng.randint(0, 500)}" for _ in range(rng.randint(60, 160))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id for r in p.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    want = {r[0] for r in brute.one_of_each(rows)}
    assert want <= got and len(got) <= len(want) + 2 and 12 < len(want) < 60


@pytest.mark.parametrize("bucket, few", [(64, 600_000), (3, 0), (3, 600_000)])
def test_near_copies_lose_no_pair(spark, monkeypatch, bucket, few):
    """Pairs just over similarity 0.8, and a family whose shingles are all frequent: the classes of all pairs, none missed."""
    import brute

    import corpus_pipeline as p
    from groundspark.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "FEW_SHINGLES", few)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 6_000)
    rng, rows = random.Random(9), []

    def variant(base, edits):
        w = list(base)
        for k in range(edits):
            w[(2 * k + 1) * len(w) // (2 * edits)] = f"n{rng.randint(0, 99999)}"
        return " ".join(w)

    for g in range(120):
        base = [f"g{g}v{rng.randint(0, 500)}" for _ in range(rng.randint(100, 180))]
        rows += [(len(rows) + k, variant(base, e)) for k, e in enumerate((0, len(base) // 46, len(base) // 44))]
    family = [f"f{k}" for k in range(90)]
    for _ in range(40):
        w = list(family)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 3)}"
        rows.append((len(rows), " ".join(w)))
    got = {r.doc_id for r in p.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    assert got == {r[0] for r in brute.one_of_each(rows)}


def test_parities_reject_no_similar_pair():
    import numpy as np
    from groundspark.llm import simhash

    rng = np.random.default_rng(5)
    for size in (1, 5, 64, 300, 5_000, 70_000):
        for _ in range(5):
            base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            cut = int(len(base) * rng.uniform(0, 0.22))
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, int(size * rng.uniform(0, 0.1))).astype(np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 5 * both >= 4 * (len(base) + len(other) - both):
                assert simhash.may_be_similar(len(base), simhash.parity(base), len(other), simhash.parity(other))
        far = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        assert size < 64 or not simhash.may_be_similar(len(base), simhash.parity(base), len(far), simhash.parity(far))


def test_decisions_are_by_row_and_not_by_id(spark, tmp_path):
    import corpus_pipeline as p

    words = lambda k: " ".join(f"d{k}w{i}" for i in range(60))
    item = words(99)
    rows = [(1, words(1), "a"), (1, words(1), "b"), (2, words(2), "a"), (None, words(2), "a"), (None, words(3), "a"), (None, words(4), "a"), (None, words(4), "a"), (5, words(5), "a"), (5, words(6), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(p.near_copies(spark, docs, "")) == sorted([rows[i] for i in (0, 2, 4, 5, 7, 8)], key=repr)
    leaky = [(None, words(7) + " " + item, "a"), (5, item, "a"), (5, item, "a")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert key(p.benchmark_leaks(spark, spark.createDataFrame(rows + leaky, docs.schema), str(tmp_path))) == sorted(rows, key=repr)


def test_registered_queries_and_sql_have_equal_names():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in q)] == [] and "pipeline" in q


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_line_dedup"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no sample tables")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    r = c.execute(e.oracle_sql()[name])
    names = [x[0] for x in r.description]
    got = e.queries()[name](spark, d).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(r.fetchall())
