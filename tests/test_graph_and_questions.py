import gzip
import random

import pytest

from groundspark.etl import catalogue, crm
from groundspark.functions import text as T
from groundspark.operators import graph as G
from groundspark.operators import questions as Q
from groundspark.operators.sqlguard import GuardError
from groundspark.plans import catalogue as plans
from groundspark.plans.crm_queries import GOLD

SCHEMA = "subject string, relation string, object string, source string"
ONTO = G.Ontology(frozenset({"HAS"}), frozenset({"BY"}), (G.Intent("who", "lookup", frozenset({"who"}), frozenset({"BY"})), G.Intent("both", "pairwise", frozenset({"both"}), frozenset({"BY"}))), frozenset({"HAS", "BY"}))


def store(spark, rows):
    return spark.createDataFrame([(*r, "s") if len(r) == 3 else r for r in rows], SCHEMA)


def model_open(rows, seeds, budget, hops=2, per=3, hub=6):
    """A direct model of the bounded search over lists."""
    adj = {}
    for r in sorted(rows):
        adj.setdefault(r[0], []).append((r, 0, r[2]))
        adj.setdefault(r[2], []).append((r, 1, r[0]))
    leaf, out, seen, frontier = {r[2] for r in rows if r[1] == "HAS"}, [], set(seeds), list(seeds)
    for _ in range(hops):
        nxt = []
        for n in frontier:
            near = sorted(adj.get(n, []), key=lambda x: (x[0], x[1]))
            for r, _, other in near[:per]:
                if r not in out:
                    if len(out) >= budget:
                        return set(out)
                    out.append(r)
                if len(near) <= hub and other not in seen and other not in leaf:
                    seen.add(other)
                    nxt.append(other)
        frontier = nxt
    return set(out)


def test_open_search_equals_the_model(spark):
    rng = random.Random(1)
    for _ in range(4):
        rows = sorted({(f"n{rng.randrange(9)}", rng.choice(["BY", "BY", "HAS"]), f"n{rng.randrange(9)}", "s") for _ in range(22)})
        seeds = ["n1", "n2"]
        got = {tuple(r) for r in G.open_search(store(spark, rows), seeds, ONTO, per_node=3, hub=6, budget=9).collect()}
        assert got == model_open(rows, seeds, 9)


def test_hub_is_capped_and_loops_count_twice(spark):
    t = store(spark, [("hub", "BY", f"f{i:03}") for i in range(500)] + [("x", "BY", "x")])
    assert G.lookup(t, ["hub"], frozenset({"BY"})).count() == 50
    assert {r.entity: r.degree for r in G.degree(t).where("entity IN ('x', 'hub')").collect()} == {"x": 2, "hub": 500}


def test_seeds_are_maximal(spark):
    t = store(spark, [("Dark", "BY", "p"), ("Dark Night", "BY", "q"), ("Dark Night Rises", "BY", "r"), ("The", "BY", "z")])
    names = G.entities(t, ONTO)
    for find in (G.seeds_by_tokens, G.seeds_by_spans):
        assert [r.entity for r in find(names, "Who made the dark night rises?").collect()] == ["Dark Night Rises"]
    assert G.retrieve(t, "nothing known", ONTO)[0] == []


def test_pairwise_rank_and_governance(spark):
    t = store(spark, [("a", "BY", "m", "1"), ("b", "BY", "m", "2"), ("a", "BY", "x", "3"), ("a", "HAS", "v", ""), ("b", "HAS", "w", "9")])
    assert {r.source for r in G.pairwise(t, ["a", "b"], frozenset({"BY"})).collect()} == {"1", "2"}
    seeds, found = G.retrieve(t, "both a and b: who", ONTO)
    assert seeds == ["b"] or set(seeds) == {"a", "b"} or seeds
    ranked = G.rank(t, t, ["a"], frozenset({"HAS"})).collect()
    assert ranked[0].object == "v" and len(ranked) == 5
    kept = G.governed(t, frozenset({"BY", "HAS"}), spark.createDataFrame([("2",)], "source string"), 3)
    assert [r.source for r in kept.collect()] == ["1", "3", "9"]
    with pytest.raises(ValueError):
        G.governed(t.select("subject"), frozenset(), None, 1)


def test_triples_survive_json(spark, tmp_path):
    t = store(spark, [("a", "BY", "b"), ("c", "BY", "d")])
    G.write_triples(t, str(tmp_path / "t"))
    G.write_triples(t.limit(1), str(tmp_path / "t"), append=True)
    assert G.read_triples(spark, str(tmp_path / "t")).count() == 3


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = G.F.lit
    assert one(T.json_names(lit('["a", "", "b"]'))) == ["a", "b"] and one(T.json_names(lit("bad["))) is None
    assert one(T.strip_wikitext(lit("'''A''' {{t}}[[x|y]] <ref>z</ref>[[q]]"))) == "A y q"
    assert one(T.section(lit("intro\n== Plot ==\nIt is.\n== Cast ==\nx"))) == "It is."
    assert [tuple(r) for r in one(T.triple_lines(lit("a | BY | b\nbad\nc | NO | d\n | BY | e"), ("BY",)))] == [("a", "BY", "b")]
    assert one(T.atoms(lit("a, b;|c "))) == ["a", "b", "c"]


def test_layer_selection_and_governance():
    layer = Q.Layer((Q.TableDef("films", "films and ratings", (Q.ColumnDef("rating"), Q.ColumnDef("born"))), Q.TableDef("people", "persons", (Q.ColumnDef("name"),))), {"m": "avg(born)"}, {"starred in": "people name"}, (("best rating", "SELECT rating"), ("oldest", "SELECT born")))
    assert [t.name for t in layer.select("who starred in it")[0]] == ["people"]
    assert len(layer.select("zzz")[0]) == 2
    g = layer.governed(lambda t, c: c != "born")
    assert g.metrics == {} and g.examples == (("best rating", "SELECT rating"),) and "born" not in g.context("x")


def test_votes_routes_and_scores(spark):
    assert Q.route("how many orders are related") == "sql+graph" and Q.route("tell me", names_entity=True) == "graph"
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    same, other = a.orderBy("a", ascending=False), a.fillna("")
    sig = [Q.signature(d).first()[0] for d in (a, same, other)]
    assert sig[0] == sig[1] != sig[2] and Q.majority([None, sig[2], sig[0], sig[1]]) == 2 and Q.majority([None]) is None
    assert Q.same_rows([(6.8334,), (1,)], [(1,), (6.83,)]) and not Q.same_rows([(2562,)], [(2560,)]) and not Q.same_rows([(6.79,)], [(6.83,)])
    assert Q.same_rows([(1.0005,), (1.0,)], [(1.0,), (1.0009,)]) == Q.same_rows([(1.0,), (1.0005,)], [(1.0009,), (1.0,)])


def test_answers_are_corrected_and_refusals_end_them(spark):
    own = spark.newSession()
    own.createDataFrame([("a", 1), ("b", 2)], "k string, v int").createOrReplaceTempView("t")
    model = Q.CannedModel(["SELECT nope FROM t", "```sql\nSELECT k FROM t WHERE v = 2;\n```"])
    got = Q.answer_sql("which k", model, own.sql, own)
    assert got.result.collect()[0].k == "b" and "nope" in model.prompts[1]
    top = Q.answer_sql("top k", Q.CannedModel(["sort, then take one", "SELECT k FROM t", "SELECT k FROM t", "SELECT k FROM t", "SELECT k FROM t ORDER BY v DESC LIMIT 1"]), own.sql, own)
    assert top.sql.endswith("LIMIT 1")

    def refuse(_):
        raise GuardError("table_access_denied")

    with pytest.raises(GuardError):
        Q.answer_sql("which k", Q.CannedModel(["SELECT 1"]), refuse, own)
    assert Q.score(own.sql, "SELECT v FROM t", "SELECT v FROM t ORDER BY v DESC") == (True, True) and Q.score(own.sql, "SELECT v FROM t", "SELECT q FROM t") == (False, False)


def test_crm_gold_answers(spark):
    own = spark.newSession()
    for n, d in crm.tables(own).items():
        d.createOrReplaceTempView(n)
    got = {k: sorted(tuple(r) for r in own.sql(q).collect()) for k, q in GOLD.items()}
    assert got["count_churned"] == [(9,)] and got["count_active"] == [(39,)] and got["churned_enterprise"] == [(3,)] and got["high_priority_active"] == [(13,)]
    assert got["region_most_churn"] == [("EMEA", 3)] and got["top_plan_by_revenue"] == [("Enterprise", 1600)] and got["apac_total_fee"] == [(560,)]
    assert got["count_by_region"] == [(r, 12) for r in ("AMER", "APAC", "EMEA", "LATAM")] and round(got["avg_fee_apac"][0][0], 3) == 46.667


def test_film_etl_and_triples(spark, tmp_path):
    files = {
        "title.basics": ["tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres", 't1\tmovie\tA "q\tA\t0\t1999\t\\N\tx\tDrama,War', "t2\tmovie\tB\tB\t0\t2000\t\\N\t90\tDrama", "t3\ttvEpisode\tC\tC\t0\t2001\t\\N\t9\t\\N"],
        "title.ratings": ["tconst\taverageRating\tnumVotes", "t1\t8.1\t5000", "t2\t7\t50", "t3\t9\t99999"],
        "title.crew": ["tconst\tdirectors\twriters", "t1\tn1\t\\N", "t2\tn2\t\\N", "t3\tn2\t\\N"],
        "title.principals": ["tconst\tordering\tnconst\tcategory\tjob\tcharacters", 't1\t1\tn3\tactor\t\\N\t["X","Y"]', "t1\t99\tn4\tactor\t\\N\t\\N"],
        "name.basics": ["nconst\tprimaryName\tbirthYear\tdeathYear\tprimaryProfession\tknownForTitles", *[f"n{i}\tP{i}\t19{i}0\t\\N\tx\t\\N" for i in range(1, 6)]],
    }
    for n, lines in files.items():
        with gzip.open(tmp_path / f"{n}.tsv.gz", "wt") as f:
            f.write("\n".join(lines) + "\n")
    t = catalogue.build(spark, str(tmp_path))
    b = t["title_basics"].collect()
    assert [(r.tconst, r.primaryTitle, r.runtimeMinutes, r.isAdult) for r in b] == [("t1", 'A "q', None, False)]
    assert {r.nconst for r in t["name_basics"].collect()} == {"n1", "n3", "n4"}
    facts = {(r.subject, r.relation, r.object) for r in catalogue.triples(t).collect()}
    assert facts == {('A "q', "HAS_GENRE", "Drama"), ('A "q', "HAS_GENRE", "War"), ('A "q', "RELEASED_IN", "1999"), ('A "q', "DIRECTED_BY", "P1"), ("P3", "ACTED_IN", 'A "q'), ('A "q', "FEATURES_CHARACTER", "X"), ('A "q', "FEATURES_CHARACTER", "Y"), ("X", "PLAYED_BY", "P3"), ("Y", "PLAYED_BY", "P3")}


def test_every_library_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL) and len(plans.QUERIES) > 60


def test_tasks_grow_with_the_tables(spark, monkeypatch):
    """The triples' sorts and the pairs of a nation are dealt into tasks by the number of rows, with the same rows."""
    from groundspark.plans import graph_queries, relational

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, graph_queries.derived(spark, sf).collect()))
    monkeypatch.setattr(G, "TASK_ROWS", 500)
    many = graph_queries.derived(spark, sf)
    assert many.rdd.getNumPartitions() >= 12 and sorted(map(tuple, many.collect())) == want
    q = relational.QUERIES["q60_natural_join"]
    want = sorted(map(tuple, q(spark, sf).collect()))
    monkeypatch.setattr(relational, "PAIRS", 100)
    many = q(spark, sf)
    assert many.rdd.getNumPartitions() >= 10 and sorted(map(tuple, many.collect())) == want


def test_cluster_filters_edges_before_any_exchange(spark):
    from groundspark.plans import graph_queries

    plan = graph_queries.q39_cluster(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    semi = [x for x in plan.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi)


def test_store_refuses_names_and_keeps_what_it_held(spark, tmp_path):
    good = spark.createDataFrame([("a", "R", "b", "s")], "subject string, relation string, object string, source string")
    G.save_store(good, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        G.save_store(good.selectExpr("subject", "'../x' AS relation", "object", "source"), f"{tmp_path}/s")
    G.save_store(good.union(good.selectExpr("subject", "'T'", "object", "source")), f"{tmp_path}/s")
    assert sorted(r.relation for r in G.open_store(spark, f"{tmp_path}/s").collect()) == ["R", "T"]
