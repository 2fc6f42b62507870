"""Knowledge-graph retrieval over a DataFrame of triples.

A triple is (subject, relation, object, source), all strings; nodes are known
by name.  Order is always the order of these four columns, so results don't
depend on how rows are stored.  Fan-out limits are top-k windows, which Spark
applies before the shuffle, so a hub's edges don't meet in one task.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch

TRIPLE = ("subject", "relation", "object", "source")
PER_NODE, HUB_DEGREE, MOST_TRIPLES, TOP = 50, 100, 300, 200
#: Rows that one task of an exchange gets, whatever the size of the table.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Intent:
    name: str
    shape: str  # lookup, cluster, pairwise or open
    triggers: frozenset[str]
    targets: frozenset[str]


@dataclass(frozen=True)
class Ontology:
    attributes: frozenset[str]  # relations whose objects are values: never seeds, never expanded
    connective: frozenset[str]
    intents: tuple[Intent, ...]
    relations: frozenset[str]
    hint: str = ""
    empty_hint: str = ""

    def resolve(self, question: set[str]) -> Intent:
        """Most triggers hit; on a tie pairwise, then the earliest; open over all relations if none."""
        scored = [(-len(i.triggers & question), i.shape != "pairwise", k, i) for k, i in enumerate(self.intents) if i.triggers & question]
        return min(scored)[3] if scored else Intent("open", "open", frozenset(), self.relations)


def dedupe(t: DataFrame, last: str | None = None) -> DataFrame:
    """One row for each (subject, relation, object): with its least source, or with the source of the greatest `last` (an order of arrival)."""
    source = F.min("source") if last is None else F.max_by("source", F.struct(last, "source"))
    return t.groupBy("subject", "relation", "object").agg(source.alias("source"))


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


SAFE_NAME = re.compile(r"[A-Za-z_]\w*", re.A)


def safe_name(name: str) -> str:
    """A relation or label that may become part of a path or of query text."""
    if not SAFE_NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def edges(t: DataFrame) -> DataFrame:
    """entity, other, slot and the triple: each triple from both ends (a loop twice); one scan."""
    end = lambda a, b, k: F.struct(F.col(a).alias("entity"), F.col(b).alias("other"), F.lit(k).alias("slot"))
    return t.select(F.explode(F.array(end("subject", "object", 0), end("object", "subject", 1))).alias("e"), *TRIPLE).select("e.*", *TRIPLE)


def degree(t: DataFrame) -> DataFrame:
    return edges(t).groupBy("entity").agg(F.count("*").alias("degree"))


def attribute_nodes(t: DataFrame, o: Ontology) -> DataFrame:
    return t.where(F.col("relation").isin(*o.attributes)).select(F.col("object").alias("entity")).distinct()


def entities(t: DataFrame, o: Ontology) -> DataFrame:
    """Names that may be seeds."""
    names = t.select(F.col("subject").alias("entity")).union(t.select("object")).distinct()
    return names.join(attribute_nodes(t, o), "entity", "left_anti")


def seeds_by_tokens(names: DataFrame, question: str, top: int = 10) -> DataFrame:
    """Entities whose tokens all occur in the question, without those whose tokens are part of another match's."""
    stop = F.array(*[F.lit(w) for w in sorted(T.STOP)])
    # The question's tokens are a literal, so this is a filter on the scan of names.
    words = T.token_set(F.lit(question))
    m = names.withColumn("t", T.token_set(F.col("entity"))).where((F.size("t") > 0) & (F.size(F.array_except("t", words)) == 0) & (F.size(F.array_except("t", stop)) > 0))
    m = m.select("entity", F.array_sort("t").alias("t"), F.size("t").alias("n"))
    # Token sets are subsets of the question's few words: containment is judged between distinct sets, for all matches.
    sets = m.select("t", "n").distinct()
    b = sets.toDF("bt", "bn")
    most = sets.join(b, (F.col("bn") > F.col("n")) & (F.size(F.array_except("t", "bt")) == 0), "left_anti").select("t")
    return m.join(most, "t", "left_semi").orderBy(F.desc("n"), F.desc(F.length("entity")), F.desc("entity")).limit(top).select("entity")


def seeds_by_spans(names: DataFrame, question: str, top: int = 10, most: int = 6) -> DataFrame:
    """Entities whose normal form is a run of words of the question; a run inside a longer matched run doesn't count."""
    spark = names.sparkSession
    s = spark.range(1).select(F.explode(T.spans(T.tokens(F.lit(question)), most)).alias("s")).select("s.i", "s.n", "s.text")
    s = s.where(~((F.col("n") == 1) & F.col("text").isin(*sorted(T.STOP))))
    m = names.select("entity", T.normal(F.col("entity")).alias("text")).join(F.broadcast(s), "text")  # at most 6 spans a word of the question
    spans = m.select("i", "n").distinct()
    outer = spans.toDF("oi", "on")
    kept = spans.join(outer, (F.col("on") > F.col("n")) & (F.col("oi") <= F.col("i")) & (F.col("oi") + F.col("on") >= F.col("i") + F.col("n")), "left_anti")
    m = m.join(kept, ["i", "n"]).groupBy("entity").agg(F.max("n").alias("n"))
    return m.orderBy(F.desc("n"), F.length("entity"), "entity").limit(top).select("entity")


def _near(t: DataFrame, nodes: list[str], per_node: int | None = PER_NODE) -> DataFrame:
    """Edges of the nodes, the first `per_node` of each in triple order."""
    e = edges(t).where(F.col("entity").isin(*nodes)) if nodes else edges(t).limit(0)
    if per_node is None:
        return e
    w = Window.partitionBy("entity").orderBy(*TRIPLE, "slot")
    return e.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_node).drop("k")


def lookup(t: DataFrame, seeds: list[str], targets: frozenset[str]) -> DataFrame:
    return _near(t, seeds).where(F.col("relation").isin(*targets)).select(*TRIPLE).distinct()


def cluster(t: DataFrame, seeds: list[str], targets: frozenset[str], o: Ontology, per_node: int = PER_NODE, hub: int = HUB_DEGREE) -> DataFrame:
    """Seed edges of the target relations (the connective ones if none), and the edges of the nodes they lead to."""
    via = targets or o.connective
    first = _near(t, seeds, None).where(F.col("relation").isin(*via))
    # A table, so that its size is known when the join is planned: edges of few hubs are filtered in the scan, before any exchange.
    path = scratch(t.sparkSession, "hubs-" + uuid.uuid4().hex)
    first.select(F.col("other").alias("entity")).distinct().write.parquet(path)
    hubs = t.sparkSession.read.schema("entity string").parquet(path)
    e = edges(t).join(hubs, "entity", "left_semi")
    w = Window.partitionBy("entity").orderBy(*TRIPLE, "slot")
    d = e.groupBy("entity").agg(F.count("*").alias("degree"))
    capped = e.withColumn("k", F.row_number().over(w)).join(d, "entity").where((F.col("degree") <= hub) | (F.col("k") <= per_node))
    return first.select(*TRIPLE).union(capped.where(F.col("relation").isin(*via)).select(*TRIPLE)).distinct()


def pairwise(t: DataFrame, seeds: list[str], targets: frozenset[str]) -> DataFrame:
    """Edges of the seeds whose other end is shared by all of them; a lookup for a single seed."""
    if len(set(seeds)) < 2:
        return lookup(t, seeds, targets)
    e = _near(t, seeds, None)
    shared = e.groupBy("other").agg(F.count_distinct("entity").alias("n")).where(F.col("n") == len(set(seeds)))
    return e.join(shared, "other", "left_semi").select(*TRIPLE).distinct()


def open_search(t: DataFrame, seeds: list[str], o: Ontology, hops: int = 2, per_node: int = PER_NODE, hub: int = HUB_DEGREE, budget: int = MOST_TRIPLES, gate: str = "node") -> DataFrame:
    """Bounded breadth-first search: hop, then order of the frontier, then triple order; stops at `budget` triples.

    gate `node`: values of attribute relations are not expanded.  gate
    `relation`: no end of an attribute edge is expanded by way of that edge.

    The frontier comes to the driver between hops; it has at most `budget` x 2
    names.  Nodes over the hub degree and attribute values are reached but not
    expanded.
    """
    frontier, seen, rows, known = list(dict.fromkeys(seeds)), set(seeds), [], set()
    attr = attribute_nodes(t, o)
    for _ in range(hops):
        if not frontier or len(rows) >= budget:
            break
        got = _near(t, frontier, per_node)
        deg = edges(t).where(F.col("entity").isin(*frontier)).groupBy("entity").agg(F.count("*").alias("degree"))
        got = got.join(deg, "entity").join(attr.select(F.col("entity").alias("other"), F.lit(True).alias("leaf")), "other", "left").select("entity", "other", "slot", *TRIPLE, "degree", "leaf").collect()  # at most per_node x frontier
        at = {n: i for i, n in enumerate(frontier)}
        got.sort(key=lambda r: (at[r.entity], r.subject, r.relation, r.object, r.source, r.slot))
        nxt: list[str] = []
        for r in got:
            key = (r.subject, r.relation, r.object, r.source)
            if key not in known:
                if len(rows) >= budget:
                    break
                known.add(key)
                rows.append(key)
            if r.degree <= hub and r.other not in seen and not (r.relation in o.attributes if gate == "relation" else r.leaf):
                seen.add(r.other)
                nxt.append(r.other)
        frontier = nxt
    return t.sparkSession.createDataFrame(rows, "subject string, relation string, object string, source string")


def rank(found: DataFrame, t: DataFrame, seeds: list[str], targets: frozenset[str], top: int = TOP) -> DataFrame:
    """3 for a target relation, 2 for touching a seed, and 1 / ln(2 + larger degree); the best `top`."""
    nodes = found.select(F.col("subject").alias("entity")).union(found.select("object")).distinct()
    d = edges(t).join(nodes, "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("degree"))
    f = dedupe_exact(found)
    f = f.join(d.toDF("subject", "ds"), "subject", "left").join(d.toDF("object", "do"), "object", "left")
    one = F.lit(1)
    score = F.when(F.col("relation").isin(*targets), 3.0).otherwise(0.0) + F.when(F.col("subject").isin(*seeds) | F.col("object").isin(*seeds), 2.0).otherwise(0.0) + F.lit(1.0) / F.log(F.lit(2.0) + F.greatest(F.coalesce("ds", one), F.coalesce("do", one)))
    return f.select(*TRIPLE, F.round(score, 6).alias("score")).orderBy(F.desc("score"), *TRIPLE).limit(top)


def dedupe_exact(t: DataFrame) -> DataFrame:
    return t.select(*TRIPLE).distinct()


def retrieve(t: DataFrame, question: str, o: Ontology, linker=seeds_by_spans) -> tuple[list[str], DataFrame]:
    """Seeds of a question and the ranked triples that answer it."""
    seeds = [r.entity for r in linker(entities(t, o), question).collect()]  # at most 10
    words = set(question.lower().replace("?", " ").replace(",", " ").split())
    intent = o.resolve(words)
    if not seeds:
        return [], rank(t.limit(0), t, [""], intent.targets or frozenset([""]))
    if intent.shape == "lookup":
        found = lookup(t, seeds, intent.targets)
    elif intent.shape == "cluster":
        found = cluster(t, seeds, intent.targets, o)
    elif intent.shape == "pairwise":
        found = pairwise(t, seeds, intent.targets)
    else:
        found = open_search(t, seeds, o)
    return seeds, rank(found, t, seeds, intent.targets)


def governed(t: DataFrame, relations: frozenset[str], denied_sources: DataFrame | None, cap: int) -> DataFrame:
    """Cited triples of granted relations without denied sources, in order, up to the cap."""
    if tuple(t.columns[:4]) != TRIPLE:
        raise ValueError("a graph result must have the columns subject, relation, object, source")
    g = t.where(F.col("relation").isin(*relations) & F.col("source").isNotNull() & (F.col("source") != ""))
    if denied_sources is not None:
        g = g.join(denied_sources.select("source"), "source", "left_anti")
    return g.select(*TRIPLE).orderBy(*TRIPLE).limit(cap)


def denied_sources(base: DataFrame, view: DataFrame, key: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Sources of the rows that the role's view hides."""
    hidden = base.select(key).exceptAll(view.select(key)).distinct()
    return hidden.select(F.explode(F.array(*[F.concat(F.lit(p), F.col(key).cast("string")) for p in prefixes])).alias("source"))


def network_nodes(t: DataFrame, most: int = 200, scale: float = 1.0) -> DataFrame:
    """Nodes of the first `most` triples: degree (a loop counts once), drawn size, whether ever a subject."""
    g = t.where("subject <> '' and object <> ''").orderBy(*TRIPLE).limit(most)
    ends = g.select(F.col("subject").alias("node"), F.lit(1).alias("s"), F.lit(1).alias("d")).union(g.select("object", F.lit(0), F.when(F.col("subject") == F.col("object"), 0).otherwise(1)))
    n = ends.groupBy("node").agg(F.sum("d").cast("long").alias("degree"), (F.max("s") == 1).alias("is_subject"))
    return n.withColumn("size", F.least(F.lit(10) + 4 * F.col("degree"), F.lit(40)) * F.lit(scale))


def network_edges(t: DataFrame, most: int = 200) -> DataFrame:
    return t.where("subject <> '' and object <> ''").orderBy(*TRIPLE).limit(most).select("subject", "object", "relation")


def backbone(parts: DataFrame, lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Triples of the sample tables: five relations, one row per (subject, relation, object)."""

    def triple(df: DataFrame, s: Column, r: str, o: Column, source: Column) -> DataFrame:
        return df.select(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"), source.alias("source"))

    p = parts.select("*", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("pn"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("src"))
    # Tasks by the number of rows: the sorts of joins and of dedupe hold a task's rows, so a fixed number of tasks would grow with the tables.
    sales = tasks_for(lineitem.count())
    sold = lineitem.select("l_partkey", "l_suppkey").repartition(sales, "l_partkey").distinct().join(p.select("p_partkey", "pn", "src"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    based = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    inside = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    t = triple(p, F.col("pn"), "HAS_BRAND", F.col("p_brand"), F.col("src"))
    t = t.unionByName(triple(p, F.col("pn"), "HAS_TYPE", F.col("p_type"), F.col("src")))
    t = t.unionByName(triple(sold, F.col("pn"), "SUPPLIED_BY", F.col("s_name"), F.col("src")))
    t = t.unionByName(triple(based, F.col("s_name"), "BASED_IN", F.col("n_name"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))))
    t = t.unionByName(triple(inside, F.col("n_name"), "IN_REGION", F.col("r_name"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))))
    return dedupe(t.repartition(sales + 2 * tasks_for(parts.count()), "subject", "relation", "object"))


def save_store(t: DataFrame, path: str) -> None:
    """Triples by relation and, once for all readers, every entity with its degree."""
    # Each task writes its own rows of every relation, and the names are those of the folders: t is computed once and not dealt out again.
    spark, fresh = t.sparkSession, f"{path}/triples-{uuid.uuid4().hex}"
    t.select(*TRIPLE).write.partitionBy("relation").parquet(fresh)
    old, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/triples", fresh))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        for r in spark.read.schema("subject string, object string, source string, relation string").parquet(fresh).select("relation").distinct().collect():  # a few relations of the ontology
            safe_name(r.relation or "")
    except ValueError:
        fs.delete(new, True)
        raise
    fs.delete(old, True)
    fs.rename(new, old)
    degree(open_store(t.sparkSession, path)).write.mode("overwrite").parquet(f"{path}/nodes")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject string, object string, source string, relation string").parquet(f"{path}/triples").select(*TRIPLE)


def store_nodes(spark: SparkSession, path: str) -> DataFrame:
    """entity (unique), degree."""
    return spark.read.schema("entity string, degree long").parquet(f"{path}/nodes")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of JSON lines; a missing source is '', a malformed line an error."""
    d = spark.read.schema("subject string, relation string, obj string, source string").option("mode", "FAILFAST").json(path)
    return d.select("subject", "relation", F.col("obj").alias("object"), F.coalesce("source", F.lit("")).alias("source"))


def write_triples(t: DataFrame, path: str, append: bool = False) -> int:
    """Writes JSON lines and returns how many."""
    seen = Observation()
    t.observe(seen, F.count(F.lit(1)).alias("n")).select("subject", "relation", F.col("object").alias("obj"), "source").write.mode("append" if append else "overwrite").json(path)
    return seen.get["n"]


SAMPLE = Ontology(
    attributes=frozenset({"HAS_BRAND", "HAS_TYPE"}),
    connective=frozenset({"SUPPLIED_BY", "BASED_IN"}),
    intents=(
        Intent("suppliers", "lookup", frozenset({"supplies", "supplier", "suppliers", "supplied"}), frozenset({"SUPPLIED_BY"})),
        Intent("alike", "cluster", frozenset({"similar", "alike", "like"}), frozenset({"BASED_IN"})),
        Intent("common", "pairwise", frozenset({"both", "common", "shared"}), frozenset({"SUPPLIED_BY", "BASED_IN"})),
    ),
    relations=frozenset({"HAS_BRAND", "HAS_TYPE", "SUPPLIED_BY", "BASED_IN", "IN_REGION"}),
)
