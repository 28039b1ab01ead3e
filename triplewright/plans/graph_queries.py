"""Queries over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import graph as g
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query

SEEDS_SQL = ", ".join(f"'{s}'" for s in v.SEEDS)
HOP1 = f"""hop1 AS (
  SELECT DISTINCT src, rel, dst, coalesce(confidence, 100.0) AS confidence, 1 AS hop FROM edges
  WHERE rel <> '{v.SAFETY}' AND (src IN ({SEEDS_SQL}) OR dst IN ({SEEDS_SQL})))"""
HOP2 = f"""frontier AS (
  SELECT DISTINCT id FROM (SELECT src AS id FROM hop1 UNION ALL SELECT dst FROM hop1) JOIN nodes USING (id)
  WHERE id NOT IN ({SEEDS_SQL}) AND label IN ('Order', 'Nation') ORDER BY id LIMIT 30
), hop2 AS (
  SELECT DISTINCT src, rel, dst, coalesce(confidence, 100.0) AS confidence, 2 AS hop FROM (
    SELECT e.*, dst AS far FROM edges e WHERE src IN (FROM frontier) UNION ALL SELECT e.*, src FROM edges e WHERE dst IN (FROM frontier))
  JOIN nodes ON nodes.id = far WHERE label IN ('Part', 'Supplier', 'Region'))"""
SAFE_PARTS = ("P1", "P2", "P3", "P5", "P8", "P13", "P21", "P34", "P55", "P89")
SAFE_SQL = ", ".join(f"'{p}'" for p in SAFE_PARTS)
SAFETY_EDGES = f"""safety AS (SELECT DISTINCT src, rel, dst, coalesce(confidence, 100.0) AS confidence, 1 AS hop FROM edges
  WHERE rel = '{v.SAFETY}' AND (src IN ({SAFE_SQL}) OR dst IN ({SAFE_SQL})))"""
SCORED = """(coalesce(w, 1) + CASE WHEN hop = 1 THEN 2 ELSE 0 END) * confidence / 100 AS score"""
MERGED = f"""WITH {v.EDGES}, {v.NODES}, {v.WEIGHTS_SQL}, {HOP1}, {HOP2}, {SAFETY_EDGES}, merged AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY stage, hop, confidence DESC) AS nth FROM (
      SELECT *, 0 AS stage FROM safety UNION ALL SELECT *, 1 FROM hop1 UNION ALL SELECT *, 2 FROM hop2)) WHERE nth = 1
), scored AS (SELECT merged.*, {SCORED} FROM merged LEFT JOIN rel_weights USING (rel))"""


def _hop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.hop1(v.edges_at(spark, sf_dir, v.SEEDS), v.SEEDS, v.SAFETY)


def _hop2(spark: SparkSession, sf_dir: str, first: DataFrame, most: int | None = None) -> DataFrame:
    nodes = v.nodes(spark, sf_dir)
    chosen = g.frontier(first, nodes, v.SEEDS, ("Order", "Nation"), 30)
    return g.hop2(v.edges_at(spark, sf_dir, chosen), chosen, nodes, ("Part", "Supplier", "Region"), most)


def _safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.safety_edges(v.edges_at(spark, sf_dir, SAFE_PARTS, (v.SAFETY,)), SAFE_PARTS, v.SAFETY)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _hop1(spark, sf_dir)
    return g.score(g.first_of([_safety(spark, sf_dir), first, _hop2(spark, sf_dir, first)]), v.weights(spark))


@query
def graph_hop1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.best(g.score(_hop1(spark, sf_dir), v.weights(spark)), 20).select("src", "rel", "dst", "confidence", "hop", "score")


oracle(graph_hop1_topk, f"WITH {v.EDGES}, {v.WEIGHTS_SQL}, {HOP1} SELECT src, rel, dst, confidence, hop, {SCORED} FROM hop1 LEFT JOIN rel_weights USING (rel) ORDER BY score DESC, src, rel, dst LIMIT 20")


@query
def graph_hop2_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("src", "rel", "dst", "confidence", "hop", "stage", "score")


oracle(graph_hop2_frontier, f"{MERGED} SELECT src, rel, dst, confidence, hop, stage, score FROM scored")


@query
def graph_safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an alert is allowed: only if a safety edge survives the ranked cut, and which comes first."""
    top = g.best(_merged(spark, sf_dir), 50)
    risky = F.when(F.col("rel") == v.SAFETY, F.struct(-F.col("score"), "src", "dst"))
    return top.agg(F.count_if(F.col("rel") == v.SAFETY).alias("n_safety"), F.min(risky).alias("m")).select("n_safety", (F.col("n_safety") > 0).alias("alert"), F.col("m.src").alias("first_src"), F.col("m.dst").alias("first_dst"))


oracle(
    graph_safety_gate,
    f"""{MERGED}, top AS (SELECT * FROM scored ORDER BY score DESC, src, rel, dst LIMIT 50)
SELECT count(*) FILTER (rel = '{v.SAFETY}') AS n_safety, count(*) FILTER (rel = '{v.SAFETY}') > 0 AS alert,
  (SELECT src FROM top WHERE rel = '{v.SAFETY}' ORDER BY score DESC, src, dst LIMIT 1) AS first_src,
  (SELECT dst FROM top WHERE rel = '{v.SAFETY}' ORDER BY score DESC, src, dst LIMIT 1) AS first_dst FROM top""",
)


@query
def graph_safety_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _safety(spark, sf_dir)


oracle(graph_safety_edges, f"WITH {v.EDGES}, {SAFETY_EDGES} SELECT * FROM safety")


@query
def graph_context_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = g.best(_merged(spark, sf_dir), 50).withColumn("section", g.section(F.col("rel"), (v.SAFETY,), ("SUPPLIED_BY", "CONTAINS")))
    line = F.concat(F.lit("("), "src", F.lit(")-["), "rel", F.lit("]->("), "dst", F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct(-F.col("score"), line.alias("line"))))
    return top.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"))


oracle(
    graph_context_sections,
    f"""{MERGED}, top AS (SELECT *, concat('(', src, ')-[', rel, ']->(', dst, ')') AS line FROM scored ORDER BY score DESC, src, rel, dst LIMIT 50)
SELECT CASE WHEN rel = '{v.SAFETY}' THEN 'circuit' WHEN rel IN ('SUPPLIED_BY', 'CONTAINS') THEN 'treatment' ELSE 'evidence' END AS section,
  count(*) AS n, string_agg(line, chr(10) ORDER BY score DESC, line) AS lines FROM top GROUP BY 1""",
)


@query
def graph_evidence_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _merged(spark, sf_dir)
    chosen = ranked.where((F.col("rel") == "LOCATED_IN") & (F.col("hop") == 1)).orderBy(F.desc("score"), *g.KEY).limit(3)
    return g.backfill(chosen, ranked, 6)


oracle(
    graph_evidence_backfill,
    f"""{MERGED}, chosen AS (SELECT src, rel, dst, score FROM scored WHERE rel = 'LOCATED_IN' AND hop = 1 ORDER BY score DESC, src, rel, dst LIMIT 3),
every AS (SELECT *, 0 AS filled FROM chosen UNION ALL SELECT src, rel, dst, score, 1 FROM scored s WHERE NOT EXISTS (FROM chosen c WHERE c.src = s.src AND c.rel = s.rel AND c.dst = s.dst))
SELECT *, CAST(row_number() OVER (ORDER BY filled, score DESC, src, rel, dst) AS INTEGER) AS place FROM every ORDER BY place LIMIT 6""",
)


@query
def graph_node_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.at_node(v.edges_at(spark, sf_dir, ("P7",)), "P7")


oracle(graph_node_relations, f"WITH {v.EDGES} SELECT DISTINCT * FROM (SELECT src, rel, dst, 'out' AS direction FROM edges WHERE src = 'P7' UNION ALL SELECT src, rel, dst, 'in' FROM edges WHERE dst = 'P7')")


@query
def graph_paths_1_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets = ("P1", "P2", "P3"), ("N1", "N2", "N3", "S4")
    return g.paths(v.edges_at(spark, sf_dir, sources + targets), sources, targets)


oracle(
    graph_paths_1_2,
    f"""WITH {v.EDGES}, a AS (SELECT src, rel, dst, dst AS mid FROM edges WHERE src IN ('P1', 'P2', 'P3') UNION ALL SELECT src, rel, dst, src FROM edges WHERE dst IN ('P1', 'P2', 'P3')),
b AS (SELECT src, rel, dst, dst AS mid FROM edges WHERE src IN ('N1', 'N2', 'N3', 'S4') UNION ALL SELECT src, rel, dst, src FROM edges WHERE dst IN ('N1', 'N2', 'N3', 'S4')),
two AS (SELECT a.src AS s1, a.rel AS r1, a.dst AS d1, b.src AS s2, b.rel AS r2, b.dst AS d2 FROM a JOIN b USING (mid) WHERE NOT (a.src = b.src AND a.rel = b.rel AND a.dst = b.dst))
SELECT src, rel, dst FROM edges WHERE (src IN ('P1', 'P2', 'P3') AND dst IN ('N1', 'N2', 'N3', 'S4')) OR (dst IN ('P1', 'P2', 'P3') AND src IN ('N1', 'N2', 'N3', 'S4'))
UNION SELECT s1, r1, d1 FROM two UNION SELECT s2, r2, d2 FROM two""",
)


@query
def graph_pseudo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q09: every ordered pair of two small id sets, unequal. Both sides are request arguments of a few ids."""
    ids = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    return ids("src", v.SEEDS).join(ids("dst", ("C3", "C9", "P1")), F.col("src") != F.col("dst"))


oracle(graph_pseudo_pairs, "SELECT * FROM (VALUES ('C1'), ('C2'), ('C3'), ('C4'), ('C5')) a(src), (VALUES ('C3'), ('C9'), ('P1')) b(dst) WHERE src <> dst")


@query
def graph_label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.nodes(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("aliases")).alias("n_aliases"))


oracle(graph_label_histogram, f"WITH {v.NODES} SELECT label, count(*) AS n, sum(len(aliases))::BIGINT AS n_aliases FROM nodes GROUP BY label")


@query
def graph_node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q27, Q28: ids whose name or any alias contains one of the terms, in id order."""
    terms = F.array(*map(F.lit, ("steel", "brand#1", "asia")))
    n = v.nodes(spark, sf_dir).where("id is not null")
    hit = F.exists(terms, lambda t: F.lower("name").contains(t) | F.exists("aliases", lambda a: F.lower(a).contains(t)))
    return n.where(hit).select("id", "label", "name").orderBy("id").limit(500)


oracle(
    graph_node_search,
    f"""WITH {v.NODES} SELECT id, label, name FROM nodes
WHERE len(list_filter(['steel', 'brand#1', 'asia'], lambda t: contains(lower(name), t) OR len(list_filter(aliases, lambda a: contains(lower(a), t))) > 0)) > 0 ORDER BY id LIMIT 500""",
)


@query
def graph_verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q18: claims about order lines against the graph; some are stated backwards, some are wrong."""
    l = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    order, part = F.concat(F.lit("O"), "l_orderkey"), F.concat(F.lit("P"), "l_partkey")
    wrong = F.concat(F.lit("P"), F.col("l_partkey") + 1)
    k = F.col("l_linenumber") % 3
    claims = l.select(F.when(k == 1, part).otherwise(order).alias("s"), F.lit("CONTAINS").alias("r"), F.when(k == 1, order).when(k == 2, wrong).otherwise(part).alias("o")).distinct()
    return g.verify(claims, v.edges(spark, sf_dir)).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


oracle(
    graph_verify_claims,
    f"""WITH {v.EDGES}, e AS (SELECT DISTINCT src, rel, dst FROM edges), claims AS (
  SELECT DISTINCT CASE WHEN l_linenumber % 3 = 1 THEN concat('P', l_partkey) ELSE concat('O', l_orderkey) END AS s, 'CONTAINS' AS r,
    CASE l_linenumber % 3 WHEN 1 THEN concat('O', l_orderkey) WHEN 2 THEN concat('P', l_partkey + 1) ELSE concat('P', l_partkey) END AS o FROM lineitem)
SELECT CASE WHEN f.src IS NOT NULL THEN 'exact' WHEN b.src IS NOT NULL THEN 'reversed' END AS how, count(*) AS n
FROM claims LEFT JOIN e f ON f.src = s AND f.rel = r AND f.dst = o LEFT JOIN e b ON b.dst = s AND b.rel = r AND b.src = o GROUP BY 1""",
)
