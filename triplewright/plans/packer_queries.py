"""The packer as a whole, over triples derived from order lines: suppliers treat, titrate and adjust parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import graph_build as b
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query

PART_LABELS, SUPPLIER_LABELS, TYPES = ("Drug", "Disease", "Clinical Metric", "Unknown"), ("Drug", "Disease", "Symptom"), ("T121", "T047", "T059")
_PICK = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col(n) % len(xs)).cast("int"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_quantity").cast("int").alias("q"))
    l = l.join(v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    ord_ = F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    return l.select(F.col("l_orderkey").alias("doc_id"), ord_.alias("ord"), ((F.col("l_partkey") + F.col("l_suppkey")) % 6).alias("k"), F.concat(F.lit("P"), "l_partkey").alias("p"), F.concat(F.lit("S"), "l_suppkey").alias("u"), "p_name", "q", "l_partkey", "l_suppkey")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l, k = _lines(spark, sf_dir), F.col("k")
    r = F.get(F.array(*map(F.lit, ("treated by", "has titration rule", "has dose adjustment", "has clinical threshold", "has finding", "contraindicated with"))), k.cast("int"))
    value = F.when(k == 2, F.concat(F.lit("increase by "), "q", F.lit("%"))).otherwise(F.concat(F.lit("< "), "q"))
    s = F.when(k.isin(0, 3, 4), F.col("p")).otherwise(F.col("u"))
    o = F.when(k == 0, F.col("u")).when(k.isin(1, 5), F.col("p")).when(k == 4, F.col("p_name")).otherwise(value)
    triples = l.select("doc_id", "ord", s.alias("s"), r.alias("r"), o.alias("o"))
    none = F.lit(None).cast("string")
    pl, sl = _PICK(PART_LABELS, "l_partkey"), _PICK(SUPPLIER_LABELS, "l_suppkey")
    typed = l.select("doc_id", "ord", s.alias("subject"), F.when(k.isin(0, 3, 4), pl).otherwise(sl).alias("subject_type"), none.alias("subject_type_canon"), o.alias("object"), F.when(k == 0, sl).when(k.isin(1, 5), pl).when(k == 4, "symptom").otherwise("Unknown").alias("object_type"), none.alias("object_type_canon"))
    p = v.table(spark, sf_dir, "part")
    vocabulary = p.where("p_partkey % 5 = 4").select(F.concat(F.lit("P"), "p_partkey").alias("term"), F.concat("p_brand", F.lit("/"), F.col("p_size") % 3).alias("code"), F.col("p_name").alias("canonical"), _PICK(TYPES, "p_size").alias("type"))
    scores = p.select(F.concat(F.lit("p"), "p_partkey").alias("s"), F.lit("treated_by").alias("key"), F.concat(F.lit("s"), F.col("p_partkey") % 10).alias("o"), F.col("p_size").cast("double").alias("score"))
    return b.pack_graph(triples, typed, vocabulary, scores)


PACKED = f"""l AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, (l_partkey + l_suppkey) % 6 AS k, concat('P', l_partkey) AS p, concat('S', l_suppkey) AS u, p_name, max(l_quantity)::INT AS q
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name),
t AS (SELECT doc, ord, k, CASE WHEN k IN (0, 3, 4) THEN p ELSE u END AS s, CASE k WHEN 0 THEN u WHEN 1 THEN p WHEN 5 THEN p WHEN 4 THEN p_name END AS o, CASE k WHEN 2 THEN concat('+', q, '%') WHEN 3 THEN concat('<', q) END AS x FROM l),
since AS (SELECT id, min(doc) AS since FROM (SELECT doc, unnest([s, o]) AS id FROM t WHERE k = 1) GROUP BY id),
free AS (SELECT t.* FROM t LEFT JOIN since ON id = s WHERE k IN (2, 3) AND (since IS NULL OR since > doc)),
ends AS (SELECT doc, 0 AS turn, ord, 0 AS slot, s AS id FROM t WHERE k NOT IN (2, 3) UNION ALL SELECT doc, 0, ord, 1, o FROM t WHERE k NOT IN (2, 3) UNION ALL SELECT doc, 1, ord, 0, s FROM free),
n0 AS (SELECT id, min({{'a': doc, 'b': turn, 'c': ord, 'd': slot}}) AS seen FROM ends GROUP BY id),
props AS (SELECT s AS id, arg_max(x, {{'a': doc, 'b': ord, 'c': x}}) FILTER (k = 3) AS threshold, arg_max(x, {{'a': doc, 'b': ord, 'c': x}}) FILTER (k = 2) AS dose FROM free GROUP BY s),
treated AS (SELECT DISTINCT s AS id FROM t WHERE k = 0),
n1 AS (SELECT n0.id, seen, CASE WHEN id[1] = 'P' AND p_partkey IS NOT NULL THEN {list(PART_LABELS)}[p_partkey % 4 + 1] WHEN id[1] = 'S' AND regexp_full_match(id, 'S[0-9]+') THEN {list(SUPPLIER_LABELS)}[id[2:]::INT % 3 + 1] ELSE 'Symptom' END AS label,
  CASE WHEN p_partkey % 5 = 4 THEN concat(p_brand, '/', p_size % 3) ELSE 'NONE' END AS code, CASE WHEN p_partkey % 5 = 4 THEN p_name ELSE n0.id END AS canonical, CASE WHEN p_partkey % 5 = 4 THEN {list(TYPES)}[p_size % 3 + 1] ELSE 'Unknown' END AS type
  FROM n0 LEFT JOIN part ON concat('P', p_partkey) = n0.id),
n2 AS (SELECT n1.*, n1.id IN (FROM treated) AND (label IN ('Drug', 'Clinical Metric') OR type = 'T121' OR (type = 'T059' AND label NOT IN ('Disease', 'Symptom'))) AS bad FROM n1),
n3 AS (SELECT id, seen, label, CASE WHEN bad THEN 'NONE' ELSE code END AS code, CASE WHEN bad THEN id ELSE canonical END AS canonical, CASE WHEN bad THEN 'Unknown' ELSE type END AS type FROM n2),
n4 AS (SELECT n3.*, threshold, dose, CASE WHEN code = 'NONE' THEN n3.id ELSE first_value(canonical) OVER (PARTITION BY code ORDER BY seen) END AS canon FROM n3 LEFT JOIN props USING (id)),
nodes AS (SELECT canon AS id, array_to_string(list_sort(CASE WHEN bool_or(label <> 'Unknown') THEN list_distinct(list(label) FILTER (label <> 'Unknown')) ELSE ['Concept'] END), ',') AS labels, list_distinct(list(n4.id)) AS ids,
  coalesce(arg_min(code, seen) FILTER (code <> 'NONE'), 'NONE') AS code, arg_min(canonical, seen) AS canonical, coalesce(arg_min(type, seen) FILTER (type <> 'Unknown'), 'Unknown') AS type,
  arg_min(threshold, seen) FILTER (threshold IS NOT NULL) AS target_threshold, arg_min(dose, seen) FILTER (dose IS NOT NULL) AS dosage_value FROM n4 GROUP BY canon)"""


@query
def pack_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G03, G05, G06, G09, G11-G14 in one call."""
    nodes, _ = _packed(spark, sf_dir)
    return nodes.select("id", F.array_join("labels", ",").alias("labels"), F.size("aliases").alias("n_aliases"), "code", "canonical", "type", "target_threshold", "dosage_value")


oracle(pack_graph_nodes, f"WITH {PACKED} SELECT id, labels, len(list_filter(ids, lambda x: x <> id AND x <> canonical))::INTEGER AS n_aliases, code, canonical, type, target_threshold, dosage_value FROM nodes")


@query
def pack_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01, G04, G07, G15, G16 in the same call."""
    return _packed(spark, sf_dir)[1]


oracle(
    pack_graph_edges,
    f"""WITH {PACKED}, th AS (SELECT doc, s AS id, arg_max(x, {{'a': ord, 'b': x}}) AS threshold FROM t WHERE k = 3 GROUP BY ALL), ad AS (SELECT doc, s AS id, arg_max(x, {{'a': ord, 'b': x}}) AS adjustment FROM t WHERE k = 2 GROUP BY ALL),
e AS (SELECT t.*, ['treated_by', 'has_titration_rule', '', '', 'has_finding', 'contraindicated_with'][k + 1] AS key, CASE WHEN k = 1 THEN threshold END AS threshold, CASE WHEN k = 1 THEN adjustment END AS adjustment FROM t LEFT JOIN th ON th.doc = t.doc AND th.id = t.o LEFT JOIN ad ON ad.doc = t.doc AND ad.id = t.s WHERE k NOT IN (2, 3)),
m AS (SELECT e.*, a.canon AS cs, b.canon AS co, x.labels AS sl, x.type AS st, y.labels AS ol, y.type AS ot, coalesce(p_size::DOUBLE, 100.0::DOUBLE) AS confidence FROM e JOIN n4 a ON a.id = s JOIN n4 b ON b.id = o JOIN nodes x ON x.id = a.canon JOIN nodes y ON y.id = b.canon
  LEFT JOIN part ON key = 'treated_by' AND concat('P', p_partkey) = s AND concat('S', p_partkey % 10) = o WHERE a.canon <> b.canon),
w AS (SELECT *, key = 'treated_by' AND (contains(sl, 'Clinical Metric') OR st = 'T059') AND (contains(ol, 'Drug') OR ot = 'T121') AS turn FROM m)
SELECT CASE WHEN turn THEN co ELSE cs END AS src, CASE WHEN turn THEN 'decreases' ELSE key END AS rel, CASE WHEN turn THEN cs ELSE co END AS dst, confidence, threshold, adjustment FROM w
QUALIFY row_number() OVER (PARTITION BY 1, 2, 3 ORDER BY doc, ord, confidence) = 1""".replace("PARTITION BY 1, 2, 3", "PARTITION BY CASE WHEN turn THEN co ELSE cs END, CASE WHEN turn THEN 'decreases' ELSE key END, CASE WHEN turn THEN cs ELSE co END"),
)
