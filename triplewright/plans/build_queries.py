"""Queries that validate triples, retrieve by vectors, look up vocabularies and build the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions.entities import INSTRUCTIONS, NON_ENTITIES, UNANCHORED
from triplewright.operators import graph_build as b
from triplewright.operators import matching as m
from triplewright.operators import validation as val
from triplewright.plans import views as v
from triplewright.plans.entity_queries import KEYED, NAMES, _names
from triplewright.plans.registry import oracle, query


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes with several spellings; every fifth holds a code, shared by the parts of one brand and size."""
    p = v.table(spark, sf_dir, "part")
    coded = F.col("p_partkey") % 5 == 4
    n = p.join(_names(spark, sf_dir), "p_partkey")
    return n.select(F.concat("name", F.lit(" #"), F.col("p_partkey") % 9).alias("id"), "p_partkey", F.when(coded, F.concat("p_brand", F.lit("/"), F.col("p_size") % 3)).otherwise("NONE").alias("code"), F.when(coded, F.col("p_name")).otherwise("NONE").alias("canonical"), "p_type", "p_size").groupBy("id").agg(F.min("p_partkey").alias("seen"), F.min_by("code", "p_partkey").alias("code"), F.min_by("canonical", "p_partkey").alias("canonical"), F.min_by("p_type", "p_partkey").alias("type"))


NODE_SQL = """n0 AS (SELECT concat(name, ' #', p_partkey % 9) AS id, p_partkey AS seen, CASE WHEN p_partkey % 5 = 4 THEN concat(p_brand, '/', p_size % 3) ELSE 'NONE' END AS code,
  CASE WHEN p_partkey % 5 = 4 THEN p_name ELSE 'NONE' END AS canonical, p_type AS type FROM part JOIN names USING (p_partkey)),
n1 AS (SELECT id, min(seen) AS seen, arg_min(code, seen) AS code, arg_min(canonical, seen) AS canonical, arg_min(type, seen) AS type FROM n0 GROUP BY id)"""


def _keys_of_ids() -> str:
    """The key CTEs of entity_queries, over the node ids instead of the names."""
    head, _, tail = KEYED.partition("abbr(a, full_)")
    tail = tail.replace("plain AS (SELECT p_partkey, name, trim(", "plain AS (SELECT seen AS p_partkey, id AS name, trim(").replace("lower(name)", "lower(id)").replace("FROM names)", "FROM n1)")
    return f"{head}{NODE_SQL}, abbr(a, full_){tail}"


CANON_SQL = f"""{_keys_of_ids()}, k AS (SELECT n1.*, CASE WHEN code <> 'NONE' THEN code ELSE key END AS k, CASE WHEN code <> 'NONE' THEN canonical ELSE id END AS own FROM n1 JOIN keyed ON name = id),
canon AS (SELECT *, first_value(own) OVER (PARTITION BY k ORDER BY seen) AS canon FROM k)"""


@query
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ids."""
    return b.canonical_ids(_part_nodes(spark, sf_dir)).select("id", "canon")


oracle(entity_groups, f"WITH {CANON_SQL} SELECT id, canon FROM canon")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = b.canonical_ids(_part_nodes(spark, sf_dir)).withColumn("labels", F.array(F.lit("Concept"), F.element_at(F.split("type", " "), 1)))
    return b.merge_nodes(nodes, ("code", "canonical", "type"))


@query
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged labels, aliases and first informative properties."""
    x = _merged(spark, sf_dir)
    return x.select("canon", F.array_join(b.inferred_labels(F.col("labels"), F.col("type")), ",").alias("labels"), F.size("aliases").alias("n_aliases"), "code", "type")


oracle(
    entity_merge,
    f"""WITH {CANON_SQL} SELECT canon, string_agg(DISTINCT string_split(type, ' ')[1], ',' ORDER BY string_split(type, ' ')[1]) AS labels, CAST(count(DISTINCT id) FILTER (id <> canon) AS INTEGER) AS n_aliases,
  arg_min(code, seen) FILTER (code <> 'NONE') AS code, arg_min(type, seen) AS type FROM canon GROUP BY canon""",
)


@query
def entity_alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncoded nodes that match an alias of a coded one; checked on a hand example in the tests."""
    return b.alias_targets(_merged(spark, sf_dir))


@query
def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes before and after resolution, and how many hold a code."""
    x = b.canonical_ids(_part_nodes(spark, sf_dir))
    return x.agg(F.count(F.lit(1)).alias("before"), F.count_distinct("canon").alias("after"), F.count_if(F.col("code") != "NONE").alias("coded"), F.round(100 * (1 - F.try_divide(F.count_distinct("canon"), F.count(F.lit(1)))), 4).alias("reduction"))


oracle(pack_stats, f"WITH {CANON_SQL} SELECT count(*) AS before, count(DISTINCT canon) AS after, count(*) FILTER (code <> 'NONE') AS coded, round(100 * (1 - count(DISTINCT canon) / count(*)), 4) AS reduction FROM canon")


def _titration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples in which orders adjust parts: rules, thresholds of parts, adjustments of suppliers."""
    l = v.table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    k = F.col("l_linenumber") % 3
    rows = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(k == 2, p).otherwise(s).alias("s"), F.when(k == 0, "has titration rule").when(k == 1, "has dose adjustment").otherwise("has clinical threshold").alias("r"), F.when(k == 0, p).when(k == 1, F.concat(F.lit("increase by "), F.col("l_quantity").cast("int"), F.lit("%"))).otherwise(F.concat(F.lit("< "), F.col("l_quantity").cast("int"))).alias("o"))
    return b.split_values(rows)


TITRATION = """t AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_linenumber % 3 AS k, CASE WHEN l_linenumber % 3 = 2 THEN concat('P', l_partkey) ELSE concat('S', l_suppkey) END AS s,
  CASE l_linenumber % 3 WHEN 0 THEN concat('P', l_partkey) WHEN 1 THEN concat('+', l_quantity::INT, '%') ELSE concat('<', l_quantity::INT) END AS x FROM lineitem)"""


@query
def titration_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G04, G07."""
    return b.titration_edges(_titration(spark, sf_dir)).select("doc_id", "ord", "s", "o", "threshold", "adjustment")


oracle(
    titration_pack,
    f"""WITH {TITRATION}, th AS (SELECT doc_id, s AS o, arg_max(x, {{'o': ord, 'x': x}}) AS threshold FROM t WHERE k = 2 GROUP BY ALL), ad AS (SELECT doc_id, s, arg_max(x, {{'o': ord, 'x': x}}) AS adjustment FROM t WHERE k = 1 GROUP BY ALL)
SELECT t.doc_id, ord, t.s, x AS o, threshold, adjustment FROM t LEFT JOIN th ON th.doc_id = t.doc_id AND th.o = x LEFT JOIN ad ON ad.doc_id = t.doc_id AND ad.s = t.s WHERE k = 0""",
)


@query
def value_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that no titration edge of the same or an earlier document takes up."""
    return b.value_properties(_titration(spark, sf_dir))


oracle(
    value_properties,
    f"""WITH {TITRATION}, since AS (SELECT s, min(doc_id) AS since FROM (SELECT s, doc_id FROM t WHERE k = 0 UNION ALL SELECT x, doc_id FROM t WHERE k = 0) GROUP BY s)
SELECT t.s, CASE k WHEN 2 THEN 'target_threshold' ELSE 'dosage_value' END AS property, arg_max(x, {{'d': doc_id, 'o': ord, 'x': x}}) AS value FROM t LEFT JOIN since USING (s) WHERE k <> 0 AND (since IS NULL OR since > doc_id) GROUP BY ALL""",
)


@query
def edge_remap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order edges remapped from parts to brands; self-loops go, the first of equal edges keeps its score."""
    p = v.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    l = v.table(spark, sf_dir, "lineitem")
    edges = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("part"), "l_partkey").alias("s"), F.lit("treated_by").alias("key"), F.concat(F.lit("supp"), F.col("l_suppkey") % 50).alias("o"))
    canon = p.select(F.concat(F.lit("part"), "p_partkey").alias("id"), "p_brand").withColumnRenamed("p_brand", "canon")
    labels = p.groupBy(F.col("p_brand").alias("canon")).agg(F.min("p_size").alias("z")).select("canon", F.when(F.col("z") == 1, F.array(F.lit("Clinical Metric"))).otherwise(F.array(F.lit("Disease"))).alias("labels"))
    labels = labels.unionByName(spark.range(50).select(F.concat(F.lit("supp"), "id").alias("canon"), F.array(F.lit("Drug")).alias("labels")))
    scores = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("part"), "p_partkey").alias("s"), F.lit("treated_by").alias("key"), F.lit("supp7").alias("o"), F.col("p_size").cast("double").alias("score"))
    return b.remap_edges(edges, canon, labels, scores)


oracle(
    edge_remap_dedup,
    """WITH x AS (SELECT l_orderkey AS d, l_linenumber AS i, p_brand, concat('supp', l_suppkey % 50) AS o, min(p_size) OVER (PARTITION BY p_brand) AS z, CASE WHEN p_partkey % 3 = 0 AND l_suppkey % 50 = 7 THEN p_size::DOUBLE ELSE 100.0::DOUBLE END AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT p_brand, min(p_size) AS z FROM part GROUP BY p_brand)
SELECT CASE WHEN m.z = 1 THEN o ELSE x.p_brand END AS src, CASE WHEN m.z = 1 THEN 'decreases' ELSE 'treated_by' END AS rel, CASE WHEN m.z = 1 THEN x.p_brand ELSE o END AS dst, arg_min(confidence, {'d': d, 'i': i, 'c': confidence}) AS confidence
FROM x JOIN m USING (p_brand) GROUP BY 1, 2, 3""",
)


@query
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged with newer rows for a third of them and a few new ones."""
    c = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    new = c.where("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 1_000_000).otherwise(0)).alias("id"), F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return b.upsert(c, new, ["id"])


oracle(
    node_upsert,
    """WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 1000000 ELSE 0 END AS id, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(n.id, c_custkey) AS id, c_name, coalesce(bal, c_acctbal) AS c_acctbal FROM customer FULL JOIN n ON n.id = c_custkey""",
)


@query
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of allowed relations whose ends exist; nodes without an allowed label are not loaded."""
    nodes = v.nodes(spark, sf_dir).where(F.col("label").isin("Part", "Supplier", "Nation"))
    return b.loadable_edges(v.edges(spark, sf_dir), nodes, ("SUPPLIED_BY", "LOCATED_IN", v.SAFETY)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


oracle(edge_upsert, f"WITH {v.EDGES}, {v.NODES}, k AS (SELECT id FROM nodes WHERE label IN ('Part', 'Supplier', 'Nation')) SELECT rel, count(*) AS n FROM (SELECT DISTINCT src, rel, dst FROM edges WHERE rel IN ('SUPPLIED_BY', 'LOCATED_IN', '{v.SAFETY}') AND src IN (FROM k) AND dst IN (FROM k)) GROUP BY rel")


@query
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K07 over part names as ids."""
    return b.repeated_ids(v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("id")))


oracle(repeated_ids, "SELECT p_brand AS label, p_name AS id, count(*) AS count FROM part GROUP BY ALL HAVING count(*) > 1")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = v.table(spark, sf_dir, "lineitem")
    t = lambda c: F.when(F.col(c) % 4 == 0, "Drug").when(F.col(c) % 4 == 1, "Disease").otherwise("Symptom")
    return l.select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), "l_partkey").alias("s"), t("l_partkey").alias("st"), F.when(F.col("l_linenumber") % 2 == 0, "treated by").otherwise("has finding").alias("r"), F.concat(F.lit("S"), "l_suppkey").alias("o"), t("l_suppkey").alias("ot"))


@query
def direction_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V08, V12 with rules learned from two examples."""
    examples = spark.createDataFrame([("flu", "treated by", "aspirin", "Disease", "Drug")], "s string, r string, o string, st string, ot string")
    return val.check_types(_typed(spark, sf_dir), val.learned_rules(examples)).groupBy("r", "turned", "keep").agg(F.count(F.lit(1)).alias("n"))


oracle(
    direction_fix,
    """WITH x AS (SELECT l_linenumber % 2 = 0 AS tb, CASE l_partkey % 4 WHEN 0 THEN 'Drug' WHEN 1 THEN 'Disease' ELSE 'Symptom' END AS a, CASE l_suppkey % 4 WHEN 0 THEN 'Drug' WHEN 1 THEN 'Disease' ELSE 'Symptom' END AS b FROM lineitem)
SELECT CASE WHEN tb THEN 'treated by' ELSE 'has finding' END AS r, tb AND a = 'Drug' AND b = 'Disease' AS turned, NOT tb OR (a = 'Disease' AND b = 'Drug') OR (a = 'Drug' AND b = 'Disease') AS keep, count(*) AS n FROM x GROUP BY 1, 2, 3""",
)


@query
def validate_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons over triples between part names, anchored in a text of one of them."""
    n = _names(spark, sf_dir).alias("a")
    x = n.join(_names(spark, sf_dir).alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 5)
    t = x.select(F.col("a.p_partkey").alias("doc_id"), F.col("a.name").alias("s"), F.lit("is_a").alias("r"), F.col("b.name").alias("o"), F.when(F.col("a.p_partkey") % 2 == 0, F.col("b.name")).otherwise(F.lit("steel and brass")).alias("text"))
    t = t.withColumn("cs", F.regexp_replace("s", "^The ", "")).withColumn("co", F.when(F.col("doc_id") % 10 == 3, F.col("s")).otherwise(F.col("o")))
    return val.validate(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_ATOMIC = lambda c: f"(len(string_split({c}, ' ')) BETWEEN 1 AND 5 AND regexp_replace(lower(split_part({c}, ' ', 1)), '[,.:]+$', '') NOT IN ({', '.join(repr(w) for w in INSTRUCTIONS)}))"
_NON_ENTITY = lambda c: f"regexp_matches({c}, '(?i){'|'.join(f'(?:{p})' for p in NON_ENTITIES)}')"
_ANCHORED = lambda c: f"(contains(lower(text), lower({c})) OR len(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in UNANCHORED)}) AND contains(lower(text), w))) > 0)"
oracle(
    validate_triples,
    f"""WITH {NAMES}, x AS (SELECT a.p_partkey AS doc_id, a.name AS s, b.name AS o, CASE WHEN a.p_partkey % 2 = 0 THEN b.name ELSE 'steel and brass' END AS text, regexp_replace(a.name, '^The ', '') AS cs, CASE WHEN a.p_partkey % 10 = 3 THEN a.name ELSE b.name END AS co FROM names a JOIN names b ON b.p_partkey = a.p_partkey + 5)
SELECT CASE WHEN {_NON_ENTITY("cs")} THEN 'non-entity subject' WHEN {_NON_ENTITY("co")} THEN 'non-entity object' WHEN NOT {_ATOMIC("cs")} THEN 'verbose subject' WHEN NOT {_ATOMIC("co")} THEN 'verbose object' WHEN lower(cs) = lower(co) THEN 'tautology'
  WHEN contains(lower(cs), lower(co)) AND length(co) < length(cs) THEN 'object in subject' WHEN NOT ({_ANCHORED("cs")} OR {_ANCHORED("s")}) THEN 'subject not in text' WHEN NOT ({_ANCHORED("co")} OR {_ANCHORED("o")}) THEN 'object not in text' END AS reason, count(*) AS n FROM x GROUP BY 1""",
)


@query
def topk_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of ten schema vectors (the first of each label) per embedding."""
    x = v.table(spark, sf_dir, "embeddings")
    schema = x.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.concat(F.lit("L"), "label").alias("name"), "vector")
    return m.top_k(x.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), schema, 5).withColumn("score", F.round("score", 5))


oracle(
    topk_relations,
    """WITH s AS (SELECT concat('L', label) AS name, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
d AS (SELECT vec_id AS id, name, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, s)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, name) AS INTEGER) AS place, name, round(score, 5) AS score FROM d QUALIFY place <= 5""",
)


@query
def canonicalise_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R04-R08 with recorded choices: known names stay, undefined ones have none, unmatched ones enrich the schema."""
    p = v.table(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 3 != 0, F.lit("d")).alias("definition"))
    schema = p.where("p_partkey < 4").select(F.col("p_type").alias("name")).distinct()
    chosen = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("made_of").alias("name"), (F.col("p_partkey") % 4 == 0).alias("swap"))
    return m.canonicalise(items, schema, chosen)


oracle(
    canonicalise_relations,
    """WITH k AS (SELECT DISTINCT p_type FROM part WHERE p_partkey < 4), x AS (SELECT p_partkey AS id, p_type AS name, p_size % 3 <> 0 AS def, p_type IN (FROM k) AS known, p_partkey % 2 = 0 AS ch FROM part),
o AS (SELECT name, min(id) AS first FROM x WHERE NOT known AND def AND NOT ch GROUP BY name)
SELECT id, name, CASE WHEN known THEN name WHEN NOT def THEN NULL WHEN ch THEN 'made_of' ELSE name END AS canon, NOT known AND def AND ch AND id % 4 = 0 AS swap, coalesce(NOT known AND def AND NOT ch AND id = first, false) AS enriched FROM x LEFT JOIN o USING (name)""",
)


@query
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, Q12: terms from part names against part nodes."""
    nodes = v.nodes(spark, sf_dir).where("label = 'Part'")
    terms = v.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.substring("p_name", 1, 6)).otherwise(F.concat("p_name", F.lit(" "), "p_brand")).alias("term")).distinct()
    return m.candidates(terms, nodes).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


oracle(
    link_candidates,
    """WITH n AS (SELECT concat('P', p_partkey) AS id, lower(unnest([p_name, p_brand, p_type])) AS n FROM part),
t AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN substring(p_name, 1, 6) ELSE concat(p_name, ' ', p_brand) END AS term FROM part),
c AS (SELECT DISTINCT term, id FROM t, n WHERE contains(n, trim(lower(term))) OR contains(trim(lower(term)), n)
  OR len(list_filter(list_intersect(list_distinct(regexp_extract_all(lower(term), '[a-z0-9_]+')), list_distinct(regexp_extract_all(n, '[a-z0-9_]+'))), lambda w: w NOT IN ('disease', 'diseases', 'mellitus', 'type', 'in', 'of', 'and', 'or', 'patients', 'with'))) >= 2)
SELECT term, count(*) AS n, min(id) AS first FROM c GROUP BY term""",
)


@query
def vocabulary_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names looked up in a vocabulary of brands and types; checked on hand examples in the tests."""
    p = v.table(spark, sf_dir, "part")
    vocab = p.select(F.concat(F.lit("V"), "p_partkey").alias("code"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(" "), "p_name")).otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 4 == 0, "T999").otherwise("T121").alias("type"), F.col("p_partkey").alias("pos"))
    terms = p.select(F.col("p_name").alias("term")).distinct()
    return m.enriched(terms, m.accept(m.rerank(m.vocabulary_hits(terms, vocab)), ("T121",)))
