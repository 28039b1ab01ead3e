"""Queries on vocabularies, types and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import entities as e
from triplewright.operators import clients as c
from triplewright.operators import matching as m
from triplewright.operators import validation as val
from triplewright.plans import build_queries as build
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)

# --- U01-U07 -------------------------------------------------------------------

CONTEXT = ("steel", "ring", "brass")
VOCAB = """vocab AS (SELECT concat('V', p_partkey) AS code, CASE WHEN p_partkey % 3 = 0 THEN concat(p_type, ' ', p_name) WHEN p_partkey % 7 = 1 THEN concat(p_name, ' ', p_type, ':', p_brand, ':x') ELSE p_name END AS name,
  ['T047', 'T121', 'T023', 'T999', 'T034'][(p_partkey % 5)::INT + 1] AS type, p_partkey AS pos FROM part),
terms AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS term, [['Concept'], ['Concept', 'Drug'], ['Disease', 'Symptom'], ['Unknown']][length(p_name) % 4 + 1] AS labels FROM part)"""
_NORM = lambda x: f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_]+'))), ' ')"
_W = lambda x: f"list_distinct(string_split(lower({x}), ' '))"
RANKED = f"""every AS (SELECT term, code, name, type, pos, 0 AS strategy FROM terms JOIN vocab ON term = name UNION ALL SELECT term, code, name, type, pos, 1 FROM terms JOIN vocab ON {_NORM("term")} = {_NORM("name")}
  UNION ALL SELECT term, code, name, type, pos, 2 FROM terms, vocab WHERE list_has_all(list_distinct(regexp_extract_all(lower(name), '[a-z0-9_]+')), list_distinct(regexp_extract_all(lower(term), '[a-z0-9_]+')))),
hits AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY pos) - 1 AS idx FROM (SELECT * FROM every QUALIFY strategy = min(strategy) OVER (PARTITION BY term)) QUALIFY idx < 10),
scored AS (SELECT *, 0.1::DOUBLE - 0.01::DOUBLE * idx + CASE WHEN lower(name) = lower(term) THEN 10.0 WHEN starts_with(lower(name), concat(lower(term), ' ')) OR ends_with(lower(name), concat(' ', lower(term))) THEN 5.0 WHEN contains(lower(name), lower(term)) THEN 2.0 ELSE 0 END::DOUBLE
  + 3.0::DOUBLE * len(list_intersect({_W("term")}, {_W("name")})) / len({_W("term")}) + least(4.0::DOUBLE, 1.5::DOUBLE * len(list_intersect(list_filter({_W("name")}, lambda w: w NOT IN ({_IN(e.STOPWORDS)})), [{_IN(CONTEXT)}])))
  - CASE WHEN contains(name, '^') OR length(name) - length(replace(name, ':', '')) >= 2 THEN 8.0 ELSE 0 END::DOUBLE - CASE WHEN len({_W("name")}) > 2 * len({_W("term")}) AND len({_W("term")}) <= 3 THEN 4.0 ELSE 0 END::DOUBLE
  - 1.5::DOUBLE * greatest(len({_W("name")}) - len({_W("term")}), 0) AS score FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, idx) AS rank FROM scored)"""
ALLOWED = "CASE " + " ".join(f"WHEN l = '{k}' THEN [{_IN(t)}]" for k, t in m.LABEL_TYPES.items()) + " END"
ACCEPTED = f"""accepted AS (SELECT ranked.* FROM ranked JOIN (SELECT term AS t2, flatten(list_filter(list_transform(labels, lambda l: {ALLOWED}), lambda x: x IS NOT NULL)) AS allowed FROM terms) ON t2 = term
  WHERE rank <= 5 AND score >= 3 AND type IN ({_IN(m.SAFE_TYPES)}) AND (len(allowed) = 0 OR list_contains(allowed, type)) QUALIFY row_number() OVER (PARTITION BY term ORDER BY rank) = 1)"""


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_type", F.lit(" "), "p_name")).when(k % 7 == 1, F.concat("p_name", F.lit(" "), "p_type", F.lit(":"), "p_brand", F.lit(":x"))).otherwise(F.col("p_name"))
    types = F.array(*map(F.lit, ("T047", "T121", "T023", "T999", "T034")))
    return p.select(F.concat(F.lit("V"), k).alias("code"), name.alias("name"), F.get(types, (k % 5).cast("int")).alias("type"), k.alias("pos"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = [["Concept"], ["Concept", "Drug"], ["Disease", "Symptom"], ["Unknown"]]
    label = F.get(F.array(*(F.array(*map(F.lit, x)) for x in labels)), F.length("p_name") % 4)
    return v.table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("term"), label.alias("labels")).distinct()


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, sf_dir)
    ranked = m.rerank(m.vocabulary_hits(terms, _vocab(spark, sf_dir)), F.array(*map(F.lit, CONTEXT)))
    return m.accept(ranked.join(terms, "term"), labels="labels")


@query
def vocabulary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the first strategy that finds any, ten at most."""
    return m.vocabulary_hits(_terms(spark, sf_dir), _vocab(spark, sf_dir)).select("term", "code", F.col("strategy").cast("int").alias("strategy"), F.col("idx").cast("int").alias("idx"))


oracle(vocabulary_search, f"WITH {VOCAB}, {RANKED} SELECT term, code, strategy, idx::INTEGER AS idx FROM hits")


@query
def vocabulary_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U02 with words of context."""
    ranked = m.rerank(m.vocabulary_hits(_terms(spark, sf_dir), _vocab(spark, sf_dir)), F.array(*map(F.lit, CONTEXT)))
    return ranked.select("term", "code", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


oracle(vocabulary_ranking, f"WITH {VOCAB}, {RANKED} SELECT term, code, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked")


@query
def vocabulary_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted hit of each term, its labels' types allowing; others map to themselves (U09's defaults)."""
    return m.enriched(_terms(spark, sf_dir).select("term"), _accepted(spark, sf_dir))


oracle(
    vocabulary_choice,
    f"WITH {VOCAB}, {RANKED}, {ACCEPTED} SELECT terms.term, coalesce(code, 'NONE') AS code, coalesce(name, terms.term) AS canonical, coalesce(type, 'Unknown') AS type FROM terms LEFT JOIN accepted ON accepted.term = terms.term",
)


oracle(
    build.vocabulary_resolution,
    f"""WITH {VOCAB.split("terms AS (")[0]}terms AS (SELECT DISTINCT p_name AS term FROM part), {RANKED}, accepted AS (SELECT * FROM ranked WHERE rank <= 5 AND score >= 3 AND type = 'T121' QUALIFY row_number() OVER (PARTITION BY term ORDER BY rank) = 1)
SELECT terms.term, coalesce(code, 'NONE') AS code, coalesce(name, terms.term) AS canonical, coalesce(type, 'Unknown') AS type FROM terms LEFT JOIN accepted ON accepted.term = terms.term""".replace("['T047', 'T121', 'T023', 'T999', 'T034'][(p_partkey % 5)::INT + 1]", "CASE WHEN p_partkey % 4 = 0 THEN 'T999' ELSE 'T121' END").replace(" WHEN p_partkey % 7 = 1 THEN concat(p_name, ' ', p_type, ':', p_brand, ':x')", "").replace(f"[{_IN(CONTEXT)}]", "['']"),
)


@query
def triple_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples between terms with both ends mapped, unless the subject's type contradicts the relation."""
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey")
    relation = F.when(k % 3 == 0, "treated by").when(k % 3 == 1, "CONTRAINDICATED_WITH").otherwise("has finding")
    t = p.select(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("s"), relation.alias("r"), F.when(k % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("o")).distinct()
    return m.map_triples(t, _accepted(spark, sf_dir), ("T034", "T081"), ("T121",)).distinct()


oracle(
    triple_mapping,
    f"""WITH {VOCAB}, {RANKED}, {ACCEPTED}, t AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS s, CASE p_partkey % 3 WHEN 0 THEN 'treated by' WHEN 1 THEN 'CONTRAINDICATED_WITH' ELSE 'has finding' END AS r, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS o FROM part)
SELECT DISTINCT s, CASE WHEN (r = 'treated by' AND a.type IN ('T034', 'T081', 'T121')) OR (r = 'CONTRAINDICATED_WITH' AND a.type IN ('T034', 'T081')) THEN s ELSE coalesce(a.name, s) END AS subject, r, coalesce(b.name, o) AS object FROM t LEFT JOIN accepted a ON a.term = s LEFT JOIN accepted b ON b.term = o""",
)


@query
def line_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of literal triples, mapped; broken lines pass as they are."""
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    term = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    line = F.concat(F.lit('[["'), term, F.lit('", "treated by", "'), "p_type", F.lit('"], ["'), "p_type", F.lit('", "has finding", "'), term, F.lit('"]]'))
    lines = p.select(F.col("p_partkey").alias("doc_id"), F.when(k == 0, "").when(k == 1, F.concat(line, F.lit("]"))).when(k == 2, "[]").otherwise(line).alias("text"))
    return m.map_lines(lines, _accepted(spark, sf_dir), ("T034", "T081"), ("T121",))


oracle(
    line_mapping,
    f"""WITH {VOCAB}, {RANKED}, {ACCEPTED}, l AS (SELECT p_partkey AS d, p_partkey % 5 AS k, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS s, p_type AS o FROM part),
x AS (SELECT l.*, CASE WHEN a.type IN ('T034', 'T081', 'T121') THEN s ELSE coalesce(a.name, s) END AS s1, coalesce(b.name, o) AS o1, coalesce(a.name, s) AS s2 FROM l LEFT JOIN accepted a ON a.term = s LEFT JOIN accepted b ON b.term = o)
SELECT d AS doc_id, CASE k WHEN 0 THEN '' WHEN 1 THEN concat('[["', s, '", "treated by", "', o, '"], ["', o, '", "has finding", "', s, '"]]]') WHEN 2 THEN '[]'
  ELSE concat('[["', s1, '","treated by","', o1, '"],["', o1, '","has finding","', s2, '"]]') END AS text, k IN (2, 3, 4) AS mapped FROM x""",
)


@query
def vocabulary_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several definitions of a code that of the best source."""
    l = v.table(spark, sf_dir, "lineitem")
    source = F.get(F.array(*map(F.lit, ("nci", "MSH", "CHV", "HPO", "SNOMEDCT_US"))), F.col("l_linenumber") % 5)
    value = F.when((F.col("l_quantity") % 4) == 0, " ").otherwise(F.concat(F.lit(" from "), "l_returnflag", F.lit(" "), F.col("l_suppkey"), F.lit(" ")))
    rows = l.select(F.concat(F.lit("V"), "l_partkey").alias("code"), source.alias("source"), value.alias("value"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag").alias("pos"))
    return m.definition_of(rows)


oracle(
    vocabulary_definitions,
    """WITH d AS (SELECT concat('V', l_partkey) AS code, ['NCI', 'MSH', 'CHV', 'HPO', 'SNOMEDCT_US'][l_linenumber % 5 + 1] AS source, CASE WHEN l_quantity % 4 = 0 THEN ' ' ELSE concat(' from ', l_returnflag, ' ', l_suppkey, ' ') END AS value, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem)
SELECT code, trim(value) AS definition FROM d WHERE trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE source WHEN 'NCI' THEN 0 WHEN 'MSH' THEN 1 WHEN 'CHV' THEN 2 ELSE 3 END, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag) = 1""",
)


@query
def vocabulary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First code of each source, the last part of its path."""
    l = v.table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_linenumber") % 3 == 0, "ICD10CM").when(F.col("l_linenumber") % 3 == 1, "RXNORM").otherwise("MSH")
    path = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("x/"), "l_returnflag", F.lit("/"))).otherwise(F.concat(F.lit("https://host/code/"), "l_suppkey"))
    rows = l.select(F.concat(F.lit("V"), "l_partkey").alias("code"), source.alias("source"), path.alias("path"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").alias("pos"))
    return m.source_codes(rows)


oracle(
    vocabulary_codes,
    """WITH a AS (SELECT concat('V', l_partkey) AS code, CASE l_linenumber % 3 WHEN 0 THEN 'ICD10CM' WHEN 1 THEN 'RXNORM' ELSE 'MSH' END AS source, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE l_suppkey::VARCHAR END AS x, {'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey, 'd': l_returnflag} AS pos FROM lineitem),
f AS (SELECT code, arg_min(x, pos) FILTER (source = 'ICD10CM') AS icd, arg_min(x, pos) FILTER (source = 'RXNORM') AS rx FROM a GROUP BY code)
SELECT code, CASE WHEN coalesce(icd, '') = '' THEN 'NONE' ELSE icd END AS "ICD10CM", CASE WHEN coalesce(rx, '') = '' THEN 'NONE' ELSE rx END AS "RXNORM" FROM f""",
)

# --- types and relations ----------------------------------------------------------


@query
def nearest_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type whose vector is nearest by cosine; types are the first vectors of each label, not normalised."""
    x = v.table(spark, sf_dir, "embeddings")
    first = x.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("w"))
    types = first.select(F.col("label").alias("pos"), F.concat(F.lit("T"), "label").alias("type"), F.transform("w", lambda y: y.cast("double") * (F.col("label") + 1)).alias("vector"))
    names = x.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 9, F.transform("embedding", lambda y: y * 0)).otherwise(F.col("embedding")).alias("vector"))
    return m.nearest_type(names, types)


oracle(
    nearest_type,
    """WITH t AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS w FROM embeddings GROUP BY label),
d AS (SELECT vec_id AS id, label, list_dot_product(embedding::DOUBLE[], list_transform(w, lambda y: y * (label + 1))) / sqrt(list_dot_product(list_transform(w, lambda y: y * (label + 1)), list_transform(w, lambda y: y * (label + 1)))) AS score FROM (SELECT vec_id, embedding FROM embeddings), t)
SELECT id, CASE WHEN id % 10 = 9 THEN 'Unknown' ELSE arg_max(concat('T', label), {'s': round(score, 12), 'l': -label}) END AS type FROM d GROUP BY id""",
)

ENTRIES = """entries AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_partkey, l_suppkey, concat('type', l_partkey % 6) AS st, concat('type', l_suppkey % 5) AS ot FROM lineitem)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = v.table(spark, sf_dir, "lineitem")
    return l.select(F.struct("l_orderkey", "l_partkey").alias("doc_id"), F.struct("l_linenumber", "l_suppkey").alias("ord"), F.concat(F.lit("type"), F.col("l_partkey") % 6).alias("subject_type"), F.concat(F.lit("type"), F.col("l_suppkey") % 5).alias("object_type")).distinct()


def _type_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("type0", "Drug"), ("type1", "Disease"), ("type2", "Drug"), ("type3", "Symptom")], "type string, canon string")


@query
def slot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both slots' types by one look-up, with the counts of aligned and failed slots."""
    out, counts = m.slot_types(_entries(spark, sf_dir), _type_names(spark))
    per = out.groupBy("subject_type_canon", "object_type_canon").agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.lit("aligned").alias("subject_type_canon"), F.lit("all").alias("object_type_canon"), F.col("aligned").alias("n"))
    return per.unionByName(total).unionByName(counts.select(F.lit("failed").alias("subject_type_canon"), F.lit("all").alias("object_type_canon"), F.col("failed").alias("n")))


_CANON = lambda x: f"CASE {x} WHEN 'type0' THEN 'Drug' WHEN 'type1' THEN 'Disease' WHEN 'type2' THEN 'Drug' WHEN 'type3' THEN 'Symptom' END"
CANONS = f"""{ENTRIES}, x AS (SELECT {_CANON("st")} AS s, {_CANON("ot")} AS o FROM (SELECT DISTINCT * FROM entries))"""
oracle(
    slot_types,
    f"""WITH {CANONS} SELECT s AS subject_type_canon, o AS object_type_canon, count(*) AS n FROM x GROUP BY ALL
UNION ALL SELECT 'aligned', 'all', count(s) + count(o) FROM x UNION ALL SELECT 'failed', 'all', 2 * count(*) - count(s) - count(o) FROM x""",
)


@query
def target_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose types are both among the target's."""
    out, _ = m.slot_types(_entries(spark, sf_dir), _type_names(spark), ("Drug", "Disease"))
    return out.groupBy("subject_type_canon", "object_type_canon").agg(F.count(F.lit(1)).alias("n"))


oracle(target_types, f"WITH {CANONS} SELECT s AS subject_type_canon, o AS object_type_canon, count(*) AS n FROM x WHERE s IN ('Drug', 'Disease') AND o IN ('Drug', 'Disease') GROUP BY ALL")


@query
def relation_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered options, each candidate straight and swapped."""
    x = v.table(spark, sf_dir, "embeddings")
    schema = x.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.concat(F.lit("L"), "label").alias("name"), "vector")
    top = m.top_k(x.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), schema, 3)
    return m.options(top).select("id", "place", "name", "swap", "letter")


oracle(
    relation_options,
    """WITH s AS (SELECT concat('L', label) AS name, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
d AS (SELECT vec_id AS id, name, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, s),
t AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, name) AS INTEGER) AS place, name FROM d QUALIFY place <= 3)
SELECT id, place, name, swap, chr(65 + (place - 1) * 2 + swap::INT) AS letter FROM t, (VALUES (false), (true)) o(swap)""",
)

# --- validation --------------------------------------------------------------------

FLIPS = """f AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN 'zinc' ELSE concat(p_type, ' kind') END AS s,
  CASE WHEN p_partkey % 3 = 0 THEN 'made of' ELSE 'Is Kind' END AS r, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE p_name END AS o FROM part),
rule AS (SELECT list_sort(list_distinct(list(lower(p_name)))) AS sn, list_sort(list_distinct(list(lower(p_type)))) AS os FROM part)"""
_FITS = lambda x, names: f"({x} <> '' AND (list_contains({names}, lower(trim({x}))) OR len(list_filter({names}, lambda n: length(n) >= 3 AND length(trim({x})) >= 3 AND (contains(n, lower(trim({x}))) OR contains(lower(trim({x})), n)))) > 0))"


@query
def name_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples turned where their ends match the learned names the other way round only."""
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    s = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_type")).when(k == 2, "zinc").otherwise(F.concat("p_type", F.lit(" kind")))
    t = p.select(F.col("p_partkey").alias("id"), s.alias("s"), F.when(F.col("p_partkey") % 3 == 0, "made of").otherwise("Is Kind").alias("r"), F.when(k == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("o"))
    learned = p.select(F.col("p_name").alias("s"), F.lit("is kind").alias("r"), F.col("p_type").alias("o"), F.lit("Part").alias("st"), F.lit("Kind").alias("ot"))
    return val.flip_by_names(t, val.learned_rules(learned)).select("id", "s", "r", "o", "turned")


oracle(
    name_direction,
    f"""WITH {FLIPS}, x AS (SELECT f.*, r = 'Is Kind' AND {_FITS("s", "os")} AND {_FITS("o", "sn")} AND NOT ({_FITS("s", "sn")} AND {_FITS("o", "os")}) AS turned FROM f, rule)
SELECT id, CASE WHEN turned THEN o ELSE s END AS s, r, CASE WHEN turned THEN s ELSE o END AS o, turned FROM x""",
)

OPEN = """e AS (SELECT DISTINCT l_orderkey AS doc_id, concat('P', l_partkey) AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'treated by' ELSE 'has finding' END AS r, concat('S', l_suppkey) AS o,
  ['Drug', 'Disease', 'Symptom', 'Symptom'][(l_partkey % 4)::INT + 1] AS st, ['Drug', 'Disease', 'Symptom', 'Symptom'][(l_suppkey % 4)::INT + 1] AS ot FROM lineitem),
t AS (SELECT DISTINCT l_orderkey AS doc_id, concat('P', l_partkey) AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'treated by' ELSE 'has finding' END AS r, CASE WHEN l_returnflag = 'R' THEN 'unseen' ELSE concat('S', l_suppkey) END AS o FROM lineitem)"""


def _open(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = v.table(spark, sf_dir, "lineitem")
    kind = lambda x: F.when(F.col(x) % 4 == 0, "Drug").when(F.col(x) % 4 == 1, "Disease").otherwise("Symptom")
    s, r, o = F.concat(F.lit("P"), "l_partkey").alias("s"), F.when(F.col("l_linenumber") % 2 == 0, "treated by").otherwise("has finding").alias("r"), F.concat(F.lit("S"), "l_suppkey")
    typed = l.select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), s, r, o.alias("o"), kind("l_partkey").alias("st"), kind("l_suppkey").alias("ot"))
    triples = l.select(F.col("l_orderkey").alias("doc_id"), s, r, F.when(F.col("l_returnflag") == "R", "unseen").otherwise(o).alias("o")).distinct()
    return triples, typed


def _rules(spark: SparkSession) -> DataFrame:
    return val.learned_rules(spark.createDataFrame([("flu", "treated by", "aspirin", "Disease", "Drug"), ("cold", "treated by", "tea", "Symptom", "Drug")], "s string, r string, o string, st string, ot string"))


@query
def typed_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open triples corrected by the types of their entries; what the rules discard goes, unmatched triples pass."""
    triples, typed = _open(spark, sf_dir)
    return val.correct_open(triples, typed, _rules(spark)).groupBy("r", "matched", "turned", "st").agg(F.count(F.lit(1)).alias("n"))


_TURN = "r = 'treated by' AND st = 'Drug' AND ot IN ('Disease', 'Symptom')"
_KEEP = "coalesce(r <> 'treated by' OR (st IN ('Disease', 'Symptom') AND ot = 'Drug') OR turned, true)"
TURNED = f"""{OPEN}, x AS (SELECT t.*, st, ot, st IS NOT NULL AS matched, coalesce({_TURN}, false) AS turned FROM t LEFT JOIN e USING (doc_id, s, r, o))"""
oracle(typed_correction, f"WITH {TURNED} SELECT r, matched, turned, CASE WHEN turned THEN ot ELSE st END AS st, count(*) AS n FROM x WHERE {_KEEP} GROUP BY ALL")


@query
def typed_correction_keeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule without discarding what merely doesn't fit."""
    triples, typed = _open(spark, sf_dir)
    return val.correct_open(triples, typed, _rules(spark), discard=False).groupBy("r", "matched", "turned", "st").agg(F.count(F.lit(1)).alias("n"))


oracle(
    typed_correction_keeping,
    f"""WITH {TURNED} SELECT r, matched, turned, CASE WHEN turned THEN ot ELSE st END AS st, count(*) AS n FROM x
WHERE NOT coalesce(r = 'treated by' AND CASE WHEN turned THEN ot ELSE st END = 'Drug', false) GROUP BY ALL""",
)

WORDY = """d AS (SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN 'Insulin raises Alpha in diabetes' WHEN 1 THEN 'Lack of Alpha does not leave diabetes untouched' WHEN 2 THEN 'Alpha is reduced in DIABETES' WHEN 3 THEN 'Alpha and others' ELSE 'Beta lowers diabetes' END, '. ', coalesce(text, '')) AS text FROM documents)"""


@query
def relation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations replaced by what a sentence with both ends says; a double negation says nothing."""
    k = F.col("doc_id") % 5
    said = F.when(k == 0, "Insulin raises Alpha in diabetes").when(k == 1, "Lack of Alpha does not leave diabetes untouched").when(k == 2, "Alpha is reduced in DIABETES").when(k == 3, "Alpha and others").otherwise("Beta lowers diabetes")
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.concat(said, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"), F.lit("Alpha").alias("s"), F.lit("linked").alias("r"), F.lit("diabetes").alias("o"))
    return val.relabel(d, EVIDENCE).select("doc_id", "s", "r", "o")


EVIDENCE = {"negative": "reduced|lack|lowers", "positive": "raises|leave"}
oracle(
    relation_evidence,
    f"""WITH {WORDY}, n AS (SELECT doc_id, list_filter(string_split(lower(text), '.'), lambda x: contains(x, 'alpha') AND contains(x, 'diabetes')) AS near FROM d),
h AS (SELECT doc_id, list_filter(near, lambda x: NOT regexp_matches(x, '\\bnot\\b.*\\b(?:not|no|un\\w+)\\b')) AS near FROM n)
SELECT doc_id, 'Alpha' AS s, CASE WHEN len(list_filter(near, lambda x: regexp_matches(x, '{EVIDENCE["negative"]}'))) > 0 THEN 'negative' WHEN len(list_filter(near, lambda x: regexp_matches(x, '{EVIDENCE["positive"]}'))) > 0 THEN 'positive' ELSE 'linked' END AS r, 'diabetes' AS o FROM h""",
)


@query
def topic_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with a topic word, taken literally, in subject or object."""
    p = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("s"), F.concat("p_brand", F.lit(" (x.y)")).alias("o"))
    return val.on_topic(p.withColumn("o", F.when(F.col("id") % 2 == 0, F.col("o")).otherwise(F.lit("xzy"))), ("STEEL", "#1 (x.")).select("id", "s", "o")


oracle(
    topic_triples,
    """WITH t AS (SELECT p_partkey AS id, p_name AS s, CASE WHEN p_partkey % 2 = 0 THEN concat(p_brand, ' (x.y)') ELSE 'xzy' END AS o FROM part)
SELECT * FROM t WHERE contains(lower(s), 'steel') OR contains(lower(o), 'steel') OR contains(lower(s), '#1 (x.') OR contains(lower(o), '#1 (x.')""",
)


@query
def heuristic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated type, else one by the words of the name."""
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat("p_name", F.lit(" Syndrome"))).when(k == 1, F.concat(F.lit("rs"), "p_partkey")).when(k == 2, F.concat("p_type", F.lit(" allele"))).when(k == 3, F.concat(F.lit(" Sodium "), "p_name")).when(k == 4, F.lit("diabetic mutation")).otherwise(F.col("p_name"))
    x = p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.when(F.col("p_size") % 5 == 0, "Stated").when(F.col("p_size") % 5 == 1, "Unknown").alias("type"))
    return x.select("id", e.heuristic_type("name", "type").alias("type"))


oracle(
    heuristic_types,
    f"""WITH x AS (SELECT p_partkey AS id, p_size, lower(CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' Syndrome') WHEN 1 THEN concat('rs', p_partkey) WHEN 2 THEN concat(p_type, ' allele') WHEN 3 THEN concat(' Sodium ', p_name) WHEN 4 THEN 'diabetic mutation' ELSE p_name END) AS n FROM part)
SELECT id, CASE WHEN p_size % 5 = 0 THEN 'Stated' {" ".join(f"WHEN {' OR '.join([f'contains(n, {chr(39)}{w}{chr(39)})' for w in words] + ([f'regexp_matches(n, {chr(39)}{pattern}{chr(39)})'] if pattern else []))} THEN '{t}'" for t, words, pattern in e.TYPE_WORDS)} ELSE '{e.OTHER_TYPE}' END AS type FROM x""",
)


@query
def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V16 without gold names: words that name nothing go, as do phrases before a name; synonyms get one spelling."""
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey") % 7
    name = F.when(k == 0, F.concat(F.lit("Levels of "), "p_name")).when(k == 1, "Increase").when(k == 2, "K+").when(k == 3, "xy").when(k == 4, F.lit("inhibition of Interleukin 6 ")).when(k == 5, "T2DM").otherwise(F.concat(F.lit("reduction of levels of "), "p_type"))
    return p.select(F.col("p_partkey").alias("id"), e.concept_name(name, {"interleukin 6": "il-6", "t2dm": "type 2 diabetes"}).alias("name"))


oracle(
    concept_names,
    """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN lower(p_name) WHEN 2 THEN 'k+' WHEN 4 THEN 'il-6' WHEN 5 THEN 'type 2 diabetes' WHEN 6 THEN lower(p_type) END AS name FROM part""",
)

# --- replay ------------------------------------------------------------------------

TEMPLATE = "Examples: {examples}\nText: {text}\nTriplets:"
RECORDED = """said AS (SELECT p_partkey AS doc_id, concat('Examples: none', chr(10), 'Text: ', p_name, ' costs ', p_size, chr(10), 'Triplets:') AS prompt,
  CASE p_partkey % 4 WHEN 0 THEN concat('Triplets: [["', p_name, '", "costs", "', p_size, '"]]') WHEN 1 THEN concat('[[''', p_name, ''', ''is a'', ''', p_type, '''], [''', p_brand, ''', ''makes'', ''', p_name, ''']]') WHEN 2 THEN 'nothing found' END AS answer FROM part)"""


@query
def replayed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from a template, recorded answers by the prompt's hash, triples read from them."""
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" costs "), "p_size").alias("text"), "p_name", "p_size", "p_type", "p_brand")
    prompts = docs.withColumn("prompt", c.filled(TEMPLATE, examples=F.lit("none"), text="text"))
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('Triplets: [["'), "p_name", F.lit('", "costs", "'), "p_size", F.lit('"]]'))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("[['"), "p_name", F.lit("', 'is a', '"), "p_type", F.lit("'], ['"), "p_brand", F.lit("', 'makes', '"), "p_name", F.lit("']]"))).when(F.col("doc_id") % 4 == 2, "nothing found")
    recorded = prompts.select(F.sha2("prompt", 256).alias("prompt_sha256"), said.alias("answer"))
    return c.extracted(c.replayed(prompts.select("doc_id", "prompt"), "prompt", recorded))


oracle(
    replayed_extraction,
    f"""WITH {RECORDED}, r AS (SELECT prompt, min(answer) AS answer FROM said GROUP BY prompt), a AS (SELECT s.doc_id, r.answer FROM said s JOIN r USING (prompt)),
t AS (SELECT doc_id, unnest(regexp_extract_all(replace(answer, '"', ''''), '\\[''[^\\[\\]]*''\\]')) AS x, generate_subscripts(regexp_extract_all(replace(answer, '"', ''''), '\\[''[^\\[\\]]*''\\]'), 1) - 1 AS ord FROM a WHERE answer IS NOT NULL)
SELECT doc_id, ord::INTEGER AS ord, regexp_extract(x, '\\[''([^'']*)'', ''([^'']*)'', ''([^'']*)''\\]', 1) AS s, regexp_extract(x, '\\[''([^'']*)'', ''([^'']*)'', ''([^'']*)''\\]', 2) AS r, regexp_extract(x, '\\[''([^'']*)'', ''([^'']*)'', ''([^'']*)''\\]', 3) AS o FROM t""",
)


@query
def replayed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation definitions from recorded answers; the last line of a name counts."""
    p = v.table(spark, sf_dir, "part")
    prompts = p.select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type", "p_brand").withColumn("prompt", c.filled("Define {name} of {doc_id}", name="p_name", doc_id="doc_id"))
    said = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Answer: yes\n- **"), "p_type", F.lit("**: first\n2. "), "p_name", F.lit(": made by "), "p_brand", F.lit("\n"), "p_type", F.lit(": last\nno colon")))
    recorded = prompts.select(F.sha2("prompt", 256).alias("prompt_sha256"), said.alias("answer"))
    return c.defined(c.replayed(prompts.select("doc_id", "prompt"), "prompt", recorded))


oracle(
    replayed_definitions,
    """SELECT p_partkey AS doc_id, p_type AS name, 'last' AS definition FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_name, concat('made by ', p_brand) FROM part WHERE p_partkey % 3 <> 0""",
)
