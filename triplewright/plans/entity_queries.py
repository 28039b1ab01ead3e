"""Queries on names, values and model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import entities as e
from triplewright.functions import parsing as p
from triplewright.functions import values as val
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query

RAW = """values_raw AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN concat('>= ', l_quantity::DECIMAL(10, 1), ' mg/dL') WHEN 1 THEN concat('increase by ', (l_discount * 100)::DECIMAL(10, 1), '%')
  WHEN 2 THEN concat(l_quantity::DECIMAL(10, 1), ' units') ELSE concat('  about ', l_returnflag, l_linestatus, '  ') END AS s, CASE l_linenumber % 5 WHEN 0 THEN 'has clinical threshold' ELSE 'contains' END AS r FROM lineitem)"""


def values_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = v.table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 4
    q, d = F.col("l_quantity").cast("decimal(10,1)"), (F.col("l_discount") * 100).cast("decimal(10,1)")
    s = F.when(k == 0, F.concat(F.lit(">= "), q, F.lit(" mg/dL"))).when(k == 1, F.concat(F.lit("increase by "), d, F.lit("%"))).when(k == 2, F.concat(q, F.lit(" units"))).otherwise(F.concat(F.lit("  about "), "l_returnflag", "l_linestatus", F.lit("  ")))
    return l.select("l_orderkey", "l_linenumber", s.alias("s"), F.when(F.col("l_linenumber") % 5 == 0, "has clinical threshold").otherwise("contains").alias("r"))


@query
def value_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values_raw(spark, sf_dir).groupBy(val.clean_value("s").alias("value"), val.is_value("r", "s").alias("is_value")).agg(F.count(F.lit(1)).alias("n"))


oracle(
    value_normalise,
    rf"""WITH {RAW}, x AS (SELECT regexp_replace(s, '^\s+|\s+$', '', 'g') AS x, r FROM values_raw)
SELECT CASE WHEN regexp_matches(x, '[<>=]') THEN concat(regexp_extract(x, '([<>]=?|=)', 1), regexp_replace(regexp_extract(x, '(\d+(?:\.\d+)?)', 1), '\.0$', ''))
  WHEN contains(x, 'increase') THEN concat('+', regexp_replace(regexp_extract(x, '(\d+(?:\.\d+)?)', 1), '\.0$', ''), '%')
  WHEN contains(x, 'unit') THEN concat(regexp_replace(regexp_extract(x, '(\d+(?:\.\d+)?)', 1), '\.0$', ''), 'u') ELSE x END AS value,
  r = 'has clinical threshold' OR regexp_matches(x, '^[<>=]') OR regexp_matches(x, '\d+\s*(mg/dL|%|units)') AS is_value, count(*) AS n FROM x GROUP BY 1, 2""",
)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names dressed as entity names: every part has several spellings."""
    x = v.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("The "), F.upper("p_name"), F.lit(" disease"))).when(k == 1, F.concat("p_name", F.lit(", T2DM"))).when(k == 2, F.concat(F.lit("T2DM ("), "p_name", F.lit(")"))).when(k == 3, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    return x.select("p_partkey", name.alias("name"))


NAMES = """names AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('The ', upper(p_name), ' disease') WHEN 1 THEN concat(p_name, ', T2DM') WHEN 2 THEN concat('T2DM (', p_name, ')') WHEN 3 THEN concat(p_name, 's') ELSE p_name END AS name FROM part)"""
_QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
_STEM = "CASE WHEN w IN (" + _QUOTED(e.UNSTEMMED) + ") THEN w " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 4 THEN w[:length(w) - {len(s)}]" for s in e.SUFFIXES) + " ELSE w END"
KEYED = rf"""{NAMES}, abbr(a, full_) AS (VALUES {", ".join(f"('{a}', '{f}')" for a, f in e.ABBREVIATIONS.items())}),
plain AS (SELECT p_partkey, name, trim(regexp_replace(replace(regexp_replace(lower(name), '[,;:()\[\]"'']', ' ', 'g'), '-', ' '), '\s+', ' ', 'g')) AS x FROM names),
words AS (SELECT p_partkey, name, unnest(string_split(x, ' ')) AS w FROM plain),
wide AS (SELECT p_partkey, name, unnest(string_split(coalesce(full_, w), ' ')) AS w FROM words LEFT JOIN abbr ON a = w),
keyed AS (SELECT p_partkey, name, coalesce(string_agg(CASE WHEN w NOT IN ({_QUOTED(e.STOPWORDS)}) AND w <> '' THEN {_STEM} END, ' ' ORDER BY CASE WHEN w NOT IN ({_QUOTED(e.STOPWORDS)}) AND w <> '' THEN {_STEM} END), '') AS key FROM wide GROUP BY p_partkey, name)"""


@query
def entity_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, V19."""
    return _names(spark, sf_dir).select("p_partkey", e.dedup_key("name").alias("key"))


oracle(entity_dedup_key, f"WITH {KEYED} SELECT p_partkey, key FROM keyed")


@query
def entity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V03, V04, V06 on names against documents: counts of each outcome."""
    d = v.table(spark, sf_dir, "documents").select((F.col("doc_id") % 200 + 1).alias("p_partkey"), "text")
    n = _names(spark, sf_dir).withColumn("name", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("less "), "name")).when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("Monitor: "), "name")).otherwise(F.col("name")))
    x = d.join(n, "p_partkey").select(e.is_atomic("name").alias("atomic"), e.is_non_entity("name").alias("non_entity"), e.is_anchored(F.col("name"), F.col("text")).alias("anchored"))
    return x.groupBy("atomic", "non_entity", "anchored").agg(F.count(F.lit(1)).alias("n"))


oracle(
    entity_checks,
    rf"""WITH {NAMES}, n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat('less ', name) WHEN p_partkey % 11 = 0 THEN concat('Monitor: ', name) ELSE name END AS name FROM names),
j AS (SELECT lower(text) AS t, name, string_split(name, ' ') AS w FROM documents JOIN n ON p_partkey = doc_id % 200 + 1)
SELECT len(w) BETWEEN 1 AND 5 AND w[1] <> 'Monitor:' AS atomic, regexp_matches(name, '(?i){"|".join(f"(?:{x})" for x in e.NON_ENTITIES)}') AS non_entity,
  contains(regexp_replace(t, '^\s+|\s+$', '', 'g'), lower(name)) OR len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9_]+'), lambda x: length(x) > 2 AND x NOT IN ({_QUOTED(e.UNANCHORED)}) AND contains(t, x))) > 0 AS anchored,
  count(*) AS n FROM j GROUP BY 1, 2, 3""",
)


@query
def entity_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01, V02, V09."""
    n = _names(spark, sf_dir).withColumn("raw", F.concat(F.lit("MESH: "), "name", F.lit(" levels in mice")))
    return n.select("p_partkey", e.simplify(e.without_ontology("raw")).alias("name"), e.without_ontology("raw", narrow=True).alias("narrow"))


_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_ROUND = "x"
for _p in e.NAME_PATTERNS:
    _ROUND = _TRIM(f"regexp_replace({_ROUND}, '{_p}', '', 'gi')")
_SHORT = f"MAP {{{', '.join(f'{chr(39)}{a}{chr(39)}: {chr(39)}{b}{chr(39)}' for a, b in e.SHORT_NAMES.items())}}}"
oracle(
    entity_simplify,
    rf"""WITH RECURSIVE {NAMES}, raw AS (SELECT p_partkey, regexp_replace(concat(name, ' levels in mice'), '^[A-Z]+[0-9]*\s+', '') AS wide, regexp_replace(concat(name, ' levels in mice'), '^[A-Z]{{1,2}}[0-9]{{1,3}}\s+', '') AS narrow FROM names),
symbol AS (SELECT *, regexp_extract(wide, '\(([^)]+)\)', 1) AS inside, regexp_replace(regexp_extract(wide, '\(([^)]+)\)', 1), '{e.SYMBOL_ENDING}', '', 'gi') AS sym FROM raw),
start AS (SELECT p_partkey, wide, CASE WHEN inside = '' THEN wide WHEN length(sym) BETWEEN 2 AND 10 AND NOT regexp_matches(lower(sym), '{"|".join(e.NO_SYMBOL)}') THEN sym ELSE regexp_replace(wide, '\s*\([^)]+\)', '', 'g') END AS x FROM symbol),
short AS (SELECT p_partkey, wide, x, list_filter(map_entries({_SHORT}), lambda s: starts_with(concat(lower(x), ' '), concat(s.key, ' '))) AS hits FROM start),
rounds AS (SELECT p_partkey, x, 0 AS n FROM short WHERE len(hits) = 0 UNION ALL SELECT p_partkey, y, n + 1 FROM (SELECT p_partkey, x, n, {_ROUND} AS y FROM rounds) WHERE x <> y),
stable AS (SELECT p_partkey, trim(arg_max(x, n), ' -_,.') AS x FROM rounds GROUP BY p_partkey)
SELECT raw.p_partkey, coalesce(hits[1].value, CASE WHEN stable.x = '' THEN raw.wide ELSE coalesce({_SHORT}[lower(stable.x)], stable.x) END) AS name, raw.narrow FROM raw JOIN short USING (p_partkey) LEFT JOIN stable USING (p_partkey)""",
)


@query
def ontology_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V01, V02 alone, and V14 on segments."""
    n = _names(spark, sf_dir).withColumn("raw", F.concat(F.lit("[A-1] LDL "), "name"))
    c = n.select("p_partkey", e.without_ontology("raw").alias("wide"), e.without_ontology("raw", narrow=True).alias("narrow"))
    return c.withColumn("label", e.label(F.when(F.col("p_partkey") % 2 == 0, "clinical_metric").otherwise("Other Thing ")))


oracle(
    ontology_prefixes,
    rf"""WITH {NAMES} SELECT p_partkey, trim(regexp_replace(concat('LDL ', name), '^[A-Z]+[0-9]*\s+', '')) AS wide, trim(concat('LDL ', name)) AS narrow,
  CASE WHEN p_partkey % 2 = 0 THEN 'Clinical Metric' ELSE 'Other Thing' END AS label FROM names""",
)


@query
def context_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 most frequent words of all names, ties by first place, then without stopwords and short words."""
    w = _names(spark, sf_dir).select("p_partkey", F.posexplode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("pos", "word"))
    n = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p_partkey", "pos")).alias("first"))
    top = n.orderBy(F.desc("n"), "first").limit(60)
    return top.where(~F.col("word").isin(*e.STOPWORDS) & (F.length("word") > 2)).select("word", "n")


oracle(
    context_keywords,
    rf"""WITH {NAMES}, w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(name), '[a-z0-9_]+')) AS word, generate_subscripts(regexp_extract_all(lower(name), '[a-z0-9_]+'), 1) AS pos FROM names),
n AS (SELECT word, count(*) AS n, min(p_partkey * 1000 + pos) AS first FROM w GROUP BY word ORDER BY n DESC, first LIMIT 60)
SELECT word, n FROM n WHERE word NOT IN ({_QUOTED(e.STOPWORDS)}) AND length(word) > 2""",
)


@query
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X06, X07 on responses built from events."""
    ev = v.table(spark, sf_dir, "events")
    k = F.col("event_id") % 5
    word = F.when(F.col("event_type") == "error", "Incorrect").when(F.col("event_type") == "purchase", "[CORRECT]").otherwise("uncertain")
    num = F.pmod(F.floor("value").cast("int"), F.lit(140))
    text = F.when(k == 0, F.concat(F.lit("Reason.\nStatus: "), word, F.lit("\nConfidence: "), num)).when(k == 1, F.concat(F.lit("Confidence: "), num, F.lit("\n\n"), word)).when(k == 2, F.concat(word, F.lit(" ["), num, F.lit("]\nthat is all"))).when(k == 3, F.concat(F.lit("verdict "), word, F.lit(" confidence = "), num)).otherwise(F.lit("no idea"))
    r = p.rating(text)
    return ev.select("event_id", r["verdict"].alias("verdict"), r["confidence"].alias("confidence"))


oracle(
    verdict_parse,
    """WITH x AS (SELECT event_id, event_id % 5 AS k, CASE event_type WHEN 'error' THEN 'INCORRECT' WHEN 'purchase' THEN 'CORRECT' ELSE 'UNCERTAIN' END AS verdict, least(100, ((floor(value)::INTEGER % 140) + 140) % 140) AS n FROM events)
SELECT event_id, CASE WHEN k = 4 THEN 'UNCERTAIN' ELSE verdict END AS verdict, CAST(CASE WHEN k IN (0, 4) THEN 50 ELSE n END AS INTEGER) AS confidence FROM x""",
)


@query
def query_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11, X12 on graph queries built from parts."""
    x = v.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    q = F.concat(F.lit('MATCH (n {id: "P'), "p_partkey", F.lit('"})-[:'), F.when(k == 0, "TREATED_BY").when(k == 1, "OWNS").otherwise("IS_A"), F.lit("]->(m) "), F.when(k == 2, "set m.x = 1").otherwise("RETURN offset"))
    return x.select("p_partkey", p.query_problem(q).alias("problem"), F.array_join(p.query_ids(q), ",").alias("ids"))


oracle(query_guardrail, "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'relation' WHEN 2 THEN 'write' END AS problem, concat('P', p_partkey) AS ids FROM part")


@query
def response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON span, a list, definitions and a chosen letter from responses built from parts."""
    x = v.table(spark, sf_dir, "part")
    body = F.concat(F.lit('Sure: {"size": '), "p_size", F.lit(', "name": "'), "p_name", F.lit('"} and ["a", "'), "p_brand", F.lit('"].\n**treated by**: first\nAnswer: B\n- treated by: '), "p_type")
    size = F.get_json_object(p.json_span(body), "$.size").cast("int")
    names = F.from_json(p.json_span(body, "[]"), "array<string>")
    d = p.definitions(F.regexp_replace(body, r"^[^\n]*\n", ""))
    letter = p.choice(F.when(F.col("p_partkey") % 2 == 0, "I think Answer: C then").otherwise("so take B"), "ABC")
    return x.select("p_partkey", size.alias("size"), F.element_at(names, 2).alias("second"), F.size(d).alias("n_definitions"), F.element_at(d, -1)["value"].alias("definition"), letter.alias("letter"))


oracle(response_fields, "SELECT p_partkey, p_size AS size, p_brand AS second, CAST(1 AS INTEGER) AS n_definitions, p_type AS definition, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'B' END AS letter FROM part")


@query
def triple_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples from brackets in free text and from literal lines; also checked on hand examples in the tests."""
    x = v.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Here: [['"), "p_name", F.lit("', 'is_a', '"), "p_type", F.lit("'], [x, by, "), "p_brand", F.lit("], ['_', 'b', 'c']]")).alias("raw"))
    return p.read_triples(x, "raw").select("p_partkey", F.posexplode("triples").alias("pos", "t")).select("p_partkey", "pos", F.col("t")[0].alias("s"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))


oracle(triple_parse, "SELECT p_partkey, CAST(0 AS INTEGER) AS pos, p_name AS s, 'is_a' AS r, p_type AS o FROM part UNION ALL SELECT p_partkey, 1, 'x', 'by', p_brand FROM part")
