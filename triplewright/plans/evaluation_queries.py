"""Queries that score predictions and generate benchmark triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import evaluation as e
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query

MATCHED = """matched AS (
  SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, coalesce(p.r, g.r) AS r, CASE WHEN p.s IS NOT NULL AND g.s IS NOT NULL THEN 1 ELSE 0 END AS tp,
    CASE WHEN g.s IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN p.s IS NULL THEN 1 ELSE 0 END AS fn
  FROM pred p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.s = g.s AND p.r = g.r AND p.o = g.o)"""
PRF = "round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS recall, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS f1"


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in df.columns if c not in keep))


@query
def triple_macro_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro scores over triple classes."""
    p, g = v.predicted_and_gold(spark, sf_dir)
    return _rounded(e.macro_by_class(e.matched(p, g, e.TRIPLE), e.TRIPLE), "classes")


oracle(triple_macro_jaccard, f"WITH {v.PRED_GOLD}, {MATCHED} SELECT count(*) AS classes, {PRF} FROM matched")


@query
def relation_macro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = v.predicted_and_gold(spark, sf_dir)
    return _rounded(e.macro_by_class(e.matched(p, g, e.TRIPLE), ["r"]), "classes")


oracle(relation_macro_prf, f"WITH {v.PRED_GOLD}, {MATCHED}, per AS (SELECT r, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM matched GROUP BY r) SELECT count(*) AS classes, {PRF} FROM per")


@query
def triple_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro counts over all documents."""
    p, g = v.predicted_and_gold(spark, sf_dir)
    return e.matched(p, g, e.TRIPLE).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.round(e.f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 6).alias("f1"))


oracle(triple_micro, f"WITH {v.PRED_GOLD}, {MATCHED} SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM matched")


@query
def doc_macro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11, E12 with an ontology of one relation."""
    p, g = v.predicted_and_gold(spark, sf_dir)
    return _rounded(e.macro_by_doc(p, g, spark.createDataFrame([("KEEPS",)], "r string")), "docs")


oracle(
    doc_macro_prf,
    f"""WITH {v.PRED_GOLD}, used AS (SELECT * FROM pred p WHERE EXISTS (FROM gold g WHERE g.doc_id = p.doc_id AND g.r = p.r)),
per AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, count(*) FILTER (p.s IS NOT NULL AND g.s IS NOT NULL) AS tp, count(*) FILTER (g.s IS NULL) AS fp, count(*) FILTER (p.s IS NULL) AS fn
  FROM used p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.s = g.s AND p.r = g.r AND p.o = g.o GROUP BY 1),
conform AS (SELECT doc_id, avg(CASE WHEN r = 'KEEPS' THEN 1 ELSE 0 END) AS conform FROM pred GROUP BY doc_id)
SELECT count(*) AS docs, {PRF}, round(avg(coalesce(conform, 1.0)), 6) AS conformance
FROM (SELECT DISTINCT doc_id FROM gold) LEFT JOIN per USING (doc_id) LEFT JOIN conform USING (doc_id)""",
)


@query
def pair_score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E06 by document, summed up."""
    p, g = v.predicted_and_gold(spark, sf_dir)
    return e.pair_scores(p, g).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("score"), 6).alias("total"))


oracle(
    pair_score_matrix,
    f"""WITH {v.PRED_GOLD} SELECT doc_id, count(*) AS pairs,
  round(sum(((p.s = g.s)::INT + (p.r = g.r)::INT + (p.o = g.o)::INT) / 3.0::DOUBLE), 6) AS total FROM pred p JOIN gold g USING (doc_id) GROUP BY doc_id""",
)


@query
def pair_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best one-to-one assignment of each document; checked against all permutations in the tests."""
    p, g = v.predicted_and_gold(spark, sf_dir)
    return e.assigned(e.pair_scores(p, g))


@query
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality 1 is valid; accepted if not toxic and not of an id divisible by 13."""
    l = v.table(spark, sf_dir, "labels")
    return e.confusion(l.select((F.col("quality") == 1).alias("valid"), ((F.col("toxic") == 0) & (F.col("doc_id") % 13 != 0)).alias("accepted")))


oracle(
    confusion_rates,
    """WITH r AS (SELECT quality = 1 AS v, toxic = 0 AND doc_id % 13 <> 0 AS a FROM labels), c AS (
  SELECT count(*) FILTER (v AND a) AS tp, count(*) FILTER (v AND NOT a) AS fn, count(*) FILTER (NOT v AND a) AS fp, count(*) FILTER (NOT v AND NOT a) AS tn FROM r)
SELECT *, round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy, round(fp / (fp + tn), 6) AS leak_rate, round(fn / (tp + fn), 6) AS false_rejection_rate, round(tn / (fp + tn), 6) AS trap_rejection_rate FROM c""",
)


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives from order lines: mentions are parts and suppliers of a line's order; the schema map knows one direction."""
    l = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", "l_returnflag")
    part, supp = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")
    flip = F.col("l_partkey") % 2 == 0
    rels = l.select("doc_id", F.col("l_returnflag").alias("rel"), F.when(flip, supp).otherwise(part).alias("e1"), F.when(flip, part).otherwise(supp).alias("e2")).distinct()
    mentions = l.select("doc_id", part.alias("id"), F.concat(F.lit("part "), "l_partkey").alias("name"), F.lit("Part").alias("type"))
    mentions = mentions.unionByName(l.select("doc_id", supp.alias("id"), F.concat(F.lit("supplier "), "l_suppkey").alias("name"), F.lit("Supplier").alias("type"))).distinct()
    schema = spark.createDataFrame([("R", "Part", "Supplier", "returned_to"), ("A", "Part", "Supplier", "accepted_from")], "rel string, t1 string, t2 string, target string")
    return e.positives(rels, mentions, schema)


POS = """pos AS (SELECT DISTINCT l_orderkey AS doc_id, concat('part ', l_partkey) AS s, CASE l_returnflag WHEN 'R' THEN 'returned_to' ELSE 'accepted_from' END AS r,
  concat('supplier ', l_suppkey) AS o, 'Part' AS st, 'Supplier' AS ot FROM lineitem WHERE l_returnflag IN ('R', 'A'))"""


@query
def positives_schema_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positives(spark, sf_dir)


oracle(positives_schema_map, f"WITH {POS} SELECT * FROM pos")


@query
def negatives_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.inverted(_positives(spark, sf_dir))


oracle(negatives_inversion, f"WITH {POS} SELECT doc_id, o AS s, r, s AS o, 'inversion' AS corruption FROM pos p WHERE NOT EXISTS (FROM pos q WHERE q.s = p.o AND q.r = p.r AND q.o = p.s)")


@query
def negatives_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.table(spark, sf_dir, "supplier").select(F.lit("Supplier").alias("type"), F.concat(F.lit("supplier "), "s_suppkey").alias("name"), "s_suppkey")
    pool = e.ranked_by_draw(s, ["type"], F.col("s_suppkey"), 42).select("type", "name", "place")
    return e.substituted(_positives(spark, sf_dir), pool)


oracle(
    negatives_substitution,
    f"""WITH {POS}, pool AS (SELECT concat('supplier ', s_suppkey) AS name, row_number() OVER (ORDER BY (s_suppkey * 7919 + 42) % 10007, s_suppkey) AS place, count(*) OVER () AS size FROM supplier)
SELECT doc_id, p.s, p.r, b.name AS o, 'substitution' AS corruption FROM pos p JOIN pool a ON a.name = p.o JOIN pool b ON b.place = a.place % a.size + 1
WHERE NOT EXISTS (FROM pos q WHERE q.s = p.s AND q.r = p.r AND q.o = b.name)""",
)


@query
def negatives_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation replaced by one that the types of the triple don't allow."""
    return _positives(spark, sf_dir).select("doc_id", "s", F.lit("located_in").alias("r"), "o").distinct().withColumn("corruption", F.lit("schema"))


oracle(negatives_schema, f"WITH {POS} SELECT DISTINCT doc_id, s, 'located_in' AS r, o, 'schema' AS corruption FROM pos")


@query
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.balanced(v.table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", F.col("doc_id"), 42)


oracle(
    balanced_sample,
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919 + 42) % 10007, doc_id) AS place FROM labels)
SELECT doc_id, quality FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)


@query
def triple_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01, E17 on the names of parts and their brands."""
    p = v.table(spark, sf_dir, "part")
    made = F.concat(F.lit("MadeBy_"), "p_brand", F.lit("  x ("), "p_type", F.lit(")"))
    return p.select("p_partkey", e.normal_name(F.lit("hasPartName")).alias("r"), e.normal_name(F.col("p_name")).alias("s"), e.normal_name(made, True).alias("o"), e.compact("p_name", "p_brand").alias("k"))


oracle(
    triple_normalise,
    r"""WITH n AS (SELECT p_partkey, p_name, p_brand, concat('MadeBy_', p_brand, '  x (', p_type, ')') AS made FROM part)
SELECT p_partkey, 'has part name' AS r,
  regexp_replace(regexp_replace(lower(regexp_replace(p_name, '([a-z])([A-Z])', '\1 \2', 'g')), '[_\s]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(made, '([a-z])([A-Z])', '\1 \2', 'g')), '[_\s]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' ?\([^()]*\)$', '') AS o,
  lower(regexp_replace(concat(p_name, p_brand), '[\s_]+', '', 'g')) AS k FROM n""",
)


@query
def corpus_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language that match an id set, a keyword, or both."""
    d = v.table(spark, sf_dir, "documents")
    ids, word = F.col("doc_id") % 10 == 3, F.lower("text").rlike("license|patient|thing")
    return d.groupBy("lang").agg(F.count_if(ids).alias("by_id"), F.count_if(word).alias("by_keyword"), F.count_if(ids & word).alias("both"), F.count_distinct("source").alias("sources"))


oracle(
    corpus_topic_counts,
    """SELECT lang, count(*) FILTER (i) AS by_id, count(*) FILTER (w) AS by_keyword, count(*) FILTER (i AND w) AS both, count(DISTINCT source) AS sources
FROM (SELECT lang, source, doc_id % 10 = 3 AS i, regexp_matches(lower(text), 'license|patient|thing') AS w FROM documents) GROUP BY lang""",
)


@query
def canonical_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent surface form of each type; ties by length, then by first place."""
    p = v.table(spark, sf_dir, "part").select(F.explode(F.array_union(F.array("p_type"), F.split("p_type", " "))).alias("concept"), F.col("p_name").alias("form"), F.col("p_partkey").alias("pos"))
    n = p.groupBy("concept", "form").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = n.groupBy("concept").agg(F.min(F.struct(-F.col("n"), F.length("form").alias("l"), "first", "form", "n")).alias("m"))
    return best.select("concept", F.col("m.form").alias("form"), F.col("m.n").alias("n"))


oracle(
    canonical_surface_forms,
    """WITH c AS (SELECT unnest(list_distinct(list_concat([p_type], string_split(p_type, ' ')))) AS concept, p_name AS form, p_partkey AS pos FROM part),
n AS (SELECT concept, form, count(*) AS n, min(pos) AS first FROM c GROUP BY concept, form)
SELECT concept, form, n FROM n QUALIFY row_number() OVER (PARTITION BY concept ORDER BY n DESC, length(form), first) = 1""",
)


@query
def definition_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts blanked where a diacritic or a foreign keyword shows another language."""
    d = v.table(spark, sf_dir, "documents")
    foreign = F.lower("text").rlike("[äöüßéèêçñíó]| der | que ")
    return d.select("doc_id", F.length(F.when(foreign, "").otherwise(F.col("text"))).cast("long").alias("chars"))


oracle(definition_language_filter, "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[äöüßéèêçñíó]| der | que ') THEN 0 ELSE length(text) END AS chars FROM documents")
