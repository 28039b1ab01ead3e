"""Queries from files to sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import prose
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query
from triplewright.plans.text_queries import TYPOS


@query
def file_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown and text files about parts; the recorded answers number the lines that they are given."""
    p, k = v.table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    table = F.when(k == 0, F.concat(F.lit("\n| a | b |\n|---|---|\n| 1 | "), "p_size", F.lit(" |"))).otherwise("")
    markdown = F.concat(F.lit("# "), "p_name", F.lit("\nIt is "), "p_type", F.lit(".\n## Made\nby "), "p_brand", table, F.lit("\n# Last\n- item"))
    prose_text = F.concat(F.lit("About\n\n"), "p_name", F.lit(" is small (1, 2).\n\nDisclaimer\n\n\n\nIt is "), "p_type")
    files = p.select(F.col("p_partkey").alias("doc_id"), F.when(k == 2, "x.MARKDOWN").when(k == 0, "dir/x.md").otherwise("x.md.txt").alias("path"), F.when(k.isin(0, 2), markdown).otherwise(prose_text).alias("text"))
    rewrite = lambda df: df.withColumn("answer", F.concat(F.lit("Here are the lines\n1. In "), "headers", F.lit("\n\n- "), "content"))
    translate = lambda df: df.withColumn("answer", F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("A table under "), "headers")))
    return prose.file_sentences(files, rewrite, translate)


oracle(
    file_sentences,
    """WITH p AS (SELECT p_partkey AS d, p_partkey % 4 AS k, * FROM part),
parts AS (SELECT d, 0 AS nth, concat('Header 1: ', p_name) AS h, [concat('It is ', p_type, '.')] AS lines FROM p WHERE k IN (0, 2)
  UNION ALL SELECT d, 1, concat('Header 1: ', p_name, ' > Header 2: Made'), CASE WHEN d % 8 = 0 THEN [concat('A table under Header 1: ', p_name, ' > Header 2: Made')] WHEN k = 0 THEN [concat('by ', p_brand), '| a | b |', '|---|---|', concat('| 1 | ', p_size, ' |')] ELSE [concat('by ', p_brand)] END FROM p WHERE k IN (0, 2)
  UNION ALL SELECT d, 2, 'Header 1: Last', ['- item'] FROM p WHERE k IN (0, 2)
  UNION ALL SELECT d, 0, 'Clinical Narrative Overview', [concat(p_name, ' is small.'), concat('It is ', p_type)] FROM p WHERE k IN (1, 3)),
s AS (SELECT d, nth, list_concat([concat('In ', h)], lines) AS x FROM parts)
SELECT d AS doc_id, nth::INTEGER AS nth, (generate_subscripts(x, 1) - 1)::INTEGER AS pos, unnest(x) AS sentence FROM s""",
)


@query
def nested_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 in structs, arrays and maps."""
    d = v.table(spark, sf_dir, "documents").where("text is not null")
    lines = F.split("text", "\n")
    nested = d.select("doc_id", F.struct(lines.alias("lines"), F.struct(F.col("lang").alias("lang"), F.create_map(F.lit("thn"), F.col("text")).alias("m")).alias("inner")).alias("x"))
    x = prose.corrected_deep(nested, TYPOS)
    return x.select("doc_id", F.sha2(F.array_join("x.lines", "|"), 256).alias("lines"), "x.inner.lang", F.sha2(F.col("x.inner.m")["thn"], 256).alias("value"))


oracle(
    nested_typos,
    """WITH c AS (SELECT doc_id, lang, text, list_transform(string_split(text, chr(10)), lambda l: replace(replace(replace(l, 'thn', 'th n'), 'th n', 'then '), 'ouou', 'ou')) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(array_to_string(lines, '|')) AS lines, replace(replace(replace(lang, 'thn', 'th n'), 'th n', 'then '), 'ouou', 'ou') AS lang, sha256(replace(replace(replace(text, 'thn', 'th n'), 'th n', 'then '), 'ouou', 'ou')) AS value FROM c""",
)
