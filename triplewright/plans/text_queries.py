"""Queries over document, conversation and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import text as t
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query

STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
CITED = lambda x: rf"regexp_replace(regexp_replace({x}, '\s*\(\d+(?:\s*,\s*\d+)*\)', '', 'g'), '\s*\[\d+(?:\s*,\s*\d+)*\]', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents")


@query
def clean_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01 on documents framed by noise lines and empty lines."""
    framed = F.concat(F.lit("About\n|\n\n\n"), F.col("text"), F.lit(" (1, 2)\n\n\nDisclaimer\nfollow us on X\n"), F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t.clean_prose(framed), 256).alias("sha"))


_NOISE = "|".join(f"(?:{p})" for p in t.NOISE_LINES)
oracle(
    clean_prose,
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(concat('About', chr(10), '|', chr(10), chr(10), chr(10), text, ' (1, 2)', chr(10), chr(10), chr(10), 'Disclaimer', chr(10), 'follow us on X', chr(10), lang), chr(10))) AS raw,
  generate_subscripts(string_split(concat('About', chr(10), '|', chr(10), chr(10), chr(10), text, ' (1, 2)', chr(10), chr(10), chr(10), 'Disclaimer', chr(10), 'follow us on X', chr(10), lang), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, CASE WHEN {STRIP("raw")} = '' THEN '' ELSE {CITED("raw")} END AS x FROM l WHERE {STRIP("raw")} = '' OR NOT regexp_matches({STRIP("raw")}, '(?i){_NOISE}')),
b AS (SELECT doc_id, pos, CASE WHEN {STRIP("x")} = '' THEN '' ELSE x END AS x FROM k),
r AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM b)
SELECT doc_id, sha256({STRIP("string_agg(x, chr(10) ORDER BY pos)")}) AS sha FROM r WHERE NOT (x = '' AND coalesce(before, 'x') = '') GROUP BY doc_id""",
)


@query
def strip_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P09, P12."""
    x = F.concat(F.lit("note(due to) [4] "), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t.one_line(t.repaired(x)), 256).alias("sha"))


oracle(
    strip_citations,
    rf"""WITH c AS (SELECT doc_id, regexp_replace({CITED("concat('note(due to) [4] ', text)")}, '([A-Za-z0-9_])\(([A-Za-z0-9_])', '\1 (\2', 'g') AS x FROM documents)
SELECT doc_id, sha256({STRIP("regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")}) AS sha FROM c""".replace("\\\\", "\\"),
)


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 on texts with abbreviations; also checked against a plain loop in the tests."""
    x = F.concat(F.lit("See Dr. Who vs. him. "), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(t.sentences(x)).alias("pos", "sentence"))


oracle(
    sentence_split,
    rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(concat('See Dr. Who vs. him. ', text), '([.?!]) ', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM s),
o AS (SELECT *, NOT regexp_matches(piece, '[.?!]$') OR regexp_replace(lower(regexp_extract({STRIP("piece")}, '\S+$')), '[^a-z0-9_\-]', '', 'g') IN ({", ".join(f"'{a}'" for a in t.ABBREVIATIONS)}) AS open FROM p),
g AS (SELECT *, coalesce(sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM o),
w AS (SELECT doc_id, grp, {STRIP("string_agg(piece, ' ' ORDER BY i)")} AS sentence FROM g GROUP BY doc_id, grp)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS pos, sentence FROM w WHERE sentence <> ''""",
)


@query
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as paragraphs, packed to 1500 characters."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(t.chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("pos", "chunk")).select("doc_id", "pos", F.length("chunk").alias("chars"))


oracle(
    paragraph_chunks,
    rf"""WITH RECURSIVE p AS (
  SELECT doc_id, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, {STRIP("unnest(string_split(text, chr(10)))")} AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE x <> ''
), f AS (
  SELECT doc_id, k, 0 AS pos, n + 2 AS size, n AS chars FROM p WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN f.size + p.n > 1500 THEN f.pos + 1 ELSE f.pos END, CASE WHEN f.size + p.n > 1500 THEN p.n ELSE f.size + p.n + 2 END,
    CASE WHEN f.size + p.n > 1500 THEN p.n ELSE f.chars + p.n + 2 END FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(max(chars) AS INTEGER) AS chars FROM f GROUP BY doc_id, pos""",
)


def _markdown() -> F.Column:
    """Page headings as Markdown: tags to hashes, other tags dropped."""
    x = F.regexp_replace("html", r"<h([1-3])[^>]*>", "\n<$1>")
    x = F.replace(F.replace(F.replace(x, F.lit("<1>"), F.lit("# ")), F.lit("<2>"), F.lit("## ")), F.lit("<3>"), F.lit("### "))
    return F.regexp_replace(F.regexp_replace(x, r"</h[1-3]>|<p[^>]*>", "\n"), r"<[^>]*>", " ")


@query
def header_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of text under each path of headings."""
    p = v.table(spark, sf_dir, "pages").select("page_id", F.explode(t.sections(_markdown())).alias("s"))
    return p.groupBy("page_id", F.col("s.path").alias("path")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("s.line")).alias("chars"))


oracle(
    header_sections,
    r"""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(html, '<h([1-3])[^>]*>', chr(10) || '<\1>', 'g'), '<1>', '# '), '<2>', '## '), '<3>', '### '), '</h[1-3]>|<p[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages),
l AS (SELECT page_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS pos FROM m),
h AS (SELECT *, length(regexp_extract(line, '^(#{1,3}) ', 1)) AS level, regexp_extract(line, '^#{1,3} +(.*)$', 1) AS title FROM l),
g AS (SELECT *, count(*) FILTER (level = 1) OVER w AS g1, count(*) FILTER (level IN (1, 2)) OVER w AS g2, count(*) FILTER (level > 0) OVER w AS g3 FROM h WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
t AS (SELECT *, max(title) FILTER (level = 1) OVER (PARTITION BY page_id, g1) AS h1, max(title) FILTER (level = 2) OVER (PARTITION BY page_id, g2) AS h2, max(title) FILTER (level = 3) OVER (PARTITION BY page_id, g3) AS h3 FROM g)
SELECT page_id, concat_ws(' > ', CASE WHEN h1 <> '' THEN 'Header 1: ' || h1 END, CASE WHEN h2 <> '' THEN 'Header 2: ' || h2 END, CASE WHEN h3 <> '' THEN 'Header 3: ' || h3 END) AS path,
  count(*) AS lines, sum(length(line))::BIGINT AS chars FROM t WHERE level = 0 AND regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1, 2""",
)


@query
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language with a table rule, before and after one is added to every third."""
    d = _docs(spark, sf_dir)
    ruled = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n| a | b |\n|---|:-:|\n"))).otherwise(F.col("text"))
    return d.groupBy("lang").agg(F.count_if(t.has_table("text")).alias("as_is"), F.count_if(t.has_table(ruled)).alias("ruled"))


oracle(
    table_detect,
    r"""SELECT lang, count(*) FILTER (regexp_matches(text, '\|[\s\-:]+\|')) AS as_is,
  count(*) FILTER (regexp_matches(CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), '| a | b |', chr(10), '|---|:-:|', chr(10)) ELSE text END, '\|[\s\-:]+\|')) AS ruled FROM documents GROUP BY lang""",
)


@query
def thinking_and_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14 on conversation texts wrapped in thinking tags and answer markers."""
    c = v.table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    x = F.when(k == 0, F.concat(F.lit("<think>a\nb</think>"), "text")).when(k == 1, F.concat("text", F.lit("<think>open"))).when(k == 2, F.concat("text", F.lit("</think>Output: "), "role")).otherwise(F.col("text"))
    y = t.without_thinking(x)
    return c.select("conv_id", "turn", F.length(y).alias("chars"), t.final_answer(y).alias("answer"))


oracle(
    thinking_and_answer,
    r"""WITH x AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('<think>a', chr(10), 'b</think>', text) WHEN 1 THEN concat(text, '<think>open') WHEN 2 THEN concat(text, '</think>Output: ', role) ELSE text END AS x FROM conversations),
y AS (SELECT conv_id, turn, regexp_replace(replace(regexp_replace(regexp_replace(x, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', ''), '</think>', ''), '^\s+|\s+$', '', 'g') AS y FROM x)
SELECT conv_id, turn, CAST(length(y) AS INTEGER) AS chars, CASE WHEN contains(y, 'Output:') THEN y[length(y) - strpos(reverse(y), ':tuptuO') - 5:] ELSE right(y, 600) END AS answer FROM y""",
)


TYPOS = [("thn", "th n"), ("th n", "then "), ("ouou", "ou")]


@query
def typo_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t.corrected("text", TYPOS), 256).alias("sha"))


oracle(typo_replace, "SELECT doc_id, sha256(replace(replace(replace(text, 'thn', 'th n'), 'th n', 'then '), 'ouou', 'ou')) AS sha FROM documents")


@query
def rewrite_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07 on documents whose lines are given bullets and numbers."""
    x = F.concat(F.lit("Here are the lines:\n\n1. "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    lines = t.tidy_rewrite(x)
    return _docs(spark, sf_dir).select("doc_id", F.size(lines).alias("lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))


oracle(
    rewrite_cleanup,
    rf"""WITH l AS (SELECT doc_id, {STRIP("unnest(string_split(concat('Here are the lines:', chr(10), chr(10), '1. ', replace(text, chr(10), chr(10) || '- ')), chr(10)))")} AS x, generate_subscripts(string_split(concat('a', chr(10), chr(10), '1. ', text), chr(10)), 1) AS pos FROM documents)
SELECT doc_id, CAST(count(*) AS INTEGER) AS lines, sha256(string_agg({STRIP("regexp_replace(x, '^(?:[-*•]\\s*|\\d+[.)]\\s*)', '')")}, chr(10) ORDER BY pos)) AS sha FROM l WHERE x <> '' AND NOT regexp_matches(lower(x), '^(here are|resolved)') GROUP BY doc_id""".replace("\\\\", "\\"),
)


@query
def list_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 on documents introduced as lists."""
    x = F.concat(F.lit("Insulin is given as:\n- "), "text")
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(t.list_sentences(x)).alias("pos", "sentence"))

oracle(
    list_expansion,
    rf"""WITH x AS (SELECT doc_id, string_split(regexp_replace({CITED("concat('Insulin is given as:', chr(10), '- ', text)")}, '([A-Za-z0-9_])\(([A-Za-z0-9_])', '\1 (\2', 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, {STRIP("unnest(x)")} AS line, generate_subscripts(x, 1) AS i FROM x),
h AS (SELECT *, CASE WHEN ends_with(line, ':') THEN regexp_replace(line, '\s*:$', '') WHEN line <> '' AND NOT starts_with(line, '-') AND (regexp_matches(line, '^\d+\.\s+') OR (length(line) < 60 AND NOT ends_with(line, '.'))) THEN '' END AS head FROM l),
g AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') AS intro FROM h),
s AS (SELECT doc_id, i, CASE WHEN intro <> '' THEN concat(intro, ' ', {STRIP("regexp_replace(line, '^-\\s*', '')")}) ELSE {STRIP("regexp_replace(line, '^-\\s*', '')")} END AS sentence FROM g WHERE head IS NULL AND line <> '' AND NOT (intro = '' AND regexp_matches(line, '{t.REFERENCE}')))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, sentence FROM s""".replace("\\\\", "\\"),
)
