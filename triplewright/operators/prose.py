"""From files to sentences: Markdown by sections and tables, other files as prose, both rewritten by a model.

``rewrite`` and ``translate`` are functions of a frame with ``headers`` and ``content`` that add ``answer`` (see
``operators.clients`` for a client in the workers and for recorded answers); a null answer gives no sentences, or
leaves a table as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from triplewright.functions.text import chunks, clean_prose, corrected, has_table, sections, tidy_rewrite

Model = Callable[[DataFrame], DataFrame]
OVERVIEW = "Clinical Narrative Overview"  # stands for the headers of prose


def prose_chunks(files: DataFrame, most: int = 1500) -> DataFrame:
    """P05 up to the model: (doc_id, nth, headers, content) of cleaned texts."""
    return files.select("doc_id", F.posexplode(chunks(clean_prose("text"), most)).alias("nth", "content")).select("doc_id", "nth", F.lit(OVERVIEW).alias("headers"), "content")


def markdown_sections(files: DataFrame) -> DataFrame:
    """(doc_id, nth, headers, content): the lines below one path of headings, up to the next heading."""
    lines = files.select("doc_id", F.posexplode(sections("text")).alias("pos", "s")).select("doc_id", "pos", "s.path", "s.line")
    w = Window.partitionBy("doc_id").orderBy("pos")
    run = F.sum(F.when(F.lag("path").over(w) == F.col("path"), 0).otherwise(1)).over(w) - 1
    rows = lines.withColumn("nth", run.cast("int")).groupBy("doc_id", "nth").agg(F.first("path").alias("headers"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    return rows.select("doc_id", "nth", "headers", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("content"))


def file_sentences(files: DataFrame, rewrite: Model, translate: Model) -> DataFrame:
    """Files (doc_id, path, text) to (doc_id, nth, pos, sentence). Files named .md or .markdown are read as
    Markdown, their sections with a table go through ``translate`` first; all others are prose."""
    markdown = F.lower("path").rlike(r"\.(md|markdown)$")
    parts = markdown_sections(files.where(markdown))
    tables = translate(parts.where(has_table("content")))
    tables = tables.withColumn("content", F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer")).otherwise(F.col("content"))).drop("answer")
    every = parts.where(~has_table("content")).unionByName(tables).unionByName(prose_chunks(files.where(~F.coalesce(markdown, F.lit(False)))))
    return rewrite(every).select("doc_id", "nth", F.posexplode(tidy_rewrite("answer")).alias("pos", "sentence"))


def corrected_deep(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Literal replacements, in order, in every string of every column, whatever it is nested in; keys of maps stay."""

    def walk(c: Column, t: DataType) -> Column:
        if isinstance(t, StringType):
            return corrected(c, rules)
        if isinstance(t, ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        if isinstance(t, MapType):
            return F.transform_values(c, lambda _, x: walk(x, t.valueType))
        if isinstance(t, StructType):
            return F.when(c.isNotNull(), F.struct(*(walk(c[f.name], f.dataType).alias(f.name) for f in t)))
        return c

    return df.select(*(walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
