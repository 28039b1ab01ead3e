"""Readers for the file formats of triple extraction: each gives a typed DataFrame keyed by an explicit id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplewright.functions.parsing import read_triples

ENTRY = "subject string, subject_type string, subject_type_definition string, relation string, relation_definition string, object string, object_type string, object_type_definition string, subject_type_canon string, object_type_canon string"
RECORD = f"index int, input_text string, entity_hint string, relation_hint string, oie_raw array<array<string>>, oie array<array<string>>, schema_definition struct<_entries: array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ENTRY.split(', '))}>>>, canonicalization_candidates string, schema_canonicalizaiton array<array<string>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text), one row per line; doc_id is the line's place over all files in the order of their paths.

    Within a block of a file, rows are read in order and numbered by the scan; what precedes a block is summed
    over the blocks' counts, one row for each block.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")
    placed = rows.join(F.broadcast(blocks.select("file", "block", "first", before.alias("before"))), ["file", "block"])
    return placed.select((F.col("before") + F.col("at") - F.col("first")).alias("doc_id"), F.col("value").alias("text"))


def definitions(spark: SparkSession, path: str, header: bool = True, underscores: bool = False) -> DataFrame:
    """(name, definition) of a two-column CSV: further columns belong to the definition, the last row of a name wins.

    ``underscores``: blanks of a name become underscores, as benchmark relations are written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for pdf in batches:
            rows = [(i, r[0].strip(), ",".join(r[1:]).strip()) for i, x in zip(pdf.doc_id, pdf.text, strict=True) for r in csv.reader([x]) if len(r) >= 2]
            yield pd.DataFrame(rows, columns=["pos", "name", "definition"])

    rows = lines(spark, path).mapInPandas(run, "pos long, name string, definition string")
    if header:
        rows = rows.where("pos > 0")
    if underscores:
        rows = rows.withColumn("name", F.translate("name", " ", "_"))
    return rows.groupBy("name").agg(F.max_by("definition", "pos").alias("definition"))


def request(spark: SparkSession, **fields: str | None) -> DataFrame:
    """A request as one row; its fields are columns."""
    return spark.range(1).select(*(F.lit(x).cast("string").alias(name) for name, x in fields.items()))


def stage_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an extraction run, a JSON array."""
    return spark.read.schema(RECORD).json(path, multiLine=True)


def typed_entries(records: DataFrame) -> DataFrame:
    """The typed entries of stage records as rows (doc_id, ord, ...)."""
    return records.select(F.col("index").alias("doc_id"), F.posexplode("schema_definition._entries").alias("ord", "e")).select("doc_id", "ord", "e.*")


def triple_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ord, s, r, o) from lines that hold a literal list of triples."""
    t = read_triples(lines(spark, path), "text", "literal").select("doc_id", F.posexplode("triples").alias("ord", "t")).where(F.size("t") == 3)
    return t.select("doc_id", "ord", F.col("t")[0].alias("s"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S07."""
    return spark.read.schema(schema).json(path)


def pubtator(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, mentions, relations). Composite identifiers are split; the last mention of an identifier names it."""
    block = spark.read.text(path, lineSep="\n\n").select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\n").alias("x")).where(F.size("x") > 0)
    part = lambda tag: F.regexp_extract(F.try_element_at(F.filter("x", lambda l: l.rlike(rf"^\d+\|{tag}\|")), F.lit(1)), rf"^\d+\|{tag}\|(.*)$", 1)
    docs = block.select(F.regexp_extract(F.col("x")[0], r"^(\d+)\|", 1).alias("pmid"), part("t").alias("title"), part("a").alias("abstract")).where("pmid <> ''")
    rows = block.select(F.posexplode("x").alias("pos", "line")).select("pos", F.split("line", "\t").alias("c"))
    c = lambda i: F.col("c")[i]
    mentions = rows.where(F.size("c") == 6).select(c(0).alias("pmid"), "pos", c(1).cast("int").alias("start"), c(2).cast("int").alias("end"), c(3).alias("mention"), c(4).alias("type"), F.explode(F.split(c(5), "[,;]")).alias("identifier"))
    relations = rows.where(F.size("c") == 5).select(c(0).alias("pmid"), c(1).alias("rel"), c(2).alias("e1"), c(3).alias("e2"), c(4).alias("novelty"))
    return docs, mentions, relations


def names_of(mentions: DataFrame) -> DataFrame:
    """The last mention of each identifier per document: (pmid, identifier, mention, type)."""
    last = mentions.groupBy("pmid", "identifier").agg(F.max_by(F.struct("mention", "type"), "pos").alias("m"))
    return last.select("pmid", "identifier", "m.mention", "m.type")


BIOC = "documents array<struct<id: string, passages: array<struct<offset: int, text: string, annotations: array<struct<id: string, text: string, infons: struct<type: string, identifier: string>>>>>, relations: array<struct<id: string, infons: struct<type: string, entity1: string, entity2: string>>>>>"


def bioc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mentions, relations) of a BioC JSON collection."""
    docs = spark.read.schema(BIOC).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    notes = docs.select("id", F.explode("passages").alias("p")).select("id", F.explode("p.annotations").alias("a"))
    mentions = notes.select(F.col("id").alias("pmid"), F.col("a.text").alias("mention"), F.col("a.infons.type").alias("type"), F.explode(F.split("a.infons.identifier", "[,;]")).alias("identifier"))
    relations = docs.select("id", F.explode("relations").alias("r")).select(F.col("id").alias("pmid"), F.col("r.infons.type").alias("rel"), F.col("r.infons.entity1").alias("e1"), F.col("r.infons.entity2").alias("e2"))
    return mentions, relations


def triples_xml(spark: SparkSession, path: str, tag: str = "mtriple") -> DataFrame:
    """(doc_id, ord, s, r, o) of benchmark entries; each triple is written as three parts between bars."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(f"_eid string, modifiedtripleset struct<{tag}: array<string>>").load(path)
    t = entries.select(F.col("_eid").alias("doc_id"), F.posexplode(f"modifiedtripleset.{tag}").alias("ord", "t")).withColumn("t", F.split("t", r"\s*\|\s*"))
    return t.select("doc_id", "ord", F.trim(F.col("t")[0]).alias("s"), F.trim(F.col("t")[1]).alias("r"), F.trim(F.col("t")[2]).alias("o"))


ONTOLOGY = "title string, id string, concepts array<struct<qid: string, label: string>>, relations array<struct<pid: string, label: string, domain: string, range: string>>"


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(relations, concepts) of an ontology; domain and range by label."""
    o = spark.read.schema(ONTOLOGY).json(path, multiLine=True)
    concepts = o.select(F.explode("concepts").alias("c")).select("c.*")
    r = o.select(F.explode("relations").alias("r")).select("r.*")
    side = lambda n: concepts.select(F.col("qid").alias(n), F.col("label").alias(f"{n}_label"))
    return r.join(side("domain"), "domain", "left").join(side("range"), "range", "left"), concepts


def vocabulary_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Cached vocabulary rows; a file of another version counts as empty, one without a version is taken."""
    field = "struct<cui: string, canonical: string, semantic_type: string, score: double, icd10_code: string, rxnorm_id: string, definition: string>"
    raw = spark.read.text(path, wholetext=True)
    stated = F.get_json_object("value", "$.__version__")
    entries = raw.where(stated.isNull() | (stated == version)).select(F.explode(F.from_json("value", f"map<string, string>")).alias("term", "v")).where("term <> '__version__'")
    return entries.select("term", F.from_json("v", field).alias("e")).select("term", "e.*")
