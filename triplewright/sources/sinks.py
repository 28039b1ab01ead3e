"""Writers: stage records, triple lines, adjudication logs, graph tables, XML pairs and benchmark sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.operators.graph_build import upsert


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object per record."""
    records.write.mode("overwrite").json(path)


def write_triple_lines(triples: DataFrame, docs: DataFrame, path: str, partitions: int = 1) -> None:
    """A list of triples per document, in document order; documents without triples give an empty list.

    Range partitions keep the order over files; one file only if ``partitions`` is 1.
    """
    t = triples.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("s", "r", "o").alias("t")))).alias("x"))
    rows = docs.select("doc_id").join(t, "doc_id", "left").select("doc_id", F.coalesce(F.to_json(F.transform("x", lambda e: e["t"])), F.lit("[]")).alias("value"))
    rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id").select("value").write.mode("overwrite").text(path)


def write_adjudication(results: DataFrame, responses: DataFrame, path: str) -> None:
    """Results with rounded scores and the responses as tables, the results as JSON lines, and accepted items as text."""
    rounded = results.withColumn("fcs", F.round("fcs", 2))
    rounded.write.mode("overwrite").parquet(f"{path}/debate_result")
    responses.write.mode("overwrite").parquet(f"{path}/debate_response")
    rounded.write.mode("overwrite").json(f"{path}/debated_json")
    rounded.where("accepted").select(F.col("item").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/debated_text")


def merge_table(new: DataFrame, path: str, target: str, keys: list[str]) -> None:
    """The table at ``path`` with ``new`` merged in, written to ``target``; without a table, ``new`` itself."""
    spark = new.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    merged = upsert(spark.read.parquet(path), new, keys) if exists else new
    merged.write.mode("overwrite").parquet(target)


def seed_rows(stored: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Stored rows with the seeds in place of rows of the same key."""
    return stored.join(seeds.select(key), key, "left_anti").unionByName(seeds)


def write_aligned_xml(pairs: DataFrame, path: str) -> None:
    """Aligned pairs (doc_id, cands, refs; see ``evaluation.aligned_pairs``) as two sets of entries, in the order of documents."""
    for side, name in (("cands", "pred"), ("refs", "ref")):
        triples = F.transform(side, lambda t: F.struct(t[0].alias("s"), t[1].alias("r"), t[2].alias("o")))
        write_pairs_xml(pairs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(triples.alias("triples")), f"{path}/{name}")


def write_pairs_xml(pairs: DataFrame, path: str) -> None:
    """Entries with their triples written as three parts between bars."""
    line = F.transform("triples", lambda t: F.concat_ws(" | ", t["s"], t["r"], t["o"]))
    pairs.select(F.struct(line.alias("striple")).alias("modifiedtripleset")).write.mode("overwrite").format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)


def write_benchmark(triples: DataFrame, path: str) -> None:
    """Benchmark triples with their validity and kind of corruption."""
    triples.write.mode("overwrite").parquet(path)


def write_benchmark_inputs(triples: DataFrame, path: str, partitions: int = 1) -> None:
    """Triples (index, text, s, r, o, valid) as input records and as reference lines, both in the order of ``index``.

    A record holds the triple as a stage's output; a reference line is a list of the triple, empty if it is not valid.
    """
    rows = triples.repartitionByRange(partitions, "index").sortWithinPartitions("index")
    none, triple = F.array().cast("array<string>"), F.array("s", "r", "o")
    rows.select("index", F.col("text").alias("input_text"), F.lit("").alias("entity_hint"), F.lit("").alias("relation_hint"), none.alias("oie_raw"), none.alias("oie"), F.array(triple).alias("schema_canonicalizaiton")).write.mode("overwrite").json(f"{path}/dataset")
    rows.select(F.when(F.col("valid"), F.to_json(F.array(triple))).otherwise("[]").alias("value")).write.mode("overwrite").text(f"{path}/references")
