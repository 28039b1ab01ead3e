"""Readers and sinks on small files in the formats they read and write."""

import json

from triplewright.operators.graph_build import upsert
from triplewright.sources import readers as r
from triplewright.sources import sinks as s
from triplewright.streaming.upserts import latest, merge_batches


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_lines_and_definitions(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'relation,definition\nis_a,"kind, of",more\nbad\nis_a,last\nhas,x\n')
    assert [tuple(x) for x in r.lines(spark, path).orderBy("doc_id").collect()][2] == (2, "bad")
    assert {tuple(x) for x in r.definitions(spark, path).collect()} == {("is_a", "last"), ("has", "x")}
    assert r.definitions(spark, path, header=False).count() == 3


def test_triple_lines(spark, tmp_path):
    path = put(tmp_path, "t.txt", "[['a', 'r', \"b's\"]]\nbroken [\n[]\n[['x', 'y', 'z'], ['1', '2']]\n")
    assert [tuple(x) for x in r.triple_lines(spark, path).orderBy("doc_id").collect()] == [(0, 0, "a", "r", "b's"), (3, 0, "x", "y", "z")]


def test_stage_records(spark, tmp_path):
    record = {"index": 3, "input_text": "t", "oie": [["a", "r", "b"]], "schema_definition": {"_entries": [{"subject": "a", "relation": "r", "object": "b", "subject_type": "drug"}]}}
    path = put(tmp_path, "r.json", json.dumps([record]))
    records = r.stage_records(spark, path)
    assert [(x.doc_id, x.ord, x.subject, x.subject_type) for x in r.typed_entries(records).collect()] == [(3, 0, "a", "drug")]
    s.write_records(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_pubtator(spark, tmp_path):
    text = "7|t|A title\n7|a|An abstract\n7\t0\t1\tA\tGene\t1,2\n7\t2\t5\tAbc\tGene\t1\n7\tAssociation\t1\t2\tNovel\n\n8|t|T\n8|a|B\n"
    docs, mentions, relations = r.pubtator(spark, put(tmp_path, "p.txt", text))
    assert {tuple(x) for x in docs.collect()} == {("7", "A title", "An abstract"), ("8", "T", "B")}
    assert {tuple(x) for x in r.names_of(mentions).collect()} == {("7", "1", "Abc", "Gene"), ("7", "2", "A", "Gene")}
    assert [tuple(x) for x in relations.collect()] == [("7", "Association", "1", "2", "Novel")]


def test_bioc(spark, tmp_path):
    doc = {"documents": [{"id": "5", "passages": [{"offset": 0, "text": "x", "annotations": [{"id": "0", "text": "x", "infons": {"type": "Gene", "identifier": "1;2"}}]}], "relations": [{"id": "R", "infons": {"type": "Bind", "entity1": "1", "entity2": "2"}}]}]}
    mentions, relations = r.bioc(spark, put(tmp_path, "b.json", json.dumps(doc)))
    assert mentions.count() == 2 and [tuple(x) for x in relations.collect()] == [("5", "Bind", "1", "2")]


def test_xml_and_ontology(spark, tmp_path):
    xml = '<benchmark><entries><entry eid="1"><modifiedtripleset><mtriple>A | r | B</mtriple><mtriple>C|q|D</mtriple></modifiedtripleset></entry></entries></benchmark>'
    assert {tuple(x) for x in r.triples_xml(spark, put(tmp_path, "x.xml", xml)).collect()} == {("1", 0, "A", "r", "B"), ("1", 1, "C", "q", "D")}
    onto = {"title": "t", "id": "o", "concepts": [{"qid": "Q1", "label": "City"}], "relations": [{"pid": "P1", "label": "in", "domain": "Q1", "range": "Q9"}]}
    relations, concepts = r.ontology(spark, put(tmp_path, "o.json", json.dumps(onto)))
    assert [(x.label, x.domain_label, x.range_label) for x in relations.collect()] == [("in", "City", None)] and concepts.count() == 1


def test_vocabulary_cache(spark, tmp_path):
    for version, rows in (("2.0", 1), ("1.0", 0), (None, 1)):
        cache = {"glucose": {"cui": "C1", "score": 1.5}} | ({"__version__": version} if version else {})
        assert r.vocabulary_cache(spark, put(tmp_path, f"c{version}.json", json.dumps(cache)), "2.0").count() == rows


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(0,), (1,), (2,)], "doc_id int")
    triples = spark.createDataFrame([(2, 1, "c", "r", "d"), (2, 0, "a", "r", "b")], "doc_id int, ord int, s string, r string, o string")
    s.write_triple_lines(triples, docs, str(tmp_path / "t"))
    assert [x.value for x in spark.read.text(str(tmp_path / "t")).collect()] == ["[]", "[]", '[["a","r","b"],["c","r","d"]]']
    pairs = spark.createDataFrame([(1, [("a", "r", "b")])], "doc_id int, triples array<struct<s:string,r:string,o:string>>")
    s.write_pairs_xml(pairs, str(tmp_path / "x"))
    assert r.triples_xml(spark, str(tmp_path / "x"), "striple").select("s", "r", "o").collect()[0] == ("a", "r", "b")
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(x) for x in s.seed_rows(stored, spark.createDataFrame([("b", 5)], "k string, v int"), "k").collect()} == {("a", 1), ("b", 5)}


def test_upsert_and_streams(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id int, n string, v int")
    b = spark.createDataFrame([(2, None, 9), (3, "z", 3)], "id int, n string, v int")
    assert {tuple(x) for x in upsert(a, b, ["id"]).collect()} == {(1, "x", 1), (2, "y", 9), (3, "z", 3)}
    assert {tuple(x) for x in latest(a.unionByName(b), ["id"], ["v"]).collect()} == {(1, "x", 1), (2, None, 9), (3, "z", 3)}
    for i, df in enumerate((a, b)):
        df.write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 10).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(merge_batches(str(tmp_path / "table"), ["id"], ["v"])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = sorted((tmp_path / "table").iterdir())[-1]
    assert spark.read.parquet(str(last)).count() == 3
