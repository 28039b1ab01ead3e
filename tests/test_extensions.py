"""Extension points, sinks and scorers that no query's SQL covers."""

import json
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright.functions import parsing as p
from triplewright.operators import clients as c
from triplewright.operators import evaluation as e
from triplewright.operators import graph as g
from triplewright.operators import matching as m
from triplewright.sources import readers as r
from triplewright.sources import sinks as s


def test_clients_answer_in_batches_and_fail_as_nulls(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string").repartition(2)
    prompts = docs.withColumn("prompt", c.filled("{a}: {text} {not a slot}", a=F.lit("Say {text}"), text="text"))
    assert prompts.where("doc_id = 3").first().prompt == "Say {text}: text 3 {not a slot}"

    def factory():
        def answer(batch):
            assert len(batch) <= 2
            if any("7" in x for x in batch):
                raise RuntimeError("no answer")
            return [f"[['{x[-1]}', 'r', 'o']]" for x in batch]

        return answer

    got = c.answered(docs, "text", factory, batch=2)
    answers = {x.doc_id: x.answer for x in got.collect()}
    assert answers[7] is None and sum(a is None for a in answers.values()) <= 2
    assert {x.s for x in c.extracted(got).collect()} == {str(i) for i, a in answers.items() if a}
    recorded = prompts.limit(4).select(F.sha2("prompt", 256).alias("prompt_sha256"), F.lit("x: one\nx: two").alias("answer"))
    replayed = c.replayed(prompts, "prompt", recorded.unionByName(recorded))
    assert replayed.count() == 10 and replayed.where("answer is not null").count() == 4
    assert {x.definition for x in c.defined(replayed).collect()} == {"two"}


def test_requests_and_guarded_statements(spark):
    assert r.request(spark, query_text="a", patient_id=None).collect()[0].asDict() == {"query_text": "a", "patient_id": None}
    edges = spark.createDataFrame([("a", "R", "b")], "src string, rel string, dst string")
    assert g.guarded(spark, "SELECT count(*) AS n FROM {edges}", edges=edges).first().n == 1
    for statement in ("DROP TABLE x", "insert INTO {edges} SELECT 1", "SELECT 1; Delete FROM x", "CALL y()"):
        with pytest.raises(ValueError):
            g.guarded(spark, statement, edges=edges)


def test_benchmark_files_and_aligned_pairs(spark, tmp_path):
    rows = [(1, "t1", "a", "r", "b's", True), (0, "t0", "x", "y", "z", False)]
    s.write_benchmark_inputs(spark.createDataFrame(rows, "index int, text string, s string, r string, o string, valid boolean"), str(tmp_path / "b"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "b/references")).collect()]
    assert lines[0] == "[]" and json.loads(lines[1]) == [["a", "r", "b's"]]
    data = spark.read.json(str(tmp_path / "b/dataset")).orderBy("index").collect()
    assert [x.schema_canonicalizaiton for x in data] == [[["x", "y", "z"]], [["a", "r", "b's"]]] and data[0].input_text == "t0"
    pred = spark.createDataFrame([(1, "[['a', 'r', 'b']]"), (2, "[['a', 'r']]"), (3, "nothing"), (4, "[]"), (5, "[('a', 'r', 'b')]")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, "[['a', 'r', 'b'], ['c', 'r', 'd']]"), (2, "[]"), (3, "[]"), (4, "[['a', 'r', 'b'], ['c', 'r', 'd']]"), (5, "[]")], "doc_id long, text string")
    assert {x.doc_id for x in e.aligned_pairs(pred, gold).collect()} == {1, 4, 5}
    near = e.aligned_pairs(pred, gold, most_apart=1)
    assert {x.doc_id for x in near.collect()} == {1, 5}
    s.write_aligned_xml(near, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x/ref"), wholetext=True).agg(F.sum((F.length("value") - F.length(F.replace("value", F.lit("<striple>"), F.lit("")))) / 9)).first()[0] == 2
    assert p.strict_triples("[['a', 'b', 3]]") is None and p.strict_triples(None) is None and p.strict_triples("[]") == []


def test_span_counts():
    got = e.span_counts(("a b", "likes", "c d"), ("a b", "likes", "c x"))
    assert got == {"type": [3, 0, 0, 0, 0], "partial": [2, 0, 1, 0, 0], "strict": [2, 1, 0, 0, 0], "exact": [2, 1, 0, 0, 0]}
    turned = e.span_counts(("c", "likes", "a"), ("a", "likes", "c"))
    assert turned["exact"] == [3, 0, 0, 0, 0] and turned["strict"] == [1, 2, 0, 0, 0] and turned["type"] == [1, 2, 0, 0, 0]
    assert e.span_counts(None, ("a", "b", "c"))["exact"] == [0, 0, 0, 3, 0] and e.span_counts(("a", "b", "c"), None)["exact"] == [0, 0, 0, 0, 3]


def test_span_evaluation_takes_the_best_assignment(spark):
    rng = np.random.default_rng(3)
    words = ["a", "b", "a b", "c d", "d"]
    triple = lambda: tuple(str(x) for x in rng.choice(words, 3))
    docs = [(i, [triple() for _ in range(rng.integers(0, 4))], [triple() for _ in range(rng.integers(0, 4))]) for i in range(40)]
    df = spark.createDataFrame([(i, [list(t) for t in a], [list(t) for t in b]) for i, a, b in docs], "doc_id long, cands array<array<string>>, refs array<array<string>>").repartition(3)
    found = e.span_evaluation(df)
    mean = {x.doc_id: x.f for x in found.groupBy("doc_id").agg(F.avg("f1").alias("f")).collect()}
    score = lambda x, y: np.mean([e._rates(e.span_counts(x, y)[k], k == "partial")[2] for k in e.MEASURES])
    for i, a, b in docs:
        small, large, flip = (a, b, False) if len(a) <= len(b) else (b, a, True)
        best = max((sum(score(y, x) if flip else score(x, y) for x, y in zip(small, q, strict=False)) for q in permutations(large, len(small))), default=0.0)
        assert (mean[i] or 0.0) == pytest.approx(best)
    total = {x.measure: x for x in e.span_summary(found).collect()}
    assert total["exact"].pairs == sum(max(len(a), len(b)) for _, a, b in docs)
    assert total["type"].correct + total["type"].incorrect + total["type"].spurious == 3 * sum(len(a) for _, a, _ in docs)


def test_assignments_of_many_documents_at_once(spark):
    """As the assignment of each document alone, without a frame per document."""
    rng = np.random.default_rng(5)
    tables = {f"d{k}": rng.integers(0, 4, rng.integers(1, 8, 2)) / 3 for k in range(120)}
    tables |= {"wide": rng.random((3, 300)), "long": rng.random((70, 40)), "no score": np.zeros((2, 2))}
    slot = lambda x: (f"{x:03}", "r", None)
    rows = [(k, slot(i), slot(j), None if k == "no score" else float(x)) for k, t in tables.items() for (i, j), x in np.ndenumerate(t)]
    triple = "struct<s: string, r: string, o: string>"
    scores = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], f"doc_id string, cand {triple}, ref {triple}, score double").repartition(3)
    out = e.assigned(scores)
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.doc_id: (x.pairs, x.mean_score) for x in out.collect()}
    assert got == {k: (max(t.shape), sum(t[i, j] for i, j in e.assign(t)) / max(t.shape)) for k, t in tables.items()}
    assert e.assigned(scores.limit(0)).count() == 0
    pair = lambda c, r: ("d", slot(c), slot(r), 1.0)
    for rows in ([pair(1, 1), pair(1, 2), pair(2, 1)], [pair(1, 1), pair(1, 2), pair(2, 1), pair(3, 2)], [pair(1, 1), pair(1, 1)], [pair(1, 1), pair(2, 2)]):
        with pytest.raises(Exception, match="against each of its references once"):
            e.assigned(spark.createDataFrame(rows, scores.schema)).collect()


def test_top_k_over_blocks_of_a_large_schema(spark, monkeypatch):
    rng = np.random.default_rng(4)
    schema = [(f"n{i}", rng.normal(size=4).tolist()) for i in range(50)]
    queries = [(i, rng.normal(size=4).tolist()) for i in range(20)]
    q, t = spark.createDataFrame(queries, "id long, vector array<double>"), spark.createDataFrame(schema, "name string, vector array<double>")
    want = sorted((i, k + 1, name) for i, v in queries for k, (_, name) in enumerate(sorted((-float(np.dot(v, w)), name) for name, w in schema)[:5]))
    for block in (1024, 8):
        monkeypatch.setattr(m, "SCHEMA_BLOCK", block)
        assert sorted((x.id, x.place, x.name) for x in m.top_k(q, t, 5).collect()) == want


@pytest.mark.parametrize("buckets", [None, 3])
def test_batches_merge_into_versions(spark, tmp_path, buckets):
    from triplewright.streaming.upserts import merge_batches, newest

    path = str(tmp_path / "table")
    assert newest(spark, path) is None
    run = merge_batches(path, ["id"], ["at"], buckets)
    frame = lambda rows: spark.createDataFrame(rows, "id long, at long, name string")
    run(frame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")]), 0)
    run(frame([(1, 3, None), (4, 1, "e")]), 1)
    run(frame([(1, 3, None), (4, 1, "e")]), 1)  # the batch runs again
    for epoch in range(2, 6):
        run(frame([(5, epoch, str(epoch))]), epoch)
    assert {tuple(x) for x in newest(spark, path).collect()} == {(1, 3, "b"), (2, 1, "c"), (3, 1, "d"), (4, 1, "e"), (5, 5, "5")}
    versions = [x for x in (tmp_path / "table").rglob("v*") if x.is_dir()]
    assert len(versions) <= 2 * (buckets or 1)
    (tmp_path / ("table/v9" if buckets is None else "table/bucket=0/v9")).mkdir(parents=True)  # a version that isn't complete
    assert newest(spark, path).count() == 5
