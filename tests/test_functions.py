"""Hand examples for functions and operators, and plain loops for those that DuckDB can't state."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright.functions import entities as e
from triplewright.functions import parsing as p
from triplewright.functions import text as t
from triplewright.functions import values as v
from triplewright.operators import evaluation as ev
from triplewright.operators import graph_build as b
from triplewright.operators import matching as m
from triplewright.operators import validation as val


def column(spark, xs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f("x")).collect()]


def test_values(spark):
    raw = ["< 70 mg/dL", ">= 8.0", "decrease by 15.0%", "15.0 ml", "10 units", "increase by 20%", "", "short text", "x" * 30, None]
    assert column(spark, raw, v.clean_value) == ["<70", ">=8", "-15%", "15ml", "10u", "+20%", None, "short text", None, None]


def test_dedup_keys_meet(spark):
    a, b_, c, d = column(spark, ["T2DM", "Type 2 Diabetes Mellitus", "rapid- or short-acting insulin", ""], e.dedup_key)
    assert a == b_ and c == "acting insulin rapid" and d == ""


def test_ratings(spark):
    texts = ["Reasons.\nStatus: [CORRECT] Confidence: [150]", "nothing here", "INCORRECT [70]", "Confidence: 40\nuncertain", "", "TRẠNG THÁI: ĐÚNG - ĐỘ TIN CẬY: 90"]
    got = column(spark, texts, p.rating)
    assert [(r["verdict"], r["confidence"]) for r in got] == [("CORRECT", 100), ("UNCERTAIN", 50), ("INCORRECT", 70), ("UNCERTAIN", 40), ("UNCERTAIN", 50), ("CORRECT", 90)]


def test_verdict_words(spark):
    assert column(spark, ["Incorrect", "true", "SAI", "wrong", "?", "correct"], p.verdict_of) == ["INCORRECT", "CORRECT", "INCORRECT", "INCORRECT", "UNCERTAIN", "CORRECT"]


def plain_sentences(text):
    done, now = [], ""
    for piece in text.replace("? ", "?\0").replace("! ", "!\0").replace(". ", ".\0").split("\0"):
        now += piece
        word = "".join(c for c in (now.split() or [""])[-1].lower() if c.isalnum() or c in "_-")
        if not piece or piece[-1] not in ".?!" or word in t.ABBREVIATIONS:
            now += " "
        else:
            done.append(now.strip())
            now = ""
    return [s for s in [*done, now.strip()] if s]


def test_sentences(spark):
    texts = ["See Dr. Who. He is in! Is he? yes", "one", "", "a vs. b. c", "ends. "]
    assert column(spark, texts, t.sentences) == [plain_sentences(x) for x in texts]


def test_list_sentences(spark):
    text = "Insulin is given as:\n- one daily shot\n- two of them.\nHeading\nThis is a plain sentence that stands for itself."
    assert column(spark, [text], t.list_sentences)[0] == ["Insulin is given as one daily shot", "Insulin is given as two of them.", "This is a plain sentence that stands for itself."]


def test_bracket_triples():
    assert p.bracket_triples("x [['a', 'is', 'b'], [c, has, d]] y ['_', 'r', 'o'] [[") == [["a", "is", "b"], ["c", "has", "d"]]
    assert p.bracket_triples("['a', ['b', 'c'], 'd']") == [["a", "b, c", "d"]]
    assert p.bracket_triples(None) == [] and p.literal_triples("[['s','r','o']") == [] and p.literal_triples("[['s','r','o']]") == [["s", "r", "o"]]


def test_simplified_names():
    cases = {"water channel (AQP2)": "AQP2", "serum glucose levels": "glucose", "type 2 diabetes mellitus": "T2DM", "lithium-treated rats in cages": "rats", "": "", "insulin": "insulin"}
    assert {k: e.simplified_name(k) for k in cases} == cases


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (4, 4), (5, 3), (3, 6)])
def test_assignment_is_best(shape):
    rng = np.random.default_rng(sum(shape))
    score = rng.integers(0, 4, shape) / 3
    pairs = ev.assign(score)
    n, k = sorted(shape)
    best = max(sum((score[i, j] if shape[0] <= shape[1] else score[j, i]) for i, j in zip(range(n), c, strict=True)) for c in itertools.permutations(range(k), n))
    assert len(pairs) == n and len({i for i, _ in pairs}) == n and len({j for _, j in pairs}) == n
    assert sum(score[i, j] for i, j in pairs) == pytest.approx(best)


def test_span_scores():
    assert ev.align_spans("a b c d".split(), "c d a b".split()) == [(0, 2, 2), (2, 0, 2)]
    same = ev.span_scores({"s": "a b", "r": "is", "o": "c"}, {"s": "a b", "r": "is", "o": "c"})
    assert same == {"exact": 1.0, "partial": 1.0, "type": 1.0, "strict": 1.0}
    turned = ev.span_scores({"s": "c", "r": "is", "o": "a b"}, {"s": "a b", "r": "is", "o": "c"})
    assert turned["exact"] == 1.0 and turned["strict"] == pytest.approx(1 / 3)


def test_alias_targets(spark):
    merged = spark.createDataFrame([("Diabetes Mellitus", ["type 1 diabetes"], "C1", 1), ("Type 1 Diabetes", [], "NONE", 2), ("Asthma", [], "NONE", 3)], "canon string, aliases array<string>, code string, seen int")
    assert [tuple(r) for r in b.alias_targets(merged).collect()] == [("Type 1 Diabetes", "Diabetes Mellitus")]


def test_first_nodes_and_types(spark):
    entries = spark.createDataFrame([(1, 0, "Insulin", "drug", None, "T2DM", "x", "disease"), (1, 1, "insulin", "Drug", None, "b", "", None)], "doc_id int, ord int, subject string, subject_type string, subject_type_canon string, object string, object_type string, object_type_canon string")
    types = b.type_map(entries)
    assert {(r.key, r.type) for r in types.collect()} == {("insulin", "Drug"), ("t2dm", "Disease")}
    triples = spark.createDataFrame([(1, 0, "T2DM", "treated by", "Insulin"), (2, 0, "Insulin", "is a", "Hormone"), (2, 1, "T2DM", "has clinical threshold", "< 7")], "doc_id int, ord int, s string, r string, o string")
    nodes = b.first_nodes(b.split_values(triples), types)
    assert {(r.id, tuple(r.labels)) for r in nodes.collect()} == {("T2DM", ("Concept", "Disease")), ("Insulin", ("Concept", "Drug")), ("Hormone", ("Concept",))}


def test_validation_reasons(spark):
    rows = [("insulin", "treats", "T2DM", "insulin treats T2DM"), ("higher", "r", "x", ""), ("a b c d e f", "r", "x", ""), ("Same", "r", "same", ""), ("blood glucose", "r", "glucose", ""), ("gold", "r", "T2DM", "only T2DM"), ("monitor sugar", "r", "x", ""), (None, "r", "x", "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "s string, r string, o string, text string, i int").withColumn("cs", F.col("s")).withColumn("co", F.col("o"))
    got = [r.reason for r in val.validate(df).orderBy("i").collect()]
    assert got == [None, "non-entity subject", "verbose subject", "tautology", "object in subject", "subject not in text", "verbose subject", "malformed"]


def test_flip_by_names(spark):
    rules = val.learned_rules(spark.createDataFrame([("flu", "treated by", "aspirin", "Disease", "Drug")], "s string, r string, o string, st string, ot string"))
    x = spark.createDataFrame([("aspirin tablets", "treated by", "flu"), ("flu", "treated by", "aspirin"), ("a", "other", "b")], "s string, r string, o string")
    assert {(r.s, r.o, r.turned) for r in val.flip_by_names(x, rules).collect()} == {("flu", "aspirin tablets", True), ("flu", "aspirin", False), ("a", "b", False)}


def test_relabel(spark):
    x = spark.createDataFrame([("A", "r", "B", "A causes B. A treats C"), ("A", "r", "C", "A does not fail to not treat C")], "s string, r string, o string, text string")
    assert [r.r for r in val.relabel(x, {"cause_of": "cause", "treated_by": "treat"}).collect()] == ["cause_of", "r"]


def test_resolution(spark):
    nodes = spark.createDataFrame([("N1", "type 2 diabetes", ["T2DM"]), ("N2", "asthma", [])], "id string, name string, aliases array<string>")
    terms = spark.createDataFrame([("t2dm",), ("diabetes type 2 in adults",), ("gold",)], "term string")
    got = {r.term: (r.id, round(r.score, 4)) for r in m.resolve(terms, nodes).collect()}
    assert got == {"t2dm": ("N1", 1.1), "diabetes type 2 in adults": ("N1", 0.6)}
    assert {r.term for r in m.missing(terms, m.resolve(terms, nodes)).collect()} == {"gold"}


def test_vocabulary(spark):
    vocab = spark.createDataFrame([("V1", "blood glucose", "T059", 1), ("V2", "glucose blood test kit deluxe set", "T061", 2), ("V3", "glucose", "T999", 3), ("V4", "glucose", "T059", 4)], "code string, name string, type string, pos int")
    terms = spark.createDataFrame([("glucose",), ("glucose blood",), ("blood",), ("zinc",)], "term string")
    hits = m.vocabulary_hits(terms, vocab)
    assert {(r.term, r.code, r.strategy) for r in hits.collect()} == {("glucose", "V3", 0), ("glucose", "V4", 0), ("glucose blood", "V1", 1), ("blood", "V1", 2), ("blood", "V2", 2)}
    got = {r.term: r.code for r in m.enriched(terms, m.accept(m.rerank(hits), ("T059", "T061"))).collect()}
    assert got == {"glucose": "V4", "glucose blood": "V1", "blood": "V1", "zinc": "NONE"}


def test_options(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id int, place int, name string")
    assert [(r.letter, r.name, r.swap) for r in m.options(c).orderBy("letter").collect()] == [("A", "a", False), ("B", "a", True), ("C", "b", False), ("D", "b", True)]
