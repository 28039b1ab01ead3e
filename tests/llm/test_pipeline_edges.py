"""The pipeline on odd tables: empty ones, very long texts, repeated ids, clashing columns."""

import corpus_pipeline as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"the ing tion {w} and of to in that" for w in ("the", "and", "ing", "ent", "tha", "for"))


def through(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES:
        docs = c.materialize(stage(spark, docs, str(folder)), "edge")
        kept[name] = docs
    return kept


def test_empty_table(spark, tmp_path):
    kept = through(spark, [], tmp_path)
    assert all(d.count() == 0 for d in kept.values())
    assert kept["packing"].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{w}ing the and {i % 7}" for i, w in enumerate(BASE.split()))
    long = " ".join(f"theand{i}ing" for i in range(60_000))
    rows = [(i, text(f"and{i}th"), "en", "s", 0, "x", 1) for i in range(12)]
    rows += [
        (5, text("othering"), "en", "s", 0, "y", 2),  # an id with another text
        (5, text("othering"), "en", "s", 0, "y", 2),  # and a repeated row
        (20, text("and1th"), None, None, None, None, None),  # a copy under a larger id
        (21, text("and2th") + " mail a.b@c.de", "en", "s", 0, "z", 3),  # a near copy
        (None, text("andnoid"), "en", "s", 0, "z", 4),
        (30, long, "en", "s", 0, "long", 5),
        (31, None, "en", "s", 0, "null", 6),
        (32, "", "en", "s", 0, "empty", 7),
        (33, "the" * 100_000, "en", "s", 0, "word", 8),
    ]
    kept = through(spark, rows, tmp_path, SCHEMA + ", kept string, node long")
    ids = {n: sorted((str(r.doc_id), r.kept) for r in d.collect()) for n, d in kept.items() if n != "packing"}
    assert all(kept[n].columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "node"] for n in ids)
    assert {"31", "32"} & {i for i, _ in ids["language_id"]} == set()
    exact = ids["exact_dedup"]
    assert exact.count(("5", "y")) == 1 and ("5", "x") in exact and ("1", "x") not in exact and ("20", None) in exact
    near = ids["jaccard_join"]
    assert ("2", "x") in near and ("21", "z") not in near and ("None", "z") in near and ("5", "x") in near and ("5", "y") in near and ("30", "long") in near
    assert ids["pii"] == near
    pieces = kept["packing"].where("doc_id = 30")
    assert pieces.count() > 100 and kept["packing"].select("doc_id").distinct().count() == len({i for i, _ in near})
