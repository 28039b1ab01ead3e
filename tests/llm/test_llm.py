"""The corpus operators: edge cases (nulls, empty and long texts, ties, repeated rows, empty tables, clashing
columns), brute force on small fixtures, exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from triplewright.llm import bpe_sql, chat_format, exact_dedup, jaccard_join, language_id, lm_score, packing, pii, toxicity, webp_lossless
from triplewright.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
LONG = "word " * 30_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", None),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", None),
    (3, None, None, "s"),
    (4, "", "de", "s"),
    (5, LONG, "en", "s"),
    (6, "  \n\t ", None, "s"),
    (None, "no id here at all, mail a.b@c.de or 10.0.0.1", "en", "s"),
    (8, "Übergrößen naïve 日本語 🙂 <|endoftext|> x²", "de", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = {c: F.lit("clash") for c in ("keep_id", "kept", "digest", "node", "salt", "score", "piece", "spans", "_tw_x")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    import sys

    sys.path.insert(0, __file__.rsplit("/llm/", 1)[0])
    from oracle import same

    same(spark, QUERIES[name], ORACLES[name], SMALL)


# --- 1 ---


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "\\[/OUT]</s>\\\\"), (1, None, "system", None), (2, 0, "tool]x", "[ROLE] <s>"), (2, 1, None, ""), (3, 5, "assistant", LONG), (4, 0, "user", "hi"), (4, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("system", ""), ("user", "a [INST] b"), ("assistant", "\\[/OUT]</s>\\\\")]
    assert back[1].valid and back[1].loss_text == "\\[/OUT]</s>\\\\"
    assert [tuple(t) for t in back[2].turns] == [("tool]x", "[ROLE] <s>"), ("", "")] and not back[2].valid and back[2].first_bad_turn == 0
    assert back[3].loss_text == LONG and back[3].first_bad_turn == 0
    assert len(back[4].turns) == 2 and back[4].first_bad_turn == 1
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_chat_template_is_checked():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(begin="[[x").controls()


# --- 7 ---


def test_exact_groups(docs, none):
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert len(got) == len(ROWS)
    sha = hashlib.sha256(ROWS[0][1].encode()).hexdigest()
    assert sorted(x for x in got if x[4] == sha) == [(1, 2, 3, False, sha), (2, 2, 3, True, sha), (2, 2, 3, True, sha)]
    assert {x[:4] for x in got if x[4] == hashlib.sha256(b"").hexdigest()} == {(3, 4, 2, False), (4, 4, 2, True)}
    assert [x[:4] for x in got if x[0] is None] == [(None, None, 1, True)]
    assert exact_dedup.exact_groups(none).count() == 0


def test_drop_copies(docs, none):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "8", "None"]
    assert exact_dedup.drop_copies(none).count() == 0


# --- 2 ---


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return sorted((doc, len(sets[i]), min(least[root(i)])) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_groups_by_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "LEAF_SETS", 8)  # so that regions are split over the cluster
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    base, passage, rows = word(120), word(60), []
    for i in range(60):  # a group of near copies, each with its own edits
        copy = list(base)
        for at in rng.integers(0, len(copy), rng.integers(0, 5)):
            copy[at] = f"e{i}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200 + i, " ".join(word(40) + passage + word(40))) for i in range(20)]  # a shared passage links nothing
    rows += [(300, " ".join(base).upper()), (301, "a b"), (302, "A\tB"), (303, None), (304, ""), (305, "x"), (306, LONG)]
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, percent)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, width, percent)


def test_near_copies_edge_cases(docs, none):
    got = jaccard_join.near_groups(docs, 5, 80)
    assert got.count() == len(ROWS)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "8", "None"]
    assert jaccard_join.near_groups(none, 3, 90).count() == 0


def test_near_copies_of_ids_with_several_texts(spark):
    text = lambda name, edit="": " ".join(f"{name}{i}" for i in range(100)) + f" {edit}"
    rows = [(1, text("a")), (5, text("a", "x")), (5, text("b")), (7, text("b", "y")), (3, text("c")), (3, text("c", "z")), (9, text("d")), (None, text("a"))]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    groups = {(r.doc_id, r.text[0]) for r in kept}
    assert groups == {(1, "a"), (5, "b"), (3, "c"), (9, "d"), (None, "a")} and len(kept) == 5


def test_null_ids_bridge_groups(spark):
    words = [f"w{i}" for i in range(60)]
    middle = " ".join(words)
    ends = [" ".join(words[4:]), " ".join(words[:-4])]  # each within 0.9 of the middle, not of each other
    rows = [(1, ends[0]), (2, ends[1]), (None, middle), (None, "quite another text of no id")]
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90)
    assert {r.doc_id: r.component_id for r in got.collect() if r.doc_id} == {1: 1, 2: 1}


@pytest.mark.parametrize("percent", [80, 90])
def test_parts_lose_no_pair(percent):
    rng, parts, pairs = np.random.default_rng(percent), jaccard_join.Parts(percent), 0
    for _ in range(1500):
        n = int(np.exp(rng.uniform(1.1, 7)))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        gone, new = rng.integers(0, n // 8 + 2, 2)
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, new).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        both = len(np.intersect1d(x, y))
        if len(y) and both < max(len(x), len(y)) and 100 * both >= percent * (len(x) + len(y) - both):
            keys, owner = parts.keys([x, y])
            assert len(np.intersect1d(keys[owner == 0], keys[owner == 1]))
            pairs += 1
    assert pairs > 200


def test_region_join_is_exact():
    rng = np.random.default_rng(1)
    centre = np.unique(rng.integers(0, 2**40, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(centre)[rng.integers(0, 30) :], rng.integers(0, 2**40, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(150)]
    up = list(range(150))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(150):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert jaccard_join.join_region(sets, 90).tolist() == [find(i) for i in range(150)]


# --- 3 ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn("".join(digits)), "phone": 10 <= len(digits) <= 15}[kind]
            out += [(m.start(), m.end(), k)] if ok else []
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_by_brute_force():
    rng = np.random.default_rng(2)
    bits = ["a", "b", "@", ".", "1", "29", "255", "+", " ", "-", "(", ")", "é", "4111111111111111", "x@y.z", "1.2.3.4", "+12345678901"]
    for _ in range(5000):
        text = "".join(rng.choice(bits, rng.integers(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_field_adds_and_masks(spark, docs, none):
    texts = [f"mail user{i}@host{i % 7}.example.com, call +1 (555) 123-{4000 + i} or go to 10.0.{i}.1 in {i} days" for i in range(200)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    field = pii.fit(train)
    text = "see mary.jones@corp.example.org today; mary.jones@corp is the same as mary.jones@corp here"
    base = pii.base_spans(text)
    every = field.spans(text, base)
    assert set(base) <= set(every)
    found = by_id(pii.find(docs, field))
    assert found[None].n_email == 1 and found[None].n_ip == 1 and "<EMAIL>" in found[None].masked
    assert found[3].spans == "" and found[3].masked is None and found[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(docs.withColumn("n_chars", F.lit(0)), field)
    assert clean.columns == [*docs.columns, "n_chars"] and clean.count() == len(ROWS)
    assert pii.find(none, pii.fit(none)).count() == 0


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(3)
    field = pii.train([("token", "0", 0, 0, 5), ("token", "1", 1, 0, 5), ("chain", "", 1, 1, 9), ("chain", "", 0, 0, 9)])
    tokens = pii.Tokens([0, 1, 2], [1, 2, 3], ["0", "1", "1"], [(0, 1), (1, 2)], [])
    unary, psi, total = field.unary(tokens.shape), field.pair["chain"], np.zeros((3, len(pii.LABELS)))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                p = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + psi[a, b] + psi[b, c])
                total[[0, 1, 2], [a, b, c]] += p
    assert field.marginals(tokens) == pytest.approx(total / total.sum(1, keepdims=True)) and rng is not None


def test_messages_reach_far_occurrences():
    field = pii.train([("token", "0", 0, 0, 5), ("token", "1", 1, 0, 5), ("token", "2", 0, 0, 5), ("token", "2", 1, 0, 5), ("skip", "", 1, 1, 9), ("skip", "", 0, 0, 9)])
    n = 40
    for first in "01":
        tokens = pii.Tokens(list(range(n)), list(range(1, n + 1)), [first] + ["2"] * (n - 1), [], [(i, i + 1) for i in range(n - 1)])
        unary, psi = np.exp(field.unary(tokens.shape)), np.exp(field.pair["skip"])
        left, right = [np.ones(len(pii.LABELS))], [np.ones(len(pii.LABELS))]
        for i in range(n - 1):
            left.append((left[-1] * unary[i]) @ psi)
            right.append(psi @ (right[-1] * unary[n - 1 - i]))
        left, right = ([x / x.sum() for x in side] for side in (left, right))
        want = np.array([left[i] * unary[i] * right[n - 1 - i] for i in range(n)])
        assert field.marginals(tokens) == pytest.approx(want / want.sum(1, keepdims=True), rel=1e-5)


# --- 4 ---


def test_language_accuracy_and_edges(spark, docs, none):
    found = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    filters = language_id.fit(truth.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id"))
    got = by_id(language_id.predict(docs, filters))
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[3].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and len(language_id.predict(docs, filters).collect()) == len(ROWS)
    kept = language_id.keep_identified(docs, filters)
    assert kept.columns == docs.columns and not {3, 4, 6} & {r.doc_id for r in kept.collect()}
    assert by_id(language_id.predict(docs, language_id.fit(none)))[1].lang_pred == "und"
    assert language_id.predict(none, filters).count() == 0


def test_bloom_filters_hold_their_grams():
    rng = np.random.default_rng(4)
    grams = {x: rng.integers(0, 2**63, 500).astype(np.uint64) for x in ("a", "b", *(f"l{i}" for i in range(70)))}
    f = language_id.LanguageFilters.build(grams)
    assert all(f.hits(g)[:, f.langs.index(x)].all() for x, g in grams.items())
    assert f.hits(grams["a"])[:, f.langs.index("b")].mean() < 0.05


# --- 5 ---


def test_pieces_and_packing(spark, docs, none):
    found = packing.pieces(docs, JSON)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in ROWS}
    placed = packing.pack(found).collect()
    assert len(placed) == found.count()
    for r in placed:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.length == 1024 or r.piece == 0
    rows = defaultdict(list)
    for r in placed:
        rows[r.sequence_id].append((r.offset, r.length))
    for x in rows.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(none, JSON)).count() == 0


def test_reduction_keeps_the_optimum():
    """Against the least number of sequences by exhaustive search on small instances."""
    from functools import cache

    rng = np.random.default_rng(6)
    for _ in range(60):
        cap = 12
        sizes = tuple(sorted(rng.integers(1, cap + 1, 9).tolist(), reverse=True))

        @cache
        def least(left, room):
            if not left:
                return 0
            best = 99
            for s in dict.fromkeys(left):
                rest = list(left)
                rest.remove(s)
                best = min(best, least(tuple(rest), room - s) if s <= room else 1 + least(tuple(rest), cap - s))
            return best

        counts = np.bincount(sizes, minlength=cap + 1)
        fixed = packing.reduce_instance(counts)
        remaining = tuple(s for s in range(cap, 0, -1) for _ in range(counts[s]))
        assert sum(n for _, n in fixed) + least(remaining, 0) == least(sizes, 0)


# --- 6 ---


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(7)
    syllables = ["tha", "ren", "ing", "sto", "mel", "kor", "ati", "une"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words[::12] = rng.choice(["vilescum", "grubwart", "snotface"], 5)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.where("doc_id < 400").drop("text"))
    got = by_id(toxicity.score(table, model))
    held = [i for i in range(400, 600)]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.9
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 for r in edge)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(table, none.select("doc_id", F.lit(1).alias("toxic")))).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_toxicity_dictionaries_read_every_window(monkeypatch):
    word = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    rows = [(i, " ".join(word(1000 * i + k) for k in range(1000)), 0) for i in range(1, 401)]
    rows += [(1000 + i, f"vilescum grubwart own{word(i)}", 1) for i in range(40)]
    sample = pd.DataFrame(rows, columns=["doc_id", "text", "toxic"])
    fed = []
    raw = lambda windows: toxicity.zstandard.ZstdCompressionDict(b"".join(windows)[-8192:], dict_type=toxicity.zstandard.DICT_TYPE_RAWCONTENT)
    monkeypatch.setattr(toxicity, "train_dictionary", lambda windows: fed.append(len(windows)) or raw(windows))
    toxicity.train(sample, 0.1)
    shaping = sum(zlib.crc32(f"dictionary {i}".encode()) / 2**32 < toxicity.DICTIONARY_SHARE for i in range(1, 401))
    assert max(fed) == shaping * 1000 // toxicity.TRAIN_WINDOW > 20_000


# --- 8 ---


def test_bpe_equals_the_library(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["", "aaaaaaaaaaaaa", " " * 700, "ab" * 3000, "é" * 501, "\x00\x01", "  x\n\n y", "0123456789" * 40, "日本語テキスト", *(r[1] or "" for r in ROWS)]
    bpe = bpe_sql.SqlBpe(RANKS, P.PATTERN, max_words=5)
    ids = bpe.encode(odd)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(x) for x in odd]
    assert bpe.decode(ids) == [x.encode() for x in odd]
    got = bpe_sql.digests(bpe_sql.encode_decode(docs, RANKS, P.PATTERN))
    assert got.count() == len(ROWS) and by_id(got)[3].n_tokens == 0 and by_id(got)[8].decoded_sha256 == hashlib.sha256(ROWS[8][1].encode()).hexdigest()
    assert bpe_sql.encode_decode(none, RANKS, P.PATTERN).count() == 0


# --- 9 ---


class Bits:
    """Writes a VP8L stream for the decoder tests."""

    def __init__(self):
        self.bits = []

    def put(self, n, value):
        self.bits += [value >> k & 1 for k in range(n)]
        return self

    def single(self, symbol):
        """A code of one symbol."""
        return self.put(3, 0b101).put(8, symbol)

    def lengths(self, lengths):
        """A normal code from lengths, each written with a code of sixteen four-bit symbols."""
        self.put(1, 0).put(4, 15)
        for s in webp_lossless.CODE_LENGTH_ORDER:
            self.put(3, 4 if s < 16 else 0)
        self.put(1, 0)
        for n in lengths:
            self.code(n, 4)
        return webp_lossless.PrefixCode(lengths)

    def code(self, code, n):
        for k in reversed(range(n)):
            self.put(1, code >> k & 1)
        return self

    def symbol(self, code, s):
        if code.only is None:
            (n, c), = [k for k, v in code.table.items() if v == s]
            self.code(c, n)
        return self

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def green_code(used, size=280):
    """Lengths of a code over the used symbols: 1, 2, 3, ... and the last twice."""
    out = [0] * size
    for i, s in enumerate(used):
        out[s] = min(i + 1, len(used) - 1)
    return out


def start(b, width, height):
    return b.put(8, 0x2F).put(14, width - 1).put(14, height - 1).put(1, 0).put(3, 0)


def rest_of_codes(b, red=0, blue=0, alpha=255, distance=0):
    return b.single(red).single(blue).single(alpha).single(distance)


def test_webp_back_references_and_cache():
    b = start(Bits(), 4, 3)
    b.put(1, 0)  # no transform
    b.put(1, 1).put(4, 2).put(1, 0)  # a colour cache of 4 entries, no meta codes
    cached = 280 + (webp_lossless.CACHE_MULTIPLIER * 0xFF000700 & 0xFFFFFFFF) % (1 << 32) // (1 << 30)
    g = b.lengths(green_code([7, 9, 256 + 4, cached], 284))
    rest_of_codes(b, distance=1)  # distance symbol 1: code 2, the pixel to the left
    b.symbol(g, 7).symbol(g, 9).symbol(g, 256 + 4).put(1, 0)  # a run of 5
    b.symbol(g, cached).symbol(g, 9).symbol(g, 7).symbol(g, 7).symbol(g, 9)
    image = webp_lossless.decode_vp8l(b.data())
    assert (image >> 8 & 255).tolist() == [[7, 9, 9, 9], [9, 9, 9, 7], [9, 7, 7, 9]]
    assert (image >> 24 == 255).all()


def test_webp_transforms():
    b = start(Bits(), 4, 2)
    b.put(1, 1).put(2, 0).put(3, 0)  # predictor, blocks of 4
    b.put(1, 0).single(1)  # every block: mode 1, left
    rest_of_codes(b, alpha=0)
    b.put(1, 1).put(2, 1).put(3, 0).put(1, 0)  # cross-colour: green to red is 32 (times green / 32)
    b.single(0)
    rest_of_codes(b, blue=32)
    b.put(1, 1).put(2, 2)  # subtract green
    b.put(1, 0).put(1, 0).put(1, 0)
    g = b.lengths(green_code([1, 2, 3]))
    rest_of_codes(b, alpha=0)
    for s in (1, 2, 3, 1, 2, 1, 1, 1):
        b.symbol(g, s)
    image = webp_lossless.decode_vp8l(b.data())
    green = np.array([[1, 3, 6, 7], [3, 4, 5, 6]])  # sums from the left; the second row starts from above
    assert (image >> 8 & 255).tolist() == green.tolist()
    assert (image & 255).tolist() == green.tolist()  # blue: subtract green alone
    assert (image >> 16 & 255).tolist() == (2 * green).tolist()  # red: cross-colour and subtract green
    assert (image >> 24 == 255).all()


def test_webp_palette_and_meta_codes():
    b = start(Bits(), 5, 2)
    b.put(1, 1).put(2, 3).put(8, 1)  # a palette of two colours, 8 pixels to a byte
    b.put(1, 0)
    g = b.lengths(green_code([10, 20]))
    rest_of_codes(b, red=1, blue=2)
    b.symbol(g, 10).symbol(g, 20)  # colours 10 and 10 + 20
    b.put(1, 0).put(1, 0).put(1, 0)
    g = b.lengths(green_code([0b10110, 0b00001]))
    rest_of_codes(b)
    b.symbol(g, 0b10110).symbol(g, 0b00001)
    image = webp_lossless.decode_vp8l(b.data())
    assert (image >> 8 & 255).tolist() == [[10, 30, 30, 10, 30], [30, 10, 10, 10, 10]]

    b = start(Bits(), 8, 1)
    b.put(1, 0).put(1, 0).put(1, 1).put(3, 0)  # meta codes for blocks of 4
    b.put(1, 0)
    g = b.lengths(green_code([0, 1]))
    rest_of_codes(b)
    b.symbol(g, 0).symbol(g, 1)
    for s in (5, 6):
        b.single(s)
        rest_of_codes(b)
    assert (webp_lossless.decode_vp8l(b.data()) >> 8 & 255).tolist() == [[5, 5, 5, 5, 6, 6, 6, 6]]


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    """Each predictor against a plain loop over the definition."""
    rng = np.random.default_rng(mode)
    w, h = 7, 6
    given = rng.integers(0, 256, (h, w, 4))
    want = np.zeros((h, w, 4), int)
    mean = lambda a, b: (a + b) // 2
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = np.array([255, 0, 0, 0]) if x == 0 else want[0, x - 1]
            elif x == 0:
                p = want[y - 1, 0]
            else:
                left, top, tl = want[y, x - 1], want[y - 1, x], want[y - 1, x - 1]
                tr = want[y - 1, x + 1] if x + 1 < w else want[y, 0]
                p = [
                    lambda: np.array([255, 0, 0, 0]), lambda: left, lambda: top, lambda: tr, lambda: tl, lambda: mean(mean(left, tr), top), lambda: mean(left, tl), lambda: mean(left, top),
                    lambda: mean(tl, top), lambda: mean(top, tr), lambda: mean(mean(left, tl), mean(top, tr)), lambda: left if abs(top - tl).sum() < abs(left - tl).sum() else top,
                    lambda: np.clip(left + top - tl, 0, 255), lambda: np.clip(mean(left, top) + ((mean(left, top) - tl) / 2).astype(int), 0, 255),
                ][mode]()
            want[y, x] = (given[y, x] + p) % 256
    got = webp_lossless.invert_predictor(webp_lossless._argb(given.reshape(-1, 4)), w, h, 2, np.full(4, mode << 8, np.uint32))
    assert webp_lossless._channels(got).reshape(h, w, 4).tolist() == want.tolist()


def test_media_round_trip(docs, none):
    for x in (b"", b"a", b"ab" * 40, bytes(range(256)) * 3, b"abc" * 1000, b"x" * (1 << 20) + b"y"):
        p = webp_lossless.padded(x)
        assert len(p) % 64 == 0 and webp_lossless.from_media(webp_lossless.to_media(p)).tobytes() == p
    got = webp_lossless.digests(webp_lossless.store_and_read(docs)).collect()
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        p = webp_lossless.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(got) == len(ROWS) and webp_lossless.store_and_read(none).count() == 0


# --- 10 ---


def test_lm_base_by_brute_force_and_model(spark, docs, none):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    in_training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    got = lm_score.score(docs, in_training, JSON, 50_257, 50_256).collect()
    words = {r[0]: (r[1] or "").encode().lower().split() for r in ROWS}
    c = Counter(w for r in ROWS if not held(r[0]) for w in words[r[0]])
    ends = sum(not held(r[0]) for r in ROWS)
    total, distinct = sum(c.values()) + ends, len(c) + 1
    log = lambda n: math.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
    assert len(got) == len(ROWS)
    for r in got:
        w = words[r.doc_id]
        assert r.base_score == pytest.approx(sum(log(c[x]) for x in w) + log(ends))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, total)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm_score.score(none, in_training, JSON, 50_257, 50_256).count() == 0


def test_attention_is_causal_normalised_and_trains():
    rng = np.random.default_rng(8)
    vocabulary = 300
    classes, within = lm_score.classes_of(rng.integers(0, 50, vocabulary), rng.integers(0, 3, vocabulary))
    model = lm_score.Attention.start(vocabulary)
    scorer = lm_score.Scorer(model, classes, within)
    ids = rng.integers(0, vocabulary, 40)
    inputs, targets = lm_score.windows_of(ids, vocabulary, 0)
    assert targets[targets >= 0].tolist() == ids.tolist()
    logs = scorer.log10(inputs, targets).reshape(-1)[:40]
    later = ids.copy()
    later[30:] = (later[30:] + 1) % vocabulary
    assert scorer.log10(*lm_score.windows_of(later, vocabulary, 0)).reshape(-1)[:30] == pytest.approx(logs[:30], abs=1e-5)
    total = sum(10 ** scorer.log10(inputs[:1], np.full((1, inputs.shape[1] // 2), i))[0, 3] for i in range(vocabulary))
    assert total == pytest.approx(1, abs=1e-4)
    t = lm_score.Trainer(model, classes)
    text = np.tile(np.arange(8), 80)
    losses = [t.step(*lm_score.windows_of(text, vocabulary, 0)) for _ in range(60)]
    assert losses[-1] < 0.5 * losses[0]


def test_training_reads_every_id_of_long_texts(spark):
    encoder = lm_score._encoder(JSON)
    texts = [" ".join(f"{a}{b}{k}" for a in "qxzvk" for b in "aeiou" for k in range(30)), "one two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = np.concatenate([lm_score.subwords(encoder, lm_score.words_of(t)) for t in texts])
    classes, _ = lm_score.classes_of(np.bincount(ids, minlength=50_257), np.zeros(50_257, np.int64))
    model = lm_score.train(docs, JSON, classes, 50_257, 50_256)
    moved = (model.matrix != lm_score.Attention.start(50_257).matrix).any(1)
    assert moved[ids].all() and moved[50_256] and moved[:50_257].sum() == len(set(ids.tolist())) + 1


def test_attention_gradient():
    rng = np.random.default_rng(9)
    classes = rng.integers(0, lm_score.CLASSES, 20)
    model = lm_score.Attention.start(20)
    model.matrix = model.matrix.astype(np.float64)
    inputs, targets = lm_score.windows_of(rng.integers(0, 20, 30), 20, 0)

    def loss(matrix):
        t = lm_score.Trainer(lm_score.Attention(matrix.copy(), 20), classes)
        return t.step(inputs, targets)

    t = lm_score.Trainer(lm_score.Attention(model.matrix.copy(), 20), classes)
    t.squares[:] = 1e12  # so that a step is the gradient times a known factor
    t.step(inputs, targets)
    grad = (model.matrix - t.m.matrix) * 1e6 / lm_score.RATE
    for row, col in [(3, 2), (10, 0), (21 + 2, 5), (21 + 20, 1), (21 + 40, 7), (21 + 60, 3), (21 + 120, 3), (len(grad) - 1, 4)]:
        a, b = model.matrix.copy(), model.matrix.copy()
        a[row, col] += 1e-4
        b[row, col] -= 1e-4
        assert grad[row, col] == pytest.approx((loss(a) - loss(b)) / 2e-4, rel=2e-2, abs=1e-5)


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    rows = [(i, f"{'the and thing ' * 3} number {i} " + " ".join(f"anthe{(i * 7 + k) % 50}ing" for k in range(40)), "en", "s", 0) for i in range(20)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " extra", "en", "s", 0), (102, None, None, None, None), (103, "12345 !!", "en", "s", 0), (104, rows[2][1] + " mail a.b@c.de", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found, docs = {}, df
    for name, stage in c.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        found[name] = docs
    assert [n for n, _ in c.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "pii", "packing"]
    ids = {n: {r.doc_id for r in d.collect()} for n, d in found.items()}
    assert ids["language_id"] == {r[0] for r in rows} - {102, 103}
    assert ids["exact_dedup"] == ids["language_id"] - {0}
    assert ids["jaccard_join"] == ids["exact_dedup"] - {101, 104}
    assert all(found[n].columns == df.columns for n in ("language_id", "exact_dedup", "jaccard_join", "pii"))
    assert ids["packing"] == ids["pii"] == ids["jaccard_join"]
    assert c.run(spark, str(tmp_path)).count() == found["packing"].count()
