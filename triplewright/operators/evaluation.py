"""Scores of predicted triples (doc_id, s, r, o) against gold ones, and benchmark generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.functions.entities import concept_name, written_out
from triplewright.functions.parsing import read_triples

TRIPLE = ["doc_id", "s", "r", "o"]


def matched(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of either side with ``tp``, ``fp``, ``fn`` as 0 or 1: one full outer join of the distinct keys."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = p.join(g, keys, "full")
    p, g = F.coalesce("p", F.lit(0)), F.coalesce("g", F.lit(0))
    return both.select(*keys, (p * g).alias("tp"), (p * (1 - g)).alias("fp"), ((1 - p) * g).alias("fn"))


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def macro_by_class(m: DataFrame, classes: list[str]) -> DataFrame:
    """Precision, recall and F1 of each class, averaged over classes. If a triple occurs once per side, that is shared / union."""
    per = m.groupBy(*classes).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return per.agg(F.count(F.lit(1)).alias("classes"), F.avg(precision(tp, fp)).alias("precision"), F.avg(precision(tp, fn)).alias("recall"), F.avg(f1(tp, fp, fn)).alias("f1"))


def macro_by_doc(predicted: DataFrame, gold: DataFrame, ontology: DataFrame) -> DataFrame:
    """Per document P, R, F1 of sets and the share of predictions whose relation the ontology has, averaged.

    Predictions are first kept only where the document's gold has their relation. Documents are those with
    gold; an empty prediction scores 0, its conformance is 1.
    """
    used = predicted.join(gold.select("doc_id", "r").distinct(), ["doc_id", "r"], "left_semi")
    conform = predicted.join(F.broadcast(ontology.select("r").withColumn("known", F.lit(1))), "r", "left")
    conform = conform.groupBy("doc_id").agg(F.avg(F.coalesce("known", F.lit(0))).alias("conform"))
    docs = gold.select("doc_id").distinct()
    per = matched(used, gold, TRIPLE).groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    per = docs.join(per, "doc_id", "left").join(conform, "doc_id", "left")
    return per.agg(F.count(F.lit(1)).alias("docs"), F.avg(precision(tp, fp)).alias("precision"), F.avg(precision(tp, fn)).alias("recall"), F.avg(f1(tp, fp, fn)).alias("f1"), F.avg(F.coalesce("conform", F.lit(1.0))).alias("conformance"))


def compact(*parts: str) -> Column:
    """One key of several names, lower-cased, without blanks and underscores."""
    return F.lower(F.regexp_replace(F.concat(*parts), r"[\s_]+", ""))


def _accents() -> dict[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, with that letter."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all(unicodedata.combining(m) for m in marks):
            found[chr(code)] = base
    return found


# Letters that stand for several, or that don't decompose.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "þ": "th"}


def folded(c: Column | str) -> Column:
    """Latin letters without their accents, ligatures spelt out; other scripts stay."""
    table = _accents()
    x = F.translate(c, "".join(table), "".join(table.values()))
    for letter, plain in LIGATURES.items():
        x = F.replace(x, F.lit(letter), F.lit(plain))
    return x


def normal_name(c: Column | str, is_object: bool = False, fold: bool = False) -> Column:
    """Camel case split, lower case, underscores and runs of blanks to one blank, accents off if ``fold``; objects lose a closing parenthesis."""
    x = F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")
    x = F.regexp_replace(F.lower(x), r"[_\s]+", " ")
    x = folded(x) if fold else x
    x = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.regexp_replace(x, r" ?\([^()]*\)$", "") if is_object else x


def confusion(results: DataFrame) -> DataFrame:
    """E16 over (valid, accepted): counts and rates. leak_rate: traps accepted; false_rejection_rate: valid ones rejected."""
    n = lambda c: F.count_if(c)
    valid, ok = F.col("valid"), F.col("accepted")
    tp, fn, fp, tn = n(valid & ok), n(valid & ~ok), n(~valid & ok), n(~valid & ~ok)
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return results.agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"), rate(tp + tn, tp + fn + fp + tn).alias("accuracy"), rate(fp, fp + tn).alias("leak_rate"), rate(fn, tp + fn).alias("false_rejection_rate"), rate(tn, fp + tn).alias("trap_rejection_rate"))


def pair_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Every candidate of a document against each of its references: which of the three slots agree."""
    p = predicted.select("doc_id", F.struct("s", "r", "o").alias("cand"))
    g = gold.select("doc_id", F.struct("s", "r", "o").alias("ref"))
    same = [(F.col(f"cand.{x}") == F.col(f"ref.{x}")).cast("int") for x in ("s", "r", "o")]
    return p.join(g, "doc_id").select("doc_id", "cand", "ref", (sum(same[1:], same[0]) / F.lit(3.0)).alias("score"))


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the greatest sum, by shortest augmenting paths with potentials."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, owner, came = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used)
            reach = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reach < least[free]
            least[free[better]], came[free[better]] = reach[better], j0
            j1 = free[least[free].argmin()]
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[came[j0]], came[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assign_all(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`assign` for many matrices (k, rows, columns) of one shape at once: the pairs' scores in its order, and their sums."""
    flip = score.shape[1] > score.shape[2]
    cost = -(score.transpose(0, 2, 1) if flip else score)
    k, n, m = cost.shape
    u, v, owner, came = np.zeros((k, n + 1)), np.zeros((k, m + 1)), np.zeros((k, m + 1), int), np.zeros((k, m + 1), int)
    for i in range(1, n + 1):
        owner[:, 0], j0 = i, np.zeros(k, int)
        least, used = np.full((k, m + 1), np.inf), np.zeros((k, m + 1), bool)
        at = np.arange(k)  # the matrices whose path hasn't reached a free column
        while len(at):
            used[at, j0[at]] = True
            row, taken, near, each = owner[at, j0[at]], used[at], least[at], np.arange(len(at))
            reach = cost[at, row - 1] - u[at, row][:, None] - v[at, 1:]
            better = (reach < near[:, 1:]) & ~taken[:, 1:]
            near[:, 1:] = np.where(better, reach, near[:, 1:])
            came[at, 1:] = np.where(better, j0[at][:, None], came[at, 1:])
            j1 = np.where(taken, np.inf, near).argmin(1)
            step = near[each, j1]
            which, column = np.nonzero(taken)
            u[at[which], owner[at[which], column]] += step[which]
            v[at] -= np.where(taken, step[:, None], 0.0)
            least[at] = np.where(taken, near, near - step[:, None])
            j0[at] = j1
            at = at[owner[at, j1] != 0]
        at = np.arange(k)
        while len(at):
            back = came[at, j0[at]]
            owner[at, j0[at]], j0[at] = owner[at, back], back
            at = at[back != 0]
    which, column = np.nonzero(owner[:, 1:])
    row = owner[which, column + 1] - 1
    chosen = np.zeros((k, m if flip else n))
    chosen[which, column if flip else row] = -cost[which, row, column]
    total = np.zeros(k)
    for x in chosen.T:
        total += x
    return chosen, total


_ASSIGNED_AT_ONCE = 1_000_000  # scores, and what the last batch has beyond them


def assigned(scores: DataFrame) -> DataFrame:
    """Per document the best one-to-one assignment of candidates to references and its mean score.

    The shorter side is padded, so the mean is over the longer side. ``scores`` has each candidate of a document with
    each of its references once (see :func:`pair_scores`); a pair without a score counts as 0. A document's matrix
    is one row: its scores by candidate, then reference. Matrices of one shape are solved together.
    """
    id_type = scores.schema["doc_id"].dataType.simpleString()
    pair = F.struct("cand", "ref", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    by_doc = scores.groupBy("doc_id").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    first = F.size(F.filter("pairs", lambda p: p["cand"].eqNullSafe(F.col("pairs")[0]["cand"])))  # references of the first candidate
    by_doc = by_doc.select("doc_id", "pairs", first.alias("refs"))
    at = lambda i: F.get("pairs", i)
    amiss = lambda p, i: ~p["ref"].eqNullSafe(at(i % F.col("refs"))["ref"]) | ~p["cand"].eqNullSafe(at(i - i % F.col("refs"))["cand"]) | ((i > 0) & (i < F.col("refs")) & p["ref"].eqNullSafe(at(i - 1)["ref"]))
    complete = (F.size("pairs") % F.col("refs") == 0) & (F.size(F.filter("pairs", amiss)) == 0)
    matrices = by_doc.select("doc_id", F.when(complete, F.col("refs")).alias("refs"), F.col("pairs.score").alias("scores"))

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        if t["refs"].null_count:
            raise ValueError("a candidate of a document isn't scored against each of its references once")
        refs, lists = t["refs"].to_numpy(), t["scores"].chunk(0)
        size, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        first, cands, mean = size.cumsum() - size, size // refs, np.zeros(len(size))
        order = np.lexsort((refs, cands))
        for rows in np.split(order, 1 + np.flatnonzero(np.diff(cands[order]) | np.diff(refs[order]))):
            n, m = int(cands[rows[0]]), int(refs[rows[0]])
            mean[rows] = assign_all(values[first[rows, None] + np.arange(n * m)].reshape(-1, n, m))[1] / max(n, m)
        return pa.record_batch([t["doc_id"].chunk(0), pa.array(np.maximum(cands, refs).astype(np.int32)), pa.array(mean)], ["doc_id", "pairs", "mean_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += len(b.column(2).flatten())
            if n >= _ASSIGNED_AT_ONCE:
                yield solved(held)
                held, n = [], 0
        if held:
            yield solved(held)

    return matrices.mapInArrow(run, f"doc_id {id_type}, pairs int, mean_score double")


# --- span alignment ------------------------------------------------------------


def align_spans(candidate: list[str], reference: list[str]) -> list[tuple[int, int, int]]:
    """Longest common runs first: (place in candidate, place in reference, length), no token used twice."""
    free_c, free_r, out = set(range(len(candidate))), set(range(len(reference))), []
    for n in range(min(len(candidate), len(reference)), 0, -1):
        for i in range(len(candidate) - n + 1):
            for j in range(len(reference) - n + 1):
                if candidate[i : i + n] == reference[j : j + n] and free_c.issuperset(range(i, i + n)) and free_r.issuperset(range(j, j + n)):
                    free_c -= set(range(i, i + n))
                    free_r -= set(range(j, j + n))
                    out.append((i, j, n))
    return sorted(out)


def span_scores(candidate: dict[str, str], reference: dict[str, str]) -> dict[str, float]:
    """Precision-like credit of a triple pair: exact, partial, strict and type agreement.

    Each slot has a span of words. exact: same words; partial: 1 for the same words, 0.5 for a shared run;
    type: a shared run in the same slot; strict: same words in the same slot. Slots may exchange roles: the
    order of candidate slots with the best exact credit is used, the given order on a tie.
    """
    slots = ("s", "r", "o")
    orders = [slots, ("o", "r", "s"), ("r", "s", "o"), ("s", "o", "r")]

    def credit(order: tuple[str, ...]) -> dict[str, float]:
        out = dict.fromkeys(("exact", "partial", "type", "strict"), 0.0)
        for mine, theirs in zip(order, slots, strict=True):
            a, b = candidate[mine].split(), reference[theirs].split()
            same, shared = a == b, bool(align_spans(a, b))
            out["exact"] += same
            out["partial"] += 1.0 if same else 0.5 if shared else 0.0
            out["type"] += shared and mine == theirs
            out["strict"] += same and mine == theirs
        return {k: x / 3 for k, x in out.items()}

    return max((credit(o) for o in orders), key=lambda c: c["exact"])


MEASURES = ("type", "partial", "strict", "exact")
COUNTS = ("correct", "incorrect", "partial", "missing", "spurious")
Triple = tuple[str, str, str]


def span_counts(candidate: Triple | None, reference: Triple | None) -> dict[str, list[int]]:
    """For each measure how many slots are correct, incorrect, partial, missing and spurious.

    Slots are compared word by word in the order of candidate slots that :func:`span_scores` finds best. A shared run
    of words is a type match in the same slot and a partial one anywhere; a slot without words on one side is
    missing or spurious, as are all slots of a triple without a partner.
    """
    slots = ("s", "r", "o")
    c, r = (dict(zip(slots, x or ("", "", ""), strict=True)) for x in (candidate, reference))
    orders = [slots, ("o", "r", "s"), ("r", "s", "o"), ("s", "o", "r")]
    order = max(orders, key=lambda o: sum(c[a].split() == r[b].split() != [] for a, b in zip(o, slots, strict=True)))
    out = {m: [0] * len(COUNTS) for m in MEASURES}
    for mine, theirs in zip(order, slots, strict=True):
        a, b = c[mine].split(), r[theirs].split()
        if not a and not b:
            continue
        shared, same = bool(align_spans(a, b)), a == b
        for m, right, half in (("type", shared and mine == theirs, False), ("partial", same, shared), ("strict", same and mine == theirs, False), ("exact", same, False)):
            kind = 3 if not a else 4 if not b else 0 if right else 2 if half else 1
            out[m][kind] += 1
    return out


def _rates(n: list[int], half: bool) -> tuple[float, float, float]:
    """Precision, recall and F1 of counts; a partial match is worth half where it counts at all."""
    right = n[0] + (0.5 * n[2] if half else 0.0)
    act, pos = n[0] + n[1] + n[2] + n[4], n[0] + n[1] + n[2] + n[3]
    p, r = right / act if act else 0.0, right / pos if pos else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def span_evaluation(pairs: DataFrame) -> DataFrame:
    """Rows (doc_id, cands, refs; arrays of triples) to (doc_id, measure, pairs, counts, precision, recall, f1).

    Candidates are assigned to references one to one so that the sum of the mean F1 of the four measures is greatest;
    what is left over has no partner. Counts are summed over a document's pairs, rates are summed too, so that
    :func:`span_summary` can average them over pairs.
    """
    id_type = pairs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, cands, refs in zip(pdf.doc_id, pdf.cands, pdf.refs, strict=True):
                cands, refs = ([tuple(t) for t in x] for x in (cands, refs))
                table = [[span_counts(a, b) for b in refs] for a in cands]
                score = np.array([[np.mean([_rates(n[m], m == "partial")[2] for m in MEASURES]) for n in row] for row in table]).reshape(len(cands), len(refs))
                matched = assign(score) if score.size else []
                found = [table[i][j] for i, j in matched]
                found += [span_counts(cands[i], None) for i in set(range(len(cands))) - {i for i, _ in matched}]
                found += [span_counts(None, refs[j]) for j in set(range(len(refs))) - {j for _, j in matched}]
                for m in MEASURES:
                    rates = np.array([_rates(n[m], m == "partial") for n in found]).reshape(-1, 3).sum(0)
                    rows.append((doc, m, len(found), *np.array([n[m] for n in found]).reshape(-1, len(COUNTS)).sum(0).tolist(), *rates.tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "measure", "pairs", *COUNTS, "precision", "recall", "f1"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return pairs.select("doc_id", "cands", "refs").mapInPandas(run, f"doc_id {id_type}, measure string, pairs long, {counts}, precision double, recall double, f1 double")


def span_summary(evaluated: DataFrame) -> DataFrame:
    """Per measure the summed counts and the mean rates over all pairs."""
    mean = [F.round(F.try_divide(F.sum(c), F.sum("pairs")), 6).alias(c) for c in ("precision", "recall", "f1")]
    return evaluated.groupBy("measure").agg(F.sum("pairs").alias("pairs"), *(F.sum(c).alias(c) for c in COUNTS), *mean)


def aligned_pairs(predicted: DataFrame, gold: DataFrame, most_apart: int | None = None) -> DataFrame:
    """(doc_id, cands, refs) from lines (doc_id, text) that hold literal lists of triples.

    A document goes if its prediction is no list of three strings each, if either line is missing, or if the
    numbers of triples differ by more than ``most_apart``.
    """
    side = lambda df, name: read_triples(df.select("doc_id", "text"), "text", "strict").select("doc_id", F.col("triples").alias(name)).where(F.col(name).isNotNull())
    both = side(predicted, "cands").join(side(gold, "refs"), "doc_id")
    return both if most_apart is None else both.where(F.abs(F.size("cands") - F.size("refs")) <= most_apart)


def scored_predictions(triples: DataFrame, synonyms: dict[str, str], topics: tuple[str, ...]) -> DataFrame:
    """Predictions (doc_id, ord, s, r, o) as they are scored: concept names, on topic, the first of equal ones per document."""
    x = triples.select("doc_id", "ord", concept_name("s", synonyms).alias("s"), F.trim("r").alias("r"), concept_name("o", synonyms).alias("o")).where("s is not null and o is not null")
    topic = reduce(Column.__or__, (F.contains(c, F.lit(t)) for t in topics for c in (F.col("s"), F.col("o"))), F.lit(False))
    return x.where(topic).groupBy("doc_id", "s", "r", "o").agg(F.min("ord").alias("ord"))


def relevant_docs(docs: DataFrame, mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents that mention one of the identifiers."""
    return docs.join(mentions.join(ids.select("id"), "id", "left_semi").select("doc_id"), "doc_id", "left_semi")


def gold_triples(relations: DataFrame, mentions: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """Gold triples (doc_id, pos, s, r, o) of relations (doc_id, pos, rel, e1, e2) by their mentions' names (doc_id, id, name).

    A name that is an abbreviation is written out; triples off topic go, of equal ones the first place stays,
    relations with an unnamed end go.
    """
    name = lambda n: mentions.select("doc_id", F.col("id").alias(f"e{n}"), written_out("name").alias(f"n{n}")).where(f"n{n} <> ''")
    x = relations.join(name(1), ["doc_id", "e1"]).join(name(2), ["doc_id", "e2"]).select("doc_id", "pos", F.col("n1").alias("s"), F.col("rel").alias("r"), F.col("n2").alias("o"))
    topic = reduce(Column.__or__, (F.contains(F.lower(c), F.lit(t)) for t in topics for c in ("s", "o")), F.lit(False))
    return x.where(topic).groupBy("doc_id", "s", "r", "o").agg(F.min("pos").alias("pos"))


# --- benchmark generation --------------------------------------------------------


def positives(relations: DataFrame, mentions: DataFrame, schema_map: DataFrame) -> DataFrame:
    """Document relations (doc_id, rel, e1, e2) with both ends' names and types, mapped by (rel, t1, t2), else swapped."""
    m = lambda n: mentions.select("doc_id", F.col("id").alias(f"e{n}"), F.col("name").alias(f"n{n}"), F.col("type").alias(f"t{n}"))
    full = relations.join(m(1), ["doc_id", "e1"]).join(m(2), ["doc_id", "e2"])
    straight = schema_map.select("rel", "t1", "t2", F.col("target").alias("straight"))
    turned = schema_map.select("rel", F.col("t1").alias("t2"), F.col("t2").alias("t1"), F.col("target").alias("turned"))
    found = full.join(F.broadcast(straight), ["rel", "t1", "t2"], "left").join(F.broadcast(turned), ["rel", "t1", "t2"], "left")
    swap = F.col("straight").isNull()
    found = found.where("straight is not null or turned is not null")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return found.select("doc_id", pick("n1", "n2").alias("s"), F.coalesce("straight", "turned").alias("r"), pick("n2", "n1").alias("o"), pick("t1", "t2").alias("st"), pick("t2", "t1").alias("ot")).distinct()


def draw(key: Column, seed: int) -> Column:
    """A number from a key and a seed by integer arithmetic, the same in every engine."""
    return (key * 7919 + F.lit(seed)) % 10007


def ranked_by_draw(df: DataFrame, classes: list[str], key: Column, seed: int) -> DataFrame:
    order = Window.partitionBy(*classes).orderBy(draw(key, seed), key)
    return df.withColumn("place", F.row_number().over(order))


def inverted(pos: DataFrame) -> DataFrame:
    """Subject and object exchanged, unless that is a positive too."""
    out = pos.select("doc_id", F.col("o").alias("s"), "r", F.col("s").alias("o"))
    return out.join(pos.select("s", "r", "o"), ["s", "r", "o"], "left_anti").select("doc_id", "s", "r", "o").withColumn("corruption", F.lit("inversion"))


def substituted(pos: DataFrame, pool: DataFrame) -> DataFrame:
    """The object replaced by the next entity of its type in the pool (type, place, name), if that isn't positive.

    The replacement is found by place, one join row per positive, instead of pairing with the whole pool.
    """
    sizes = pool.groupBy("type").agg(F.count(F.lit(1)).alias("size"))
    own = pool.select(F.col("type").alias("ot"), F.col("name").alias("o"), "place").join(F.broadcast(sizes.withColumnRenamed("type", "ot")), "ot")
    nxt = pool.select(F.col("type").alias("ot"), F.col("place").alias("next"), F.col("name").alias("other"))
    found = pos.join(own, ["ot", "o"]).withColumn("next", F.col("place") % F.col("size") + 1).join(nxt, ["ot", "next"])
    out = found.select("doc_id", "s", "r", F.col("other").alias("o"))
    return out.join(pos.select("s", "r", "o"), ["s", "r", "o"], "left_anti").select("doc_id", "s", "r", "o").withColumn("corruption", F.lit("substitution"))


def balanced(df: DataFrame, cls: str, key: Column, seed: int) -> DataFrame:
    """As many rows of each class as the smallest has, by drawn order."""
    least = df.groupBy(cls).count().agg(F.min("count").alias("least"))
    return ranked_by_draw(df, [cls], key, seed).join(F.broadcast(least), F.col("place") <= F.col("least")).drop("least", "place")


def all_pairs(names: list[str]) -> list[tuple[str, str]]:
    """Unordered pairs of a few relation names, for schema-violation traps."""
    return list(combinations(names, 2))
