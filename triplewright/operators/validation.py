"""Validation of extracted triples (doc_id, ord, s, r, o) against their text and learned type rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions.entities import is_anchored, is_atomic, is_non_entity, matches_set
from triplewright.functions.text import strip


def validate(triples: DataFrame) -> DataFrame:
    """The first check that a triple (with cs, co as cleaned ends and text) fails, as ``reason``; null if it passes all."""
    low = lambda c: F.lower(strip(c))
    anchored = lambda clean, raw: is_anchored(F.col(clean), F.col("text")) | is_anchored(F.col(raw), F.col("text"))
    reason = (
        F.when(F.col("s").isNull() | F.col("r").isNull() | F.col("o").isNull(), "malformed")
        .when(is_non_entity("cs"), "non-entity subject")
        .when(is_non_entity("co"), "non-entity object")
        .when(~is_atomic("cs"), "verbose subject")
        .when(~is_atomic("co"), "verbose object")
        .when(low("cs") == low("co"), "tautology")
        .when(F.contains(low("cs"), low("co")) & (F.length(strip("co")) < F.length(strip("cs"))), "object in subject")
        .when(~anchored("cs", "s"), "subject not in text")
        .when(~anchored("co", "o"), "object not in text")
    )
    return triples.withColumn("reason", reason)


def learned_rules(examples: DataFrame) -> DataFrame:
    """Per relation the types and literal names seen as subject and as object."""
    return examples.groupBy(F.lower("r").alias("rule")).agg(*(F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in ("st", "ot")), *(F.array_sort(F.collect_set(F.lower(c))).alias(f"{c}_names") for c in ("s", "o")))


def flip_by_names(triples: DataFrame, rules: DataFrame, most_overlap: float = 0.3) -> DataFrame:
    """Ends exchanged where they match the learned names the other way round only, for relations whose name sets differ."""
    x = triples.join(F.broadcast(rules), F.lower("r") == F.col("rule"), "left")
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect("s_names", "o_names")), F.size(F.array_union("s_names", "o_names"))), F.lit(0.0))
    m = lambda c, names: matches_set(F.col(c), F.col(names))
    turn = F.col("rule").isNotNull() & (overlap < most_overlap) & m("s", "o_names") & m("o", "s_names") & ~(m("s", "s_names") & m("o", "o_names"))
    return _turned(x, F.coalesce(turn, F.lit(False))).drop("rule", "st_set", "ot_set", "s_names", "o_names")


def _turned(x: DataFrame, turn) -> DataFrame:  # noqa: ANN001
    swap = {"s": "o", "o": "s"} | ({"st": "ot", "ot": "st"} if "st" in x.columns else {})
    x = x.withColumn("turned", turn)
    return x.withColumns({a: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)) for a, b in swap.items()})


def check_types(triples: DataFrame, rules: DataFrame, discard: bool = True) -> DataFrame:
    """(s, st, r, o, ot) turned where only the reverse fits the learned types; then ``keep``.

    With ``discard`` a triple whose types don't fit is not kept; relations without rules pass. Two rules hold
    in any case: an adverse effect is no drug, and a drug isn't treated by something.
    """
    x = triples.join(F.broadcast(rules.select("rule", "st_set", "ot_set")), F.lower("r") == F.col("rule"), "left")
    fits = lambda s, o: F.array_contains("st_set", F.col(s)) & F.array_contains("ot_set", F.col(o))
    turn = F.coalesce(~F.arrays_overlap("st_set", "ot_set") & fits("ot", "st"), F.lit(False))
    x = _turned(x, turn)
    key = F.replace(F.lower("r"), F.lit("_"), F.lit(" "))
    drug = ("Drug", "Treatment Procedure")
    bad = (key == "has adverse effect") & (F.col("ot").isin(*drug) | F.lower("o").rlike("drug|insulin")) | key.isin("treated by", "may be treated by") & F.col("st").isin(*drug)
    fit = F.coalesce(fits("st", "ot"), F.lit(True)) if discard else F.lit(True)
    return x.withColumn("keep", fit & ~bad).drop("rule", "st_set", "ot_set")


def correct_open(triples: DataFrame, typed: DataFrame, rules: DataFrame, discard: bool = True) -> DataFrame:
    """Open triples (doc_id, s, r, o) checked by the types of the typed entry of the same document, subject,
    relation and object (of several, the last by ``ord``). Triples without an entry pass; turned ones exchange types too.
    """
    entry = typed.groupBy("doc_id", "s", "r", "o").agg(F.max_by(F.struct("st", "ot"), "ord").alias("e")).select("doc_id", "s", "r", "o", "e.st", "e.ot", F.lit(True).alias("matched"))
    x = triples.join(entry, ["doc_id", "s", "r", "o"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    checked = check_types(x, rules, discard)
    return checked.where(~F.col("matched") | F.col("keep")).drop("keep")


def _says(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern) & ~x.rlike(r"\bnot\b.*\b(?:not|no|un\w+)\b")


def relabel(triples: DataFrame, evidence: dict[str, str]) -> DataFrame:
    """The relation replaced by the one whose words a sentence of the text with both ends holds; a double negation counts as none."""
    near = F.filter(F.split(F.lower("text"), r"\."), lambda x: F.contains(x, F.lower("s")) & F.contains(x, F.lower("o")))
    out = F.col("r")
    for relation, pattern in reversed(evidence.items()):
        out = F.when(F.exists(near, _says(pattern)), relation).otherwise(out)
    return triples.withColumn("r", out)


def on_topic(triples: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Triples with a topic word, taken literally and without regard to case, in subject or object."""
    says = lambda c: reduce(Column.__or__, (F.contains(F.lower(c), F.lit(w.lower())) for w in words), F.lit(False))
    return triples.where(says("s") | says("o"))
