"""Adjudication of items from recorded rater responses (item, round, agent, verdict, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCERTAIN_SHARE = 0.3


def with_failures(responses: DataFrame) -> DataFrame:
    """A missing verdict is UNCERTAIN, a missing confidence 30."""
    return responses.withColumns({"verdict": F.coalesce("verdict", F.lit("UNCERTAIN")), "confidence": F.coalesce("confidence", F.lit(30))})


def signed(weight: Column) -> Column:
    """+w c if correct, -w c if incorrect, 0.3 w c if uncertain."""
    c = F.col("confidence") * weight
    return F.when(F.col("verdict") == "CORRECT", c).when(F.col("verdict") == "INCORRECT", -c).otherwise(UNCERTAIN_SHARE * c)


def clamp_score(signed_sum: Column, weight_sum: Column) -> Column:
    """(sum of signed / sum of weights + 100) / 2 within 0 and 100; 50 for a weight of zero."""
    mean = F.when(weight_sum == 0, 0.0).otherwise(signed_sum / weight_sum)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (mean + 100.0) / 2))


def per_round(responses: DataFrame, veto: int) -> DataFrame:
    """Per item and round: whether all agree, who vetoes (the first rater by index), and the score.

    Raters weigh 1, or what a ``weight`` column says.
    """
    r = with_failures(responses)
    vetoes = (F.col("verdict") == "INCORRECT") & (F.col("confidence") > veto)
    one = F.col("weight") if "weight" in responses.columns else F.lit(1.0)
    return r.groupBy("item", "round").agg(
        (F.count_distinct("verdict") == 1).alias("consensus"),
        F.min(F.when(vetoes, F.col("agent"))).alias("veto_agent"),
        clamp_score(F.sum(signed(one)), F.sum(one)).alias("fcs"),
    )


def replay(responses: DataFrame, threshold: float, veto: int, stop_on_consensus: bool = True) -> DataFrame:
    """Rounds run until a veto, or a consensus before the last round; the last round that ran decides.

    One aggregation by (item, round) and one by item; the decision is the least round that stops.
    """
    rounds = per_round(responses, veto)
    stops = F.col("veto_agent").isNotNull()
    if stop_on_consensus:
        stops = stops | F.col("consensus")
    row = F.struct("round", "fcs", "veto_agent", "consensus")
    decided = rounds.groupBy("item").agg(F.coalesce(F.min(F.when(stops, row)), F.max(row)).alias("d"))
    vetoed = F.col("d.veto_agent").isNotNull()
    return decided.select(
        "item",
        F.col("d.round").alias("rounds"),
        F.col("d.fcs").alias("fcs"),
        vetoed.alias("vetoed"),
        F.col("d.veto_agent").alias("veto_agent"),
        F.col("d.consensus").alias("consensus"),
        (~vetoed & (F.col("d.fcs") >= threshold)).alias("accepted"),
    )


def complete(results: DataFrame, items: DataFrame) -> DataFrame:
    """Items without any response are rejected with a score of 0."""
    return items.join(results, "item", "left").withColumns({"fcs": F.coalesce("fcs", F.lit(0.0)), "vetoed": F.coalesce("vetoed", F.lit(False)), "accepted": F.coalesce("accepted", F.lit(False)), "rounds": F.coalesce("rounds", F.lit(0))})


def prompt_context(responses: DataFrame, most: int = 800) -> DataFrame:
    """For each rater and round, what the others said before, in rater order, with their ``reasoning`` where there is
    that column, cut to ``most`` characters each."""
    said = F.concat(F.lit("rater "), "agent", F.lit(": "), "verdict", F.lit(" ["), "confidence", F.lit("]"))
    if "reasoning" in responses.columns:
        said = F.concat(said, F.lit("\n"), F.substring(F.coalesce("reasoning", F.lit("")), 1, most))
    else:
        said = F.substring(said, 1, most)
    r = with_failures(responses).withColumn("said", said)
    a, b = r.alias("a"), r.alias("b")
    others = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("b.round") == F.col("a.round") - 1) & (F.col("a.agent") != F.col("b.agent")))
    lines = F.array_sort(F.collect_list(F.struct("b.agent", "b.said")))
    return others.groupBy("a.item", "a.round", "a.agent").agg(F.array_join(F.transform(lines, lambda x: x["said"]), "\n").alias("context"))
