"""Queries over recorded rater responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import adjudication as a
from triplewright.plans import views as v
from triplewright.plans.registry import oracle, query

THRESHOLD, VETO = 65.0, 85
FCS = "greatest(0.0, least(100.0, (sum(CASE verdict WHEN 'CORRECT' THEN confidence * 1.0::DOUBLE WHEN 'INCORRECT' THEN -confidence * 1.0::DOUBLE ELSE 0.3::DOUBLE * confidence END) / count(*) + 100.0) / 2))::DOUBLE"
ROUNDS = f"""rounds AS (
  SELECT item, round, count(DISTINCT verdict) = 1 AS consensus,
    min(agent) FILTER (verdict = 'INCORRECT' AND confidence > {VETO}) AS veto_agent, {FCS} AS fcs
  FROM responses GROUP BY item, round)"""
DECIDED = f"""{ROUNDS}, decided AS (
  SELECT item, arg_max(rounds, rank) AS d FROM (
    SELECT *, CASE WHEN veto_agent IS NOT NULL OR consensus THEN 1000 - round ELSE round END AS rank FROM rounds) rounds GROUP BY item
), replayed AS (
  SELECT item, d.round AS rounds, round(d.fcs, 6) AS fcs, d.veto_agent IS NOT NULL AS vetoed, d.veto_agent AS veto_agent, d.consensus AS consensus,
    d.veto_agent IS NULL AND d.fcs >= {THRESHOLD} AS accepted FROM decided)"""
RATERS = [(0, "clinical reviewer", 0.4), (1, "methods reviewer", 0.3), (2, "sceptic", 0.3)]


@query
def fcs_last_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D04 over the last round of each item."""
    rounds = a.per_round(v.responses(spark, sf_dir), VETO)
    last = rounds.groupBy("item").agg(F.max(F.struct("round", "fcs")).alias("m"))
    return last.select("item", F.col("m.round").alias("round"), F.round("m.fcs", 6).alias("fcs"))


oracle(fcs_last_round, f"WITH {v.RESPONSES}, {ROUNDS} SELECT item, max(round) AS round, round(arg_max(fcs, round), 6) AS fcs FROM rounds GROUP BY item")


@query
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01 with raters of different weights, joined from a small dimension table."""
    raters = spark.createDataFrame(RATERS, "agent int, persona string, weight double")
    r = v.responses(spark, sf_dir).join(F.broadcast(raters), "agent")
    return r.groupBy("item", "round").agg(F.round(a.clamp_score(F.sum(a.signed(F.col("weight"))), F.sum("weight")), 6).alias("fcs"))


oracle(
    weighted_scores,
    f"""WITH {v.RESPONSES}, raters(agent, weight) AS (VALUES (0, 0.4::DOUBLE), (1, 0.3::DOUBLE), (2, 0.3::DOUBLE))
SELECT item, round, round(greatest(0.0, least(100.0, (sum(CASE verdict WHEN 'CORRECT' THEN confidence * weight WHEN 'INCORRECT' THEN -confidence * weight ELSE 0.3::DOUBLE * confidence * weight END) / sum(weight) + 100.0) / 2)), 6)::DOUBLE AS fcs
FROM responses JOIN raters USING (agent) GROUP BY item, round""",
)


@query
def veto_first_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.per_round(v.responses(spark, sf_dir), VETO).where("veto_agent is not null").select("item", "round", "veto_agent")


oracle(veto_first_rater, f"WITH {v.RESPONSES}, {ROUNDS} SELECT item, round, veto_agent FROM rounds WHERE veto_agent IS NOT NULL")


@query
def consensus_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round in which all raters agree."""
    return a.per_round(v.responses(spark, sf_dir), VETO).where("consensus").groupBy("item").agg(F.min("round").alias("round"))


oracle(consensus_round, f"WITH {v.RESPONSES}, {ROUNDS} SELECT item, min(round) AS round FROM rounds WHERE consensus GROUP BY item")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.replay(v.responses(spark, sf_dir), THRESHOLD, VETO).withColumn("fcs", F.round("fcs", 6))


@query
def debate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)


oracle(debate_replay, f"WITH {v.RESPONSES}, {DECIDED} SELECT * FROM replayed")


@query
def debate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an item; those without responses are rejected; accepted ones stay."""
    items = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))
    return a.complete(_replayed(spark, sf_dir), items).groupBy("accepted", "vetoed").agg(F.count(F.lit(1)).alias("n"), F.sum("rounds").alias("rounds"))


oracle(
    debate_batch,
    f"""WITH {v.RESPONSES}, {DECIDED} SELECT coalesce(accepted, false) AS accepted, coalesce(vetoed, false) AS vetoed, count(*) AS n, coalesce(sum(rounds), 0)::BIGINT AS rounds
FROM customer LEFT JOIN replayed ON item = c_custkey GROUP BY 1, 2""",
)


@query
def debate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals before and after, and the accepted share."""
    return _replayed(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_items"), F.count_if("accepted").alias("n_accepted"), F.count_if("vetoed").alias("n_vetoed"), F.count_if("consensus").alias("n_consensus"), F.round(F.try_divide(F.count_if("accepted"), F.count(F.lit(1))), 6).alias("accepted_share"))


oracle(debate_summary, f"WITH {v.RESPONSES}, {DECIDED} SELECT count(*) AS n_items, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (vetoed) AS n_vetoed, count(*) FILTER (consensus) AS n_consensus, round(count(*) FILTER (accepted) / nullif(count(*), 0)::DOUBLE, 6) AS accepted_share FROM replayed")


@query
def debate_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.prompt_context(v.responses(spark, sf_dir))


oracle(
    debate_prompts,
    f"""WITH {v.RESPONSES} SELECT a.item, a.round, a.agent,
  string_agg(substring(concat('rater ', b.agent, ': ', b.verdict, ' [', b.confidence, ']'), 1, 800), chr(10) ORDER BY b.agent, b.verdict, b.confidence) AS context
FROM responses a JOIN responses b ON a.item = b.item AND b.round = a.round - 1 AND a.agent <> b.agent GROUP BY 1, 2, 3""",
)


REASONED = f"""{v.RESPONSES}, reasoned AS (SELECT r.item, r.round, r.agent, coalesce(CASE WHEN confidence % 17 <> 3 THEN verdict END, 'UNCERTAIN') AS verdict, coalesce(CASE WHEN confidence % 13 <> 5 THEN confidence END, 30) AS confidence, w AS weight,
  CASE WHEN confidence % 5 <> 0 THEN repeat(concat(verdict, ' since ', confidence, '. '), confidence) END AS reasoning FROM responses r JOIN (VALUES (0, 0.5::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0::DOUBLE)) raters(agent, w) USING (agent))"""


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of weighted raters, with reasons; some verdicts and confidences are missing, as of failed calls."""
    raters = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.0)], "agent int, weight double")
    r, c = v.responses(spark, sf_dir).join(F.broadcast(raters), "agent"), F.col("confidence")
    reasoning = F.when(c % 5 != 0, F.expr("repeat(concat(verdict, ' since ', confidence, '. '), confidence)"))
    return r.withColumn("reasoning", reasoning).withColumns({"verdict": F.when(c % 17 != 3, F.col("verdict")), "confidence": F.when(c % 13 != 5, c)})


@query
def debate_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay with weights and failed calls; a round of weight zero scores 50."""
    return a.replay(_reasoned(spark, sf_dir), THRESHOLD, VETO).select("item", "rounds", F.round("fcs", 6).alias("fcs"), "vetoed", "accepted")


_WEIGHED = "sum(CASE verdict WHEN 'CORRECT' THEN confidence * weight WHEN 'INCORRECT' THEN -confidence * weight ELSE 0.3::DOUBLE * confidence * weight END)"
oracle(
    debate_weighted,
    f"""WITH {REASONED}, rounds AS (SELECT item, round, count(DISTINCT verdict) = 1 AS consensus, min(agent) FILTER (verdict = 'INCORRECT' AND confidence > {VETO}) AS veto_agent,
  greatest(0.0, least(100.0, (CASE WHEN sum(weight) = 0 THEN 0 ELSE {_WEIGHED} / sum(weight) END + 100.0) / 2))::DOUBLE AS fcs FROM reasoned GROUP BY item, round),
decided AS (SELECT item, arg_max(rounds, CASE WHEN veto_agent IS NOT NULL OR consensus THEN 100000 - round ELSE round END) AS d FROM rounds GROUP BY item)
SELECT item, d.round AS rounds, round(d.fcs, 6) AS fcs, d.veto_agent IS NOT NULL AS vetoed, d.veto_agent IS NULL AND d.fcs >= {THRESHOLD} AS accepted FROM decided""",
)


@query
def debate_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts' context with the other raters' reasons, 800 characters of each."""
    return a.prompt_context(_reasoned(spark, sf_dir)).select("item", "round", "agent", F.sha2("context", 256).alias("sha"), F.length("context").alias("chars"))


oracle(
    debate_reasoning,
    f"""WITH {REASONED}, c AS (SELECT a.item, a.round, a.agent, string_agg(concat('rater ', b.agent, ': ', b.verdict, ' [', b.confidence, ']', chr(10), substring(coalesce(b.reasoning, ''), 1, 800)), chr(10) ORDER BY b.agent) AS context
FROM reasoned a JOIN reasoned b ON a.item = b.item AND b.round = a.round - 1 AND a.agent <> b.agent GROUP BY 1, 2, 3)
SELECT item, round, agent, sha256(context) AS sha, length(context)::INTEGER AS chars FROM c""",
)


# Definitions of relations by display name.
DEFINITIONS = [("supplied by", "The part is delivered by the supplier."), ("located in", "The party is based in the nation."), ("part of", "The nation belongs to the region.")]


@query
def relation_definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions found with space and underscore treated alike, else a default."""
    key = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    definitions = spark.createDataFrame(DEFINITIONS, "name string, definition string")
    rels = v.edges(spark, sf_dir).select("rel").distinct().withColumn("name", key("rel"))
    return rels.join(F.broadcast(definitions), "name", "left").select("rel", F.coalesce("definition", F.lit("No definition available.")).alias("definition"))


oracle(
    relation_definition_lookup,
    f"WITH {v.EDGES}, defs(name, definition) AS (VALUES "
    + ", ".join(f"('{n}', '{d}')" for n, d in DEFINITIONS)
    + ") SELECT rel, coalesce(definition, 'No definition available.') AS definition FROM (SELECT DISTINCT rel FROM edges) LEFT JOIN defs ON name = replace(lower(rel), '_', ' ')",
)
