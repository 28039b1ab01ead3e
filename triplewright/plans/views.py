"""The graph, rater and gold views over the star-schema tables, in DataFrame form and as oracle SQL.

Star-schema rows stand for a property graph: customers place orders, orders contain parts, parts are
supplied by suppliers, all are located in nations, and heavily returned (supplier, part) pairs carry the
safety relation CONTRAINDICATED_WITH.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAFETY = "CONTRAINDICATED_WITH"
DEFAULT_CONFIDENCE = 100.0
SEEDS = ("C1", "C2", "C3", "C4", "C5")
HEAVY_RETURN = 45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column))


class Part(NamedTuple):
    """Edges of one relation: the table and columns of its ends, and how several rows of one edge are rated."""

    rel: str
    table: str
    src: tuple[str, str]  # kind (first letter of an id) and key column
    dst: tuple[str, str]
    only: str = "true"
    repeated: bool = False
    rating: str = "cast(null as double)"  # an aggregate where edges repeat


PARTS = (
    Part("PLACED", "orders", ("C", "o_custkey"), ("O", "o_orderkey")),
    Part("CONTAINS", "lineitem", ("O", "l_orderkey"), ("P", "l_partkey"), repeated=True, rating="100.0D * (1 - max(l_discount))"),
    Part("SUPPLIED_BY", "lineitem", ("P", "l_partkey"), ("S", "l_suppkey"), repeated=True),
    Part("LOCATED_IN", "customer", ("C", "c_custkey"), ("N", "c_nationkey")),
    Part("LOCATED_IN", "supplier", ("S", "s_suppkey"), ("N", "s_nationkey")),
    Part("PART_OF", "nation", ("N", "n_nationkey"), ("R", "n_regionkey")),
    Part(SAFETY, "lineitem", ("S", "l_suppkey"), ("P", "l_partkey"), f"l_returnflag = 'R' AND l_quantity >= {HEAVY_RETURN}", True, "2.0D * max(l_quantity)"),
)


def _edges(spark: SparkSession, sf_dir: str, part: Part, chosen: Column | None = None) -> DataFrame:
    rows = table(spark, sf_dir, part.table).where(part.only)
    if chosen is not None:
        rows = rows.where(chosen)
    keys, rating = [part.src[1], part.dst[1]], F.expr(part.rating).alias("confidence")
    rows = rows.groupBy(*keys).agg(rating) if part.repeated else rows.select(*keys, rating)
    return rows.select(_id(*part.src).alias("src"), F.lit(part.rel).alias("rel"), _id(*part.dst).alias("dst"), "confidence")


EDGE_SCHEMA = "src string, rel string, dst string, confidence double"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, rel, dst, confidence), distinct on (src, rel, dst); confidence is null where none was rated."""
    return reduce(DataFrame.unionByName, [_edges(spark, sf_dir, p) for p in PARTS])


def edges_at(spark: SparkSession, sf_dir: str, ids: Sequence[str], rels: Sequence[str] | None = None) -> DataFrame:
    """The edges with one of a few ids at either end. The ids reach the scans as literals on the raw keys, so files and
    row groups without them are skipped, and relations whose ends can't be of these kinds aren't read at all."""
    keys: dict[str, list[int]] = {}
    for x in ids:
        if x[1:].isdecimal():
            keys.setdefault(x[0], []).append(int(x[1:]))
    found = []
    for p in PARTS:
        ends = [F.col(column).isin(keys[kind]) for kind, column in (p.src, p.dst) if kind in keys]
        if ends and (rels is None or p.rel in rels):
            found.append(_edges(spark, sf_dir, p, reduce(Column.__or__, ends)))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], EDGE_SCHEMA)


EDGES = f"""edges AS (
  SELECT concat('C', o_custkey) AS src, 'PLACED' AS rel, concat('O', o_orderkey) AS dst, CAST(NULL AS DOUBLE) AS confidence FROM orders
  UNION ALL SELECT concat('O', l_orderkey), 'CONTAINS', concat('P', l_partkey), 100.0::DOUBLE * (1 - max(l_discount)) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT concat('P', l_partkey), 'SUPPLIED_BY', concat('S', l_suppkey), CAST(NULL AS DOUBLE) FROM lineitem
  UNION ALL SELECT concat('C', c_custkey), 'LOCATED_IN', concat('N', c_nationkey), CAST(NULL AS DOUBLE) FROM customer
  UNION ALL SELECT concat('S', s_suppkey), 'LOCATED_IN', concat('N', s_nationkey), CAST(NULL AS DOUBLE) FROM supplier
  UNION ALL SELECT concat('N', n_nationkey), 'PART_OF', concat('R', n_regionkey), CAST(NULL AS DOUBLE) FROM nation
  UNION ALL SELECT concat('S', l_suppkey), '{SAFETY}', concat('P', l_partkey), 2.0::DOUBLE * max(l_quantity) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= {HEAVY_RETURN} GROUP BY l_suppkey, l_partkey
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(id, label, name, aliases)."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<string>")
    node = lambda df, key, label, name, aliases=none: df.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"), aliases.alias("aliases"))
    part_alias = F.array("p_brand", "p_type")
    parts = [
        node(t("customer"), _id("C", "c_custkey"), "Customer", F.col("c_name"), F.array("c_mktsegment")),
        node(t("supplier"), _id("S", "s_suppkey"), "Supplier", F.col("s_name")),
        node(t("part"), _id("P", "p_partkey"), "Part", F.col("p_name"), part_alias),
        node(t("nation"), _id("N", "n_nationkey"), "Nation", F.col("n_name")),
        node(t("region"), _id("R", "r_regionkey"), "Region", F.col("r_name")),
        node(t("orders"), _id("O", "o_orderkey"), "Order", F.col("o_orderpriority"), F.array("o_orderstatus")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES = """nodes AS (
  SELECT concat('C', c_custkey) AS id, 'Customer' AS label, c_name AS name, [c_mktsegment] AS aliases FROM customer
  UNION ALL SELECT concat('S', s_suppkey), 'Supplier', s_name, [] FROM supplier
  UNION ALL SELECT concat('P', p_partkey), 'Part', p_name, [p_brand, p_type] FROM part
  UNION ALL SELECT concat('N', n_nationkey), 'Nation', n_name, [] FROM nation
  UNION ALL SELECT concat('R', r_regionkey), 'Region', r_name, [] FROM region
  UNION ALL SELECT concat('O', o_orderkey), 'Order', o_orderpriority, [o_orderstatus] FROM orders
)"""

# Weights of relations in ranking; the safety relation counts 100, unknown relations 1.
WEIGHTS = {"PLACED": 8, "CONTAINS": 7, "SUPPLIED_BY": 6, "LOCATED_IN": 2, "PART_OF": 1, SAFETY: 100}
WEIGHTS_SQL = "rel_weights(rel, w) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items()) + ")"


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "rel string, w int")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses(item, round, agent, verdict, confidence): recorded rater answers, derived from events."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("agent", (F.col("event_id") % 3).cast("int"))
    order = Window.partitionBy("user_id", "agent").orderBy("ts", "event_id")
    verdict = F.when(F.col("event_type").isin("purchase", "signup"), "CORRECT").when(F.col("event_type") == "error", "INCORRECT").otherwise("UNCERTAIN")
    rated = e.withColumn("round", F.row_number().over(order))
    return rated.select(F.col("user_id").alias("item"), "round", "agent", verdict.alias("verdict"), F.pmod(F.floor("value").cast("int"), F.lit(101)).alias("confidence"))


RESPONSES = """responses AS (
  SELECT user_id AS item, CAST(round AS INTEGER) AS round, agent, verdict, confidence FROM (
    SELECT user_id, CAST(event_id % 3 AS INTEGER) AS agent,
           row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS round,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 'CORRECT' WHEN event_type = 'error' THEN 'INCORRECT' ELSE 'UNCERTAIN' END AS verdict,
           CAST(((floor(value)::INTEGER % 101) + 101) % 101 AS INTEGER) AS confidence
    FROM events)
)"""


def predicted_and_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, s, r, o) predictions and gold: two fixed subsets of an order's lines; doc_id is the order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    triple = [F.col("l_orderkey").alias("doc_id"), _id("O", "l_orderkey").alias("s"), F.when(F.col("l_returnflag") == "R", "RETURNS").otherwise("KEEPS").alias("r"), _id("P", "l_partkey").alias("o")]
    predicted = l.where((F.col("l_partkey") + F.col("l_linenumber")) % 5 != 0).select(*triple).distinct()
    gold = l.where((F.col("l_partkey") + 2 * F.col("l_linenumber")) % 7 != 0).select(*triple).distinct()
    return predicted, gold


PRED_GOLD = """lines AS (
  SELECT l_orderkey AS doc_id, concat('O', l_orderkey) AS s, CASE WHEN l_returnflag = 'R' THEN 'RETURNS' ELSE 'KEEPS' END AS r,
         concat('P', l_partkey) AS o, l_partkey, l_linenumber FROM lineitem
), pred AS (SELECT DISTINCT doc_id, s, r, o FROM lines WHERE (l_partkey + l_linenumber) % 5 <> 0),
gold AS (SELECT DISTINCT doc_id, s, r, o FROM lines WHERE (l_partkey + 2 * l_linenumber) % 7 <> 0)"""
