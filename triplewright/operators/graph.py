"""Graph expansion, ranking and the safety gate on edge tables (src, rel, dst, confidence).

Seeds are small request arguments, and so is the frontier of a second hop, which has a limit. All
limits come after a total order, so results don't depend on partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplewright.functions.parsing import WRITE_WORDS

WRITES = re.compile(rf"\b({'|'.join((*WRITE_WORDS, 'INSERT', 'UPDATE', 'ALTER', 'TRUNCATE', 'OVERWRITE'))})\b", re.IGNORECASE)
KEY = ["src", "rel", "dst"]


def rated(edges: DataFrame, default: float = 100.0) -> DataFrame:
    return edges.withColumn("confidence", F.coalesce("confidence", F.lit(default)))


def touching(edges: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """Edges with a seed at either end; a filter of literals, no join."""
    return edges.where(F.col("src").isin(*seeds) | F.col("dst").isin(*seeds)).distinct()


def safety_edges(edges: DataFrame, seeds: Sequence[str], relation: str) -> DataFrame:
    """Q01: edges of the safety relation at a seed."""
    return rated(touching(edges.where(F.col("rel") == relation), seeds)).withColumn("hop", F.lit(1))


def _cut(rows: DataFrame, most: int | None) -> DataFrame:
    return rows if most is None else rows.orderBy(*KEY).limit(most)


def hop1(edges: DataFrame, seeds: Sequence[str], excluding: str, most: int | None = None) -> DataFrame:
    """Q02: one hop in both directions, without the safety relation; at most the first ``most`` edges by their key."""
    return _cut(rated(touching(edges.where(F.col("rel") != excluding), seeds)), most).withColumn("hop", F.lit(1))


def frontier(first: DataFrame, nodes: DataFrame, seeds: Sequence[str], through: Sequence[str], most: int) -> list[str]:
    """Q03: up to ``most`` neighbours (by id) of labels ``through``; so few that they are literals of the next hop."""
    ends = first.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where(~F.col("id").isin(*seeds))
    chosen = ends.join(nodes.where(F.col("label").isin(*through)).select("id"), "id", "left_semi")
    return [r["id"] for r in chosen.orderBy("id").limit(most).collect()]


def hop2(near: DataFrame, chosen: Sequence[str], nodes: DataFrame, to: Sequence[str], most: int | None = None) -> DataFrame:
    """Q03: edges (``near``: those at a chosen id, at least) between the frontier and nodes of labels ``to``."""
    one = touching(near, chosen)
    far = F.explode(F.array_compact(F.array(F.when(F.col("src").isin(*chosen), F.col("dst")), F.when(F.col("dst").isin(*chosen), F.col("src")))))
    labels = nodes.where(F.col("label").isin(*to)).select(F.col("id").alias("far"))
    reached = one.withColumn("far", far).join(labels, "far", "left_semi").select(*KEY, "confidence").distinct()
    return _cut(rated(reached), most).withColumn("hop", F.lit(2))


def safety_of(edges: DataFrame, relation: str, name: str) -> DataFrame:
    """Q04: (id, other, rel) of the safety relation's edges from nodes whose id contains ``name`` (case doesn't count)."""
    e = edges.where((F.col("rel") == relation) & F.contains(F.lower("src"), F.lit(name.lower())))
    return e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lower("rel").alias("rel")).distinct()


def guarded(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Q06: a statement over ``tables``, named in braces; statements that hold a write word are refused."""
    if WRITES.search(statement):
        raise ValueError("the statement is not read-only")
    return spark.sql(statement, **tables)


def covered(nodes: DataFrame, ids: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Q10: one row, ``ok``: whether any of the ids is a node of one of the labels."""
    hit = F.col("id").isin(*ids) & F.col("label").isin(*labels)
    return nodes.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("ok"))


def first_of(parts: Sequence[DataFrame]) -> DataFrame:
    """Q13: union of result lists; of rows with one key, that of the first list stays."""
    tagged = [p.withColumn("stage", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    order = Window.partitionBy(*KEY).orderBy("stage", "hop", F.desc("confidence"))
    return out.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def score(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Q14: (weight + 2 on the first hop) * confidence / 100; relations without a weight count 1."""
    weight = F.coalesce("w", F.lit(1)) + F.when(F.col("hop") == 1, 2).otherwise(0)
    return edges.join(F.broadcast(weights), "rel", "left").withColumn("score", weight * F.col("confidence") / 100).drop("w")


def best(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), *KEY).limit(n)


def section(relation: Column, safety: Sequence[str], treatment: Sequence[str]) -> Column:
    """Q15: which part of an answer's context an edge belongs to."""
    return F.when(relation.isin(*safety), "circuit").when(relation.isin(*treatment), "treatment").otherwise("evidence")


def at_node(edges: DataFrame, node: str) -> DataFrame:
    """Q05: all edges at one node, with their direction."""
    out = edges.where(F.col("src") == node).select(*KEY, F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == node).select(*KEY, F.lit("in").alias("direction"))).distinct()


def paths(edges: DataFrame, sources: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Q07, Q08: edges on undirected paths of length 1 or 2 between two id sets; no path uses an edge twice."""
    one = edges.where((F.col("src").isin(*sources) & F.col("dst").isin(*targets)) | (F.col("dst").isin(*sources) & F.col("src").isin(*targets)))
    ends = lambda ids, name: edges.where(F.col("src").isin(*ids)).select(*KEY, F.col("dst").alias(name)).unionByName(edges.where(F.col("dst").isin(*ids)).select(*KEY, F.col("src").alias(name)))
    a, b = ends(sources, "mid").alias("a"), ends(targets, "mid").alias("b")
    same = (F.col("a.src") == F.col("b.src")) & (F.col("a.rel") == F.col("b.rel")) & (F.col("a.dst") == F.col("b.dst"))
    two = a.join(b, (F.col("a.mid") == F.col("b.mid")) & ~same)
    halves = two.select("a.src", "a.rel", "a.dst").unionByName(two.select("b.src", "b.rel", "b.dst"))
    return one.select(*KEY).unionByName(halves).distinct()


def verify(claims: DataFrame, edges: DataFrame, prefixes: bool = False) -> DataFrame:
    """Q18: claims (s, r, o) with ``how``: exact, reversed, or null where the graph has no such edge.

    With ``prefixes``, a claim that is neither is also matched, in either direction, with edges of its relation
    whose ends are the claim's, or start with them and a comma or a blank: ``how`` is then prefix, and ``vs``
    and ``vo`` are the ends of the first such edge (of the edge itself otherwise). Candidates meet on the
    relation and on each end's part before the first comma or blank, so no pair of tables is crossed.
    """
    e = edges.select(*KEY).distinct()
    forward = e.select(F.col("src").alias("s"), F.col("rel").alias("r"), F.col("dst").alias("o"), F.lit(True).alias("forward"))
    backward = e.select(F.col("dst").alias("s"), F.col("rel").alias("r"), F.col("src").alias("o"), F.lit(True).alias("backward"))
    found = claims.join(forward, ["s", "r", "o"], "left").join(backward, ["s", "r", "o"], "left")
    found = found.withColumn("how", F.when(F.col("forward"), "exact").when(F.col("backward"), "reversed")).drop("forward", "backward")
    if not prefixes:
        return found
    head = lambda c: F.regexp_extract(c, "^[^, ]*", 0)
    both = e.unionByName(e.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst")))
    both = both.select(F.col("rel").alias("r"), "src", "dst", head("src").alias("hs"), head("dst").alias("ho"))
    starts = lambda x, c: (F.col(x) == F.col(c)) | F.col(x).startswith(F.concat(c, F.lit(","))) | F.col(x).startswith(F.concat(c, F.lit(" ")))
    rest = found.where("how is null and s <> '' and o <> ''").select("s", "r", "o").distinct().withColumns({"hs": head("s"), "ho": head("o")})
    hits = rest.join(both, ["r", "hs", "ho"]).where(starts("src", "s") & starts("dst", "o"))
    first = hits.groupBy("s", "r", "o").agg(F.min(F.struct("src", "dst")).alias("first"))
    out = found.join(first, ["s", "r", "o"], "left")
    how = F.coalesce("how", F.when(F.col("first").isNotNull(), "prefix"))
    pick = lambda end, own: F.when(F.col("how").isin("exact", "reversed"), F.col(own)).otherwise(F.col(f"first.{end}"))
    return out.withColumns({"vs": pick("src", "s"), "vo": pick("dst", "o"), "how": how}).drop("first")


def repaired_paths(hops: DataFrame, edges: DataFrame, top: DataFrame) -> DataFrame:
    """Q19: proposed paths (path, nth, s, r, o; one row a hop) cut to the hops that verify, in their order.

    A hop keeps its direction and takes the ends of the edge that verifies it and that edge's confidence. A path
    without any such hop becomes the first edge of ``top`` (src, rel, dst, confidence).
    """
    ok = verify(hops, edges, prefixes=True).where("how is not null")
    known = rated(edges).select(*KEY, "confidence")
    both = known.unionByName(known.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), "confidence")).groupBy(*KEY).agg(F.max("confidence").alias("confidence"))
    kept = ok.join(both, (ok["vs"] == both["src"]) & (ok["r"] == both["rel"]) & (ok["vo"] == both["dst"]))
    kept = kept.select("path", "nth", F.col("vs").alias("src"), "rel", F.col("vo").alias("dst"), "confidence", F.lit(False).alias("fallback"))
    one = F.broadcast(rated(top).orderBy(F.desc("confidence"), *KEY).limit(1))  # one row
    lost = hops.select("path").distinct().join(kept.select("path"), "path", "left_anti")
    return kept.unionByName(lost.join(one).select("path", F.lit(0).cast(hops.schema["nth"].dataType).alias("nth"), *KEY, "confidence", F.lit(True).alias("fallback")))


def flagged(recommendations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Q22: recommendations (id, title, drug) with ``verified``, if title or drug resolves to a node, and ``node`` of the title; none goes."""
    side = lambda c: resolved.select(F.col("term").alias(c), F.col("id").alias(f"{c}_node"))
    x = recommendations.join(side("title"), "title", "left").join(side("drug"), "drug", "left")
    return x.select("id", "title", "drug", (F.col("title_node").isNotNull() | F.col("drug_node").isNotNull()).alias("verified"), F.col("title_node").alias("node"))


def translated(terms: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q24: distinct terms with their entry (term, meaning), case and outer blanks aside, and the terms that remain for a call."""
    key = lambda c: F.lower(F.trim(c))
    entries = dictionary.groupBy(key("term").alias("key")).agg(F.min("meaning").alias("meaning"))
    x = terms.select("term").where("term is not null").distinct().withColumn("key", key("term")).join(entries, "key", "left").select("term", "meaning")
    return x.where("meaning is not null"), x.where("meaning is null").select("term")


def backfill(chosen: DataFrame, ranked: DataFrame, n: int) -> DataFrame:
    """Q20: the chosen edges, then the best ranked others, up to ``n`` rows with their place."""
    more = ranked.join(chosen.select(*KEY), KEY, "left_anti").select(*KEY, "score", F.lit(1).alias("filled"))
    every = chosen.select(*KEY, "score", F.lit(0).alias("filled")).unionByName(more)
    top = every.orderBy("filled", F.desc("score"), *KEY).limit(n)  # n rows: the numbering below is of those alone
    return top.withColumn("place", F.row_number().over(Window.orderBy("filled", F.desc("score"), *KEY)))
