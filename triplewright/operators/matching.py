"""Linking of terms to nodes, retrieval by vectors, and vocabulary look-up.

Term-by-node rules that compare parts of words can't be hashed; they are joined on shared words or grams
first, which is exact for them, and the rule then filters the few candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.functions.entities import STOPWORDS
from triplewright.functions.parsing import read_triples

# Words that link nothing.
LINK_STOPWORDS = ("disease", "diseases", "mellitus", "type", "in", "of", "and", "or", "patients", "with")
GRAM = 3
SCHEMA_BLOCK = 1024


def words(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def candidates(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q11, Q12: (term, id) where the term or an id/alias contains the other, or two words that count are shared.

    If one name contains the other, all grams of the shorter occur in the longer, so both sides meet on the
    shorter one's gram that the fewest of the others hold; names below the gram length are grams themselves.
    Shared words meet on each side's words. Distinct spellings are compared once, then expanded to
    terms and ids. An empty term links nothing.
    """
    named = nodes.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("name")).select("id", F.lower(F.trim("name")).alias("n")).where("n <> ''").distinct()
    said = terms.select("term", F.lower(F.trim("term")).alias("t")).where("t <> ''").distinct()
    n, t = named.select("n").distinct(), said.select("t").distinct()
    inside = _holding(t, "t", n, "n")
    around = _holding(n, "n", t, "t")
    useful = lambda c: F.filter(words(c), lambda w: ~w.isin(*LINK_STOPWORDS))
    by_word = t.withColumn("w", F.explode(useful("t"))).join(n.withColumn("w", F.explode(useful("n"))), "w")
    shared = by_word.groupBy("t", "n").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    pairs = reduce(DataFrame.unionByName, (x.select("t", "n") for x in (inside, around, shared))).distinct()
    return said.join(pairs, "t").join(named, "n").select("term", "id").distinct()


def _holding(short: DataFrame, s: str, long: DataFrame, c: str) -> DataFrame:
    """Pairs of strings of which the second contains the first."""
    grams = lambda x, size: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - size + 1, F.lit(1))), lambda i: F.substring(F.col(x), i, size))
    every = long.withColumn("g", F.explode(F.array_distinct(F.concat(*(grams(c, F.lit(k)) for k in range(1, GRAM + 1))))))
    often = every.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    own = short.withColumn("g", F.explode(F.array_distinct(grams(s, F.least(F.length(s), F.lit(GRAM))))))
    rarest = own.join(often, "g", "left").groupBy(s).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")).alias("m"))
    key = rarest.where("m.often > 0").select(s, F.col("m.g").alias("g"))
    return key.join(every, "g").where(F.contains(F.col(c), F.col(s))).select(s, c)


def missing(terms: DataFrame, found: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """Q23: terms of more than three characters, not in the stop list, that no node covers."""
    return terms.where((F.length("term") > 3) & ~F.lower("term").isin(*stop)).join(found, "term", "left_anti")


def resolve(terms: DataFrame, nodes: DataFrame, least: float = 0.4) -> DataFrame:
    """Q17, Q21: the node of each term: exact id or alias, else the best word Jaccard plus 0.1 for containment, from ``least`` on."""
    names = nodes.select("id", F.explode(F.concat(F.array("name"), "aliases")).alias("name")).select("id", F.lower("name").alias("n")).distinct()
    t = terms.select("term", F.lower("term").alias("t")).distinct()
    exact = t.join(names, F.col("t") == F.col("n")).groupBy("term").agg(F.min("id").alias("id")).withColumn("score", F.lit(1.1))
    rest = t.join(exact, "term", "left_anti")
    pairs = rest.withColumn("w", F.explode(words("t"))).join(names.withColumn("w", F.explode(words("n"))), "w").select("term", "t", "id", "n").distinct()
    bonus = F.when(F.contains("t", F.col("n")) | F.contains("n", F.col("t")), 0.1).otherwise(0.0)
    scored = pairs.select("term", "id", (jaccard(words("t"), words("n")) + bonus).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("minus"), "id")).alias("m")).select("term", F.col("m.id").alias("id"), (-F.col("m.minus")).alias("score"))
    return exact.select("term", "id", "score").unionByName(best)


def grounded(terms: DataFrame, names: DataFrame, least: float = 0.35) -> DataFrame:
    """Q21: terms with ``grounded``: whether the words shared with some name are ``least`` of the words of both.

    Commas and parentheses separate words. Both sides meet on a shared word.
    """
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.translate(c, ",()", "   ")), r"\s+"), lambda w: w != ""))
    t = terms.select("term").distinct().withColumn("tw", split("term"))
    n = names.select(split("name").alias("nw")).distinct()
    met = t.withColumn("w", F.explode("tw")).join(n.withColumn("w", F.explode("nw")), "w").select("term", "tw", "nw").distinct()
    hit = met.where(jaccard(F.col("tw"), F.col("nw")) >= least).select("term").distinct().withColumn("hit", F.lit(True))
    return t.select("term").join(hit, "term", "left").select("term", F.coalesce("hit", F.lit(False)).alias("grounded"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, schema: DataFrame, k: int) -> DataFrame:
    """The k schema rows (name, vector) of the greatest dot product per query (id, vector), ties by name.

    The schema is a few dozen definitions, so every task holds it whole as one array; queries aren't shuffled
    and the cut is taken inside each row. A larger one is cut into blocks of about ``SCHEMA_BLOCK`` rows; each
    gives its best k, and these are merged per query (ids are then taken to be unique).
    """
    block = F.pmod(F.xxhash64("name"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / SCHEMA_BLOCK)))
    rows = schema.withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct("name", F.col("vector").alias("v"))).alias("all"))
    scored = F.transform("all", lambda s: F.struct((-dot(F.col("vector"), s["v"])).alias("minus"), s["name"].alias("name")))
    near = queries.join(F.broadcast(rows)).select("id", F.slice(F.array_sort(scored), 1, k).alias("near"))
    if schema.count() > SCHEMA_BLOCK:  # each block gave its best k: merge them
        near = near.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    best = near.select("id", F.posexplode("near").alias("pos", "m"))
    return best.select("id", (F.col("pos") + 1).alias("place"), F.col("m.name").alias("name"), (-F.col("m.minus")).alias("score"))


def canonicalise(items: DataFrame, schema: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items (id, name, definition): an exact schema name stays; without a definition there is none; else
    the recorded choice among (candidate, swap) options decides. Unmatched names with a definition enrich the
    schema in one further pass: ``enriched`` marks the first occurrence of each.
    """
    known = schema.select(F.col("name"), F.lit(True).alias("known"))
    x = items.join(F.broadcast(known), "name", "left").join(chosen.select("id", F.col("name").alias("choice"), "swap"), "id", "left")
    canon = F.when(F.col("known"), F.col("name")).when(F.col("definition").isNull(), None).otherwise(F.col("choice"))
    x = x.withColumn("canon", canon).withColumn("swap", F.coalesce("swap", F.lit(False)) & F.col("known").isNull() & canon.isNotNull())
    new = F.col("canon").isNull() & F.col("definition").isNotNull()
    first = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    open_ = x.where(new).withColumn("enriched", first == 1).withColumn("canon", F.col("name"))
    return x.where(~new).withColumn("enriched", F.lit(False)).unionByName(open_).select("id", "name", "canon", "swap", "enriched")


def slot_types(entries: DataFrame, names: DataFrame, target: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries with their types in the canonical spelling of ``names`` (type, canon), and the counts of slots.

    Both slots go through one look-up. ``target``: only entries whose two types are among these stay.
    """
    slots = entries.select("doc_id", "ord", F.explode(F.array(F.struct(F.lit("subject").alias("slot"), F.col("subject_type").alias("type")), F.struct(F.lit("object").alias("slot"), F.col("object_type").alias("type")))).alias("x")).select("doc_id", "ord", "x.*")
    found = slots.join(names, "type", "left")
    counts = found.agg(F.count_if(F.col("canon").isNotNull()).alias("aligned"), F.count_if(F.col("canon").isNull()).alias("failed"))
    back = found.groupBy("doc_id", "ord").agg(*(F.max(F.when(F.col("slot") == s, F.col("canon"))).alias(f"{s}_type_canon") for s in ("subject", "object")))
    out = entries.drop("subject_type_canon", "object_type_canon").join(back, ["doc_id", "ord"])
    if target is not None:
        out = out.where(F.col("subject_type_canon").isin(*target) & F.col("object_type_canon").isin(*target))
    return out, counts


def nearest_type(names: DataFrame, types: DataFrame) -> DataFrame:
    """(id, type) of the type whose vector has the greatest cosine with the name's; Unknown for a zero vector, the first ``pos`` on ties.

    Types are the few entity types of a schema: each task holds them as one array.
    """
    norm = lambda c: F.sqrt(dot(c, c))
    every = F.broadcast(types.agg(F.collect_list(F.struct("pos", "type", F.col("vector").alias("v"))).alias("all")))
    scored = F.transform("all", lambda t: F.struct((-F.try_divide(dot(F.col("vector"), t["v"]), norm(t["v"]))).alias("minus"), t["pos"].alias("pos"), t["type"].alias("type")))
    best = F.array_min(F.filter(scored, lambda t: t["minus"].isNotNull()))
    return names.join(every).select("id", F.when(norm(F.col("vector")) == 0, "Unknown").otherwise(F.coalesce(best["type"], F.lit("Unknown"))).alias("type"))


def options(candidates: DataFrame) -> DataFrame:
    """Two options per candidate, as it is and with subject and object exchanged, lettered in order."""
    both = candidates.select("id", "place", "name", F.explode(F.array(F.lit(False), F.lit(True))).alias("swap"))
    n = (F.col("place") - 1) * 2 + F.col("swap").cast("int")
    return both.withColumn("letter", F.char(n + 65))


def vocabulary_hits(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vocabulary rows (code, name, pos) of a term by the first strategy that has any: exact, normalised, words; at most ten."""
    norm = lambda c: F.array_join(F.array_sort(words(c)), " ")
    t = terms.select("term").distinct()
    exact = t.join(vocab, F.col("term") == F.col("name")).withColumn("strategy", F.lit(0))
    normal = t.join(vocab, norm("term") == norm("name")).withColumn("strategy", F.lit(1))
    by_word = t.withColumn("w", F.explode(words("term"))).join(vocab.withColumn("w", F.explode(words("name"))), "w").groupBy("term", *vocab.columns).agg(F.count(F.lit(1)).alias("k"))
    by_word = by_word.where(F.col("k") == F.size(words("term"))).drop("k").withColumn("strategy", F.lit(2))
    every = exact.unionByName(normal).unionByName(by_word)
    w = Window.partitionBy("term")
    page = F.row_number().over(w.orderBy("strategy", "pos")) - 1
    return every.withColumn("least", F.min("strategy").over(w)).where("strategy = least").withColumn("idx", page).where("idx < 10").drop("least")


# Semantic types that a term may be mapped to, and those that each label allows.
SAFE_TYPES = ("T047", "T184", "T033", "T037", "T121", "T200", "T116", "T125", "T109", "T123", "T061", "T059", "T060", "T023", "T029", "T034", "T081")
LABEL_TYPES = {
    "Disease": ("T047", "T184", "T033", "T037"),
    "Symptom": ("T047", "T184", "T033", "T037"),
    "Drug": ("T121", "T200", "T116", "T125", "T109", "T123"),
    "Anatomical Site": ("T023", "T029"),
    "Clinical Metric": ("T034", "T081", "T059", "T060", "T061"),
    "Treatment Procedure": ("T061", "T060", "T059", "T034", "T081"),
}

# Words too common to be a document's context.
CONTEXT_STOPWORDS = ("the", "and", "a", "of", "in", "to", "for", "with", "on", "at", "by", "an", "is", "or", "that", "this", "are", "was", "were", "be", "been")


def context_words(triples: DataFrame, most: int = 60) -> DataFrame:
    """One row with ``context``: of the ``most`` commonest words of subjects and objects (s, o), those that count.

    Ties go to the lesser word.
    """
    found = triples.select(F.explode(F.array("s", "o")).alias("x")).select(F.explode(F.regexp_extract_all(F.lower("x"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    top = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most)
    return top.where(~F.col("w").isin(*CONTEXT_STOPWORDS) & (F.length("w") > 2)).agg(F.array_sort(F.collect_list("w")).alias("context"))


def rerank(hits: DataFrame, context: Column | None = None) -> DataFrame:
    """Lexical score of each hit, best first with ``rank``; earlier hits win ties. ``context``: words that raise names which hold them."""
    t, n = F.lower("term"), F.lower("name")
    tw, nw = F.array_distinct(F.split(t, " ")), F.array_distinct(F.split(n, " "))
    lexical = F.when(n == t, 10.0).when(n.startswith(F.concat(t, F.lit(" "))) | n.endswith(F.concat(F.lit(" "), t)), 5.0).when(F.contains(n, t), 2.0).otherwise(0.0)
    overlap = 3.0 * F.size(F.array_intersect(tw, nw)) / F.size(tw)
    odd = F.when(F.contains("name", F.lit("^")) | (F.length("name") - F.length(F.replace("name", F.lit(":"), F.lit(""))) >= 2), 8.0).otherwise(0.0)
    long = F.when((F.size(nw) > 2 * F.size(tw)) & (F.size(tw) <= 3), 4.0).otherwise(0.0)
    extra = 1.5 * F.greatest(F.size(nw) - F.size(tw), F.lit(0))
    near = F.lit(0.0)
    if context is not None:
        near = F.least(F.lit(4.0), 1.5 * F.size(F.array_intersect(F.filter(nw, lambda w: ~w.isin(*STOPWORDS)), context)))
    score = 0.1 - 0.01 * F.col("idx") + lexical + overlap + near - odd - long - extra
    scored = hits.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "idx")))


def accept(ranked: DataFrame, safe: tuple[str, ...] = SAFE_TYPES, least: float = 3.0, labels: str | None = None) -> DataFrame:
    """Of the best five hits the first that scores ``least``, has a safe type and, if one of its ``labels`` (an array
    column) is specific, a type that one of these allows."""
    ok = (F.col("rank") <= 5) & (F.col("score") >= least) & F.col("type").isin(*safe)
    if labels is not None:
        own = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in LABEL_TYPES.items())))
        allowed = F.flatten(F.filter(F.transform(F.coalesce(F.col(labels), F.array().cast("array<string>")), lambda l: F.try_element_at(own, l)), lambda x: x.isNotNull()))
        ok &= (F.size(allowed) == 0) | F.array_contains(allowed, F.col("type"))
    return ranked.where(ok).groupBy("term").agg(F.min_by(F.struct("code", "name", "score", "type"), "rank").alias("m")).select("term", "m.*")


# Sources of definitions, best first; any other comes last.
DEFINITION_SOURCES = ("NCI", "MSH", "CHV")


def definition_of(entries: DataFrame) -> DataFrame:
    """(code, definition) from (code, source, value, pos): the first non-empty value of the best source."""
    value = F.trim("value")
    known = F.upper("source")
    priority = F.coalesce(*(F.when(known == x, i) for i, x in enumerate(DEFINITION_SOURCES)), F.lit(len(DEFINITION_SOURCES)))
    return entries.where(value != "").groupBy("code").agg(F.min_by(value, F.struct(priority, "pos")).alias("definition"))


def source_codes(atoms: DataFrame, sources: tuple[str, ...] = ("ICD10CM", "RXNORM")) -> DataFrame:
    """Per code its first atom's identifier of each source (last part of its path), NONE without one; columns are named by source."""
    own = atoms.select("code", "source", "pos", F.element_at(F.split("path", "/"), -1).alias("x"))
    firsts = own.groupBy("code").agg(*(F.min_by(F.when(F.col("source") == s, F.col("x")), F.when(F.col("source") == s, F.col("pos"))).alias(s) for s in sources))
    return firsts.select("code", *(F.when(F.coalesce(F.col(s), F.lit("")) == "", "NONE").otherwise(F.col(s)).alias(s) for s in sources))


def map_triples(triples: DataFrame, resolved: DataFrame, metric_types: tuple[str, ...], drug_types: tuple[str, ...]) -> DataFrame:
    """Subjects and objects by their accepted names; a subject whose type contradicts "treated by" stays raw."""
    r = lambda n: resolved.select(F.col("term").alias(n), F.col("name").alias(f"{n}_name"), F.col("type").alias(f"{n}_type"))
    x = triples.join(r("s"), "s", "left").join(r("o"), "o", "left")
    key = F.replace(F.upper("r"), F.lit(" "), F.lit("_"))
    wrong = (key == "TREATED_BY") & F.col("s_type").isin(*metric_types, *drug_types) | (key == "CONTRAINDICATED_WITH") & F.col("s_type").isin(*metric_types)
    own = [c for c in triples.columns if c not in ("s", "r", "o")]
    return x.select(*own, "s", F.when(wrong, F.col("s")).otherwise(F.coalesce("s_name", "s")).alias("subject"), "r", F.coalesce("o_name", "o").alias("object"))


def map_lines(lines: DataFrame, resolved: DataFrame, metric_types: tuple[str, ...], drug_types: tuple[str, ...]) -> DataFrame:
    """Lines (doc_id, text) that hold literal lists of triples, with all triples mapped, as (doc_id, text, mapped).

    ``text`` is the mapped list as JSON, ``mapped`` whether the line could be read; a line that could not, or that
    is empty, passes as it is.
    """
    read = read_triples(lines.select("doc_id", "text"), "text", "strict").withColumn("mapped", F.col("triples").isNotNull())
    t = read.select("doc_id", F.posexplode("triples").alias("ord", "t")).select("doc_id", "ord", F.col("t")[0].alias("s"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))
    done = map_triples(t, resolved, metric_types, drug_types).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("subject", "r", "object").alias("t")))).alias("x"))
    json = F.coalesce(F.to_json(F.transform("x", lambda e: e["t"])), F.lit("[]"))
    return read.join(done, "doc_id", "left").select("doc_id", F.when(F.col("mapped"), json).otherwise(F.col("text")).alias("text"), "mapped")


def enriched(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Nodes (term) with code, name, type; what is missing is NONE, the term itself and Unknown."""
    x = nodes.join(resolved, "term", "left")
    return x.select("term", F.coalesce("code", F.lit("NONE")).alias("code"), F.coalesce("name", "term").alias("canonical"), F.coalesce("type", F.lit("Unknown")).alias("type"))
