"""Property-graph construction: entity resolution and packing of values on nodes and edges.

Input rows carry an explicit order (doc_id, ord), as first and last occurrences decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.functions.entities import dedup_key, label
from triplewright.functions.values import clean_value, is_value, relation_key
from triplewright.operators.lineage import cut

ORDER = ["doc_id", "ord"]
# Semantic types and codes that tell drugs, tests and procedures.
DRUG_TYPES = ("T121", "T200", "T116", "T125")
DRUG_SUBJECT_TYPES = (*DRUG_TYPES, "T109", "T123")
LAB_TYPES = ("T059", "T060", "T061", "T034", "T081")
PROCEDURE_TYPES = ("T059", "T060")
PROCEDURE_CODES = ("C0474680", "C0202042", "C0583513")
METRIC_LABELS = ("Clinical Metric", "Treatment Procedure")
PROPERTIES = ("code", "canonical", "type", "target_threshold", "dosage_value")


def informative(c: Column) -> Column:
    """Null for what counts as missing: null, empty, NONE and Unknown."""
    return F.when(~c.isin("", "NONE", "Unknown"), c)


def type_map(entries: DataFrame) -> DataFrame:
    """(doc_id, key, type) from typed entries (doc_id, ord, subject, subject_type, object, object_type, *_canon); the last one wins."""
    slot = lambda s: F.struct(F.lower(F.trim(s)).alias("key"), label(F.coalesce(f"{s}_type_canon", f"{s}_type")).alias("type"), F.lit(0 if s == "subject" else 1).alias("slot"))
    rows = entries.select("doc_id", "ord", F.inline(F.array(slot("subject"), slot("object")))).where("key <> '' and type <> 'Unknown'")
    return rows.groupBy("doc_id", "key").agg(F.max_by("type", F.struct("ord", "slot")).alias("type"))


def split_values(triples: DataFrame) -> DataFrame:
    """(doc_id, ord, s, r, o) with ``key`` of the relation, ``is_value`` and the cleaned ``value``."""
    return triples.select(*ORDER, "s", "r", "o", relation_key("r").alias("key"), is_value("r", "o").alias("is_value")).withColumn("value", F.when(F.col("is_value"), clean_value("o")))


def first_nodes(split: DataFrame, types: DataFrame) -> DataFrame:
    """One node per end of a concept triple, at its first occurrence, labelled by the types of that document."""
    ends = split.where(~F.col("is_value")).select(*ORDER, F.posexplode(F.array("s", "o")).alias("slot", "id"))
    first = ends.groupBy("id").agg(F.min(F.struct("doc_id", "ord", "slot")).alias("seen"))
    keyed = first.select("id", "seen", F.col("seen.doc_id").alias("doc_id"), F.lower(F.trim("id")).alias("key"))
    return keyed.join(types, ["doc_id", "key"], "left").select("id", "seen", F.array_compact(F.array(F.lit("Concept"), "type")).alias("labels"))


def graph_nodes(split: DataFrame, types: DataFrame) -> DataFrame:
    """The ends of concept triples and the subjects of values that become properties, (id, seen, labels).

    ``seen`` orders a document's concept triples before its values, as nodes are made in that order.
    """
    concepts = split.where(~F.col("is_value")).select(*ORDER, F.lit(0).alias("turn"), F.posexplode(F.array("s", "o")).alias("slot", "id"))
    values = free_values(split).select(*ORDER, F.lit(1).alias("turn"), F.lit(0).alias("slot"), F.col("s").alias("id"))
    first = concepts.unionByName(values).groupBy("id").agg(F.min(F.struct("doc_id", "turn", "ord", "slot")).alias("seen"))
    keyed = first.select("id", "seen", F.col("seen.doc_id").alias("doc_id"), F.lower(F.trim("id")).alias("key"))
    return keyed.join(types, ["doc_id", "key"], "left").select("id", "seen", F.array_compact(F.array(F.lit("Concept"), "type")).alias("labels"))


def reverted(nodes: DataFrame, split: DataFrame) -> DataFrame:
    """Nodes (id, labels, code, canonical, type) without their vocabulary fields where these contradict a relation.

    The subject of "treated by" or "contraindicated with" is no procedure or metric unless it is labelled a
    disease or symptom, and the subject of "treated by" is no drug.
    """
    subjects = split.where(~F.col("is_value") & F.upper("key").isin("TREATED_BY", "CONTRAINDICATED_WITH"))
    subjects = subjects.groupBy(F.col("s").alias("id")).agg(F.bool_or(F.col("key") == "treated_by").alias("treated"))
    x = nodes.join(subjects, "id", "left")
    tuis = F.regexp_extract_all(F.coalesce("type", F.lit("")), F.lit(r"T\d{3}"), F.lit(0))
    holds = lambda a, values: F.arrays_overlap(a, F.array(*map(F.lit, values)))
    procedure = (holds(tuis, PROCEDURE_TYPES) | F.col("code").isin(*PROCEDURE_CODES) | holds("labels", METRIC_LABELS)) & ~holds("labels", ("Disease", "Symptom"))
    drug = F.col("treated") & (holds(tuis, DRUG_SUBJECT_TYPES) | F.array_contains("labels", "Drug"))
    bad = F.col("treated").isNotNull() & F.coalesce(procedure | drug, F.lit(False))
    raw = {"code": F.lit("NONE"), "canonical": F.col("id"), "type": F.lit("Unknown")}
    return x.select(*(F.when(bad, raw[c]).otherwise(F.col(c)).alias(c) if c in raw else F.col(c) for c in nodes.columns))


def titration_edges(split: DataFrame) -> DataFrame:
    """Titration edges with the document's last threshold of their object and last adjustment of their subject."""
    last = lambda keys, name, col: split.where(F.col("is_value") & F.col("key").isin(*keys) & F.col("value").isNotNull()).groupBy("doc_id", F.col("s").alias(name)).agg(F.max_by("value", F.struct("ord", "value")).alias(col))
    edges = split.where(~F.col("is_value") & (F.col("key") == "has_titration_rule"))
    thresholds = last(("has_clinical_threshold", "has_titration_rule"), "o", "threshold")
    adjustments = last(("has_dose_adjustment",), "s", "adjustment")
    return edges.join(thresholds, ["doc_id", "o"], "left").join(adjustments, ["doc_id", "s"], "left").select(*ORDER, "s", "key", "o", "threshold", "adjustment")


def free_values(split: DataFrame) -> DataFrame:
    """Values whose subject no titration edge of this or an earlier document touches."""
    titrated = split.where(~F.col("is_value") & (F.col("key") == "has_titration_rule"))
    since = titrated.select("doc_id", F.explode(F.array("s", "o")).alias("s")).groupBy("s").agg(F.min("doc_id").alias("since"))
    return split.where("value is not null").join(since, "s", "left").where("since is null or since > doc_id")


def value_properties(split: DataFrame) -> DataFrame:
    """Values that become properties of their subject: those whose subject no titration edge of this or an earlier document touches.

    The least document of a titration edge per end stands for all of them, so one join replaces the running check.
    """
    free = free_values(split)
    name = F.when(F.col("key").isin("has_clinical_threshold", "has_titration_rule"), "target_threshold").otherwise("dosage_value")
    return free.groupBy("s", name.alias("property")).agg(F.max_by("value", F.struct(*ORDER, "value")).alias("value"))


def canonical_ids(nodes: DataFrame) -> DataFrame:
    """Nodes (id, seen, code, canonical) with ``canon``: the canonical name of a code's first holder, else the first id of the same key.

    Codes and keys share one space; codes are matched as they are, names by their key.
    """
    coded = informative(F.col("code")).isNotNull()
    key = F.when(coded, F.col("code")).otherwise(dedup_key("id"))
    own = F.when(coded, F.coalesce(informative(F.col("canonical")), F.col("id"))).otherwise(F.col("id"))
    keyed = nodes.withColumn("_key", key).withColumn("_own", own)
    first = keyed.groupBy("_key").agg(F.min_by("_own", "seen").alias("canon"))
    return keyed.join(first, "_key").drop("_key", "_own")


def merge_nodes(nodes: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """One row per canon: labels and aliases united, of each property the first informative value by ``seen``."""
    firsts = [F.min_by(informative(F.col(p)), F.when(informative(F.col(p)).isNotNull(), F.col("seen"))).alias(p) for p in properties]
    merged = nodes.groupBy("canon").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"),
        F.array_sort(F.collect_set("id")).alias("ids"),
        F.min("seen").alias("seen"),
        *firsts,
    )
    return merged.withColumn("aliases", F.array_except("ids", F.array("canon"))).drop("ids")


# Words of a semantic type and the label that they imply.
TYPE_LABELS = (
    ("pharmacologic substance|clinical drug|amino acid, peptide, or protein|hormone|biologically active substance", "Drug"),
    ("disease or syndrome|injury or poisoning", "Disease"),
    ("sign or symptom|finding", "Symptom"),
    ("body part, organ, or organ component|body location or region", "Anatomical Site"),
    ("laboratory procedure|diagnostic procedure|therapeutic or preventive procedure", "Treatment Procedure"),
    ("laboratory or test result|quantitative concept", "Clinical Metric"),
)


def inferred_labels(labels: Column, semantic: Column) -> Column:
    """Labels implied by the semantic type if none is specific; Concept goes once there is another."""
    specific = F.filter(labels, lambda x: ~x.isin("Concept", "Unknown", ""))
    implied = F.array_compact(F.array(*(F.when(F.lower(semantic).rlike(words), F.lit(name)) for words, name in TYPE_LABELS)))
    found = F.when(F.size(specific) > 0, F.array_remove(labels, "Concept")).when(F.size(implied) > 0, F.array_union(F.array_remove(labels, "Concept"), implied)).otherwise(labels)
    return F.array_sort(found)


def alias_targets(merged: DataFrame) -> DataFrame:
    """(canon, target) for uncoded nodes whose key is that of a coded node's id or an alias; of several the last indexed one."""
    coded = informative(F.col("code")).isNotNull()
    names = merged.where(coded).select("canon", "seen", F.posexplode(F.concat("aliases", F.array("canon"))).alias("nth", "name"))
    index = names.groupBy(dedup_key("name").alias("key")).agg(F.max_by("canon", F.struct("seen", "nth")).alias("target"))
    return merged.where(~coded).select("canon", dedup_key("canon").alias("key")).join(index, "key").where("canon <> target").select("canon", "target")


def remap_edges(edges: DataFrame, canon: DataFrame, labels: DataFrame, scores: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Edges (doc_id, ord, s, key, o) between canonical nodes; self-loops go, the first of equal edges stays.

    A metric treated by a drug, by labels or by semantic types where ``labels`` has a ``type``, is turned round into
    "decreases". The confidence is that of the triple before any correction, by the keys of its ends, else 100.
    ``carried``: further columns that stay with an edge.
    """
    typed = "type" in labels.columns
    ends = lambda n: canon.select(F.col("id").alias(n), F.col("canon").alias(f"{n}_canon"))
    tags = lambda n: labels.select(F.col("canon").alias(f"{n}_canon"), F.col("labels").alias(f"{n}_labels"), (F.col("type") if typed else F.lit(None).cast("string")).alias(f"{n}_type"))
    e = edges.join(ends("s"), "s", "left").join(ends("o"), "o", "left")
    e = e.withColumn("s_canon", F.coalesce("s_canon", "s")).withColumn("o_canon", F.coalesce("o_canon", "o")).where("s_canon <> o_canon")
    e = e.join(tags("s"), "s_canon", "left").join(tags("o"), "o_canon", "left")
    of = lambda n, types: F.coalesce(F.col(f"{n}_type"), F.lit("")).rlike("|".join(types))
    metric = F.coalesce(F.arrays_overlap("s_labels", F.array(*map(F.lit, METRIC_LABELS))), F.lit(False)) | of("s", LAB_TYPES)
    drug = F.coalesce(F.array_contains("o_labels", "Drug"), F.lit(False)) | of("o", DRUG_TYPES)
    turn = (F.col("key") == "treated_by") & metric & drug & F.col("s_labels").isNotNull() & F.col("o_labels").isNotNull()
    e = e.join(scores.select(F.col("s").alias("_s"), F.col("key").alias("_k"), F.col("o").alias("_o"), "score"), (dedup_key("s") == F.col("_s")) & (F.col("key") == F.col("_k")) & (dedup_key("o") == F.col("_o")), "left")
    out = e.select(*ORDER, F.when(turn, F.col("o_canon")).otherwise(F.col("s_canon")).alias("src"), F.when(turn, "decreases").otherwise(F.col("key")).alias("rel"), F.when(turn, F.col("s_canon")).otherwise(F.col("o_canon")).alias("dst"), F.coalesce("score", F.lit(100.0)).alias("confidence"), *carried)
    order = Window.partitionBy("src", "rel", "dst").orderBy(*ORDER, "confidence")
    return out.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("src", "rel", "dst", "confidence", *carried)


def with_aliases_merged(merged: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes with the ones of ``targets`` merged into theirs: their names become aliases, their values fill gaps."""
    x = merged.join(targets, "canon", "left").withColumn("into", F.coalesce("target", "canon"))
    own = F.col("target").isNull()
    rank = F.struct((~own).cast("int").alias("guest"), "seen")
    firsts = [F.min_by(informative(F.col(p)), F.when(informative(F.col(p)).isNotNull(), rank)).alias(p) for p in PROPERTIES]
    out = x.groupBy("into").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("canon"))))).alias("names"),
        F.min(F.when(own, F.col("seen"))).alias("seen"),
        *firsts,
    )
    return out.withColumnRenamed("into", "canon").withColumn("aliases", F.array_sort(F.array_except("names", F.array_compact(F.array("canon", "canonical"))))).drop("names")


def pack_graph(triples: DataFrame, entries: DataFrame, vocabulary: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G18, the whole packer: nodes (id, labels, aliases, code, canonical, type, target_threshold, dosage_value) and edges
    (src, rel, dst, confidence, threshold, adjustment).

    Input: triples (doc_id, ord, s, r, o), typed entries as :func:`type_map` takes them, vocabulary rows (term, code,
    canonical, type; terms without one keep their name) and scores (s, key, o as keys of names; score).
    """
    split = cut(split_values(triples))
    nodes = graph_nodes(split, type_map(entries))
    known = vocabulary.select(F.col("term").alias("id"), "code", "canonical", "type")
    nodes = nodes.join(known, "id", "left").select("id", "seen", "labels", F.coalesce("code", F.lit("NONE")).alias("code"), F.coalesce("canonical", "id").alias("canonical"), F.coalesce("type", F.lit("Unknown")).alias("type"))
    nodes = reverted(nodes, split)
    values = value_properties(split).groupBy(F.col("s").alias("id")).agg(*(F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in ("target_threshold", "dosage_value")))
    named = cut(canonical_ids(nodes.join(values, "id", "left")))
    merged = cut(merge_nodes(named, PROPERTIES).withColumn("labels", inferred_labels(F.col("labels"), F.coalesce("type", F.lit("")))))
    targets = cut(alias_targets(merged))
    packed = with_aliases_merged(merged, targets)
    canon = named.select("id", "canon").join(targets, "canon", "left").select("id", F.coalesce("target", "canon").alias("canon"))
    rest = split.where(~F.col("is_value") & (F.col("key") != "has_titration_rule"))
    none = F.lit(None).cast("string")
    edges = titration_edges(split).unionByName(rest.select(*ORDER, "s", "key", "o", none.alias("threshold"), none.alias("adjustment")))
    edges = remap_edges(edges, canon, packed.select("canon", "labels", "type"), scores, ("threshold", "adjustment"))
    fill = lambda c, d: F.coalesce(c, d).alias(c)
    return packed.select(F.col("canon").alias("id"), "labels", "aliases", fill("code", F.lit("NONE")), fill("canonical", F.col("canon")), fill("type", F.lit("Unknown")), "target_threshold", "dosage_value"), edges


# Labels that a node may be loaded with.
NODE_LABELS = ("Disease", "Symptom", "Drug", "Treatment_Procedure", "Dosage_Value", "Clinical_Metric", "Biomarker", "Nutrient", "Clinical_Rule", "Risk_Factor", "Anatomical_Site")


def loadable_nodes(nodes: DataFrame, allowed: tuple[str, ...] = NODE_LABELS) -> DataFrame:
    """Nodes with their ``labels`` in the allowed spelling, case, blanks and dashes aside; nodes without any don't load."""
    key = lambda c: F.lower(F.translate(F.trim(c), " -", "__"))
    spelt = F.create_map(*(F.lit(x) for label_ in allowed for x in (label_.lower(), label_)))
    known = F.array_sort(F.array_distinct(F.array_compact(F.transform("labels", lambda x: F.try_element_at(spelt, key(x))))))
    return nodes.withColumn("labels", known).where(F.size("labels") > 0)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace what is stored column by column where they have a value; other rows stay."""
    a, b = stored.alias("a"), new.alias("b")
    cols = [c for c in stored.columns if c not in keys]
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in cols))


def loadable_edges(edges: DataFrame, nodes: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """Edges of the allowed relations whose ends both exist, once each."""
    ids = nodes.select("id")
    kept = edges.withColumn("rel", F.upper("rel")).where(F.col("rel").isin(*relations))
    kept = kept.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Violations of the uniqueness of (label, id)."""
    return nodes.groupBy("label", "id").count().where("count > 1")
