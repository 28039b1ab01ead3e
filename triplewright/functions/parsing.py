"""Column functions that read structure out of model responses."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions.text import strip

# Verdict words in the order in which they count, local ones first.
VERDICTS = (
    ("ĐÚNG", "CORRECT"), ("SAI", "INCORRECT"), ("KHÔNG_CHẮC_CHẮN", "UNCERTAIN"), ("KHÔNG CHẮC CHẮN", "UNCERTAIN"), ("INCORRECT", "INCORRECT"), ("WRONG", "INCORRECT"),
    ("FALSE", "INCORRECT"), ("UNCERTAIN", "UNCERTAIN"), ("UNSURE", "UNCERTAIN"), ("CORRECT", "CORRECT"), ("TRUE", "CORRECT"),
)
SAID = r"(?iu)\[?\s*(ĐÚNG|SAI|KHÔNG[_\s]?CHẮC[_\s]?CHẮN|CORRECT|INCORRECT|UNCERTAIN)\s*\]?"
SURE = r"(?iu)(?:ĐỘ[_\s]?TIN[_\s]?CẬY|CONFIDENCE|TIN\s*CẬY)\s*[:=]?\s*\[?\s*(?:ĐỘ[_\s]?TIN[_\s]?CẬY\s*[:=]?\s*)?(\d{1,3})\s*\]?"

# Words that a read-only graph query may not hold, and the relations that it may use.
WRITE_WORDS = ("CREATE", "MERGE", "DELETE", "REMOVE", "SET", "DROP", "APOC", "CALL", "LOAD", "CSV", "WRITE")
RELATIONS = (
    "IS_A", "HAS_ANATOMIC_SITE", "CAUSE_OF", "HAS_FINDING", "HAS_BIOMARKER", "CO_OCCURS_WITH", "TREATED_BY", "HAS_ADVERSE_EFFECT",
    "CONTRAINDICATED_WITH", "PREFERRED_OVER", "HAS_EVALUATION", "HAS_TITRATION_RULE", "INCREASES_RISK_OF", "ADMINISTERED_VIA", "DISPENSES",
)


def verdict_of(c: Column | str) -> Column:
    """The first word of the list that occurs; UNCERTAIN if none does."""
    x = F.upper(strip(c))
    out = F.lit("UNCERTAIN")
    for word, verdict in reversed(VERDICTS):
        out = F.when(F.contains(x, F.lit(word)), verdict).otherwise(out)
    return out


def _number(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.expr("try_cast(null as int)") if c is None else c.cast("int")))


def rating(c: Column | str) -> Column:
    """(verdict, confidence) from the last line that states a verdict.

    The confidence comes from that line, else from the lines up to two around it, else from the last bracketed
    number of the line; else it is 50. Without a verdict the rating is UNCERTAIN, 50.
    """
    lines = F.split(strip(c), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), strip(x).alias("x")))
    hits = F.filter(numbered, lambda s: s["x"].rlike(SAID))
    last = F.try_element_at(hits, F.lit(-1))
    line, at = last["x"], last["i"]
    near = F.filter(F.slice(lines, F.greatest(at - 1, F.lit(1)), F.lit(5) - F.greatest(F.lit(2) - at, F.lit(0))), lambda x: x.rlike(SURE))
    own = F.when(line.rlike(SURE), F.regexp_extract(line, SURE, 1))
    around = F.regexp_extract(F.try_element_at(near, F.lit(1)), SURE, 1)
    status = line.rlike(r"(?iu)(?:Trạng\s*thái|Status)\s*:\s*\[?\s*(?:ĐÚNG|SAI|KHÔNG|CORRECT|INCORRECT|UNCERTAIN)")
    bracket = F.try_element_at(F.regexp_extract_all(line, F.lit(r"\[\s*(\d{1,3})\s*\]"), F.lit(1)), F.lit(-1))
    confidence = F.coalesce(own, F.when(~status, around), bracket, F.lit("50"))
    return F.when(last.isNull(), F.struct(F.lit("UNCERTAIN").alias("verdict"), F.lit(50).alias("confidence"))).otherwise(F.struct(verdict_of(F.regexp_extract(line, SAID, 1)).alias("verdict"), _number(confidence).alias("confidence")))


def definitions(c: Column | str) -> Column:
    """X03, X05: "key: value" lines as entries; markdown marks go from the key, "Answer" is skipped, the last of a key wins."""
    pairs = F.transform(F.split(c, "\n"), lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, r"^([^:]*):", 1), r"^[\s*#`\-\d.]+|[\s*#`]+$", "").alias("key"), strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["key"] != "Answer") & (p["value"] != ""))
    return F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["key"] == p["key"]))


def json_span(c: Column | str, brackets: str = "{}") -> Column:
    """From the first opening to the last closing bracket; null if there is none."""
    open_, close = brackets
    found = F.regexp_extract(c, rf"(?s)(\{open_}.*\{close})", 1)
    return F.when(found != "", found)


def choice(c: Column | str, letters: str) -> Column:
    """The letter of an answer marker, else the last single capital, else the first valid character."""
    x = strip(c)
    marked = F.regexp_extract(x, r"[Aa]nswer\s*[:.=]?\s*([A-Z])", 1)
    single = F.filter(F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z])([A-Z])(?![A-Za-z])"), F.lit(1)), lambda l: F.contains(F.lit(letters), l))
    any_ = F.upper(F.regexp_extract(x, f"(?i)([{letters}])", 1))
    return F.coalesce(F.when((marked != "") & F.contains(F.lit(letters), marked), marked), F.try_element_at(single, F.lit(-1)), F.when(any_ != "", any_))


def query_problem(c: Column | str) -> Column:
    """X11: why a graph query is refused: write, relation, or null."""
    x = F.col(c) if isinstance(c, str) else c
    used = F.regexp_extract_all(x, F.lit(r"\[:([A-Z_]+)\]"), F.lit(1))
    bad = F.size(F.array_except(used, F.array(*map(F.lit, RELATIONS)))) > 0
    return F.when(F.upper(x).rlike(rf"\b({'|'.join(WRITE_WORDS)})\b"), "write").when(bad, "relation")


def query_ids(c: Column | str) -> Column:
    """Ids named in a graph query, in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\bid\s*[:=]\s*[\"']([^\"']+)[\"']"), F.lit(1)))


def literal_triples(line: str | None) -> list[list[str]]:
    """A list of triples written as a Python literal; an empty list if it can't be read."""
    try:
        found = ast.literal_eval(line or "")
        return [[str(x) for x in t] for t in found] if isinstance(found, list) and all(isinstance(t, (list, tuple)) for t in found) else []
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return []


def strict_triples(line: str | None) -> list[list[str]] | None:
    """A list of triples of strings written as a Python literal; null if it is anything else."""
    try:
        found = ast.literal_eval((line or "").strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    ok = isinstance(found, list) and all(isinstance(t, (list, tuple)) and len(t) == 3 and all(isinstance(x, str) for x in t) for t in found)
    return [list(t) for t in found] if ok else None


# Parts that say nothing.
BLANKS = ("", "_", "...")


def _bracketed(raw: str) -> Iterator[str]:
    """Every balanced stretch in square brackets, in the order in which they close."""
    depth: dict[int, int] = {}  # how deep, and where the bracket of that depth opened
    level = 0
    for m in re.finditer(r"[\[\]]", raw):
        if m[0] == "[":
            level += 1
            depth[level] = m.start()
        elif level:
            yield raw[depth[level] : m.end()]
            level -= 1


def _parts(span: str) -> list[str]:
    """The parts of a bracketed list of strings. Inner lists are joined by commas; a list that is no literal is cut at its
    commas if it holds no further brackets. Anything else has no parts."""
    try:
        found = ast.literal_eval(span)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        inside = span[1:-1]
        return [] if "[" in inside else [re.sub(r"^[\s'\"]+|[\s'\"]+$", "", x) for x in inside.split(",")]
    joined = [", ".join(map(str, x)) if isinstance(x, list) else x for x in found]
    return [x.strip() for x in joined] if all(isinstance(x, str) for x in joined) else []


def bracket_triples(raw: str | None) -> list[list[str]]:
    """Of all bracketed stretches, innermost first, those that read as three strings that say something.

    An unquoted list around others is no triple: its commas belong to the inner ones.
    """
    found = map(_parts, _bracketed(raw or ""))
    return [x for x in found if len(x) == 3 and not any(p in BLANKS for p in x)]


def read_triples(df: DataFrame, column: str, how: str = "brackets") -> DataFrame:
    """Rows of ``df`` with ``triples``: array of arrays; a bracket matcher has no built-in form, so batches go through pandas."""
    f = {"brackets": bracket_triples, "literal": literal_triples, "strict": strict_triples}[how]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(triples=pdf[column].map(f))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, triples array<array<string>>")
