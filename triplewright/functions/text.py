"""Column functions that clean and split text. All stay inside the JVM, in time linear in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of scraped pages that carry no prose (case is ignored).
NOISE_LINES = (
    r"^\|$",
    r"^(View Patient Education|Multimedia|About|Disclaimer|Cookie Preferences|quizzes_lightbulb_red|Test your Knowledge.*)$",
    r"^(video|multimedia|About|Disclaimer|Cookie Preferences)$",
    r"^follow us on (facebook|youtube|x|instagram)$",
    r"^Copyright©.*$",
    r"^(Reviewed By|Reviewed/Revised|ByErika F\.|Reviewed ByGlenn).*$",
    r"^(In this topic|Other topics in this chapter)$",
    r"^This icon serves as a link to download.*$",
    r"^Diabetes in children and adolescents is discussed in detail elsewhere\.$",
)

# Words after which a full stop does not end a sentence.
ABBREVIATIONS = ("eg", "ie", "al", "dr", "vs", "mr", "mrs", "ms", "prof", "u-500", "u-300", "u-100", "am", "pm")

# Markers of the final answer of a reasoning text.
ANSWER_MARKERS = (
    "Triplets:", "Final answer:", "Final Answer:", "FINAL ANSWER:", "Final triplets:", "Final Triplets:", "Output:", "Answer:",
    "ANSWER:", "So, the triples are:", "So, the triplets are:", "The triples are:", "The triplets are:", "Therefore, the triples",
    "In conclusion,", "To summarize,",
)


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def one_line(c: Column | str) -> Column:
    """Runs of white space become one blank."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def without_citations(c: Column | str) -> Column:
    """Citations such as (1, 2) and [3] with the blanks before them go."""
    return F.regexp_replace(F.regexp_replace(c, r"\s*\(\d+(?:\s*,\s*\d+)*\)", ""), r"\s*\[\d+(?:\s*,\s*\d+)*\]", "")


def repaired(c: Column | str) -> Column:
    """Citations go, and a bracket that touches two words gets its blank."""
    return F.regexp_replace(without_citations(c), r"([A-Za-z0-9_])\(([A-Za-z0-9_])", "$1 ($2")


def clean_prose(c: Column | str) -> Column:
    """Noise lines go, citations go, runs of empty lines become one, ends are stripped."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.struct(x.alias("raw"), strip(x).alias("bare")))
    noise = "(?i)" + "|".join(f"(?:{p})" for p in NOISE_LINES)
    kept = F.filter(lines, lambda x: ~x["bare"].rlike(noise) | (x["bare"] == ""))
    text = F.transform(kept, lambda x: F.when(x["bare"] == "", "").otherwise(without_citations(x["raw"])))
    blank = F.transform(text, lambda x: F.when(strip(x) == "", "").otherwise(x))
    shifted = F.concat(F.array(F.lit("x")), blank)  # each line beside the one before it; the last pair has no line
    pairs = F.zip_with(blank, shifted, lambda x, before: F.struct(x.alias("x"), before.alias("before")))
    runs = F.filter(pairs, lambda s: s["x"].isNotNull() & ~((s["x"] == "") & (s["before"] == "")))
    return strip(F.array_join(F.transform(runs, lambda s: s["x"]), "\n"))


def has_table(c: Column | str) -> Column:
    """Whether a Markdown table rule occurs."""
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\|[\s\-:]+\|")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once; a column named inside a lambda is computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _stretches(items: Column, ends: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of each stretch of ``items`` up to an element number in ``ends`` (rising, the last is that of all items)."""
    starts = F.concat(F.array(F.lit(1)), F.transform(ends, lambda e: e + 1))
    pairs = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["e"].isNotNull())
    return F.transform(pairs, lambda x: f(F.slice(items, x["s"], x["e"] - x["s"] + 1)))


def chunks(c: Column | str, most: int = 1500) -> Column:
    """Paragraphs packed in order; a chunk is closed when the next paragraph would pass ``most`` characters.

    The running length counts two more for each paragraph added to a chunk, but not for its first after a
    close. A paragraph above the limit stays whole. The fold keeps only the numbers of the last paragraphs.
    """
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("size"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["size"] + F.length(p) > most) & (acc["n"] > 0)
        ends = F.when(full, F.concat(acc["ends"], F.array(acc["n"]))).otherwise(acc["ends"])
        size = F.when(full, F.length(p)).otherwise(acc["size"] + F.length(p) + 2)
        return F.struct(ends.alias("ends"), size.alias("size"), (acc["n"] + 1).alias("n"))

    ends = lambda ps: F.aggregate(ps, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["ends"], F.array(acc["n"]))).otherwise(acc["ends"]))
    return let(paragraphs, lambda ps: let(ends(ps), lambda e: _stretches(ps, e, lambda x: F.array_join(x, "\n\n"))))


def sentences(c: Column | str) -> Column:
    """P10: split after ". ", "? " and "! ", unless the word before is an abbreviation. Whether a piece ends a sentence shows in the piece alone."""

    def closes(piece: Column) -> Column:
        word = F.lower(F.regexp_replace(F.regexp_extract(strip(piece), r"\S+$", 0), r"[^A-Za-z0-9_\-]", ""))
        return piece.rlike(r"[.?!]$") & ~word.isin(*ABBREVIATIONS)

    def joined(ps: Column) -> Column:
        n = F.size(ps)
        numbered = F.transform(ps, lambda x, i: F.when(closes(x) | (i == n - 1), i + 1))
        return let(F.array_compact(numbered), lambda ends: F.filter(_stretches(ps, ends, lambda x: strip(F.array_join(x, " "))), lambda x: x != ""))

    return let(F.split(c, r"(?<=[.?!]) "), joined)


def without_thinking(c: Column | str) -> Column:
    """Balanced thinking tags, then an unclosed tail, then stray closing tags go."""
    x = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    return strip(F.replace(F.regexp_replace(x, r"(?s)<think>.*$", ""), F.lit("</think>"), F.lit("")))


def final_answer(c: Column | str, tail: int = 600) -> Column:
    """From the last of the markers on, else the last ``tail`` characters."""
    c = F.col(c) if isinstance(c, str) else c
    places = [F.when(F.contains(c, F.lit(m)), F.length(c) - F.instr(F.reverse(c), m[::-1]) - len(m) + 2).otherwise(0) for m in ANSWER_MARKERS]
    at = F.greatest(*places)
    return F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(F.right(c, F.lit(tail)))


def corrected(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements in order; later rules see what earlier ones wrote."""
    out = F.col(c) if isinstance(c, str) else c
    for old, new in rules:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def tidy_rewrite(c: Column | str) -> Column:
    """Lines of a rewritten text without blank lines, introductions, bullets and numbers."""
    lines = F.transform(F.split(c, "\n"), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike("^(here are|resolved)"))
    return F.transform(kept, lambda x: strip(F.regexp_replace(x, r"^(?:[-*•]\s*|\d+[.)]\s*)", "")))


def _below(lines: Column, head: Callable[[Column], Column], f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each line that is no head and what ``head`` gives for the nearest head above it ("" if there is none).

    ``head`` is null for other lines. Lines are cut at the heads, so each is looked at once.
    """

    def cut(ls: Column) -> Column:
        marks = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), head(x).alias("said"))), lambda m: m["said"].isNotNull())
        marks = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("said"))), marks)
        n = F.size(ls)

        def part(ms: Column) -> Column:
            ends = F.concat(F.slice(F.transform(ms, lambda m: m["i"]), 2, F.size(ms)), F.array(n))
            spans = F.zip_with(ms, ends, lambda m, e: F.struct(m["said"].alias("said"), F.slice(ls, m["i"] + 2, e - m["i"] - 1).alias("lines")))
            return F.flatten(F.transform(spans, lambda s: F.transform(s["lines"], lambda x: f(x, s["said"]))))

        return let(marks, part)

    return let(lines, cut)


def sections(c: Column | str) -> Column:
    """Lines of Markdown with the path of headings (levels 1 to 3) above them, as (path, line).

    Headings are first given their paths, in a fold over the headings alone.
    """
    lines = F.split(c, "\n")
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,3}) ", 1))
    start = F.struct(F.array().cast("array<string>").alias("paths"), F.lit("").alias("h1"), F.lit("").alias("h2"), F.lit("").alias("h3"))

    def step(acc: Column, line: Column) -> Column:
        title = F.regexp_extract(line, r"^#{1,3} +(.*)$", 1)
        h1 = F.when(level(line) == 1, title).otherwise(acc["h1"])
        h2 = F.when(level(line) == 2, title).when(level(line) == 1, "").otherwise(acc["h2"])
        h3 = F.when(level(line) == 3, title).otherwise("")
        named = F.filter(F.array(*(F.when(h != "", F.concat(F.lit(f"Header {n}: "), h)) for n, h in ((1, h1), (2, h2), (3, h3)))), lambda x: x.isNotNull())
        return F.struct(F.concat(acc["paths"], F.array(F.array_join(named, " > "))).alias("paths"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"))

    def placed(ls: Column) -> Column:
        heads = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: level(m["x"]) > 0)

        def cut(hs: Column) -> Column:
            paths = F.concat(F.array(F.lit("")), F.aggregate(F.transform(hs, lambda h: h["x"]), start, step, lambda acc: acc["paths"]))
            starts = F.concat(F.array(F.lit(-1)), F.transform(hs, lambda h: h["i"]))
            ends = F.concat(F.transform(hs, lambda h: h["i"]), F.array(F.size(ls)))
            after = F.zip_with(starts, ends, lambda s, e: F.slice(ls, s + 2, e - s - 1))
            spans = F.zip_with(paths, after, lambda p, x: F.struct(p.alias("path"), x.alias("lines")))
            rows = F.transform(spans, lambda z: F.transform(F.filter(z["lines"], lambda x: strip(x) != ""), lambda x: F.struct(z["path"].alias("path"), x.alias("line"))))
            return F.flatten(rows)

        return let(heads, cut)

    return let(lines, placed)


# What shows that a line is a reference to literature.
REFERENCE = r"(?i)doi:|vol\.|\d{4};\d+"


def list_sentences(c: Column | str) -> Column:
    """Lines that introduce a list with a colon are joined with each item; short lines without a full stop are headings
    and go, as do references to literature outside lists."""

    def head(line: Column) -> Column:
        heading = (line.rlike(r"^\d+\.\s+") | ((F.length(line) < 60) & ~line.endswith("."))) & ~line.startswith("-")
        return F.when(line.endswith(":"), F.regexp_replace(line, r"\s*:$", "")).when(heading & (line != ""), "")

    def said(line: Column, intro: Column) -> Column:
        item = strip(F.regexp_replace(line, r"^-\s*", ""))
        return F.when((line == "") | (intro == "") & line.rlike(REFERENCE), None).when(intro != "", F.concat(intro, F.lit(" "), item)).otherwise(item)

    return F.array_compact(_below(F.transform(F.split(repaired(c), "\n"), strip), head, said))
