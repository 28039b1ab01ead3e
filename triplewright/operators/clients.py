"""Model calls as an extension point: prompts from templates, a pluggable batch client, and replay of recorded answers.

A client is a function from a list of prompts to a list of answers (null where a call failed). It is made by
a factory inside each Python worker, so nothing but the factory is shipped. A recorded run is a table keyed by
the prompt's SHA-256 and replayed by a join, without Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions.parsing import definitions, read_triples

Client = Callable[[list[str]], list[str | None]]


def filled(template: str, **slots: Column | str) -> Column:
    """A prompt: ``template`` with each {name} replaced by a column; a null counts as empty. Braces of values stay as they are."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in slots if "{" + n + "}" in rest), default=(-1, ""))
        if at[0] < 0:
            parts.append(F.lit(rest))
            break
        c = slots[at[1]]
        parts += [F.lit(rest[: at[0]]), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def replayed(df: DataFrame, prompt: str, recorded: DataFrame) -> DataFrame:
    """``df`` with ``answer`` from ``recorded`` (prompt_sha256, answer); null where the run has none. Of several answers the least counts."""
    one = recorded.groupBy("prompt_sha256").agg(F.min("answer").alias("answer"))
    return df.withColumn("prompt_sha256", F.sha2(prompt, 256)).join(one, "prompt_sha256", "left").drop("prompt_sha256")


def answered(df: DataFrame, prompt: str, factory: Callable[[], Client], batch: int = 64) -> DataFrame:
    """``df`` with ``answer`` from a client, in batches; a batch that raises gives null answers, as a failed call does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            out: list[str | None] = []
            for at in range(0, len(pdf), batch):
                part = pdf[prompt].iloc[at : at + batch].tolist()
                try:
                    out += client(part)
                except Exception:  # noqa: BLE001  (whatever the client's library raises)
                    out += [None] * len(part)
            yield pdf.assign(answer=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, answer string")


def extracted(answers: DataFrame) -> DataFrame:
    """(doc_id, ord, s, r, o) from extraction answers (doc_id, answer); a null answer gives none."""
    t = read_triples(answers.select("doc_id", "answer"), "answer").select("doc_id", F.posexplode("triples").alias("ord", "t"))
    return t.select("doc_id", "ord", F.col("t")[0].alias("s"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))


def defined(answers: DataFrame) -> DataFrame:
    """(doc_id, name, definition) from definition answers (doc_id, answer)."""
    return answers.select("doc_id", F.inline(definitions("answer"))).select("doc_id", F.col("key").alias("name"), F.col("value").alias("definition"))
