"""Subtitle files as cues."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The fields of a dialogue line where no format line came before.
DEFAULT_FIELDS = ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")


def _normal(text: str):  # noqa: ANN202
    return F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")


def timed_cues(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cues of SRT and VTT texts: ``key``, ``cue`` (block number), ``start``, ``end``, ``text``.

    Blocks are separated by blank lines; the first line with an arrow holds the times. Blocks without readable times,
    not ending after their start, or without text are dropped. Null texts have no cues.
    """
    body = F.regexp_replace(_normal(text), "(?i)^WEBVTT[^\n]*(?:\n|$)", "")
    blocks = files.select(F.col(key).alias("k"), F.posexplode(F.split(body, "\n{2,}")).alias("cue", "block")).where(F.contains("block", F.lit("-->")))
    lines = F.filter(F.transform(F.split("block", "\n"), T.strip_blanks), lambda x: x != "")
    b = blocks.select("k", "cue", lines.alias("l"))
    at = F.array_position(F.transform("l", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    b = b.withColumn("at", at).withColumn("time", F.get("l", F.col("at") - 1))
    start = T.subtitle_seconds(F.get(F.split("time", "-->"), F.lit(0)))
    end = T.subtitle_seconds(F.get(F.split(T.strip_blanks(F.get(F.split("time", "-->"), F.lit(1))), f"{T.BLANK}+"), F.lit(0)))
    said = T.clean_subtitle(F.array_join(F.slice("l", F.col("at") + 1, F.size("l")), "\n"))
    cues = b.select(F.col("k").alias(key), "cue", start.alias("start"), end.alias("end"), said.alias("text"))
    return cues.where((F.col("end") > F.col("start")) & (F.col("text") != ""))


def _dialogues(lines: list[str]) -> Iterator[tuple[int, str, str, str]]:
    fields = list(DEFAULT_FIELDS)
    for n, raw in enumerate(lines):
        line = raw.strip()
        head, _, rest = line.partition(":")
        if head.lower() == "format":
            fields = [f.strip().lower() for f in rest.split(",")]
        elif head.lower() == "dialogue":
            values = [v.strip() for v in rest.strip().split(",", max(0, len(fields) - 1))]
            named = dict(zip(fields, values))
            yield n, named.get("start", ""), named.get("end", ""), named.get("text", values[-1] if values else "")


def styled_cues(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cues of ASS and SSA texts. A format line names the fields of what follows it; the last field keeps its commas.

    Only the walk through the lines, where a line depends on an earlier one, is done in Python, a file at a time;
    times and texts are read by the same expressions as those of other subtitles.
    """
    rows = files.select(F.col(key).alias("k"), _normal(text).alias("t")).where("t is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:  # noqa: ANN001
        import pandas as pd

        for x in batches:
            out = [(k, *d) for k, t in zip(x["k"], x["t"]) for d in _dialogues(t.split("\n"))]
            yield pd.DataFrame(out, columns=["k", "cue", "s", "e", "raw"])

    raw = rows.mapInPandas(run, f"k {kind}, cue int, s string, e string, raw string")
    said = F.regexp_replace(F.regexp_replace("raw", r"\\[Nn]", "\n"), r"\{[^}]*\}", "")
    cues = raw.select(F.col("k").alias(key), "cue", T.subtitle_seconds("s").alias("start"), T.subtitle_seconds("e").alias("end"), T.clean_subtitle(said).alias("text"))
    return cues.where((F.col("end") > F.col("start")) & (F.col("text") != ""))


def subtitle_cues(files: DataFrame, key: str = "doc_id", text: str = "text", extension: str = "extension") -> DataFrame:
    """Cues of files of any kind, by extension."""
    styled = F.lower(F.col(extension)).isin("ass", "ssa")
    return timed_cues(files.where(~styled), key, text).unionByName(styled_cues(files.where(styled), key, text))
