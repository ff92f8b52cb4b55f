"""Reports as single documents: JSON and HTML, of many pairs or one, of duplicates, and rewritten after a deletion.

Every row is rendered where it lies, by expressions; one task then streams the finished
lines into the document in order. For reports too large for one file ``reports`` writes
them in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T
from ..operators import report as O
from . import reports

#: How many segments and windows of a pair are shown.
SHOWN_SEGMENTS, SHOWN_WINDOWS = 5, 6


def _document(lines: DataFrame, order: list[Column], head: str, tail: str, between: str = "", numbered: bool = False) -> DataFrame:
    """One partition with the head, the lines (column ``line``) in order and the tail; ``#`` in a line is its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        n = 0
        for x in batches:
            out = []
            for line in x["line"]:
                if line is None:
                    continue
                n += 1
                out.append((between if n > 1 else "") + (line.replace("\0", str(n)) if numbered else line))
            yield pd.DataFrame({"value": out}, dtype=object)
        yield pd.DataFrame({"value": [tail]})

    names = [f"__o{i}" for i in range(len(order))]
    keyed = lines.select("line", *[c.alias(n) for c, n in zip(order, names)])
    # A row without a line, so that there is a partition even without pairs.
    blank = lines.sparkSession.range(1).select(*[F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in keyed.columns])
    keyed = keyed.unionByName(blank)
    return keyed.repartition(1).sortWithinPartitions(*[F.col(n).asc_nulls_last() for n in names]).select("line").mapInPandas(run, "value string")


def _best_first(df: DataFrame) -> list[Column]:
    return [-F.coalesce(F.col("symmetric_similarity"), F.lit(-1.0)), F.col("video_a"), F.col("video_b")]


def _quoted(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def json_document(pairs: DataFrame, timestamp: str, warnings: list[str] | None = None, facts: dict[str, int] | None = None) -> DataFrame:
    """Lines of one JSON document: ``timestamp``, ``num_pairs``, ``warnings``, ``facts`` and ``video_pairs``, best first."""
    n = pairs.count()
    head = f'{{"timestamp": {_quoted(timestamp)}, "num_pairs": {n}, "warnings": [{", ".join(map(_quoted, warnings or []))}]'
    head += "".join(f", {_quoted(k)}: {int(v)}" for k, v in (facts or {}).items()) + ', "video_pairs": ['
    keep = [c for c in pairs.columns if c != "pair_id"]
    lines = pairs.select(F.to_json(F.struct(*keep)).alias("line"), "symmetric_similarity", "video_a", "video_b")
    return _document(lines, _best_first(lines), head, "]}", between=",")


def write_json_document(pairs: DataFrame, path: str, timestamp: str, warnings: list[str] | None = None, facts: dict[str, int] | None = None) -> None:
    json_document(pairs, timestamp, warnings, facts).write.mode("overwrite").text(path)


def pair_document(pairs: DataFrame, matches: DataFrame, key: str = "pair_id") -> DataFrame:
    """``key``, ``document``, ``summary``: each pair as a document of its own, with all of its matches in both directions."""
    entry = F.struct(*[c for c in matches.columns if c not in (key, "direction")])
    lists = matches.groupBy(key).agg(*[F.sort_array(F.collect_list(F.when(F.col("direction") == d, entry))).alias(n) for d, n in (("A_to_B", "matches_a_to_b"), ("B_to_A", "matches_b_to_a"))])
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(lists.schema[c].dataType))
    x = pairs.join(lists, key, "left").withColumn("matches_a_to_b", empty("matches_a_to_b")).withColumn("matches_b_to_a", empty("matches_b_to_a"))
    x = x.withColumn("matches_a_to_b_total", F.size("matches_a_to_b")).withColumn("matches_b_to_a_total", F.size("matches_b_to_a"))
    score = lambda c: F.format_string("%.4f", F.coalesce(F.col(c), F.lit(0.0)))
    told = F.concat_ws("\n", F.concat(F.lit("A in B: "), score("a_in_b")), F.concat(F.lit("B in A: "), score("b_in_a")), F.concat(F.lit("symmetric: "), score("symmetric_similarity")), F.concat(F.lit("relation: "), F.col("relation")))
    return x.select(key, F.to_json(F.struct(*[c for c in x.columns if c != key])).alias("document"), told.alias("summary"))


def relation_class(relation: str) -> Column:
    r = F.lower(F.col(relation))
    return F.when(r.contains("near"), "near-duplicate").when(r.contains("clip"), "clip").when(r.contains("partial"), "partial-overlap").otherwise("different")


def _items(items: Column, most: int, one, title: str, more: str) -> Column:  # noqa: ANN001
    """A list of the first ``most`` items, and how many more there are; nothing without items."""
    n = F.size(items)
    rest = F.when(n > most, F.concat(F.lit("<li>... "), (n - most).cast("string"), F.lit(f" {more}</li>"))).otherwise("")
    shown = F.concat(F.lit(f"<div><strong>{title}</strong><ul>"), F.array_join(F.transform(F.slice(items, 1, most), one), ""), rest, F.lit("</ul></div>"))
    return F.when(n > 0, shown).otherwise("")


def html_detail_rows(pairs: DataFrame) -> DataFrame:
    """``line``: the table row of each pair with its class, counts, lengths and first segments and windows.

    ``segments`` and ``windows`` are arrays of structs, as ``operators.report.pair_rows`` makes them; without them, and
    for pairs that have none, these parts are left out.
    """
    num = lambda c, f="%.4f": F.format_string(f, F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c in pairs.columns else F.lit("-")
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in pairs.columns else F.lit(0)
    f1 = lambda c: F.format_string("%.1f", c.cast("double"))
    f3 = lambda c: F.format_string("%.3f", c.cast("double"))
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    named = lambda s: F.concat(F.lit('<td title="'), T.html_escape(f"video_{s}_path"), F.lit('">'), T.html_escape(f"video_{s}"), F.lit("</td>"))
    segments, windows = F.lit(""), F.lit("")
    if "segments" in pairs.columns:
        names = pairs.schema["segments"].dataType.elementType.names
        a, b = (("source", "target") if "source_start" in names else ("a", "b"))
        one = lambda s: F.concat(F.lit("<li>A "), f1(s[f"{a}_start"]), F.lit("s - "), f1(s[f"{a}_end"]), F.lit("s, B "), f1(s[f"{b}_start"]), F.lit("s - "), f1(s[f"{b}_end"]), F.lit("s (similarity "), f3(s["avg_similarity"]), F.lit(", confidence "), f3(s["confidence"]), F.lit(")</li>"))
        segments = F.coalesce(_items(F.col("segments"), SHOWN_SEGMENTS, one, "Matched segments", "more segments"), F.lit(""))
    if "windows" in pairs.columns:
        way = lambda w: T.html_escape(F.coalesce(w["direction"], F.lit("combined")))
        one_w = lambda w: F.concat(F.lit("<li>"), way(w), F.lit(": "), f1(w["source_start"]), F.lit("s - "), f1(w["source_end"]), F.lit("s, matched "), f3(w["matched_frame_ratio"]), F.lit(", similarity "), f3(w["avg_similarity"]), F.lit("</li>"))
        windows = F.coalesce(_items(F.col("windows"), SHOWN_WINDOWS, one_w, "Time windows", "more windows"), F.lit(""))
    details = F.concat(
        F.lit("<details><summary>Details</summary><p>Frames A="), whole("total_frames_a").cast("string"), F.lit(", B="), whole("total_frames_b").cast("string"),
        F.lit("</p><p>Duration A="), num("duration_a", "%.1f"), F.lit("s, B="), num("duration_b", "%.1f"), F.lit("s</p><p>Mean similarity A to B="), num("avg_similarity_a_to_b"), F.lit(", B to A="), num("avg_similarity_b_to_a"),
        F.lit("</p><p>Raw max="), num("raw_similarity_max"), F.lit(", p95="), num("raw_similarity_p95"), F.lit("</p>"), segments, windows, F.lit("</details>"),
    )
    matches = (whole("matches_a_to_b_total") + whole("matches_b_to_a_total")).cast("string")
    label = F.concat(F.lit('<td><span class="'), relation_class("relation"), F.lit('">'), R.relation_label("relation"), F.lit("</span></td>"))
    row = F.concat(F.lit('<tr class="'), relation_class("relation"), F.lit('"><td>\0</td>'), named("a"), named("b"), td(num("a_in_b")), td(num("b_in_a")), td(num("symmetric_similarity")), label, td(whole("matched_segment_count").cast("string")), td(matches), td(details), F.lit("</tr>"))
    return pairs.select(row.alias("line"), "symmetric_similarity", "video_a", "video_b")


def html_document(pairs: DataFrame, timestamp: str = "", warnings: list[str] | None = None, title: str = "Video similarity report") -> DataFrame:
    """Lines of the HTML report: warnings, counts by class, and the pairs best first with their details."""
    import html

    c, n = O.relation_counters(pairs).first(), pairs.count()
    told = "".join(f"<li>{html.escape(w)}</li>" for w in warnings or [])
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>Generated: {html.escape(timestamp)}</p>"
    head += f"<ul class='warnings'>{told}</ul>" if told else ""
    head += f"<p class='summary'>pairs {n}, near duplicates {c['near']}, clips {c['clip']}, partial overlaps {c['partial']}, different {c['different']}</p>"
    columns = ("#", "Video A", "Video B", "A in B", "B in A", "Symmetric", "Relation", "Segments", "Frame matches", "Details")
    head += "<table><thead><tr>" + "".join(f"<th>{x}</th>" for x in columns) + "</tr></thead><tbody>"
    rows = html_detail_rows(pairs)
    return _document(rows, _best_first(rows), head, "</tbody></table></body></html>", numbered=True)


def write_html_document(pairs: DataFrame, path: str, timestamp: str = "", warnings: list[str] | None = None) -> None:
    html_document(pairs, timestamp, warnings).write.mode("overwrite").text(path)


def duplicate_html(groups: DataFrame) -> DataFrame:
    """One row ``value``: the page of a duplicate report, from groups with ``members``; it states counts only."""
    n = F.col("members").cast("long")
    facts = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long").alias("pairs"))
    page = F.format_string("<!doctype html><html><head><meta charset='utf-8'><title>Identical files</title></head><body><h1>Identical files</h1><p>Groups: %d</p><p>Pairs: %d</p></body></html>", "groups", "pairs")
    return facts.select(page.alias("value"))


def rewrite_report(pairs: DataFrame, doomed: DataFrame, folder: str, timestamp: str) -> int:
    """Deletes pairs from a report and writes its JSON, CSV (with paths) and HTML anew; the number of pairs that are left.

    ``pairs`` as read from a report; an error if nothing was deleted, and then nothing is written. The files are written
    beside what was read: give another folder than the one that ``pairs`` comes from.
    """
    a, b = (T.normalize_path(F.coalesce(F.nullif(F.trim(f"video_{s}_path"), F.lit("")), f"video_{s}")) for s in "ab")
    keyed = pairs.withColumn("pair_key", F.concat_ws("||", F.least(a, b), F.greatest(a, b)))
    left = O.delete_pairs_checked(keyed, doomed).drop("pair_key")
    write_json_document(left, f"{folder}/report.json", timestamp)
    reports.write_csv(left, f"{folder}/report.csv", with_paths=True)
    write_html_document(left, f"{folder}/report.html", timestamp)
    return left.count()


def search_documents(found: DataFrame, query: str = "query", name: str = "name", score: str = "similarity") -> DataFrame:
    """``query``, ``document``, ``text``: the ranked results of each query as JSON and as text with four decimals."""
    x = found.groupBy(F.col(query).alias("query")).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(name).alias("name")))).alias("r"))
    result = lambda s, i: F.struct((i + 1).alias("rank"), s["name"].alias("video"), F.round(-s["s"], 4).alias("score"))
    line = lambda s, i: F.format_string("%d. %s (score: %.4f)", i + 1, s["name"], -s["s"])
    doc = F.to_json(F.struct(F.col("query"), F.size("r").alias("num_results"), F.transform("r", result).alias("results")))
    return x.select("query", doc.alias("document"), F.array_join(F.transform("r", line), "\n").alias("text"))
