"""Relation labels of a pair of videos, and ratios as reports give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and thresholds of the two rule sets.
CLIP_OF_A = "B_is_likely_clip_of_A"
CLIP_OF_B = "A_is_likely_clip_of_B"
NEAR_DUPLICATE = "near_duplicate_or_same_content"
PARTIAL = "partial_overlap"
SIMILAR = "similar"
DIFFERENT = "different"
LENGTH_RATIO = 1.35
CLIP_COVERAGE = 0.65
DIRECTIONAL_GAP = 0.18
ENGINE_DIRECTIONAL = 0.85
REPORT_DIRECTIONAL = 0.75
ENGINE_NEAR = 0.80
ENGINE_PARTIAL = 0.50
REPORT_PARTIAL = 0.3
REPORT_SIMILAR = 0.1


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _longer(x: list[Column], y: list[Column]) -> Column:
    """True if x exceeds y by the length ratio in any measure that both have."""
    out = F.lit(False)
    for a, b in zip(x, y):
        out = out | F.coalesce((a > 0) & (b > 0) & (a >= b * LENGTH_RATIO), F.lit(False))
    return out


def _directional(a: Column, b: Column, frames: tuple, durations: tuple, least: float) -> Column:
    size_a, size_b = [frames[0], durations[0]], [frames[1], durations[1]]
    return (
        F.when(_longer(size_a, size_b) & (b >= CLIP_COVERAGE), CLIP_OF_A)
        .when(_longer(size_b, size_a) & (a >= CLIP_COVERAGE), CLIP_OF_B)
        .when((b >= least) & (b - a >= DIRECTIONAL_GAP), CLIP_OF_A)
        .when((a >= least) & (a - b >= DIRECTIONAL_GAP), CLIP_OF_B)
    )


def relation_engine(a_in_b, b_in_a, frames_a=0, frames_b=0, duration_a=0.0, duration_b=0.0) -> Column:  # noqa: ANN001
    """Label of a compared pair; columns, names or literals."""
    a, b, fa, fb, da, db = (F.lit(x) if isinstance(x, (int, float)) else _c(x) for x in (a_in_b, b_in_a, frames_a, frames_b, duration_a, duration_b))
    case = _directional(a, b, (fa, fb), (da, db), ENGINE_DIRECTIONAL)
    return case.when((a >= ENGINE_NEAR) & (b >= ENGINE_NEAR), NEAR_DUPLICATE).when(F.greatest(a, b) >= ENGINE_PARTIAL, PARTIAL).otherwise(DIFFERENT)


def relation_report(a_in_b, b_in_a, threshold=0.8, frames_a=0, frames_b=0, duration_a=0.0, duration_b=0.0) -> Column:  # noqa: ANN001
    """Label that the report reader derives from stored ratios."""
    a, b, t, fa, fb, da, db = (F.lit(x) if isinstance(x, (int, float)) else _c(x) for x in (a_in_b, b_in_a, threshold, frames_a, frames_b, duration_a, duration_b))
    case = _directional(a, b, (fa, fb), (da, db), REPORT_DIRECTIONAL)
    most = F.greatest(a, b)
    return case.when((a >= t) & (b >= t), NEAR_DUPLICATE).when(most > REPORT_PARTIAL, PARTIAL).when(most > REPORT_SIMILAR, SIMILAR).otherwise(DIFFERENT)


def normalized_relation(reported, a_in_b, b_in_a, threshold=0.65, frames_a=0, frames_b=0, duration_a=0.0, duration_b=0.0) -> Column:  # noqa: ANN001
    """The reported label, or the derived one where it tells a direction that the report may have reversed."""
    r, a, b = _c(reported), _c(a_in_b), _c(b_in_a)
    derived = relation_report(a, b, max(0.8, threshold), frames_a, frames_b, duration_a, duration_b)
    directional = [CLIP_OF_A, CLIP_OF_B]
    return (
        F.when(r.isin("identical_file", "identical") | a.isNull() | b.isNull(), r)
        .when(derived.isin(*directional) | r.isin(*directional, "a_contains_b", "b_contains_a") | (r == "unknown"), derived)
        .otherwise(r)
    )


def is_partial(relation: Column | str) -> Column:
    """True for overlaps, clips and containment, in code or label."""
    return _c(relation).rlike("(?i)partial|clip|contain|重叠|包含")


def relation_matches(relation: Column | str, wanted: str) -> Column:
    """Report filter by class of relation: all, near, partial, clip, unknown or different; also by local label."""
    r = _c(relation)
    classes = {
        "all": F.lit(True),
        "near": r.rlike("(?i)near|identical|重复"),
        "partial": r.rlike("(?i)partial|contains|重叠|包含"),
        "clip": r.rlike("(?i)clip|片段"),
        "unknown": r.rlike("(?i)^unknown$|未知"),
        "different": r.rlike("(?i)different|差异"),
    }
    return F.coalesce(classes[wanted], F.lit(False))


def relation_rank(relation: Column | str) -> Column:
    """Sort rank of a relation, 5 for identical down to -1 for unknown."""
    r = F.lower(_c(relation))
    marks = (("identical", 5), ("clip|contains", 4), ("near", 3), ("partial", 2), ("similar", 1), ("different", 0))
    out = F.when(r.rlike(marks[0][0]), marks[0][1])
    for pattern, rank in marks[1:]:
        out = out.when(r.rlike(pattern), rank)
    return out.otherwise(-1)


# Labels shown for relation codes.
LABELS = {
    NEAR_DUPLICATE: "Near duplicate",
    CLIP_OF_A: "B is a clip of A",
    CLIP_OF_B: "A is a clip of B",
    PARTIAL: "Partial overlap",
    SIMILAR: "Similar",
    DIFFERENT: "Different",
    "identical": "Identical",
    "identical_file": "Identical file",
    "a_contains_b": "A contains B",
    "b_contains_a": "B contains A",
}


def relation_label(relation: Column | str) -> Column:
    """Display label; an unknown code is shown as it is."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(table, _c(relation)), _c(relation))


def relation_tone(relation: Column | str) -> Column:
    """Coarse class used for colouring."""
    r = relation_rank(relation)
    return F.when(r.isin(3, 5), "strong").when(r == 4, "clip").when(r == 2, "partial").when(r == 1, "weak").otherwise("none")


def number_value(text: Column | str) -> Column:
    """A number read from text; blank text reads as 0, null stays null, other text gives null."""
    c = _c(text).cast("string")
    n = c.try_cast("double")
    return F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n))


def first_number(*columns: Column | str) -> Column:
    return F.coalesce(*[number_value(c) for c in columns])


def first_text(*columns: Column | str) -> Column:
    """First text that isn't blank, trimmed; the empty text if there is none."""
    return F.coalesce(*[F.nullif(F.trim(_c(c).cast("string")), F.lit("")) for c in columns], F.lit(""))


def normalized_ratio(value: Column | str) -> Column:
    """A ratio clamped to [0, 1]; values above 1 and up to 100 are percentages; null and NaN give null."""
    v = _c(value).cast("double")
    r = F.when((v > 1) & (v <= 100), v / 100).otherwise(v)
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)))


def format_percent(value: Column | str) -> Column:
    v = _c(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    return F.when(ok, F.concat(F.format_number(F.when(v <= 1, v * 100).otherwise(v), 1), F.lit("%"))).otherwise("-")


def format_score(value: Column | str) -> Column:
    v = _c(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    return F.when(ok, F.format_number(F.when(v > 1, v / 100).otherwise(v), 2)).otherwise("-")


def metric_percent(value: Column | str) -> Column:
    v = _c(value).cast("double")
    p = F.when(v <= 1, v * 100).otherwise(v)
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.lit(0.0), F.least(F.lit(100.0), p))).otherwise(0.0)
