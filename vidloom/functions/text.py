"""Paths, names, times, sizes and escapes as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_ID = re.compile(r"^[A-Za-z0-9_-]+$")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_path(path: Column | str) -> Column:
    """Trimmed, ``/`` for ``\\``, no trailing slashes, lower case; ``-`` if nothing is left."""
    p = F.lower(F.regexp_replace(F.regexp_replace(F.trim(_c(path)), r"\\", "/"), "/+$", ""))
    return F.coalesce(F.nullif(p, F.lit("")), F.lit("-"))


def basename(path: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(_c(path), r"\\", "/"), "/", -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))


def sibling(path: Column | str, ext: str) -> Column:
    """The same path with another extension."""
    return F.concat(F.regexp_replace(_c(path), r"\.[^./\\]*$", ""), F.lit(f".{ext}"))


def is_child_path(parent: Column | str, child: Column | str) -> Column:
    """True if child is parent or lies below it."""
    p, c = _c(parent), _c(child)
    return (p == c) | c.startswith(F.concat(p, F.lit("/")))


def filter_tokens(text: Column | str) -> Column:
    """Words of a filter field, separated by blanks, commas or semicolons of either width."""
    return F.filter(F.split(F.trim(_c(text)), r"[\s,;，；、]+"), lambda x: x != "")


def safe_name(text: Column | str, fallback: str = "video") -> Column:
    """Anything but letters, digits, ``-``, ``_`` and ``.`` becomes ``_``; no outer ``.`` and ``_``; never empty."""
    n = F.regexp_replace(F.regexp_replace(_c(text), r"[^\p{L}\p{N}._-]", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(n, F.lit("")), F.lit(fallback))


def is_safe_id(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(SAFE_ID.pattern), F.lit(False))


def cache_float(value: Column | str) -> Column:
    """Four decimals without trailing zeros, ``p`` for the point."""
    return F.replace(F.regexp_replace(F.format_string("%.4f", _c(value).cast("double")), r"\.?0+$", ""), F.lit("."), F.lit("p"))


def profile_key(suffix: Column | str, skip: Column | str, gap: Column | str, step: Column | str) -> Column:
    """Key of a feature cache profile."""
    return F.concat_ws("__", _c(suffix), F.concat(F.lit("skip_"), cache_float(skip)), F.concat(F.lit("gap_"), cache_float(gap), F.lit("s")), F.concat(F.lit("step_"), _c(step).cast("string")))


def compact_error(text: Column | str, most: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), 1, most)


def progress_text(text: Column | str) -> Column:
    """Text for a pipe-delimited line: its own pipes become full width."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"\|", "｜"), r"[\r\n]+", " ")


def strip_ansi(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\x1b\[[0-9;?]*[@-~]|\r", "")


def csv_cell(text: Column | str) -> Column:
    """Quoted where it holds a comma, quote or line end."""
    t = F.coalesce(_c(text).cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(t, '"', '""'), F.lit('"'))).otherwise(t)


def html_escape(text: Column | str) -> Column:
    t = F.coalesce(_c(text).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def drawtext_escape(text: Column | str) -> Column:
    """Escapes backslash, colon, quote, percent sign and comma for a filter graph."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"([\\:',%])", r"\\$1"), r"\r?\n", r"\\n")


#: Blanks of any script, as subtitle files hold them.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def strip_blanks(text: Column | str) -> Column:
    """Text without outer blanks of any script."""
    return F.regexp_replace(_c(text), f"^{BLANK}+|{BLANK}+$", "")


def subtitle_seconds(text: Column | str) -> Column:
    """Seconds of ``[h:]m:s[.,]ms``; null if it doesn't read as a time."""
    t = strip_blanks(text)
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(t, pattern, k), F.lit("")), F.lit("0"))
    ms = F.rpad(part(4), 3, "0")
    value = part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int") + ms.cast("double") / 1000
    return F.when(t.rlike(pattern), value)


def clean_subtitle(text: Column | str) -> Column:
    """Subtitle text without tags and entities; blank lines and outer blanks of lines go."""
    t = F.regexp_replace(_c(text), r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.regexp_replace(t, "(?i)" + a, b)
    lines = F.filter(F.transform(F.split(t, "\n"), strip_blanks), lambda x: x != "")
    return F.array_join(lines, "\n")


def hhmmss(seconds: Column | str) -> Column:
    """``HH:MM:SS``; ``-`` for null and NaN."""
    s = _c(seconds).cast("double")
    n = F.greatest(F.lit(0), F.floor(s)).cast("long")
    pad = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.when(s.isNotNull() & ~F.isnan(s), F.concat_ws(":", pad(F.floor(n / 3600)), pad(F.floor(n % 3600 / 60)), pad(n % 60))).otherwise("-")


def clock(seconds: Column | str) -> Column:
    """``HH:MM:SS`` from an hour on, else ``MM:SS``."""
    n = F.greatest(F.lit(0), F.floor(_c(seconds).cast("double"))).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    h, m, s = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(h > 0, F.concat_ws(":", two(h), two(m), two(s))).otherwise(F.concat_ws(":", two(m), two(s)))


def file_size(size: Column | str) -> Column:
    """Size with a unit of 1024 steps and at most two decimals; ``0 B`` for null, zero and negative sizes."""
    b = _c(size).cast("double")
    step = F.least(F.lit(4), F.floor(F.log2(b) / 10 + 1e-12)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1)
    number = F.regexp_replace(F.replace(F.format_number(b / F.pow(F.lit(1024.0), step), 2), F.lit(","), F.lit("")), r"\.?0+$", "")
    return F.when(b >= 1, F.concat_ws(" ", number, unit)).otherwise("0 B")


def time_value(text: Column | str) -> Column:
    """Epoch milliseconds of epoch seconds, epoch milliseconds (above 10^10) or ISO text; else null."""
    t = F.trim(_c(text).cast("string"))
    n = t.try_cast("double")
    iso = F.unix_millis(F.try_to_timestamp(t))
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), F.when(n > 1e10, n).otherwise(n * 1000).cast("long")).otherwise(iso)


def iso_time(text: Column | str) -> Column:
    """ISO time, null where the text is none."""
    return F.try_to_timestamp(F.trim(_c(text)))


def short_hash(text: Column | str, length: int = 20) -> Column:
    """First digits of the SHA-256 of a text."""
    return F.substring(F.sha2(_c(text), 256), 1, length)


def path_digest(path: Column | str) -> Column:
    return F.substring(F.sha1(F.lower(_c(path)).cast("binary")), 1, 12)


# Share of the whole that each phase of an analysis covers, in percent.
PHASES = {"scan": (5.0, 12.0), "model": (12.0, 20.0), "index": (20.0, 55.0), "candidate": (55.0, 63.0), "compare": (63.0, 90.0), "report": (90.0, 98.0), "done": (100.0, 100.0)}


def parse_progress(line: Column | str) -> Column:
    """Struct ``stage``, ``progress``, ``sub_stage``, ``sub_progress`` of a progress line, null for other lines.

    A line reads ``PROGRESS|phase|current|total|message|sub current|sub total|sub stage``. Percentages have two decimals.
    """
    p = F.split(F.substring_index(_c(line), "PROGRESS|", -1), r"\|", 7)
    at = lambda k: F.trim(F.get(p, F.lit(k)))
    share = lambda a, b: F.when(b > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / b)))
    current, total = at(1).try_cast("double"), at(2).try_cast("double")
    ratio = F.coalesce(share(current, total), F.lit(0.0))
    percent = None
    for name, (lo, hi) in PHASES.items():
        value = lo + ratio * (hi - lo)
        percent = F.when(at(0) == name, value) if percent is None else percent.when(at(0) == name, value)
    sub = share(at(4).try_cast("double"), at(5).try_cast("double"))
    made = F.struct(F.coalesce(at(3), F.lit("")).alias("stage"), F.round(percent, 2).alias("progress"), F.nullif(at(6), F.lit("")).alias("sub_stage"), F.round(sub * 100, 2).alias("sub_progress"))
    ok = _c(line).startswith("PROGRESS|") & percent.isNotNull() & current.isNotNull() & total.isNotNull()
    return F.when(ok, made)


def natural_key(text: Column | str) -> Column:
    """Lower case with numbers padded, so that plain comparison orders them by value."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    padded = F.regexp_replace(t, r"(\d+)", "0000000000000000000$1")
    return F.regexp_replace(padded, r"\d*(\d{20})", "$1")
