"""Pieces of oversized texts, cut at natural boundaries near content-defined landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ends of cues and paragraphs, of lines, of sentences, and blanks, in UTF-8.
PARAGRAPH = re.compile(rb"(?:\r\n|\n|\r|\xe2\x80\xa9)[ \t]*(?:\r\n|\n|\r|\xe2\x80\xa9)+|\xe2\x80\xa9")
LINE = re.compile(rb"\r\n|\n|\r|\x0b|\x0c|\xc2\x85|\xe2\x80\xa8")
SENTENCE = re.compile(rb"[.!?](?:[\"')\]]|\xe2\x80[\x99\x9d])*[ \t\r\n]+|\xe2\x80\xa6[ \t\r\n]*|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbc\x9b")
BLANK = re.compile(rb"[ \t]+|\xe3\x80\x80")
LOOK = 64


def _gear() -> np.ndarray:
    """256 well mixed numbers from a rule (the finalizer of a public 32-bit hash)."""
    x = (np.arange(256, dtype=np.uint64) + 1) * 0x9E3779B1 & 0xFFFFFFFF
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> shift)) * times & 0xFFFFFFFF
    return (x ^ (x >> 16)).astype(np.uint32)


GEAR = _gear()


def landmarks(b: np.ndarray, every: int) -> np.ndarray:
    """Positions after which a rolling hash of the last 32 bytes falls on a multiple of about ``every``."""
    h = GEAR[b]
    for k in (1, 2, 4, 8, 16):  # each step doubles the bytes that the hash sees
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    bits = max(1, int(round(np.log2(max(2, every)))))
    return np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1


def _ends(pattern: re.Pattern, raw: bytes) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(raw)), dtype=np.int64)


def cuts(raw: bytes, limit: int, overlap: int) -> list[int]:
    """End offsets of the pieces of one text of more than ``limit`` bytes."""
    n, most = len(raw), limit - overlap - 3  # an overlap may start up to 3 bytes early, at a whole character
    least = max(1, most // 4)
    b = np.frombuffer(raw, np.uint8)
    marks = landmarks(b, max(16, most // 3))
    kinds = [_ends(p, raw) for p in (PARAGRAPH, LINE, SENTENCE, BLANK)]
    reach = most // 5
    out, s = [], 0
    while n - s > most:
        lo, hi = s + least, min(s + most, n - 1)
        k = np.searchsorted(marks, lo)
        found = k < len(marks) and marks[k] <= hi
        at = int(marks[k]) if found else hi
        cut = 0
        for width in (reach, n):  # near the landmark first, else anywhere between least and most
            for ends in kinds if width == n else kinds[:3]:
                a, z = np.searchsorted(ends, max(lo, at - width)), np.searchsorted(ends, min(hi, at + width), "right")
                if a < z:
                    near = ends[a:z]
                    cut = int(near[np.argmin(np.abs(near - at))])
                    break
            if cut:
                break
        if not cut:
            cut = at
            while cut > s + 1 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(cut)
        s = cut
    return [*out, n]


def overlap_start(raw: bytes, start: int, overlap: int) -> int:
    """Where a piece begins that repeats at least ``overlap`` bytes, at a whole character."""
    p = max(0, start - overlap)
    while p > 0 and raw[p] & 0xC0 == 0x80:
        p -= 1
    return p


def split_oversized(documents: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens (UTF-8 bytes).

    Columns: ``key``, ``piece`` (from 0), ``start`` and ``end`` (bytes of the text that the piece adds; they
    partition the text), ``repeats`` (bytes of the piece before ``start``), ``tokens`` and, if asked, ``text``. A
    piece has at most ``limit`` tokens and starts with at least ``overlap`` tokens of the one before (up to 3 more
    where a character would be torn). Cuts lie at the natural boundary nearest to a content-defined landmark: end
    of cue or paragraph, line, sentence, in this order, between a quarter of the size and all of it; a text
    without any is cut at the landmark. An edit changes only the pieces around it.

    Null, empty and small texts have no pieces; texts of any length are cut whole. Repeated rows give repeated
    pieces; a null key stays null; other columns don't matter. One pass over the rows, without a shuffle.
    """
    if overlap < 0 or limit - overlap < 16:
        raise ValueError("limit must exceed overlap by at least 16 tokens")
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") > limit)
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ks, texts = x.column("k"), x.column("t")
            which, cols = [], ([], [], [], [], [])
            body: list[bytes] = []
            held = 0
            for i in range(len(texts)):
                raw = texts[i].as_py().encode("utf-8", "surrogatepass")
                s = 0
                for p, e in enumerate(cuts(raw, limit, overlap)):
                    o = overlap_start(raw, s, overlap) if p else s
                    which.append(i)
                    for c, v in zip(cols, (p, s, e, s - o, e - o)):
                        c.append(v)
                    if with_text:
                        body.append(raw[o:e])
                        held += e - o
                    s = e
                if held > 16_000_000:
                    yield _batch(key, ks, which, cols, body, with_text)
                    which, cols, body, held = [], ([], [], [], [], []), [], 0
            if which:
                yield _batch(key, ks, which, cols, body, with_text)

    schema = f"{key} {kind}, piece int, start bigint, end bigint, repeats int, tokens int" + (", text string" if with_text else "")
    return rows.mapInArrow(run, schema)


def _batch(key: str, ks: pa.Array, which: list[int], cols: tuple, body: list[bytes], with_text: bool) -> pa.RecordBatch:
    arrays = [ks.take(pa.array(which, pa.int64()))]
    arrays += [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    names = [key, "piece", "start", "end", "repeats", "tokens"]
    if with_text:
        arrays.append(pa.array([x.decode("utf-8", "replace") for x in body], pa.string()))
        names.append("text")
    return pa.RecordBatch.from_arrays(arrays, names=names)
