"""Splitting oversized texts at natural boundaries by content-defined landmarks.

A rolling hash over the last 16 characters picks a landmark in the window of allowed piece ends; the cut snaps to the nearest natural
boundary, preferring lines over sentences over words. Landmarks depend on the text around them only, so an edit moves the cuts of the
pieces next to it, and later pieces fall back into step at the next common landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MIN_CHARS, OVERLAP = 1800, 600, 150
SPAN = 16

_SPACE = re.compile(r"\s")
_SENTENCE = re.compile(r"[.!?;:…][)\"'’”»\]]*\s+")
_LINE = re.compile(r"[\r\n]+\s*")


def _rolling(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``SPAN`` characters up to each place, the same wherever these characters stand."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(codes), np.uint64)
    mult = 1
    for k in range(min(SPAN, len(codes))):
        out[k:] += mixed[: len(codes) - k] * np.uint64(mult)
        mult = mult * 0x5851F42D4C957F2D % (1 << 64)
    out ^= out >> np.uint64(31)
    return out


def _nearest(places: np.ndarray, low: int, high: int, at: int) -> int | None:
    """The place in [low, high] nearest to ``at``, the lower one of two."""
    a, b = np.searchsorted(places, (low, high + 1))
    if a >= b:
        return None
    k = int(np.searchsorted(places[a:b], at)) + a
    if k > a and (k == b or at - places[k - 1] <= places[k] - at):
        k -= 1
    return int(places[k])


def cut_text(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start of piece, start of its new text, end, how its end was cut) for each piece of ``text``.

    Each piece has at most ``max_chars`` characters; the first up to ``overlap`` of them repeat the end of the piece before, from a
    word's start. The cut is 'line', 'sentence', 'word', 'forced' (a stretch without white space longer than ``max_chars``) or 'end'.
    """
    n = len(text)
    if n <= max_chars:
        return [(0, 0, n, "end")]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = _rolling(codes)
    lines = np.fromiter((m.end() for m in _LINE.finditer(text)), np.int64)
    ends = np.fromiter((m.end() for m in _SENTENCE.finditer(text)), np.int64)
    blank = np.fromiter((m.start() for m in _SPACE.finditer(text)), np.int64)
    words = np.unique(np.concatenate([blank, blank + 1]))
    step = max(1, (max_chars - min_chars) // 4)
    pieces: list[tuple[int, int, int, str]] = []
    start = fresh = 0
    while n - start > max_chars:
        low, high = min(fresh + min_chars, start + max_chars), start + max_chars
        marks = np.flatnonzero(hashes[low:high] % np.uint64(step) == 0)
        at = low + int(marks[0] if len(marks) else np.argmin(hashes[low:high])) if high > low else high
        end, kind = None, "forced"
        for kind, places in (("line", lines), ("sentence", ends), ("word", words)):
            end = _nearest(places, low, high, at)
            if end is not None:
                break
        if end is None:  # nothing within the bounds: the last word boundary before them
            k = int(np.searchsorted(words, low))
            if k and words[k - 1] > fresh:
                end, kind = int(words[k - 1]), "word"
            elif start < fresh:  # the repeated text is given up before a word is cut
                start = fresh
                continue
            else:
                end, kind = high, "forced"
        pieces.append((start, fresh, end, kind))
        fresh = end
        back = max(end - overlap, pieces[-1][1])
        k = int(np.searchsorted(words, back))
        start = int(words[k]) if kind != "forced" and k < len(words) and words[k] < end else (back if kind == "forced" else end)
    pieces.append((start, fresh, n, "end"))
    return pieces


def split_oversized(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every row whose ``text`` is longer than ``max_chars`` characters.

    The row's other columns are kept; ``part`` and ``parts`` (replaced if present) count the pieces from 1, ``cut_kind`` is
    'forced' if a cut had to fall inside a stretch without white space, else 'clean'. Null and shorter texts give no row. The long
    rows are found in the JVM; only they cross to Python, in Arrow batches, without a shuffle.
    """
    keep = [f for f in df.schema.fields if f.name not in ("part", "parts", "cut_kind")]
    names = [f.name for f in keep]
    where = names.index(text)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                cuts = cut_text(row[where], max_chars, min_chars, overlap)
                kind = "forced" if any(c[3] == "forced" for c in cuts) else "clean"
                for k, (a, _, b, _) in enumerate(cuts, 1):
                    rows.append((*row[:where], row[where][a:b], *row[where + 1 :], k, len(cuts), kind))
            yield pd.DataFrame(rows, columns=[*names, "part", "parts", "cut_kind"])

    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([*keep, StructField("part", IntegerType()), StructField("parts", IntegerType()), StructField("cut_kind", StringType())])
    return df.select(*names).filter(F.length(text) > max_chars).mapInPandas(pieces, schema)
