"""Column functions on words, lines, vectors and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[^ \\t\\n\\r]+"


def words_of(text: Column) -> Column:
    """Words between white space, in order; null text gives null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bare(word: Column) -> Column:
    """Lower case without punctuation at either end."""
    return F.regexp_replace(F.lower(word), "^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", "")


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; equal texts, empty ones included, give 1."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def alike_by_length(a: Column, b: Column, least: float) -> Column:
    """Whether the likeness is at least ``least``, false if either is null; null where only the distance tells.

    The distance is no less than the difference of the lengths. Only pairs for which that
    leaves the question open pay for the distance, which is quadratic in their length.
    """
    m, n = F.char_length(a), F.char_length(b)
    possible = 1 - F.abs(m - n) / F.greatest(m, n) >= least
    return F.when(a.isNull() | b.isNull(), False).when(a == b, F.lit(least <= 1)).when(~possible, False)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is null or zero or lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def padded(n: Column, width: int = 2) -> Column:
    """Decimal digits with zeros in front up to the width; longer numbers keep all digits."""
    digits = n.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def clock(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm; hours beyond 99 have more digits."""
    total = ms.cast("long")
    part = lambda unit, base: F.floor(total / unit) % base
    return F.concat(padded(F.floor(total / 3_600_000)), F.lit(":"), padded(part(60_000, 60)), F.lit(":"), padded(part(1000, 60)), F.lit(mark), padded(total % 1000, 3))


def frames(ms: Column, fps: int) -> Column:
    """Whole frames, halves rounded up."""
    return F.floor((ms.cast("long") * fps + 500) / 1000).cast("long")


def timecode(frame: Column, fps: int) -> Column:
    """HH:MM:SS:FF, no dropped frames; hours beyond 99 have more digits."""
    return F.concat(
        padded(F.floor(frame / (fps * 3600))), F.lit(":"), padded(F.floor(frame / (fps * 60)) % 60), F.lit(":"), padded(F.floor(frame / fps) % 60), F.lit(":"), padded(frame % fps)
    )
