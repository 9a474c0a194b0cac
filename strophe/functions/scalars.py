"""Column expressions for times, durations and small numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(x: Column) -> Column:
    """Seconds to three decimals, halves to the even digit: the same steps in any IEEE engine."""
    return F.rint(x * 1000) / 1000


def upper_median(values: Column) -> Column:
    """Element ``n div 2`` of the sorted array (the upper of the two middle ones); null if empty."""
    return F.get(F.array_sort(values), F.expr("0") + F.floor(F.size(values) / 2).cast("int"))


def clock(seconds: Column) -> Column:
    """``H:MM:SS.cc`` of a time, not under 0, with the carry of centiseconds rounded halves to even."""
    cs = F.rint(F.greatest(seconds, F.lit(0.0)) * 100).cast("bigint")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def parse_clock(text: Column) -> Column:
    """Seconds of exactly three parts ``H:M:S``; null otherwise."""
    p = F.split(F.trim(text), ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2))


def parse_time(text: Column) -> Column:
    """Seconds of one to three parts: ``S``, ``M:S`` or ``H:M:S``; null otherwise."""
    p = F.split(F.trim(text), ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    n = F.size(p)
    return F.when(n == 1, part(0)).when(n == 2, part(0) * 60 + part(1)).when(n == 3, part(0) * 3600 + part(1) * 60 + part(2))


def shifted(seconds: Column, offset: Column) -> Column:
    """A time on another clock that runs ``offset`` ahead."""
    return millis(seconds + offset)


def pair_hash(f1: Column, f2: Column, dt: Column) -> Column:
    """9 + 9 + 7 bits: two frequencies and a distance in time."""
    return F.shiftleft(f1.bitwiseAND(F.lit(0x1FF)), 16).bitwiseOR(F.shiftleft(f2.bitwiseAND(F.lit(0x1FF)), 7)).bitwiseOR(dt.bitwiseAND(F.lit(0x7F)))


#: Label, least share and least lead over the next.
CONFIDENCE = (("high", 0.90, 0.80), ("medium", 0.70, 0.40))


def confidence(share: Column, lead: Column) -> Column:
    """The first label of ``CONFIDENCE`` that share and lead reach, else uncertain."""
    return F.coalesce(*[F.when((share >= least) & (lead >= ahead), name) for name, least, ahead in CONFIDENCE], F.lit("uncertain"))


def log_softmax(scores: Column) -> Column:
    """Linear in the scores: the maximum and the sum go beside the array, not into a function of its elements."""
    spread = lambda c: F.array_repeat(c, F.size(scores))
    shifted = F.zip_with(scores, spread(F.array_max(scores)), lambda x, top: x - top)
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return F.zip_with(shifted, spread(F.log(total)), lambda x, whole: x - whole)


def version_parts(text: Column) -> Column:
    """``v1.2[.3[.4]]`` as four ints; null if it is none."""
    m = lambda i: F.regexp_extract(text, r"^\s*v?(\d+)\.(\d+)(?:\.(\d+))?(?:\.(\d+))?", i)
    return F.when(m(0) != "", F.array(*[F.when(m(i) == "", F.lit(0)).otherwise(m(i).try_cast("int")) for i in range(1, 5)]))
