"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Base spans come from three fixed patterns (assign, access, hex). The battery judges every other run
of 16 or more characters of ``[A-Za-z0-9+/_=-]``. Its encoding is inferred from the characters it
uses (digits, hex, lower, upper, base32, base36, letters, base62, base64, ...), and its statistics are

* chi-squared: the counts of the alphabet's symbols against equal counts;
* runs: the switches between character classes (lower, upper, digit, sign); in an alphabet of one
  class of letters, the turns between vowels and consonants;
* serial correlation: the lag-1 correlation of the symbols' places (alphabets of several classes).

Each is asked twice. *Noise*: are all of them such as uniform draws of the alphabet give, none with a
p-value under ``alpha`` / 3? If not, the run's p-value is 1. *Nature*: each gets a p-value against a
natural text (``Natural``: how often it changes class, turns between vowels and consonants, repeats a
letter, how alike neighbours are): fewer coincidences, more class switches, fewer turns, less
correlation than that speak for a secret. Brown's form of Fisher's sum combines them into the run's
p-value, at one formula for all lengths; ``dependence`` is the correlation that it allows for.
These p-values go through Benjamini-Yekutieli's step-up at level ``q`` within each length band (16-19,
20-27, 28-39, 40+), over the runs of all documents, so that a band's threshold follows how many natural
runs of such lengths the corpus holds. Only counts per band and p-value bin travel: a bounded table.
Random digits alone differ from ordinary numbers in nothing that the battery sees and are not found.

Edge cases: a null or empty text has no spans; a run that overlaps a base span is not reported
again; equal documents get equal spans, each row counting as a document of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import free_name, materialize, of_texts

KINDS = ("assign", "access", "hex")
# Fixed patterns of the contract; minimum lengths are checked on what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of [0-9a-f] that have 24 or more
KEYWORDS = re.compile(rb"password|passwd|secret|token|api_?key", re.I)
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
VOWELS = frozenset("aeiouyAEIOUY")
#: In order of inference: the first whose alphabet holds all characters of the run.
ALPHABETS = {
    "digits": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_=",
}
TURNING = ("lower", "upper")  # runs are of vowels and consonants
BANDS = (16, 20, 28, 40)
BIN = 0.5  # width of a bin of -log10 p
TOP_BIN = 120


@dataclass(frozen=True)
class Natural:
    """A natural text, per pair of neighbours or of letters: class switches, vowel-consonant turns, equal
    letters, and the lag-1 correlation of places in an alphabet of several classes."""

    switch: float = 0.06
    turn: float = 0.55
    match: float = 0.06
    serial: float = 0.25


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


@lru_cache(None)
def switch_rate(encoding: str) -> float:
    """Chance that two uniform draws of the alphabet are of different classes (vowel, consonant in one of letters)."""
    a = ALPHABETS[encoding]
    kinds = [c in VOWELS if encoding in TURNING else _class(c) for c in a]
    return 1 - sum((kinds.count(k) / len(a)) ** 2 for k in set(kinds))


def infer_encoding(run: str) -> str:
    body = run.rstrip("=") or run
    used = set(body)
    return next((k for k, a in ALPHABETS.items() if used <= set(a)), "mixed")


@dataclass(frozen=True)
class Statistics:
    encoding: str
    n: int
    chi2: float
    switches: int
    serial: float | None  # None where all symbols are equal


def statistics(run: str) -> Statistics:
    encoding = infer_encoding(run)
    alphabet = ALPHABETS[encoding]
    body = run.rstrip("=") or run
    n, k = len(body), len(alphabet)
    place = np.array([alphabet.find(c) for c in body])
    counts = np.bincount(place[place >= 0], minlength=k).astype(float)
    kind = np.array([c in VOWELS for c in body]) if encoding in TURNING else np.array([_class(c) for c in body])
    d = place - place.mean()
    spread = float((d * d).sum())
    serial = float((d[:-1] * d[1:]).sum()) / spread if spread > 0 else None
    return Statistics(encoding, n, float((counts**2).sum()) * k / n - n, int((kind[1:] != kind[:-1]).sum()), serial)


def _above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def noise_p(s: Statistics) -> tuple[float, float, float]:
    """p-values of chi-squared (too uneven), runs and serial correlation (two-sided) under uniform noise of the encoding."""
    df, rate = len(ALPHABETS[s.encoding]) - 1, switch_rate(s.encoding)
    z = ((max(s.chi2, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    runs = 2 * _above(abs(s.switches - (s.n - 1) * rate) / math.sqrt((s.n - 1) * rate * (1 - rate))) if rate > 0 else 1.0
    serial = 2 * _above(abs(s.serial + 1 / s.n) * math.sqrt(s.n)) if s.serial is not None else 0.0
    return _above(z), runs, serial


def binomial_tail(n: int, rate: float, at: int, upper: bool) -> float:
    """ln of the chance of ``at`` or more (or fewer) of ``n``: a sum in logarithms, at any length."""
    j = np.arange(at, n + 1) if upper else np.arange(0, at + 1)
    if not len(j):
        return -math.inf
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    terms = logs[n] - logs[j] - logs[n - j] + j * math.log(rate) + (n - j) * math.log1p(-rate)
    top = terms.max()
    return min(0.0, float(top + math.log(np.exp(terms - top).sum())))


def natural_logs(s: Statistics, natural: Natural) -> list[float]:
    """ln of the p-values of the statistics that an alphabet has, against a natural text."""
    k, pairs = len(ALPHABETS[s.encoding]), s.n * (s.n - 1) / 2
    match = max(natural.match, 1 / k)
    # Equal pairs of a text whose letters agree with chance ``match`` (their third moment: 1.25 match**2).
    mean = match * pairs
    spread = math.sqrt(pairs * match * (1 - match) + s.n * (s.n - 1) * (s.n - 2) * 0.25 * match**2)
    equal = ((s.chi2 + s.n) * s.n / k - s.n) / 2
    out = [_log(_above((mean - equal - 0.5) / spread))]
    if s.encoding in TURNING:
        out.append(binomial_tail(s.n - 1, natural.turn, s.switches, False))
    elif switch_rate(s.encoding) > 0:
        out.append(binomial_tail(s.n - 1, natural.switch, s.switches, True))
        out.append(_log(_above((natural.serial - (s.serial or 0.0)) * math.sqrt(s.n))) if s.serial is not None else 0.0)
    return out


def _log(p: float) -> float:
    return math.log(max(p, 1e-300))


def gamma_tail(a: float, x: float) -> float:
    """ln of the upper regularised incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 0.0
    head = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # the series of P = 1 - Q
        term = total = 1 / a
        k = a
        while term > 1e-17 * total:
            k += 1
            term *= x / k
            total += term
        return math.log1p(-min(math.exp(head) * total, 1 - 1e-16))
    b = x + 1 - a  # the continued fraction, by Lentz
    f = d = 1 / b
    c = 1e300
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return head + math.log(f)


def combined_log(logs: list[float], dependence: float) -> float:
    """ln of the combined p-value: Fisher's sum against a scaled chi-squared with room for a common correlation (Brown)."""
    k = len(logs)
    variance = 4 * k + k * (k - 1) * dependence * (3.25 + 0.75 * dependence)
    scale, freedom = variance / (4 * k), 8 * k * k / variance
    return min(0.0, gamma_tail(freedom / 2, -sum(logs) / scale))


def run_log(run: str, alpha: float, natural: Natural, dependence: float) -> float:
    """ln of a run's p-value; 0 where it does not look like noise."""
    s = statistics(run)
    return combined_log(natural_logs(s, natural), dependence) if min(noise_p(s)) >= alpha / 3 else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, by start and then kind."""
    out = []
    if KEYWORDS.search(text.encode()):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]], alpha: float, natural: Natural, dependence: float) -> list[tuple[int, int, int, int]]:
    """The runs outside base spans as (start, end, band, bin of -log10 p)."""
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, _, b in base):
            continue
        log = run_log(m.group(), alpha, natural, dependence)
        out.append((s, e, sum(e - s >= b for b in BANDS) - 1, min(TOP_BIN, int(-log / math.log(10) / BIN))))
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, text_col: str = "text", alpha: float = 0.001, natural: Natural = Natural(), dependence: float = 0.3, q: float = 0.01, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text), the counts of base spans, ``base`` and ``spans``.

    ``spans`` is array<struct<kind, start, end>>, code points, end exclusive, by start and then kind in
    the order assign, access, hex, random; ``base`` those of the three fixed kinds.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    seen_name = free_name(docs, "seen")

    def make(texts: list[str]) -> list[dict]:
        out = []
        for text in texts:
            base = base_spans(text)
            tested = candidates(text, base, alpha, natural, dependence)
            out.append({"base": [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base], "tested": [{"start": s, "end": e, "band": b, "bin": p} for s, e, b, p in tested]})
        return out

    look = of_texts(make, f"struct<base:{_SPANS},tested:array<struct<start:int,end:int,band:int,bin:int>>>")
    seen = materialize(docs.select(*keep, look(F.col(text_col)).alias(seen_name)))
    # Step-up within a band: the lowest bin whose expected false share is at most q. A bin counts by
    # its upper end of p, so that binning can only make the rule stricter.
    counts = seen.select(F.explode(f"{seen_name}.tested").alias("x")).groupBy(F.col("x.band").alias("band"), F.col("x.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("band")
    ranked = counts.select("band", "bin", F.sum("n").over(down).alias("hits"), F.sum("n").over(whole).alias("m"))
    m = F.col("m")
    passed = F.pow(F.lit(10.0), -F.col("bin") * BIN) * m * (F.log(m.cast("double")) + 1) / F.col("hits") <= q
    limits = ranked.where(passed & (F.col("bin") > 0)).groupBy("band").agg(F.min("bin").alias("least"))
    least = {r["band"]: r["least"] for r in limits.collect()}  # a row per band: four at most

    def discovered(x):
        out = F.lit(False)
        for band, at in least.items():
            out = out | ((x["band"] == band) & (x["bin"] >= at))
        return out

    base = F.col(f"{seen_name}.base")
    random = F.transform(F.filter(f"{seen_name}.tested", discovered), lambda x: F.struct(F.lit("random").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    spans = F.array_sort(F.concat(base, random), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"])).otherwise(_order(a) - _order(b)))
    of_kind = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("bigint")
    out = {f"n_{k}": of_kind(k) for k in KINDS} | {"base": base, "spans": spans}
    return seen.select(*keep, *[v.alias(free_name(docs.select(*keep), c)) for c, v in out.items()])


def _order(x):
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_position(kinds, x["kind"]).cast("int")


def digest(spans, hashed: bool):
    """kind:start:end joined by commas, or the SHA-256 of it."""
    joined = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return F.sha2(joined, 256) if hashed else joined


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span found replaced by ``[secret]``; overlapping spans become one mark.

    All rows stay, with their columns in their order; a null text stays null.
    """
    found = scan(docs, text_col, keep=docs.columns, **options)
    spans = found.columns[-1]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = F.col(text_col)

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit("[secret]"))).otherwise(acc["out"]).alias("out"),
        )

    cut = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.greatest(F.length(t) - acc["at"], F.lit(0)))))
    text = F.when(F.size(spans) > 0, cut).otherwise(t).alias(text_col)
    return found.select(*[text if c == text_col else F.col(c) for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest(F.col("base"), True).alias("base_sha256"), digest(F.col("spans"), False).alias("spans"))


def text_digest(spans: list[tuple[str, int, int]]) -> str:
    """The same digest for one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
