"""Token counts by offset-mapped attribution.

A whole document is encoded once, with the encoder of ``bpe``. Each token covers a span of bytes, hence
of characters; the spans are joined with the spans of fields or sections, an interval join by sorted
boundaries, and every section gets its tokens. A token that crosses a boundary goes to one of the
sections it touches, or to none, by ``rule``:

* ``first``: the section that holds the token's first byte in any section;
* ``most``: the section that holds most of its bytes, the first of those on a tie;
* ``split``: a share to every section, by its bytes (counts are then fractions).

Bytes outside all sections (between or around them) belong to section -1, the rest. Tokens cut a
character when the vocabulary does; therefore bytes, and not characters, are attributed.

Sections come from ``sections``: a column of array<struct<section:int, start:int, end:int>> in code
points, end exclusive, sorted by start and not overlapping; or, by default, the text's lines, each with its
line break. ``join_fields`` makes one text and its sections out of several columns.

Edge cases: a null or empty text has no token and one empty line, section 0; empty sections get 0;
null or inverted sections are left out; repeated rows are attributed each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strophe.llm.bpe import Bpe, load, vocabulary_path
from strophe.llm.common import text_runs

RULES = ("first", "most", "split")


def token_bytes(bpe: Bpe, cut: list[str], known: dict) -> np.ndarray:
    """Bytes that each token of a whole text covers, from its pieces."""
    return _widths(bpe)[np.fromiter(chain.from_iterable(map(known.__getitem__, cut)), np.int64)]


def _widths(bpe: Bpe) -> np.ndarray:
    if not hasattr(bpe, "widths"):
        bpe.widths = np.zeros(max(bpe.bytes_of, default=0) + 1, np.int64)
        for i, b in bpe.bytes_of.items():
            bpe.widths[i] = len(b)
    return bpe.widths


def line_sections(text: str) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        end = min(len(text), at + len(line) + 1)
        out.append((k, at, end))
        at = end
    if len(out) > 1 and out[-1][1] == out[-1][2]:
        out.pop()  # what follows the last line break is no line
    return out


def attribute(widths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each piece between ``bounds`` (bytes, rising from 0 to the end), and how many cross a bound."""
    n = len(bounds) - 1
    ends = np.cumsum(widths)
    starts = ends - widths
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1
    first, last = np.clip(first, 0, max(0, n - 1)), np.clip(last, 0, max(0, n - 1))
    cross = np.flatnonzero(first != last)
    out = np.bincount(np.delete(first, cross) if len(cross) else first, minlength=n).astype(float)
    for k in cross:
        touched = np.arange(first[k], last[k] + 1)
        share = np.minimum(ends[k], bounds[touched + 1]) - np.maximum(starts[k], bounds[touched])
        if rule == "split":
            out[touched] += share / widths[k]
        else:
            out[touched[share.argmax()] if rule == "most" else touched[share > 0][0]] += 1
    return out, len(cross)


def count_text(widths: np.ndarray, text: str, sections: list[tuple[int, int, int]], rule: str) -> tuple[list[tuple[int, int, int, float]], int]:
    """((section, start, end, tokens) ..., crossing tokens) of one text; section -1 if bytes lie outside."""
    if text.isascii():
        raw_at = np.arange(len(text) + 1)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        raw_at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
    kept = sorted((s, e, k) for k, s, e in sections if s is not None and e is not None and 0 <= s <= e)
    bounds, owner = [0], []
    at = 0
    for i, (s, e, _) in enumerate(kept):
        s, e = min(max(s, at), len(text)), min(max(e, at), len(text))
        if s > at:
            bounds.append(int(raw_at[s])), owner.append(-1)
        bounds.append(int(raw_at[e])), owner.append(i)
        at = e
    if at < len(text):
        bounds.append(int(raw_at[len(text)])), owner.append(-1)
    # Empty sections are zero bytes wide and no token's; the others have rising bounds.
    wide = np.diff(bounds) > 0
    edges = np.concatenate([[0], np.array(bounds[1:])[wide]]).astype(np.int64)
    counts, crossing = attribute(widths, edges, rule) if wide.any() else (np.zeros(0), 0)
    held = np.zeros(len(kept) + 1)
    for i, c in zip(np.array(owner)[wide] if len(owner) else [], counts, strict=True):
        held[i] += c
    rows = [(k, s, e, float(held[i])) for i, (s, e, k) in enumerate(kept)]
    if -1 in owner:
        rows.append((-1, 0, len(text), float(held[-1])))
    return rows, crossing


def attribute_tokens(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text", sections: Column | None = None, rule: str = "most") -> DataFrame:
    """A row per document and section: key, n_tokens (of the document), n_crossing, section, start, end, tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    lean = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"), *([sections.alias("sections")] if sections is not None else []))
    kind, own_sections = docs.schema[key].dataType, sections is not None
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            keys = batch.column("key")
            given = batch.column("sections") if own_sections else None
            at: list[int] = []
            cols: list[list] = [[] for _ in range(6)]

            def made():
                names = ("n_tokens", "n_crossing", "section", "start", "end", "tokens")
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                out = pa.RecordBatch.from_pydict({"key": keys.take(pa.array(at)).cast(arrow), **{c: pa.array(v, t) for c, v, t in zip(names, cols, types, strict=True)}})
                at.clear(), [c.clear() for c in cols]
                return out

            i = 0
            for texts in text_runs(batch.column("text")):
                cuts = [bpe.cut(t) for t in texts]
                known = bpe.learn(cuts)
                for text, cut in zip(texts, cuts, strict=True):
                    if given is None:
                        spans = line_sections(text)
                    else:
                        spans = [(s["section"], s["start"], s["end"]) for s in given[i].as_py() or [] if s is not None]
                    widths = token_bytes(bpe, cut, known)
                    rows, crossing = count_text(widths, text, spans, rule)
                    for r in rows:
                        at.append(i)
                        for c, v in zip(cols, (len(widths), crossing, *r), strict=True):
                            c.append(v)
                    i += 1
                if len(at) > 100_000:
                    yield made()
            if at:
                yield made()

    schema = f"key {kind.simpleString()}, n_tokens bigint, n_crossing bigint, section int, start int, end int, tokens double"
    return lean.mapInArrow(run, schema).withColumnRenamed("key", key)


def join_fields(df: DataFrame, fields: list[str], between: str = "\n", text_name: str = "text", sections_name: str = "sections") -> DataFrame:
    """``df`` with one text of all fields (null: empty) and the span of each field, in order."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for k, p in enumerate(parts):
        end = at + F.length(p)
        spans.append(F.struct(F.lit(k).alias("section"), at.alias("start"), end.alias("end")))
        at = end + len(between)
    return df.withColumns({text_name: F.concat_ws(between, *parts), sections_name: F.array(*spans)})


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return attribute_tokens(docs, vocabulary_path())
