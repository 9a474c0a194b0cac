"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A vocabulary file (JSON of the ``tokenizers`` library, byte-level BPE) is read from a path; nothing
is trained. A text is cut into pieces by the vocabulary's pattern and BPE runs inside a piece: the
leaves of a segment tree hold the rank of each adjacent pair, an inner node the least of its
children, the left one on ties, so that the root names the leftmost merge of lowest rank. A merge
changes at most three leaves, each a logarithmic update, until no leaf holds a rank. Short pieces
are handled many at a time (one tree per row of a matrix, all levels in numpy), long ones one by one.

Edge cases: a null or empty text has no tokens and decodes to the empty text; special-token strings
in a text stand for the special token, as in the library; ids that are not in the vocabulary are
skipped by ``decode``; bytes that are no UTF-8 decode to U+FFFD, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import map_texts

#: Pieces whose ids a worker keeps for later batches: the first so many it meets, among them the
#: frequent ones; others are merged anew in each batch. Bounds memory, not results.
REMEMBERED = 100_000
#: Pieces longer than this many bytes get a tree of their own.
LONG_PIECE = 64
#: Cells of one step over a table of pieces: rows times width.
CELLS = 1 << 18
NONE = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    table = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Pairs:
    """(left id, right id) -> rank and merged id, as an open-addressing table in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys))))) + 2)
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):  # each round, the first of those that want a free slot gets it
            want = slot[todo]
            first = np.zeros(len(todo), bool)
            first[np.unique(want, return_index=True)[1]] = True
            win = first & (self.keys[want] == np.iinfo(np.uint64).max)
            at = want[win]
            self.keys[at], self.rank[at], self.merged[at] = keys[todo[win]], todo[win], merged[todo[win]]
            todo = todo[~win]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where the pair merges into nothing) and merged ids; an id below 0 fits nothing."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank = np.full(len(keys), NONE, np.int64)
        merged = np.zeros(len(keys), np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        mask = len(self.keys) - 1
        while len(open_):
            s = slot[open_]
            k = self.keys[s]
            hit = k == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[s[hit]], self.merged[s[hit]]
            open_ = open_[~hit & (k != np.iinfo(np.uint64).max)]
            slot[open_] = (slot[open_] + 1) & mask
        return rank, merged


class SegmentTree:
    """Ranks of adjacent pairs of one long piece; the root holds rank * width + position."""

    def __init__(self, ranks: list[int]):
        self.width = 1 << max(1, (len(ranks) - 1).bit_length())
        self.nodes = [NONE_INT] * (2 * self.width)
        for i, r in enumerate(ranks):
            self.nodes[self.width + i] = NONE_INT if r < 0 else r * self.width + i
        for i in range(self.width - 1, 0, -1):
            self.nodes[i] = min(self.nodes[2 * i], self.nodes[2 * i + 1])

    def set(self, i: int, rank: int) -> None:
        k = self.width + i
        self.nodes[k] = NONE_INT if rank < 0 else rank * self.width + i
        while k > 1:
            k >>= 1
            self.nodes[k] = min(self.nodes[2 * k], self.nodes[2 * k + 1])

    def least(self) -> int:
        """Position of the leftmost pair of lowest rank, or -1."""
        root = self.nodes[1]
        return -1 if root == NONE_INT else root % self.width


NONE_INT = 1 << 80


class Bpe:
    """A vocabulary with its encoder and decoder; one per worker and path."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.byte_id = np.array([self.vocab[c] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = Pairs(self.left, self.right, self.merged)
        self.rank_of = {(a, b): (i, m) for i, (a, b, m) in enumerate(zip(self.left.tolist(), self.right.tolist(), self.merged.tolist(), strict=True))}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.shown_of = {i: str(i) for i in self.bytes_of}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.passing: list[str] = []
        self.path = path
        self._probe = None
        self._proxy: dict[str, str] = {}

    # -- cutting into pieces ------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """The pattern's pieces, in order; they join to the text."""
        pattern, newer = _pattern(), _newer()
        if newer.search(text) is None:
            return pattern.findall(text)
        swap = {c: p for c in set(text) if (p := self.proxy(c)) != c}
        if not swap:
            return pattern.findall(text)
        # Characters on whose class the pattern's library and the vocabulary's library disagree are
        # matched as a stand-in of the right class.
        return [text[m.start() : m.end()] for m in pattern.finditer("".join(swap.get(c, c) for c in text))]

    def proxy(self, c: str) -> str:
        if c < "Ͱ":
            return c
        if (p := self._proxy.get(c)) is None:
            kind = unicodedata.category(c)
            if kind == "Cn":  # newer than this Python's tables: ask the library that is to be matched
                if self._probe is None:
                    from tokenizers import Tokenizer

                    self._probe = Tokenizer.from_file(self.path).pre_tokenizer
                first = self._probe.pre_tokenize_str(f"b{c}1")[0][1][1]
                last = self._probe.pre_tokenize_str(f"b{c}1")[-1][1][0]
                kind = "L" if first == 2 else "N" if last == 1 else "S"
            want = kind[0] if kind[0] in "LN" else "W" if c.isspace() else "S"
            has = "L" if _letter().match(c) else "N" if _number().match(c) else "W" if _blank().match(c) else "S"
            p = self._proxy[c] = c if want == has else {"L": "b", "N": "1", "S": "!", "W": " "}[want]
        return p

    # -- merging ------------------------------------------------------------------------------

    def merge_long(self, piece: bytes) -> list[int]:
        """One tree for one piece; neighbours by linked lists."""
        ids = [int(self.byte_id[b]) for b in piece]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank_of
        tree = SegmentTree([rank.get((ids[i], ids[i + 1]), (-1,))[0] for i in range(n - 1)] or [-1])
        while (i := tree.least()) >= 0:
            j = nxt[i]
            ids[i] = rank[ids[i], ids[j]][1]
            ids[j] = -1
            nxt[i] = k = nxt[j]
            if j < n - 1:
                tree.set(j, -1)
            if k < n:
                prv[k] = i
                tree.set(i, rank.get((ids[i], ids[k]), (-1,))[0])
            elif i < n - 1:
                tree.set(i, -1)
            if (h := prv[i]) >= 0:
                tree.set(h, rank.get((ids[h], ids[i]), (-1,))[0])
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """A tree per row, for pieces of up to LONG_PIECE bytes; rows of alike length together."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for width in (4, 8, 16, 32, 64):
            rows = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 4 else 0)))
            step = CELLS // width
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for k, ids in zip(part.tolist(), self._rows([pieces[i] for i in part], sizes[part], width), strict=True):
                    out[k] = ids
        return out

    def _rows(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[list[int]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        col = np.arange(width)
        ids = np.where(col < sizes[:, None], self.byte_id[raw], -1)
        nxt = np.broadcast_to(col + 1, (n, width)).copy()
        prv = np.broadcast_to(col - 1, (n, width)).copy()
        ranks, into = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        tree = np.full((n, 2 * width), NONE, np.int64)  # rank * width + position, so that least is leftmost
        tree[:, width : 2 * width - 1] = np.where(ranks < NONE, ranks * width + np.tile(col[:-1], n), NONE).reshape(n, -1)
        merged = np.zeros((n, width), np.int64)
        merged[:, :-1] = into.reshape(n, -1)
        k = width
        while k > 1:
            k //= 2
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            while width > 1 and len(node) and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(live):
            i = tree[live, 1] % width
            j = nxt[live, i]
            ids[live, i] = merged[live, i]
            ids[live, j] = -1
            k = nxt[live, j]
            nxt[live, i] = k
            put(live, j, np.full(len(live), NONE))
            right = np.where(k < width, ids[live, np.minimum(k, width - 1)], -1)
            has = k < width
            prv[live[has], k[has]] = i[has]
            rank, into = self.pairs.find(ids[live, i], right)
            merged[live, i] = into
            put(live, i, np.where(rank < NONE, rank * width + i, NONE))
            h = prv[live, i]
            rows, hh, ii = live[h >= 0], h[h >= 0], i[h >= 0]
            rank, into = self.pairs.find(ids[rows, hh], ids[rows, ii])
            merged[rows, hh] = into
            put(rows, hh, np.where(rank < NONE, rank * width + hh, NONE))
            live = live[tree[live, 1] < NONE]
        keep = ids >= 0
        flat, ends = ids[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    # -- texts --------------------------------------------------------------------------------

    def cut(self, text: str) -> list[str]:
        """Pieces and special-token strings, in order; they join to the text."""
        if self.special_re is None or self.special_re.search(text) is None:
            return self.pieces(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [*self.pieces(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.pieces(text[at:])

    def learn(self, cuts: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """Ids of every piece in ``cuts``; what is new goes through the trees."""
        for p in self.passing:
            del self.known[p]
        self.passing = []
        new = set().union(*cuts) - self.known.keys() if cuts else set()
        for s in new & self.special.keys():
            self.known[s] = (self.special[s],)
        new -= self.special.keys()
        raw = [(p, p.encode()) for p in new]
        short = [(p, b) for p, b in raw if len(b) <= LONG_PIECE]
        for (p, _), ids in zip(short, self.merge_many([b for _, b in short]), strict=True):
            self.known[p] = tuple(ids)
        for p, b in raw:
            if len(b) > LONG_PIECE:
                self.known[p] = tuple(self.merge_long(b))
        if len(self.known) > REMEMBERED:
            self.passing = [p for p, _ in raw]
        return self.known

    def encode(self, texts: list[str]) -> list[list[int]]:
        cuts = [self.cut(t) for t in texts]
        known = self.learn(cuts)
        return [list(chain.from_iterable(map(known.__getitem__, c))) for c in cuts]

    def decode(self, ids: list[int]) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(None)
def _pattern():
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(None)
def _newer():
    return re.compile("[Ͱ-\U0010ffff]")


@lru_cache(None)
def _letter():
    import regex

    return regex.compile(r"\p{L}")


@lru_cache(None)
def _number():
    import regex

    return regex.compile(r"\p{N}")


@lru_cache(None)
def _blank():
    import regex

    return regex.compile(r"\s")


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others than the text by default) and ``ids array<int>`` of each text."""
    keep = [c for c in docs.columns if c != text_col and c != "ids"] if keep is None else keep

    def make(texts: list[str]) -> dict:
        return {"ids": load(path).encode(texts)}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(docs, make, f"{schema}{', ' * bool(schema)}ids array<int>", keep, text_col)


def decode_documents(tokens: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``text``, decoded from ``ids_col`` (null: empty)."""
    import pyarrow as pa

    keep = [c for c in tokens.columns if c not in (ids_col, "text")] if keep is None else keep

    def run(batches):
        for b in batches:
            bpe = load(path)
            texts = [bpe.decode([i for i in x if i is not None] if x else []) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in keep}, "text": texts})

    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return tokens.select(*keep, ids_col).mapInArrow(run, f"{schema}{', ' * bool(schema)}text string")


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass: ``keep`` (doc_id), n_tokens, ids_sha256, decoded_sha256, lossless.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded text in
    UTF-8; ``lossless`` says whether the decoded text is the text (null: the empty text). With
    ``with_ids`` also ``ids array<int>``.
    """
    keep = ["doc_id"] if keep is None else keep

    def make(texts: list[str]) -> dict:
        bpe = load(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "lossless": []} | ({"ids": []} if with_ids else {})
        cuts = [bpe.cut(t) for t in texts]
        known, shown, raw = bpe.learn(cuts), bpe.shown_of, bpe.bytes_of
        for text, c in zip(texts, cuts, strict=True):
            ids = list(chain.from_iterable(map(known.__getitem__, c)))
            decoded = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            out["lossless"].append(decoded == text)
            if with_ids:
                out["ids"].append(np.array(ids, np.int32))
        return out

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return map_texts(docs, make, schema, keep, text_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, vocabulary_path())
