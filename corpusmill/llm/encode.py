"""Encoding of texts with a public tokenizer (problem 6).

The tokenizer is given by the path of its rank file.  Texts are cut at safe
boundaries, places where the split pattern always ends a piece, so that no call
of the library sees an unbounded text; a piece that is itself very long goes
through an own merge in n log n instead of the library's quadratic one.

Edge cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import spread

#: default place of the rank file of byte_bpe_50k
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the id that closes or pads a record; the rank file leaves it free
END_ID = 50256
# Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: texts above this many characters are cut, pieces above this many bytes merged by heap
CHUNK_CHARS, PIECE_BYTES = 16_384, 2_048

_SAFE = regex.compile(r"[0-9A-Za-z一-鿿](?=[ \n])")
_PIECE = regex.compile(PATTERN)


class Codec:
    """Ids of texts and texts of ids for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in self.ranks.items()}

    def chunks(self, text: str) -> Iterator[str]:
        """Parts of ``text`` cut where a piece ends in any case."""
        at, n = 0, len(text)
        while n - at > CHUNK_CHARS:
            m = _SAFE.search(text, at + CHUNK_CHARS)
            end = m.end() if m else n
            yield text[at:end]
            at = end
        if at < n:
            yield text[at:]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the lowest rank first, leftmost among equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        start, nxt, prev, alive = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i] = stop
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                k = nxt[j]
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if prev[i] >= 0:
                h = prev[i]
                if (r := ranks.get(piece[h:stop])) is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[start[i] : end[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``, without special tokens."""
        if not text:
            return []
        if len(text) <= CHUNK_CHARS:
            return self.lib.encode_ordinary(text)
        out: list[int] = []
        for part in self.chunks(text):
            if len(part) <= 2 * CHUNK_CHARS:
                out += self.lib.encode_ordinary(part)
            else:
                for m in _PIECE.finditer(part):
                    raw = m[0].encode()
                    out += self.merge(raw) if len(raw) > PIECE_BYTES else self.lib.encode_ordinary(m[0])
        return out

    def encode_array(self, text: str | None) -> np.ndarray:
        """The same ids as an array, for short texts without a Python object for each id."""
        if not text:
            return np.empty(0, np.uint32)
        if len(text) <= CHUNK_CHARS:
            return self.lib.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        return np.array(self.encode(text), np.uint32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The raw bytes of ``ids``; ids outside the vocabulary give none."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids])


@lru_cache(maxsize=4)
def codec(path: str = RANKS) -> Codec:
    """The codec of a rank file, built once in each Python process."""
    return Codec(path)


def _encoder(path: str, keep: list[str], text: str, only_count: bool):
    def run(batches):
        c = codec(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            if only_count:
                out = pa.array([len(c.encode_array(t)) for t in texts], pa.int64())
            else:
                ids = [c.encode_array(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*cols, out], names=[*keep, "n_tokens" if only_count else "ids"])

    return run


def _mapped(df: DataFrame, keep: list[str], text: str, path: str, only_count: bool) -> DataFrame:
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    out = "n_tokens bigint" if only_count else "ids array<int>"
    return spread(df.select(*keep, text)).mapInArrow(_encoder(path, keep, text, only_count), f"{fields}, {out}")


def encode_column(df: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """``keep`` and the ``ids`` (array<int>) of each row's text; null and empty texts give an empty list."""
    return _mapped(df, keep, text, path, only_count=False)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """``keep`` and ``n_tokens``, without moving the ids out of the Python worker."""
    return _mapped(df, keep, text, path, only_count=True)


def decode_column(df: DataFrame, keep: list[str], ids: str = "ids", path: str = RANKS) -> DataFrame:
    """``keep``, the raw bytes of each row's ids and whether they are valid UTF-8; null lists give null."""

    def run(batches):
        c = codec(path)
        for b in batches:
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            raw = [None if x is None else c.decode_bytes([i for i in x if i is not None]) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(raw, pa.binary()), pa.array([None if r is None else _valid(r) for r in raw], pa.bool_())], names=[*keep, "raw", "valid"]
            )

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, ids).mapInArrow(run, f"{fields}, raw binary, valid boolean")


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def source_name(col: Column) -> Column:
    """Source names are compared without case and surrounding white space; blank is null."""
    s = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)
