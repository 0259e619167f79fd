"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is one token that the encoding of that prefix ends with. It is found from the
shorter prefixes: of the tokens that end there, it is the one before which the encoding of what precedes stands
unchanged, i.e. whose boundary to the preceding prefix's last token no merge would have crossed. The last tokens of
all prefixes are kept, so that bytes can be appended exactly, and an edit is re-encoded only until the last tokens
agree with the old ones over the length of the longest token.

A text is cut into the matches of a pattern; each match is encoded by itself, and encodings are cached by piece in a
bounded cache of the Python worker. Texts are whole and bounded by their own length.

Nulls and odd rows: a null text counts as empty, and an empty text has no tokens; special tokens' strings are
ordinary text; equal texts have equal ids; an empty table gives an empty result; further columns pass through
`with_tokens`.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 300_000):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}  # length of the longest token that ends with two bytes
        for token in ranks:
            if len(token) > 1:
                self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 0))
        self.halves: dict[int, tuple[int, int]] = {}
        self.compatible = Cache(self._compatible, cached)
        self.packed = Cache(self._packed, cached)

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            self.halves[token] = self._split(self.bytes_of[token])
        return self.halves[token]

    def _split(self, raw: bytes) -> tuple[int, int] | None:
        """Merges raw by rank until two parts are left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Merges are undone from the latest on, on either side of the boundary. The state before each undone merge was
        reached only if no pair across the boundary had a lower rank than a merge still to come.
        """
        left, right = pair
        latest = 1 << 40
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < latest:
                return False
            l_split, r_split = self.half(left), self.half(right)
            if l_split is None and r_split is None:
                return True
            if r_split is None or (l_split is not None and left > right):
                latest, left = left, l_split[1]
            else:  # at equal rank the left one is merged first
                latest, right = right + 1, r_split[0]

    def last_tokens(self, raw: bytes, upto: list[int] | None = None) -> list[int]:
        """The last token of each prefix of raw; `upto`: those that are known already, for a start."""
        last = list(upto or [])
        ranks, ok = self.ranks, self.compatible
        for end in range(len(last) + 1, len(raw) + 1):
            last.append(self._last(raw, end, last, ranks, ok))
        return last

    def _last(self, raw: bytes, end: int, last: list[int], ranks: dict, ok: Cache) -> int:
        for start in range(max(0, end - self.reach.get(raw[end - 2 : end], 1)), end):
            token = ranks.get(raw[start:end])
            if token is not None and (start == 0 and self._whole(token) or start > 0 and ok[(last[start - 1], token)]):
                return token
        raise ValueError("a byte has no token")

    def _whole(self, token: int) -> bool:
        """Whether the token's bytes are encoded as this token."""
        return len(self.bytes_of[token]) == 1 or self.half(token) is not None

    def tokens(self, raw: bytes, last: list[int]) -> list[int]:
        out, at = [], len(raw)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.tokens(raw, self.last_tokens(raw))

    def _packed(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pattern.findall(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The encoding of a growing and changing piece of bytes."""

    def __init__(self, bpe: ByteBpe, raw: bytes = b""):
        self.bpe, self.raw, self.last = bpe, b"", []
        self.append(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self.last = self.bpe.last_tokens(self.raw, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Puts new in place of raw[start:stop]; returns the number of prefixes computed afresh."""
        old, shift = self.last, len(new) - (stop - start)
        self.raw = self.raw[:start] + new + self.raw[stop:]
        last, alike, bpe = old[:start], 0, self.bpe
        for end in range(start + 1, len(self.raw) + 1):
            last.append(bpe._last(self.raw, end, last, bpe.ranks, bpe.compatible))
            before = end - 1 - shift
            alike = alike + 1 if end > start + len(new) and before >= 0 and last[-1] == old[before] and len(bpe.bytes_of[last[-1]]) <= end - start - len(new) else 0
            if alike >= bpe.longest:
                self.last = last + old[end - shift :]
                return end - start
        self.last = last
        return len(self.raw) - start

    def tokens(self) -> list[int]:
        return self.bpe.tokens(self.raw, self.last)


@lru_cache(4)
def load(path: str, pattern: str, cached: int = 300_000) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern, cached)


TOKENS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digested(bpe: ByteBpe, text: str | None) -> tuple:
    """Number of ids of a text, digests of the ids and of the bytes they decode to, and the ids."""
    packed = bpe.encode_packed(text)
    ids = np.frombuffer(packed, dtype="<u4")
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids.tolist())).hexdigest(), ids.astype(np.int32)


def token_digests(text: Column, path: str, pattern: str) -> Column:
    """struct of the number of ids, digests of ids and of the decoded bytes."""
    @F.pandas_udf(TOKENS)
    def digests(texts: pd.Series) -> pd.DataFrame:
        bpe = load(path, pattern)
        return pd.DataFrame([digested(bpe, t)[:3] for t in texts], columns=[c.split()[0] for c in TOKENS.split(", ")])

    return digests(text)


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    return docs.select("doc_id", token_digests(F.col("text"), path, pattern).alias("t")).select("doc_id", "t.*")


def with_tokens(docs: DataFrame, path: str, pattern: str, rows: int = 256, cached: int = 100_000) -> DataFrame:
    """doc_id, n_tokens, both digests and the ids themselves, of every whole text; `rows` of them are held at a time."""
    def encode(batches):
        bpe = load(path, pattern, cached)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                n, ids_sha, text_sha, ids = zip(*[digested(bpe, t) for t in part.column(1).to_pylist()], strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {TOKENS}, ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def decode_ids(df: DataFrame, ids: str, path: str, pattern: str) -> DataFrame:
    """Adds `decoded`, the bytes of a column of ids; null where the ids are null or one of them is in no vocabulary entry."""

    @F.pandas_udf("binary")
    def decoded(column: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        known = lambda x: x is not None and all(int(i) in bpe.bytes_of for i in x)
        return pd.Series([bpe.decode(map(int, x)) if known(x) else None for x in column], dtype=object)

    return df.withColumn("decoded", decoded(F.col(ids)))
