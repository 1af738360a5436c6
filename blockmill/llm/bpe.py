"""Byte-level BPE encoding and decoding in linear time.

A piece of text is covered from left to right by the longest vocabulary entry
that matches; where that entry could not stand next to the one before it, the
next shorter one is tried, and where none is left the last token is taken back.
Positions given up once are never entered again, so the work is linear. Two
tokens may be neighbours if no merge across their border would have happened
before the merges that built them; the answer is remembered per pair of tokens.
The result equals that of applying the merges in rank order.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmill.llm.tables import slices, text_of

#: Pieces kept with their tokens per Python worker; all are forgotten at this number.
REMEMBERED_PIECES = 400_000
#: Longer pieces are encoded anew each time.
REMEMBERED_LENGTH = 64
#: Token pairs kept with their compatibility per Python worker.
REMEMBERED_PAIRS = 500_000


class BytePairs:
    """A vocabulary ``{token bytes: rank}`` whose ranks are in merge order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        self._shorter: dict[int, int] = {}
        self._known: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and not self._split(token, rank):
                continue  # no sequence of merges gives it: only whole pieces are looked up
            automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        for token, rank in ranks.items():
            for end in range(len(token) - 1, 0, -1):
                prefix = ranks.get(token[:end])
                if prefix is not None and (end == 1 or prefix in self._halves):
                    self._shorter[rank] = prefix
                    break
        automaton.make_automaton()
        self._automaton = automaton

    def _split(self, token: bytes, rank: int) -> bool:
        """Find the two tokens that merge into this one, given all lower ranks."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is None or right is None or left >= rank or right >= rank:
                continue
            if self._compatible(left, right):
                self._halves[rank] = (left, right)
                self._merged[left, right] = rank
                return True
        return False

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two adjacent tokens alone.

        Merges are undone from the latest to the earliest, on the side that came
        last; the border falls if its two tokens merge earlier than what was undone.
        """
        limit = float("inf")
        while True:
            merged = self._merged.get((left, right))
            if merged is not None and merged < limit:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                halves = self._halves.get(left if side == "left" else right)
                if halves is None:
                    continue
                if side == "left":
                    limit, left = left, halves[1]
                else:
                    limit, right = right + 1, halves[0]
                break
            else:
                return True

    def _fit(self, left: int, right: int) -> bool:
        known = self._known.get((left, right))
        if known is None:
            if len(self._known) >= REMEMBERED_PAIRS:
                self._known.clear()
            known = self._known[left, right] = self._compatible(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (rank, before) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - before] = rank  # ends rise, so the last one is the longest
        usable = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = tokens[-1] if tokens else -1
            while True:
                end = at + self.size_of[token]
                if usable[end] and (last < 0 or self._fit(last, token)):
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                shorter = self._shorter.get(token)
                if shorter is None:
                    usable[at] = 0
                    token = tokens.pop()
                    at -= self.size_of[token]
                    break
                token = shorter
        return tokens


class _Packed(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self._pairs = pairs

    def __missing__(self, piece: str) -> bytes:
        ids = self._pairs.encode(piece.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Whole texts to packed ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = BytePairs(ranks)
        self._packed = _Packed(self.pairs)
        self._pattern = regex.compile(pattern)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._packed.__getitem__, self._pattern.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4").tolist()
        return b"".join(map(self.pairs.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        fields = (line.split() for line in lines)
        return {base64.b64decode(f[0]): int(f[1]) for f in fields if f}


_CODECS: dict[str, Codec] = {}


def _codec(name: str, shared, pattern: str) -> Codec:
    """One codec per Python worker, built at its first batch."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(shared.value, pattern)
    return _CODECS[name]


class SparkCodec:
    """The two column functions for one vocabulary.

    The driver reads the vocabulary file and broadcasts it: its size is that of
    the vocabulary, whatever the data.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
        shared = spark.sparkContext.broadcast(ranks)

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(name, shared, pattern)
            for texts in batches:
                yield pd.Series([codec.encode(t or "") for t in texts], dtype=object)

        @F.pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(name, shared, pattern)
            for packed in batches:
                yield pd.Series([codec.decode(p or b"") for p in packed], dtype=object)

        self._encode, self._decode = encode, decode
        self.open = lambda: _codec(name, shared, pattern)

    def encode(self, text: Column | str) -> Column:
        """Packed ids (little-endian unsigned 32 bits each); null counts as empty."""
        return self._encode(text_of(text))

    def decode(self, packed: Column | str) -> Column:
        """The bytes that packed ids stand for; null counts as no ids."""
        return self._decode(packed)


def encode_texts(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Add the packed ids of ``text`` and the bytes they decode to.

    Rows are kept one to one, in place; a null text is an empty one; existing
    columns named ``ids`` or ``decoded`` are replaced. Nothing is shuffled. Both
    columns come from one pass of one worker, a record batch cut into slices of
    bounded size, so a worker holds few texts at a time.
    """
    codec = SparkCodec(df.sparkSession, path, pattern)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    fields = [df.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.open()
        for batch in batches:
            for part in slices(batch, text):
                packed = [own.encode(t or "") for t in part.column(text).to_pylist()]
                arrays = [part.column(c) for c in kept]
                arrays += [pa.array(packed, pa.binary()), pa.array(map(own.decode, packed), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, ids, decoded])

    return df.select(*kept).mapInArrow(both, schema)


def token_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of whole texts."""
    coded = encode_texts(df.select("doc_id", text_of("text").alias("text")), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
