"""Fill-in-middle examples: texts cut at unit borders and put in another order.

Cut places are found in the UTF-8 bytes of many texts at once, eight bytes in one
64-bit word. Arithmetic on the word sets the top bit of every byte that ends a
unit; the marks of each word are counted, the counts added up, the word with the
wanted mark found by binary search, and the mark within that word by dropping
its lowest marks one after the other. No text is split into a list of its units.

Units are ``lines`` (each up to and with its line feed; what follows the last
one is a line too) or ``chars`` (code points). A text of ``n`` units is cut after
the smaller and the larger of two numbers from 0 to n that come from the hash
of the text's key, so they are the same in every run.

Nulls and odd rows: a null text is empty; an empty text, or one that holds a
sentinel, stays as it is (``plain``). A null key is hashed as no digits. Equal
rows give equal results. Nothing is shuffled; record batches are worked on in
slices of bounded bytes, one text at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmill.llm.tables import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)


class Marks:
    """Top bits of the bytes of a buffer, eight to a word, with running counts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, ends: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each of the byte places ``ends``."""
        word, inside = ends >> 3, (ends & 7).astype(np.uint64)
        mask = (np.uint64(1) << (inside * np.uint64(8))) - np.uint64(1)
        # A place at the very end of the buffer has no word of its own.
        last = np.append(self.words, np.uint64(0))[word]
        return self.before[word] + np.bitwise_count(last & mask)

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """Byte places of the marks with these numbers, counted from 0."""
        word = np.searchsorted(self.before, numbers, side="right") - 1
        left = numbers - self.before[word]
        bits = self.words[word]
        for step in range(7):
            bits = np.where(left > step, bits & (bits - np.uint64(1)), bits)
        lowest = bits & (~bits + np.uint64(1))
        return (word << 3) + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, filled up with zero bytes."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def line_ends(words: np.ndarray) -> Marks:
    """Marks every line feed. Without a carry between bytes: seven low bits plus
    127 reach the top bit unless they are all zero."""
    other = words ^ (_ONES * np.uint64(0x0A))
    return Marks(~(((other & _LOW) + _LOW) | other) & _HIGH)


def code_points(words: np.ndarray, size: int) -> Marks:
    """Marks the first byte of every code point: all but those of form 10xxxxxx."""
    marks = (~words | (words << np.uint64(1))) & _HIGH
    if size % 8:
        marks[-1] &= (np.uint64(1) << np.uint64(size % 8 * 8)) - np.uint64(1)
    return Marks(marks)


class Cuts(NamedTuple):
    """Byte places between prefix, middle and suffix, and what they are worth."""

    units: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prefix_chars: np.ndarray
    middle_chars: np.ndarray


def find_cuts(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> Cuts:
    """Cuts of the texts ``data[bounds[i]:bounds[i + 1]]``, as places in ``data``."""
    words = words_of(data)
    points = code_points(words, len(data))
    starts, ends = bounds[:-1], bounds[1:]
    if unit == "lines":
        marks = line_ends(words)
        base = marks.rank(starts)
        marked = marks.rank(ends) - base
        # A last line without a line feed ends with its text.
        open_end = (ends > starts) & (data[np.maximum(ends - 1, 0)] != 0x0A) if len(data) else ends > starts
        units = marked + open_end
    else:
        marks = points
        base = marks.rank(starts)
        units = marked = marks.rank(ends) - base
    places = []
    for chosen in (np.minimum(h1 % (units + 1), h2 % (units + 1)), np.maximum(h1 % (units + 1), h2 % (units + 1))):
        place = np.where(chosen == 0, starts, ends)
        inner = np.nonzero((chosen > 0) & ((chosen <= marked) if unit == "lines" else (chosen < marked)))[0]
        number = base[inner] + chosen[inner]
        # A line ends with its mark; the next code point starts at its mark.
        place[inner] = marks.select(number - 1) + 1 if unit == "lines" else marks.select(number)
        places.append(place)
    first, second = places
    at = [points.rank(p) for p in (starts, first, second)]
    return Cuts(units, first, second, at[1] - at[0], at[2] - at[1])


def key_hashes(key: object, salt: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of ``salt`` and the decimal key."""
    digest = hashlib.sha256(f"{salt}{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"not an output of form {form}")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


#: Columns that ``infill_examples`` adds, and their types.
ADDED = T.StructType(
    [
        T.StructField("n_units", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def transform_batch(
    texts: pa.Array, keys: list, unit: str, percent: int, spm_percent: int, salt: str
) -> list[pa.Array]:
    """The columns ``ADDED`` for the texts of a slice, null texts as empty ones."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    bounds = np.cumsum([0, *map(len, raw)], dtype=np.int64)
    whole = b"".join(raw)
    hashes = np.array([key_hashes(k, salt) for k in keys], dtype=np.int64).reshape(-1, 4)
    cuts = find_cuts(np.frombuffer(whole, np.uint8), bounds, hashes[:, 0], hashes[:, 1], unit)
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs = [], []
    for i, text in enumerate(raw):
        if not text or hashes[i, 2] % 100 >= percent or any(s in text for s in sentinels):
            forms.append("plain")
            outputs.append(text)
            continue
        one, two = cuts.first[i] - bounds[i], cuts.second[i] - bounds[i]
        forms.append("spm" if hashes[i, 3] % 100 < spm_percent else "psm")
        outputs.append(joined(forms[-1], text[:one], text[one:two], text[two:]))
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    return [
        pa.array(cuts.units, pa.int64()),
        pa.array(forms, pa.string()),
        pa.array(cuts.prefix_chars, pa.int64(), mask=plain),
        pa.array(cuts.middle_chars, pa.int64(), mask=plain),
        # Cuts lie between code points, so the bytes are UTF-8 as the texts are.
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]


def infill_examples(
    df: DataFrame,
    key: str,
    text: str = "text",
    unit: str = "lines",
    percent: int = 100,
    spm_percent: int = 50,
    salt: str = "7:",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``n_units, form, prefix_chars, middle_chars, output`` to every row.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these with the
    suffix first. Columns that have these names already are replaced; all others
    (or those named in ``keep``) stay, and rows stay one to one. The character
    counts are null for plain texts.
    """
    if unit not in ("lines", "chars"):
        raise ValueError(f"unit must be lines or chars, not {unit!r}")
    kept = [c for c in (df.columns if keep is None else keep) if c not in ADDED.names]
    # After the columns that stay, the text and the key as they are used.
    used = df.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col(f"`{key}`").cast("string").alias("_infill_key"),
        *([] if text in kept else [F.col(f"`{text}`")]),
    )
    schema = T.StructType([*(df.schema[c] for c in kept), *ADDED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                keys = part.column("_infill_key").to_pylist()
                added = transform_batch(part.column(text), keys, unit, percent, spm_percent, salt)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *added], [*kept, *ADDED.names])

    return used.mapInArrow(run, schema)


def restored(df: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """Add the texts that ``infill_examples`` started from, rebuilt from its output."""
    kept = [c for c in df.columns if c != into]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output):
                outputs = part.column(output).cast(pa.binary()).to_pylist()
                texts = [restore(o, f) for o, f in zip(outputs, part.column(form).to_pylist())]
                columns = [part.column(c) for c in kept] + [pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, into])

    return df.select(*kept).mapInArrow(run, schema)


def example_digests(df: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``
    of whole ``documents`` texts cut into lines."""
    made = infill_examples(df, "doc_id", keep=["doc_id"])
    return restored(made).select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
