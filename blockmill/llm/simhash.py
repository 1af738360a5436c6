"""SimHash fingerprints and the links between fingerprints a few bits apart.

Segment popcounts: a fingerprint is cut into 32 segments of two bits, and the
bits of every segment are counted. Moving from one fingerprint to another by d
bits moves the vector of counts by at most d in Manhattan distance, so that
distance is a lower bound of the Hamming distance. The 32 coordinates are dealt
into ``max_distance + 3`` groups: vectors within ``max_distance`` agree wholly in
three of the groups at least, so they meet in a cell of the grid over some three
groups. Pairs of a cell are first tried by the Manhattan bound, then exactly.

Cells holding many fingerprints are cut into blocks and met block by block. What
leaves a cell is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from blockmill.llm.tables import connected, store, text_of

BITS = 64
SEGMENTS = BITS // 2
SEED = 42
WORDS = 4
#: Most fingerprints of a cell that meet in one place; larger cells are cut.
BLOCK = 4096
#: Groups up to this size are compared by offsets, all groups of a batch at once.
SMALL = 48
#: Shingles hashed before their bits are counted, so long texts take bounded memory.
CHUNK = 1 << 16

_ODD = 0x5555555555555555


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles of a text (A-Z lower-cased, split at ASCII
    white space): a bit is 1 if set in over half of the hashes. No words: zero."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate((len(p) + 1 for p in parts)))
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return hashed(joined, SEED)
    n = len(parts) - words + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        starts = [0, *ends[: high - 1]][low:] if low == 0 else ends[low - 1 : high - 1]
        hashes = np.fromiter(
            (hashed(joined[s : e - 1], SEED) for s, e in zip(starts, ends[low + words - 1 : high + words - 1])),
            dtype="<u8",
            count=high - low,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        values = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
        yield pd.Series(values.view(np.int64))


def fingerprints(text: Column | str) -> Column:
    """Fingerprint of a text as a long (the unsigned value's two's complement)."""
    return _fingerprints(text_of(text))


def segment_counts(fp: Column) -> Column:
    """The 32 counts, packed two bits each into a long."""
    odd = F.lit(_ODD)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # The sum of two bits: one if they differ, two if both are set.
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _cells(max_distance: int) -> list[int]:
    """Masks over the packed counts, one for each choice of three groups."""
    groups = np.array_split(np.arange(SEGMENTS), max_distance + 3)
    masks = [sum(3 << (2 * int(s)) for s in g) for g in groups]
    both = [sum(c) for c in combinations(masks, 3)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in both]


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two arrays of packed counts (0, 1 or 2 each)."""
    odd = np.uint64(_ODD)
    differ = a ^ b
    by_one = differ & odd
    by_two = (differ >> np.uint64(1)) & odd & ~by_one
    return np.bitwise_count(by_one) + 2 * np.bitwise_count(by_two)


def _near(a, ca, b, cb, max_distance: int) -> np.ndarray:
    """Whether fingerprints are linked: the bound first, then the bits."""
    near = _bound(ca, cb) <= max_distance
    where = np.nonzero(near)[0]
    if len(where):
        fa = a[where] if np.ndim(a) else a
        near[where] = np.bitwise_count(fa ^ b[where]) <= max_distance
    return near


def _forest(fps: np.ndarray, counts: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links in one block, breadth first."""
    links, left = [], np.arange(len(fps))
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            i = waiting.pop()
            hit = _near(fps[i], counts[i], fps[left], counts[left], max_distance)
            for j in left[hit]:
                links.append((i, j))
            waiting.extend(left[hit])
            left = left[~hit]
    return links


def _links(cells: np.ndarray, fps: np.ndarray, counts: np.ndarray, max_distance: int):
    """Links within runs of equal cells; ``cells`` is sorted."""
    n = len(cells)
    starts = np.nonzero(np.r_[True, cells[1:] != cells[:-1]])[0]
    sizes = np.diff(np.r_[starts, n])
    out_a, out_b = [], []
    size_of = np.repeat(sizes, sizes)
    small = size_of <= SMALL
    for offset in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        i = np.nonzero(small[:-offset] & (cells[:-offset] == cells[offset:]))[0]
        j = i + offset
        hit = _near(fps[i], counts[i], fps[j], counts[j], max_distance)
        out_a.append(fps[i[hit]])
        out_b.append(fps[j[hit]])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        part = slice(start, start + size)
        pairs = np.array(_forest(fps[part], counts[part], max_distance), dtype=np.int64).reshape(-1, 2)
        out_a.append(fps[part][pairs[:, 0]])
        out_b.append(fps[part][pairs[:, 1]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.uint64)
    a, b = join(out_a), join(out_b)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def fingerprint_links(distinct: DataFrame, max_distance: int = 4, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``fp``, enough of them
    to connect all that are connected by steps of ``max_distance`` bits or fewer."""
    masks = F.array(*[F.lit(m) for m in _cells(max_distance)])
    placed = distinct.select("fp", segment_counts(F.col("fp")).alias("counts")).select(
        "fp",
        "counts",
        F.posexplode(masks).alias("grid", "mask"),
    ).select(
        F.xxhash64("grid", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), "fp", "counts"
    )
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = store(sizes.select("cell", F.ceil(F.col("n") / (block // 2)).cast("int").alias("blocks")), "cells")
    if hot.isEmpty():
        keyed = placed
    else:
        # Each fingerprint of a large cell goes to the meetings of its block with all blocks.
        many = placed.join(hot, "cell", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(
            F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
                F.sequence(F.lit(0), F.col("blocks") - 1)
            )
        )
        spread = many.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
        keyed = spread.select(
            F.when(F.col("blocks").isNull(), F.col("cell"))
            .otherwise(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")))
            .alias("cell"),
            "fp",
            "counts",
        )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = [batch[c].to_numpy(np.int64).view(t) for c, t in (("cell", "i8"), ("fp", "u8"), ("counts", "u8"))]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if not len(rows[0]):
                continue
            # The last cell of a batch may go on in the next one.
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [x[whole:] for x in rows]
            if whole:
                yield _links(*[x[:whole] for x in rows], max_distance)
        if rest is not None and len(rest[0]):
            yield _links(*rest, max_distance)

    together = keyed.repartition("cell").sortWithinPartitions("cell")
    return together.mapInPandas(meet, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", max_distance: int = 4
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Fingerprints link at ``max_distance`` or fewer differing bits; equal ones
    always do. ``component_id`` is the smallest id reachable, itself included.
    Null and empty texts have the fingerprint zero, linked like any other. A null
    id takes part in links but is never the smallest; where a component has no
    other id, ``component_id`` is null. Repeated rows stay repeated.
    """
    return _linked(docs.select(F.col(id).alias("doc_id"), fingerprints(text).alias("fp")), max_distance).drop("root")


def _linked(prints: DataFrame, max_distance: int) -> DataFrame:
    """Add ``root``, one fingerprint of each component, and ``component_id``."""
    marked = store(prints, "prints")
    distinct = store(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "print-classes")
    links = store(fingerprint_links(distinct, max_distance), "links")
    if links.isEmpty():
        classes = distinct.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    else:
        roots = connected(links).withColumnRenamed("node", "fp")
        rooted = store(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
        firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = rooted.join(firsts, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", max_distance: int = 4) -> DataFrame:
    """One document of each component: that with the smallest id (null ids last),
    of several such texts the one with the smallest hash; repeated rows count once."""
    # Two hashes name a row, so that null ids can be joined as well.
    names = {"_k1": F.xxhash64(id, text), "_k2": F.xxhash64(text, id, F.lit(1))}
    prints = docs.select(F.col(id).alias("doc_id"), fingerprints(text).alias("fp"), *[c.alias(n) for n, c in names.items()])
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *names, "n")
    rows = _linked(prints, max_distance).groupBy("root", "doc_id", *names).agg(F.count(F.lit(1)).alias("n"))
    kept = store(rows.groupBy("root").agg(F.min(rank).alias("kept")).select("kept._k1", "kept._k2", "kept.n"), "kept")
    named = docs.withColumns(names)

    def of(some: DataFrame) -> DataFrame:
        # A table of names per part, so that no text is sorted.
        return named.join(some.select(*names).hint("shuffle_hash"), [*names], "left_semi")

    # Texts are brought together only where rows are repeated.
    out, repeated = of(kept.filter("n = 1")), kept.filter("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(of(repeated).dropDuplicates([*names]))
    return out.select(*docs.columns)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
