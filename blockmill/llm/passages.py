"""Near-duplicate passages across documents, through compact windows.

A text is the sequence of its five-word shingles. For one hash function the
smallest hash of a range splits it: a Cartesian tree of ranges, each of which is a
compact window (l, c, r): all passages that begin in [l, c] and end in [c, r] have
the hash at c as their min-hash. A passage of ``WORDS`` words is thus covered by
one window of every hash function. The windows of ``FUNCTIONS`` functions are joined on
their intervals of beginnings: each common interval is a run of passages that
share their min-hashes. ``BANDS`` such bands of functions are kept.

Runs with equal min-hashes in several documents are candidates. A run stands for
those of its band value that are word for word the same, whole. Two distinct runs
are laid over each other at the shared min-hash and linked by the passages of both
that have a Jaccard similarity of ``SIMILARITY``. The distinct runs of a band value
meet block by block, and every two are compared unless links found there connect
them already: what leaves a meeting is a spanning forest of its links, never all
pairs. Documents connected by links are a class; no link between two is lost to it.

Most band values with distinct runs have two, of the same two documents as other band
values near by. Their shingles travel together, once for each document, and what lies
over each other in several of them is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.llm.tables import connected, slices, store, text_of

SHINGLE = 5
#: Words of the shortest passage looked for.
WORDS = 50
SIMILARITY = 0.8
#: Passages at similarity 0.8 share a band value with probability 0.994 (0.76 for two
#: bands of three, 0.997 for eight, which take 2.4 times the windows of five of two).
BANDS, FUNCTIONS = 5, 2
#: Words of text gathered by a task; longer texts are cut into pieces that overlap by a
#: passage.
BATCH_WORDS = 1 << 18
#: Shingles of gathered texts worked on together: their arrays stay in a core's cache.
BLOCK_SHINGLES = 1 << 17
#: Bits of the filter of repeated band values (8 MB, whatever the corpus; a fuller
#: filter lets more rows through to the join that decides).
FILTER_BITS = 1 << 26
#: Most runs of a band value that meet in one place; more are cut into blocks.
BLOCK = 1024
#: Ranges of a document cut out together; for more of them its text is read again.
RANGES = 5_000

#: Pairs of runs compared together, and shingles of a batch that is handed on, about.
_PAIRS, _SHINGLES = 1 << 13, 1 << 19

_LENGTH = WORDS - SHINGLE + 1  # of a passage, in shingles
_SPAN = 2 * _LENGTH - 1  # places that passages with a common place can hold
#: Share of the sum of their distinct shingles that two matching passages have in common.
_SHARED = SIMILARITY / (1 + SIMILARITY)
#: Of a run: band value, document, places, whether it holds its min-hash several times.
_COLUMNS = ["band", "doc", "first", "last", "at", "again", "content"]
_PLACE = np.uint64(20)  # bits of a place within a batch

# Of equal values the one whose scattered place is smallest counts: the trees of
# texts that repeat themselves stay shallow.
_SCATTER = 0x9E375
_GATHER = pow(_SCATTER, -1, 1 << 20)

_u64 = np.uint64
_ODD = _u64(0x9E3779B97F4A7C15)
_INVERSE = _u64(pow(int(_ODD), -1, 1 << 64))


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ _u64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    moved = x >> _u64(30)
    x ^= moved
    x *= _u64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, _u64(27), out=moved)
    x *= _u64(0x94D049BB133111EB)
    x ^= np.right_shift(x, _u64(31), out=moved)
    return x


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingle_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of every run of five words."""
    one = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
    n = len(one) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        out = out * _u64(0x100000001B3) + one[i : i + n]
    return _mixed(out)


def compact_windows(values: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, length: int = _LENGTH, opens: int = 0):
    """``(l, c, r, value)`` of all windows at least ``length`` wide over the ranges
    [first, last], by place. Such a window's ``c`` is the smallest of ``length``
    neighbours, and so are the smaller ones on both its sides, where it ends. Sorted by
    ``c``, and so by the beginnings of their passages. Equal values are told apart by
    places counted from ``opens``."""
    low_bits = _u64((1 << 20) - 1)
    minima = (values & ~low_bits) | _scattered(opens, len(values))
    wide = np.nonzero(lasts - firsts + 1 >= length)[0]
    if not len(wide):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    width = 1
    while width < length:
        step = min(width, length - width)
        minima = np.minimum(minima[:-step], minima[step:])
        width += step
    # Beginnings of ``length`` neighbours that lie in one range; each window has some, in a row.
    steps = np.zeros(len(minima) + 1, dtype=np.int8)
    steps[firsts[wide]] += 1
    steps[lasts[wide] - length + 2] -= 1
    begins = np.nonzero(np.cumsum(steps[:-1], dtype=np.int8))[0]
    best = minima[begins]
    best = best[np.r_[True, best[1:] != best[:-1]]]
    middle = ((best & low_bits) * _u64(_GATHER) & low_bits).astype(np.int64) - opens
    owner = np.searchsorted(firsts, middle, "right") - 1
    before, after = _smaller(best), len(best) - 1 - _smaller(best[::-1])[::-1]
    low = np.where(before >= 0, middle[before] + 1, 0)
    high = np.where(after < len(best), middle[np.minimum(after, len(best) - 1)] - 1, len(values))
    return np.maximum(low, firsts[owner]), middle, np.minimum(high, lasts[owner]), best >> _PLACE


@lru_cache(maxsize=1)
def _scattered(opens: int, n: int) -> np.ndarray:
    return np.arange(opens, opens + n, dtype=np.uint64) * _u64(_SCATTER) & _u64((1 << 20) - 1)


def _smaller(values: np.ndarray) -> np.ndarray:
    """For each of distinct values the place of the next smaller one before it, else -1."""
    before = np.arange(len(values)) - 1
    left = np.nonzero(before >= 0)[0]
    while len(left):
        left = left[values[before[left]] > values[left]]
        before[left] = before[before[left]]
        left = left[before[left] >= 0]
    return before


def _runs(shingles: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, opens: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """For each band: beginnings [a, b] of passages that share its min-hashes, the
    place of the first of them, and the band value; sorted by beginning."""
    for band in range(BANDS):
        begins, values, middles, ends = [], [], [], None
        for n in range(FUNCTIONS):
            l, c, r, v = compact_windows(_mixed(shingles, 1 + band * FUNCTIONS + n), firsts, lasts, opens=opens)
            begins.append(np.maximum(l, c - _LENGTH + 1))
            values.append(v)
            middles.append(c)
            if n == 0:
                ends = np.minimum(c, r - _LENGTH + 1)
        # The intervals of every function cover the same beginnings, so their
        # join is the common refinement.
        marks = np.zeros(len(shingles), dtype=bool)
        for begin in begins:
            marks[begin] = True
        a = np.nonzero(marks)[0]
        value = np.zeros(len(a), dtype=np.uint64)
        for begin, v in zip(begins, values):
            value = _mixed(value ^ v[np.searchsorted(begin, a, "right") - 1], band + 11)
        first = np.searchsorted(begins[0], a, "right") - 1
        # A run ends where the next begins, at the latest where its window does.
        b = np.minimum(np.r_[a[1:] - 1, len(shingles)], ends[first])
        yield a, b, middles[0][first], value


def _pieces(ids, texts):
    """Texts gathered to about ``BATCH_WORDS`` words: numbers, shingles, offsets."""
    gathered, size = [], 0
    for n, text in zip(ids, texts, strict=True):
        words = words_of(text)
        for at in range(0, max(len(words) - WORDS + 1, 0), BATCH_WORDS):
            part = words[at : at + BATCH_WORDS + WORDS - 1]
            if size + len(part) > BATCH_WORDS and gathered:
                yield gathered
                gathered, size = [], 0
            gathered.append((n, at, shingle_hashes(part)))
            size += len(part)
    if gathered:
        yield gathered


def _rows(gathered, columns: list[str] = _COLUMNS, bits: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The runs of gathered texts; with a filter those whose band value is in it."""
    sizes = np.cumsum([0, *(len(s) for _, _, s in gathered)])
    block = sizes[:-1] // BLOCK_SHINGLES
    cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(gathered)]
    for low, high in pairwise(cuts):
        yield _rows_of(gathered[low:high], int(sizes[low]), columns, bits)


def _rows_of(gathered, opens: int, columns: list[str], bits: np.ndarray | None) -> pd.DataFrame:
    """The runs of texts that stand from the place ``opens`` on in what was gathered."""
    found = []
    sizes = np.array([len(s) for _, _, s in gathered], dtype=np.int64)
    lasts = np.cumsum(sizes) - 1
    firsts = lasts - sizes + 1
    shingles = np.concatenate([s for _, _, s in gathered])
    docs = np.array([d for d, _, _ in gathered], dtype=np.int64)
    offset = np.array([a for _, a, _ in gathered], dtype=np.int64) - firsts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    placed = len(columns) > 2
    if placed:
        # Sums of shingles times the powers of an odd number: the hash of any range.
        power, inverse = (np.cumprod(np.r_[_u64(1), np.full(len(shingles), x)]) for x in (_ODD, _INVERSE))
        sums = np.r_[_u64(0), np.cumsum(shingles * power[:-1])]
        # The places before and after each where the same shingle stands.
        order = np.argsort(shingles, kind="stable")
        same = shingles[order[1:]] == shingles[order[:-1]]
        before, after = np.full(len(shingles), -1), np.full(len(shingles), len(shingles))
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    for a, b, c, value in _runs(shingles, firsts, lasts, opens):
        if bits is not None:
            kept = np.nonzero(_held(bits, value))[0]
            a, b, c, value = a[kept], b[kept], c[kept], value[kept]
        doc = owner[a]
        rows = {"band": value.view(np.int64), "doc": docs[doc]}
        if placed:
            rows |= {
                "first": (a + offset[doc]).astype(np.int32),
                "last": (b + offset[doc]).astype(np.int32),
                "at": (c + offset[doc]).astype(np.int32),
                "again": (before[c] >= a) | (after[c] < b + _LENGTH),
                # Hash of all shingles of the run, in their order.
                "content": _mixed((sums[b + _LENGTH] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)).view(np.int64),
            }
        found.append(rows)
    return pd.DataFrame({c: np.concatenate([rows[c] for rows in found]) for c in columns})


def _runs_of(docs: DataFrame, columns: list[str], shared=None) -> DataFrame:
    """Runs of all documents; with a filter only those whose band value may be repeated."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for gathered in _pieces(batch["doc"], batch["text"]):
                yield from _rows(gathered, columns, bits)

    kinds = {"band": "long", "doc": "long", "content": "long", "again": "boolean"}
    return docs.mapInPandas(find, ", ".join(f"{c} {kinds.get(c, 'int')}" for c in columns))


def _filter_of(bands: DataFrame) -> np.ndarray:
    """Filter of band values, put together by Spark: at most 2 ** 20 rows come here."""
    place = F.pmod(F.col("band"), F.lit(FILTER_BITS))
    words = bands.select(
        F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(band, {FILTER_BITS}) & 63 as int))").alias("b")
    ).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[words["w"].to_numpy().astype(np.int64)] = words["b"].to_numpy().view(np.uint64)
    return out


def _held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be among those of the filter."""
    at = values % _u64(FILTER_BITS)
    return ((bits[(at >> _u64(6)).astype(np.int64)] >> (at & _u64(63))) & _u64(1)).astype(bool)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the passages of two equally long rows of shingles,
    of those that begin at the same place."""
    both = _laid([1], [0], [x], [0], [0], [y])
    sim = both.similar(*next(both._pairs()))[-1]
    return np.concatenate([row[: high + 1] for row, high in zip(sim, both.high[1::2])])


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, partner_id, first_word, last_word, partner_first_word, partner_last_word,
    similarity, component_id``: stretches of a document made of passages of ``WORDS`` words
    that a document with a smaller id has as well, with their smallest similarity, and
    the smallest id of the document's class.

    Documents are of one class if links connect them, whatever passages these are of. A
    passage that is word for word the same in many documents gives one row for each but
    one of them, the smallest, which stands for all. Those that stand for different
    passages are linked to the first that they match, and where that leaves classes of a
    band value apart, to further ones: rows grow with the runs, not with their pairs.
    A document that only stands for others is told as their partner.
    Null and short texts have no passages; rows with a null id, or with the id of
    another row, take part but are not compared with themselves. Words are split
    at white space and lower-cased.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id).cast("long").alias("doc"), text_of(text).alias("text")).filter("doc IS NOT NULL")
    # The values of clean text are nearly all different: only the band value and
    # the ids travel. Minima and maxima are taken before the shuffle.
    repeated = _runs_of(own, _COLUMNS[:2]).groupBy("band").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    repeated = store(repeated.filter("a <> b").select("band"), "bands")
    shared = spark.sparkContext.broadcast(_filter_of(repeated))
    runs = store(_runs_of(own, _COLUMNS, shared).join(repeated, "band", "left_semi"), "runs")

    # Equal runs of a band value: one stands for all.
    place = F.struct("doc", "first", "last", "at", "again")
    stands = runs.groupBy("band", "content").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n"))
    stands = store(stands.select("band", "content", "n", "p.*"), "stands")
    renamed = [F.col(c).alias(f"p_{c}") for c in ("doc", "first")]
    links = store(
        runs.join(stands.select("band", "content", *renamed), ["band", "content"]).filter("doc <> p_doc").select(
            "doc", "p_doc", (F.col("p_first") - F.col("first")).alias("shift"), F.col("first").alias("low"), F.col("last").alias("high"), F.lit(1.0).alias("sim")
        ),
        "links",
    )
    met = _meetings(own, stands)
    # As many parts as are set: few bytes can be much work here.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "meeting").sortWithinPartitions("meeting").mapInArrow(_meet, _LINKED)
    told = store(_stretches(links.unionByName(met)), "stretches")
    if told.isEmpty():
        return told.withColumn("component_id", F.col("partner_id"))
    classes = connected(told.select(F.col("doc_id").alias("a"), F.col("partner_id").alias("b")).distinct())
    return told.join(classes.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")), "doc_id")


_LINKED = "doc long, p_doc long, shift int, low int, high int, sim double"
#: Of a range to be cut out: what its meeting follows from, and the run.
_RANGE = ["key", "mine", "blocks", "band", "first", "last", "at", "again"]


def _laid(doc, first, shingles, p_doc, p_first, p_shingles) -> _Meetings:
    """Pairs of equally long stretches, beginning over beginning, each cut into pieces."""
    pieces = [max(1, -(-(len(x) - _LENGTH + 1) // _LENGTH)) for x in shingles]
    n = np.repeat(np.arange(len(pieces)), pieces)
    moved = (np.arange(len(n)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _LENGTH
    cut = [x[k][at : at + _SPAN] for k, at in zip(n, moved) for x in (p_shingles, shingles)]
    docs, firsts = (
        np.stack([np.asarray(a)[n], np.asarray(b)[n]], axis=1) + at
        for a, b, at in ((p_doc, doc, 0), (p_first, first, moved[:, None]))
    )
    numbers = np.repeat(np.arange(len(n)), 2)
    first = firsts.ravel()
    return _Meetings(numbers, docs.ravel(), first, first + _LENGTH - 1, numbers < 0, numbers * 0 - 1, cut)


def _meetings(docs: DataFrame, stands: DataFrame) -> DataFrame:
    """The runs to be compared, ``BLOCK`` at most to a meeting, of band values that
    distinct runs of several documents have; those of a document that overlap within a
    meeting in one row. Band values with two runs meet with others of the same two
    documents. ``side`` is null where all of a meeting are compared, else those of
    different sides are."""
    sizes = stands.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"), F.min("first").alias("from")
    ).filter("a <> b")
    blocks = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / (BLOCK // 2))).otherwise(1).cast("int")
    near = F.xxhash64("a", "b", F.floor(F.col("from") / BLOCK))
    key = F.when(F.col("n") == 2, near).otherwise(F.xxhash64("band"))
    named = stands.select("band", "doc", "first", "last", "at", "again")
    rows = named.join(sizes.select("band", blocks.alias("blocks"), key.alias("key")), "band")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("doc", "first"), F.col("blocks")).cast("int"))
    rows = _with_shingles(docs, rows)
    mine = F.col("mine")

    def meeting(other: Column) -> Column:
        return F.struct(
            F.xxhash64("key", F.least(mine, other), F.greatest(mine, other)).alias("meeting"),
            F.when(mine != other, (mine > other).cast("int")).alias("side"),
        )

    rows = rows.withColumn("goes", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), meeting)))
    return rows.select("goes.*", "doc", "start", "shingles", *_RANGE[3:])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by meeting; the last meeting of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        meeting = batch.column("meeting").to_numpy()
        opens = np.nonzero(np.r_[True, meeting[1:] != meeting[:-1]])[0]
        rest = batch.slice(opens[-1])
        part = (np.cumsum(batch.column("band").value_lengths().to_numpy())[opens] - 1) // (4 * _PAIRS)
        cuts = [*opens[np.r_[True, part[1:] != part[:-1]]].tolist(), int(opens[-1])]
        for low, high in pairwise(cuts):
            yield _linked(batch.slice(low, high - low))
    if rest is not None:
        yield _linked(rest)


def _linked(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Links of whole meetings."""
    sizes, lengths = (rows.column(c).value_lengths().to_numpy().astype(np.int64) for c in ("band", "shingles"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    band, first, last, at, again = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in _RANGE[3:])
    meeting, doc, start = (rows.column(c).to_numpy()[row] for c in ("meeting", "doc", "start"))
    side = rows.column("side").fill_null(-1).to_numpy().astype(np.int64)[row]
    whole = rows.column("shingles").flatten().to_numpy()
    base = (np.cumsum(lengths) - lengths)[row] - start
    order = np.lexsort((first, doc, band, meeting))
    row, meeting, band, doc, first, last, at, again, side, base = (
        x[order] for x in (row, meeting, band, doc, first, last, at, again, side, base)
    )
    fresh = np.r_[True, (meeting[1:] != meeting[:-1]) | (band[1:] != band[:-1])][: len(band)]
    opens, numbers = np.nonzero(fresh)[0], np.cumsum(fresh) - 1
    # Two runs with one place each for their min-hash are compared at that place alone.
    u = opens[np.bincount(numbers) == 2]
    u = u[(doc[u] != doc[u + 1]) & ~again[u] & ~again[u + 1] & (side[u] < 0)]
    others = np.ones(len(doc), dtype=bool)
    others[u] = others[u + 1] = False
    found, others = [], np.nonzero(others)[0]
    if len(others) > 1:
        told = [x[others] for x in (doc, first, at, again, side)]
        runs = zip((base + first)[others].tolist(), (base + last + _LENGTH)[others].tolist())
        found += _Meetings(numbers[others], *told, [whole[a:b] for a, b in runs]).forest()
    shift = at[u] - at[u + 1]
    low, high = np.maximum(first[u + 1], first[u] - shift), np.minimum(last[u + 1], last[u] - shift)
    kept = low <= high
    u, shift, low, high = u[kept], shift[kept], low[kept], high[kept]
    if len(u):
        keys = row[u + 1], row[u], shift
        order = np.lexsort((low, *keys[::-1]))
        u, shift, low, high = u[order], shift[order], low[order], high[order]
        opens, high = _unions(_numbered(*(x[order] for x in keys)), low, high)
        u, shift, low = u[opens], shift[opens], low[opens]
        size = high - low + _LENGTH
        x, y = (
            [whole[a : a + n] for a, n in zip(begins.tolist(), size.tolist())]
            for begins in (base[u + 1] + low, base[u] + low + shift)
        )
        found += _laid(doc[u + 1], low, x, doc[u], low + shift, y).links()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    columns = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0)] * len(kinds)
    names = [c.split()[0] for c in _LINKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(columns, kinds)], names)


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the groups of equal keys, which follow each other."""
    return np.cumsum(np.any([np.diff(x, prepend=x[:1]) != 0 for x in keys], axis=0))


def _unions(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of intervals [low, high], sorted by group and low: those where a union of
    neighbouring ones of a group opens, and where the union ends."""
    group, low = group.astype(np.int64) << 32, low.astype(np.int64)
    reach = np.maximum.accumulate(group + high)
    opens = np.nonzero(np.r_[True, group[1:] + low[1:] > reach[:-1] + 1])[0]
    return opens, reach[np.r_[opens[1:], len(group)] - 1] - group[opens]


class _Meetings:
    """Pairs of the runs of each meeting, many pairs at a time.

    Runs are laid over each other at their min-hash, so a place of a run is one of
    ``_SPAN`` columns and a beginning of a passage one of ``_LENGTH``. A shingle that
    all its holders in a meeting have in one column is counted column by column;
    others, such as those after an inserted word or those that a run repeats, are
    counted by the beginnings whose passages hold it in both runs.
    """

    def __init__(self, meeting, doc, first, at, again, side, shingles):
        self.doc, self.first, self.at, self.side = doc.astype(np.int64), first.astype(np.int64), at.astype(np.int64), side
        self.again, self.shingles = again.astype(bool), shingles
        n = len(shingles)
        sizes = np.array([len(x) for x in shingles], dtype=np.int64)
        self.low = self.first - self.at + _LENGTH - 1
        self.high = self.low + sizes - _LENGTH
        self.opens = np.searchsorted(meeting, meeting)
        row = np.repeat(np.arange(n), sizes)
        column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - self.low, sizes)
        code = meeting[row] << 32 | np.concatenate(shingles).astype(np.int64) & 0xFFFFFFFF
        within = (column >= 0) & (column < _SPAN)
        code, row, column = code[within], row[within], column[within]
        order = np.argsort(code, kind="stable")
        code, row, column = code[order], row[order], column[order]
        begins = np.nonzero(np.r_[True, code[1:] != code[:-1]])[0]
        group = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(code)]))
        mixed = (np.minimum.reduceat(column, begins) != np.maximum.reduceat(column, begins))[group]
        self.table = np.repeat(-1 - np.arange(n, dtype=np.int32)[:, None], _SPAN, axis=1)
        self.table[row[~mixed], column[~mixed]] = group[~mixed]
        group, row, column = group[mixed], row[mixed], column[mixed]
        opens, since, until = _spans(group * n + row, column)
        # Distinct shingles of every passage: of each span with several places one counts.
        several = until - since >= _LENGTH
        places = np.repeat(several, np.diff(np.r_[opens, len(row)]))
        more = _covered(row[places], column[places] - _LENGTH + 1, column[places], n)
        self.distinct = _LENGTH - more + _covered(row[opens][several], since[several], until[several], n)
        begin = np.arange(_LENGTH)
        inside = (begin >= self.low[:, None]) & (begin <= self.high[:, None])
        self.least = np.where(inside, self.distinct, _LENGTH).min(axis=1)
        # Spans by shingle: where those of their shingle begin; and their numbers by run.
        group, self.row, self.since, self.until = group[opens], row[opens], since, until
        self.heads, self.tails = np.searchsorted(group, group), np.searchsorted(group, group, "right")
        self.by_run = np.argsort(self.row, kind="stable")
        self.ends = np.searchsorted(self.row[self.by_run], np.arange(n + 1))
        self.sets = {}

    def links(self) -> list[tuple]:
        """Of all pairs that match."""
        return [self._told(*found) for v, u in self._pairs() for found in self._matched(v, u)]

    def forest(self) -> list[tuple]:
        """Of pairs enough to connect all runs that links connect: each run's first, and
        those that join classes."""
        out, classes = [], np.arange(len(self.doc))
        for v, u in self._pairs(classes):
            found = [*self._matched(v, u)]
            if not found:
                continue
            found = [np.concatenate(x) for x in zip(*found)]
            mine, theirs = found[:2]
            first = np.unique(classes[mine], return_index=True)[1]
            kept = np.isin(mine, mine[first])
            out.append(self._told(*(x[kept] for x in found)))
            into = np.arange(len(classes))
            into[classes[mine[first]]] = classes[theirs[first]]
            classes[:] = into[classes]
        return out

    def _told(self, v, u, shift, opens, closes, least) -> tuple:
        base = self.at[v] - _LENGTH + 1
        return self.doc[v], self.doc[u], shift, base + opens, base + closes, least

    def _pairs(self, classes: np.ndarray | None = None) -> Iterator[tuple]:
        """Runs and the one of their meeting they are paired with: its first, then its
        second, and so on. With classes only those of different ones."""
        rank = np.arange(len(self.doc)) - self.opens
        left, at = np.nonzero(rank > 0)[0], 0
        while len(left):
            u = self.opens[left] + at
            apart = (self.doc[u] != self.doc[left]) & ((self.side[u] != self.side[left]) | (self.side[u] < 0))
            if classes is not None:
                apart &= classes[u] != classes[left]
            v, u = left[apart], u[apart]
            for n in range(0, len(v), _PAIRS):
                yield v[n : n + _PAIRS], u[n : n + _PAIRS]
            at += 1
            left = left[rank[left] > at]

    def _matched(self, v: np.ndarray, u: np.ndarray) -> Iterator[tuple]:
        """Runs, those paired with them, how far these are moved, and the beginnings from
        where to where they match, with the least similarity."""
        v, u, low, high, sim = self.similar(v, u)
        begin = np.arange(_LENGTH)
        alike = (sim >= SIMILARITY) & (begin >= low[:, None]) & (begin <= high[:, None])
        found = alike.any(axis=1)
        hits = np.nonzero(found)[0]
        if len(hits):
            edges = np.diff(np.pad(alike[hits].astype(np.int8), ((0, 0), (1, 1))), axis=1)
            which, opens = np.nonzero(edges == 1)
            closes = np.nonzero(edges == -1)[1]
            padded = np.pad(sim[hits], ((0, 0), (0, 1))).ravel()
            spans = np.stack([which, which], axis=1) * (_LENGTH + 1) + np.stack([opens, closes], axis=1)
            least = np.minimum.reduceat(padded, spans.ravel())[::2]
            mine, theirs = v[hits][which], u[hits][which]
            yield mine, theirs, self.at[theirs] - self.at[mine], opens, closes - 1, least
        rest = ~found & (self.again[u] | self.again[v])
        if rest.any():
            yield from self._elsewhere(v[rest], u[rest])

    def similar(self, v: np.ndarray, u: np.ndarray) -> tuple:
        """Of the pairs that can match: both runs, the beginnings that both have, and the
        similarities of their passages. A run is paired with one other at a time."""
        low, high = np.maximum(self.low[u], self.low[v]), np.minimum(self.high[u], self.high[v])
        taken = (low <= high) | self.again[u] | self.again[v]
        v, u, low, high = v[taken], u[taken], low[taken], high[taken]
        sums = np.zeros((len(u), _SPAN + 1), dtype=np.uint8)
        np.cumsum(self.table[u] == self.table[v], axis=1, dtype=np.uint8, out=sums[:, 1:])
        both = (sums[:, _LENGTH:] - sums[:, : _LENGTH]).astype(np.int64)
        # Shingles in several columns: each span of the others with those of its shingle.
        other = np.unique(u)
        y = self.by_run[_ranges(self.ends[other], self.ends[other + 1])]
        if len(y):
            x = _ranges(self.heads[y], self.tails[y])
            y = np.repeat(y, self.tails[y] - self.heads[y])
            slot = np.full(len(self.doc), -1)
            slot[v] = np.arange(len(v))
            pair = slot[self.row[x]]
            kept = np.nonzero(pair >= 0)[0]
            x, y = x[kept], y[kept]
            both += _covered(pair[kept], np.maximum(self.since[x], self.since[y]), np.minimum(self.until[x], self.until[y]), len(u))
        total = self.distinct[u] + self.distinct[v] - both
        return v, u, low, high, both / np.maximum(total, 1)

    def _elsewhere(self, v: np.ndarray, u: np.ndarray) -> Iterator[tuple]:
        """A min-hash that a run holds several times is tried at its other places as
        well, those nearest to its first one first."""
        trials = []
        enough = _SHARED * (self.least[v] + self.least[u]) - 1e-6
        for n, (i, j) in enumerate(zip(v.tolist(), u.tolist())):
            if len(self._set(i) & self._set(j)) < enough[n]:
                continue
            a, b = self.shingles[i], self.shingles[j]
            at, p_at = int(self.at[i] - self.first[i]), int(self.at[j] - self.first[j])
            mine, theirs = np.nonzero(a == a[at])[0], np.nonzero(b == b[p_at])[0]
            others = set(np.subtract.outer(mine, theirs).ravel().tolist()) - {at - p_at}
            trials += [(n, x) for x in sorted(others, key=abs) if min(len(a), len(b) + x) - max(0, x) >= _LENGTH]
        done = np.zeros(len(v), dtype=bool)
        for at in range(0, len(trials), _PAIRS // 8):
            n, moved = np.array(trials[at : at + _PAIRS // 8]).T
            n, moved = n[~done[n]], moved[~done[n]]
            if not len(n):
                continue
            rows = np.stack([u[n], v[n]], axis=1).ravel()
            shift = self.first[u[n]] - self.first[v[n]] - moved
            place = np.stack([self.at[v[n]] + shift, self.at[v[n]]], axis=1).ravel()
            numbers = np.arange(len(rows)) // 2
            tried = _Meetings(
                numbers, self.doc[rows], self.first[rows], place, numbers < 0, numbers * 0 - 1, [self.shingles[r] for r in rows]
            )
            for mine, _, _, *found in (x for pair in tried._pairs() for x in tried._matched(*pair)):
                trial = mine // 2
                # The first trial of a pair that finds something counts; they come in order.
                first = np.searchsorted(n[trial], n[trial])
                kept = (trial == trial[first]) & ~done[n[trial]]
                pair = n[trial[kept]]
                yield v[pair], u[pair], shift[trial[kept]], *(x[kept] for x in found)
                done[n[trial]] = True

    def _set(self, n: int) -> set:
        if n not in self.sets:
            self.sets[n] = set(self.shingles[n].tolist())
        return self.sets[n]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each of ``low`` to below its ``high``, in a row."""
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


def _spans(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of places that are sorted by key: where a span opens, and its beginnings of
    passages. Places of a key that follow each other within a passage are one span."""
    opens = np.nonzero(np.r_[True, (keys[1:] != keys[:-1]) | (places[1:] - places[:-1] > _LENGTH)][: len(keys)])[0]
    closes = np.r_[opens[1:], len(keys)][: len(opens)] - 1
    return opens, places[opens] - _LENGTH + 1, places[closes]


def _covered(row: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """How many of the intervals [low, high] of each of ``n`` rows hold each beginning."""
    low, high = np.maximum(low, 0), np.minimum(high, _LENGTH - 1)
    some = low <= high
    row, low, high = row[some] * (_LENGTH + 1), low[some], high[some]
    size = n * (_LENGTH + 1)
    steps = np.bincount(row + low, minlength=size) - np.bincount(row + high + 1, minlength=size)
    return np.cumsum(steps.reshape(n, -1), axis=1)[:, :-1]


def _links_of(rows: list[list]) -> list[tuple]:
    """Links of one meeting's runs, given in order: of each run to every other before it
    that it matches, in another document."""
    if len(rows) < 2:
        return []
    doc, first, at, shingles, again, side = zip(*rows)
    sides = np.full(len(rows), -1) if pd.isna(side[0]) else np.array(side, dtype=np.int64)
    told = [np.array(x) for x in (doc, first, at, again)]
    found = _Meetings(np.zeros(len(rows), dtype=np.int64), *told, sides, [np.asarray(x) for x in shingles]).links()
    return [tuple(x) for links in found for x in zip(*(c.tolist() for c in links))]


def _with_shingles(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each document and meeting the runs that overlap, and the shingles of all
    passages that begin at their first to last (32 bits of each hash)."""
    number = F.row_number().over(Window.partitionBy("doc").orderBy("first"))
    parts = ranges.withColumn("part", F.floor((number - 1) / RANGES)).groupBy("doc", "part")
    wanted = store(parts.agg(F.collect_list(F.struct(*_RANGE)).alias("wanted")), "wanted")
    # Texts without ranges are not shuffled.
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted.select(F.xxhash64("doc").alias("band"))))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _held(shared.value, batch.column("hash").to_numpy().view(np.uint64))
            yield batch.select(["doc", "text"]).filter(pa.array(kept))

    own = docs.select("doc", "text", F.xxhash64("doc").alias("hash")).mapInArrow(held, "doc long, text string")
    told = "key long, mine int, blocks int, band array<long>, first array<int>, last array<int>, at array<int>, again array<boolean>"
    return own.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(
        _cut, f"doc long, start int, shingles array<int>, {told}"
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield from _overlapping(part)


def _overlapping(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The ranges of each text that overlap within a meeting, with their shingles."""
    texts = [(shingle_hashes(words_of(x)) >> _u64(32)).astype(np.uint32).view(np.int32) for x in rows.column("text").to_pylist()]
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), rows.column("wanted").value_lengths().to_numpy())
    flat = rows.column("wanted").flatten().flatten()
    runs = {c: x.to_numpy(zero_copy_only=False) for c, x in zip(_RANGE, flat, strict=True)}
    # Another text of the same id may be too short.
    kept = np.nonzero(runs["last"] + _LENGTH <= sizes[owner])[0]
    if not len(kept):
        return
    order = kept[np.lexsort([x[kept] for x in (runs["first"], runs["mine"], runs["key"], owner)])]
    runs, owner = {c: x[order] for c, x in runs.items()}, owner[order]
    begins = (np.cumsum(sizes) - sizes)[owner]
    low = begins + runs["first"]
    opens, high = _unions(_numbered(owner, runs["key"], runs["mine"]), low, begins + runs["last"] + _LENGTH - 1)
    low, high, closes, whole = low[opens], high + 1, np.r_[opens[1:], len(owner)], np.concatenate(texts)
    part = (np.cumsum(high - low) - 1) // _SHINGLES
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(opens)]
    doc = rows.column("doc").to_numpy()[owner[opens]]
    for a, b in pairwise(cuts):
        inside, at = slice(opens[a], closes[b - 1]), opens[a:b]
        told = {"doc": doc[a:b], "start": runs["first"][at]}
        told["shingles"] = _lists(whole[_ranges(low[a:b], high[a:b])], high[a:b] - low[a:b])
        told |= {c: runs[c][at] for c in _RANGE[:3]} | {c: _lists(runs[c][inside], closes[a:b] - at) for c in _RANGE[3:]}
        yield pa.RecordBatch.from_pydict(told)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _stretches(pairs: DataFrame) -> DataFrame:
    """Neighbouring passages with one partner, at one distance, as one stretch of
    the document with the larger id."""
    turned = F.col("doc") < F.col("p_doc")
    moved = F.when(turned, F.col("shift")).otherwise(0)
    placed = pairs.select(
        F.greatest("doc", "p_doc").alias("doc"),
        F.least("doc", "p_doc").alias("p_doc"),
        F.when(turned, -F.col("shift")).otherwise(F.col("shift")).alias("shift"),
        (F.col("low") + moved).alias("low"),
        (F.col("high") + moved + WORDS - 1).alias("high"),
        "sim",
    )
    order = Window.partitionBy("doc", "p_doc", "shift").orderBy("low")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("low") <= reach + 1, 0).otherwise(1)
    numbered = placed.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc", "p_doc", "shift", "n").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("sim").alias("similarity")
    )
    return joined.select(
        F.col("doc").alias("doc_id"),
        F.col("p_doc").alias("partner_id"),
        F.col("low").cast("long").alias("first_word"),
        F.col("high").cast("long").alias("last_word"),
        (F.col("low") + F.col("shift")).cast("long").alias("partner_first_word"),
        (F.col("high") + F.col("shift")).cast("long").alias("partner_last_word"),
        "similarity",
    )
