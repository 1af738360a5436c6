"""Finding benchmark items in training text with a BM25 index of the items.

Every passage of every text is a query. Passages are windows of two lengths of the
longest item, starting every such length, so that an item lies whole in one of
them. A score is the BM25 sum over the terms that passage and item share, as a
share of what the item scores against itself; all items above a threshold are
wanted. Items are stored in blocks, and of each term the index keeps its largest
weight in each block: a passage skips every block whose maxima cannot add up to
the threshold. Terms that occur in many items are left out of that sum altogether
and answered for by lowering the threshold by the most they can contribute to any
item. What is left is scored exactly, then checked word by word: enough of the
word shingles of the whole item, or of its question and of its answer where they
stand apart, have to be in the passage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm.tables import store, text_of

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage has to reach.
SCORE = 0.6
#: Most of any item's own score that frequent terms may make up together.
FREQUENT = 0.3
#: Share of the shingles of the item, or of question and answer each, to be found.
OVERLAP = 0.8
SHINGLE = 5
#: Shorter answers, of which one changed word can take over a fifth of the shingles,
#: are also judged by their words.
SHORT_WORDS = 29
BLOCK_ITEMS = 8
#: Words of an index that is broadcast, at most; more items make more indexes,
#: each of which all texts are held against.
INDEX_WORDS = 5_000_000
#: Words of text looked at together by a task.
BATCH_WORDS = 100_000

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")

FOUND = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence is the answer, and an
    item of one sentence is both."""
    parts = [p for p in _SENTENCE_END.split(text.strip()) if words_of(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _share(wanted: set, words: list[str]) -> float:
    """Share of ``wanted`` shingles that are in ``words``; none wanted: all found."""
    if not wanted:
        return 1.0
    size = len(next(iter(wanted)))
    have = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return len(wanted & have) / len(wanted)


class BenchmarkIndex:
    """Items of similar length: ``[(item_id, text)]``, with document frequencies
    and mean length taken over all items of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], count: int, mean: float):
        items = sorted(items, key=lambda x: (x[1], x[0]))
        self.ids = [i for i, _ in items]
        self.parts = [tuple(shingles(words_of(p)) for p in split_item(t)) for _, t in items]
        self.whole = [shingles(words_of(t)) for _, t in items]
        self.short = [{(w,) for w in a} if len(a) < SHORT_WORDS else set() for a in (words_of(split_item(t)[1]) for _, t in items)]
        counts = [Counter(words_of(t)) for _, t in items]
        self.longest = max(sum(c.values()) for c in counts)
        self.words = sum(sum(c.values()) for c in counts)
        self.terms = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
        self.weights: list[dict[int, float]] = []
        for c in counts:
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            w = {
                self.terms[t]: np.log1p((count - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm)
                for t, n in c.items()
            }
            own = sum(w.values())
            self.weights.append({t: x / own for t, x in w.items()})
        self._leave_out(frequency)
        self._store_blocks()

    def _leave_out(self, frequency: dict[str, int]) -> None:
        """Frequent terms, most frequent first, while no item owes them too much."""
        holders: dict[int, list[int]] = {}
        for i, w in enumerate(self.weights):
            for t in w:
                holders.setdefault(t, []).append(i)
        owed, out = np.zeros(len(self.weights)), set()
        for term, t in sorted(self.terms.items(), key=lambda x: (-frequency[x[0]], x[0])):
            more = [owed[i] + self.weights[i][t] for i in holders[t]]
            if max(more) <= FREQUENT:
                owed[holders[t]] = more
                out.add(t)
        self.frequent = out
        self.owed = owed

    def _store_blocks(self) -> None:
        self.blocks = -(-len(self.weights) // BLOCK_ITEMS)
        best: dict[tuple[int, int], float] = {}
        for i, w in enumerate(self.weights):
            for t, x in w.items():
                if t not in self.frequent:
                    key = (t, i // BLOCK_ITEMS)
                    best[key] = max(best.get(key, 0.0), x)
        keys = sorted(best)
        self.block_of = np.array([b for _, b in keys], dtype=np.int64)
        self.most = np.array([best[k] for k in keys], dtype=np.float64)
        self.starts = np.searchsorted([t for t, _ in keys], np.arange(len(self.terms) + 1))
        self.least = SCORE - np.array(
            [self.owed[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(self.blocks)]
        )

    def find(self, texts: list[list[str]]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text ``{item number: (score, question share, answer share)}``."""
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        if not texts:
            return found
        step, get = self.longest, self.terms.get
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        terms = np.fromiter((get(w, -1) for words in texts for w in words), dtype=np.int64, count=int(sizes.sum()))
        first = np.r_[0, np.cumsum(sizes)]
        windows = np.r_[0, np.cumsum(np.maximum(-(-sizes // step), 1))]
        at = np.nonzero(terms >= 0)[0]
        at = at[self.starts[terms[at] + 1] > self.starts[terms[at]]]
        text = np.searchsorted(first, at, "right") - 1
        window = windows[text] + (at - first[text]) // step
        count = self.starts[terms[at] + 1] - self.starts[terms[at]]
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.starts[terms[at]], count)
        # A passage begins at each step and holds the words of two steps.
        half = np.bincount(
            np.repeat(window, count) * self.blocks + self.block_of[entry], self.most[entry], int(windows[-1]) * self.blocks
        ).reshape(-1, self.blocks)
        bound = half.copy()
        bound[:-1] += half[1:]
        bound[windows[1:] - 1] = half[windows[1:] - 1]  # the last step of a text has none behind it
        for w, block in zip(*np.nonzero(bound >= self.least - 1e-9)):
            n = int(np.searchsorted(windows, w, "right")) - 1
            low = int(w - windows[n]) * step
            self._score(texts[n][low : low + 2 * step], terms[first[n] + low : first[n] + min(low + 2 * step, sizes[n])], int(block), found[n])
        return found

    def _score(self, words: list[str], terms: np.ndarray, block: int, found: dict) -> None:
        have = set(terms.tolist())
        for i in range(block * BLOCK_ITEMS, min((block + 1) * BLOCK_ITEMS, len(self.weights))):
            score = sum(x for t, x in self.weights[i].items() if t in have)
            if score < SCORE - 1e-9:
                continue
            question, answer = (_share(part, words) for part in self.parts[i])
            if self.short[i]:
                answer = max(answer, _share(self.short[i], words))
            if min(question, answer) >= OVERLAP or _share(self.whole[i], words) >= OVERLAP:
                found[i] = max(found.get(i, (0.0, 0.0, 0.0)), (score, question, answer))


def build_indexes(items: DataFrame, id: str = "item_id", text: str = "text") -> list[BenchmarkIndex]:
    """Indexes over all items, by classes of length and at most ``INDEX_WORDS``
    words each. Null ids, and texts without words, are left out."""
    split = F.udf(words_of, "array<string>")
    own = items.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text")).filter("id IS NOT NULL")
    own = store(own.withColumn("words", split("text")).filter(F.size("words") > 0), "items")
    count, mean = own.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    if not count:
        return []
    sized = own.withColumn("kind", F.greatest(F.ceil(F.log2(F.size("words"))), F.lit(5)))
    kinds = sized.groupBy("kind").agg(F.sum(F.size("words")).alias("n")).orderBy("kind").collect()
    indexes = []
    for kind in kinds:
        shards = -(-kind["n"] // INDEX_WORDS)
        for shard in range(shards):
            mine = sized.filter((F.col("kind") == kind["kind"]) & (F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard))
            terms = mine.select(F.explode(F.array_distinct("words")).alias("term")).distinct()
            every = own.select(F.explode(F.array_distinct("words")).alias("term"))
            frequency = {r["term"]: r["count"] for r in every.join(terms, "term", "left_semi").groupBy("term").count().collect()}
            rows = [(r["id"], r["text"]) for r in mine.select("id", "text").collect()]
            if rows:
                indexes.append(BenchmarkIndex(rows, frequency, count, mean))
    return indexes


def _together(indexes: list[BenchmarkIndex]) -> list[list[BenchmarkIndex]]:
    """Indexes that a text is held against in one pass: ``INDEX_WORDS`` words at most."""
    groups, size = [], INDEX_WORDS
    for index in indexes:
        if size + index.words > INDEX_WORDS or not groups:
            groups.append([])
            size = 0
        groups[-1].append(index)
        size += index.words
    return groups


def _finder(shared):
    """The column function of some indexes; texts are taken a bounded number of words at a time."""

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:

        def find_all(texts: list[list[str]]) -> list[list[dict]]:
            found = [(index, index.find(texts)) for index in shared.value]
            return [
                [_told(index.ids[i], *f) for index, x in found for i, f in sorted(x[n].items())] for n in range(len(texts))
            ]

        for texts in batches:
            out, waiting, size = [], [], 0
            for t in texts:
                words = words_of(t)
                waiting.append(words)
                size += len(words)
                if size >= BATCH_WORDS:
                    out += find_all(waiting)
                    waiting, size = [], 0
            out += find_all(waiting)
            yield pd.Series(out, dtype=object)

    return find


def _told(item: int, score: float, question: float, answer: float) -> dict:
    return {"item_id": item, "score": score, "question_overlap": question, "answer_overlap": answer}


def leaked_items(text: Column | str, indexes: list[BenchmarkIndex]) -> Column:
    """Items found in a text, with their best scores, by item id; an empty array
    where there are none. One row in, one row out; nothing is shuffled."""
    context = SparkSession.active().sparkContext
    columns = [_finder(context.broadcast(some))(text_of(text)) for some in _together(indexes)]
    if not columns:
        return F.array().cast(FOUND)
    return F.array_sort(F.concat(*columns))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: one row per
    document and item found in it.

    Null and empty texts hold nothing; repeated documents and items of equal text
    are each reported; without items there are no rows.
    """
    found = docs.select("doc_id", leaked_items("text", build_indexes(items)).alias("found"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
