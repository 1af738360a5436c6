import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockmill import runtime
from blockmill.llm import decontamination as dec
from blockmill.llm import queries, toxicity
from tests.helpers import DATA


def share(wanted, words):
    size = len(next(iter(wanted)))
    return sum(any(tuple(words[i : i + size]) == w for i in range(len(words))) for w in wanted) / len(wanted)


def test_query_against_plain_search(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    want = {
        (d, i) for d, text in docs for i, item in items
        if all(share(dec.shingles(dec.words_of(p)), dec.words_of(text)) >= 0.8 for p in dec.split_item(item))
    }
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, DATA).collect()}
    whole = {(d, i) for d, text in docs for i, item in items if item in text}
    assert got == want and whole <= got and whole


def make_items(rng, words, n):
    return [(i, " ".join(rng.choices(words, k=rng.randint(2, 90))).capitalize() + ". The answer is " + rng.choice(words) + str(i) + ".") for i in range(n)]


@pytest.mark.parametrize("index_words", [5_000_000, 300])
def test_planted_and_changed_items(spark, index_words, monkeypatch):
    monkeypatch.setattr(dec, "INDEX_WORDS", index_words)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = make_items(rng, words, 40)
    filler = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, f"{filler(rng.randint(0, 300))} {t.upper()} {filler(rng.randint(0, 300))}") for i, t in items]
    docs += [(100 + i, filler(500)) for i in range(20)] + [(200, None), (201, ""), (202, "w1 " * 5000), (None, items[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    bench = spark.createDataFrame([*items, (50, None), (51, "..."), (None, "x"), (0, items[0][1])], "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in dec.find_leaks(df, bench).collect())
    assert got == sorted([(i, i) for i, _ in items] + [(0, 0), (-1, 0), (-1, 0)])
    assert dec.find_leaks(df, bench.limit(0)).count() == dec.find_leaks(df.limit(0), bench).count() == 0


def test_bound_never_loses_a_score():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = make_items(rng, words, 30)
    frequency = {}
    for _, t in items:
        for w in set(dec.words_of(t)):
            frequency[w] = frequency.get(w, 0) + 1
    index = dec.BenchmarkIndex(items, frequency, 30, 40.0)
    texts = [rng.choices(words, k=rng.randint(0, 400)) for _ in range(20)]
    for i, _ in enumerate(index.weights):
        index.parts[i] = (set(), set())  # every score counts
    step = index.longest
    for text, found in zip(texts, index.find(texts), strict=True):
        want = {}
        for low in range(0, max(len(text), 1), step):
            have = {index.terms.get(w) for w in text[low : low + 2 * step]}
            for i, w in enumerate(index.weights):
                score = sum(x for t, x in w.items() if t in have)
                if score >= dec.SCORE:
                    want[i] = max(want.get(i, 0), score)
        assert {i: s for i, (s, _, _) in found.items()} == pytest.approx(want)


@pytest.mark.parametrize("answer_words", [3, 4, 8, 20])
def test_one_word_changed_in_the_last_sentence(spark, answer_words):
    rng = random.Random(answer_words)
    text = lambda n: [f"q{rng.randint(0, 5000)}" for _ in range(n)]
    items, docs = [], []
    for i in range(20):
        question, answer = text(60 - answer_words), text(answer_words)
        items.append((i, " ".join(question).capitalize() + ". " + " ".join(answer).capitalize() + "."))
        changed = list(answer)
        changed[rng.randrange(answer_words)] = "changed"
        docs.append((i, " ".join([*text(40), *question, *changed, *text(40)])))
        # Half of an item is none.
        docs.append((100 + i, " ".join([*text(40), *question[: len(question) // 2], *answer, *text(40)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dec.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(20)]


def test_toxicity_on_held_out_rows(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, data).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    texts = duckdb.sql(f"SELECT doc_id FROM '{data}/documents.parquet'").fetchall()
    assert set(got) == {d for d, in texts}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def toy(spark):
    rng = random.Random(7)
    mild, rude = ["house", "river", "stone", "green", "walk"], ["grumpfish", "grumpfoot", "grumpnose"]
    docs = [(i, " ".join(rng.choices(mild, k=30) + ([rng.choice(rude)] * 2 if i % 3 == 0 else []))) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    return docs, labels


def test_rare_spellings_and_odd_rows(spark):
    docs, labels = toy(spark)
    docs += [(1000, "house river grumpfinger stone"), (1001, "house river stone green"), (1002, None), (1003, ""), (None, "walk"), (1001, "house river stone green")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (5, None), (7, 3), (None, 1), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, known).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(docs) and by_id[1000].predicted == 1 and by_id[1001].predicted == 0
    assert by_id[1002].score == by_id[1003].score and by_id[None].held_out is False
    assert toxicity.score_documents(df.limit(0), known).count() == 0
    none = toxicity.score_documents(df, known.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}


def test_shared_counts_make_unknown_spellings_neutral(spark):
    docs, labels = toy(spark)
    side = {i: t for i, t in labels}
    df = spark.createDataFrame([(t, side[i]) for i, t in docs] + [("zzyzx qwert", None)], "text string, side int")
    spelling = toxicity.fit_spelling(toxicity.word_counts(df))
    words = ["grumpfinger", "zzyzx", "house", "grumpfinger"]
    scores, hashes = spelling.score(words)
    assert scores[0] > 4 > 1 > abs(scores[1]) and scores[2] < 1
    assert scores[0] == scores[3] and hashes[0] == hashes[3] and len(set(hashes)) == 3
    assert scores.tolist() == [spelling.score([w])[0][0] for w in words]
    features = toxicity.features_of([["house"], [], ["grumpfinger", "house", "house"]], spelling)
    assert features[1].tolist() == [0] * 5 and features[2, 1] == scores[0]
    assert features[2, 0] == pytest.approx((scores[0] + scores[2]) / 2)


def test_words_are_counted_once_per_document(spark):
    df = spark.createDataFrame([("a b a", 1), ("a", 0), ("b c", None), (None, 1)], "text string, side int")
    got = {r.word: (r.n_toxic, r.n_plain, r.n_all) for r in toxicity.word_counts(df.withColumn("x", F.lit(1))).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 2), "c": (0, 0, 1)}


def kneser_ney(docs, order=toxicity.ORDER, discount=toxicity.DISCOUNT):
    """Difference of a word, from counts in dictionaries: [(text, side)] -> function"""
    own = {1: Counter(), 0: Counter()}
    every = set()
    for text, side in docs:
        for word in set(toxicity.words_of(text)):
            for gram in toxicity._grams(word):
                every.add(gram)
                if side is not None:
                    own[side][gram] += 1

    def shared(gram):
        p = 1 / 1000
        for m in range(1, len(gram) + 1):
            part = gram[-m:]
            longer = {g[-m - 1 :] for g in every if len(g) > m}
            after = Counter(g[1:] for g in longer if g[1:-1] == part[:-1])
            p = (max(after[part] - discount, 0) + discount * len(after) * p) / sum(after.values())
        return p

    def probability(gram, side, below):
        here = {g: n for g, n in own[side].items() if g[:-1] == gram[:-1]}
        if not here:
            return below
        return (max(here.get(gram, 0) - discount, 0) + discount * len(here) * below) / sum(here.values())

    def difference(word):
        out = 0.0
        for gram in toxicity._grams(word):
            below = shared(gram[1:]) if any(own[s][gram] for s in (0, 1)) else 1.0
            out += math.log(probability(gram, 1, below) / probability(gram, 0, below))
        return out

    return difference


def test_differences_equal_counts_in_dictionaries(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 7)))
    docs = [(" ".join(word() for _ in range(6)), rng.choice([0, 0, 1, None])) for _ in range(40)]
    spelling = toxicity.fit_spelling(toxicity.word_counts(spark.createDataFrame(docs, "text string, side int")))
    words = sorted({word() for _ in range(60)} | {"zzz", "a", "abz", "𝔸a"})
    plain = kneser_ney(docs)
    assert spelling.score(words)[0].tolist() == pytest.approx([plain(w) for w in words], abs=1e-4)


def test_sequences_beyond_the_bound_count_as_unseen(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SEQUENCES", 3)
    docs, labels = toy(spark)
    df = spark.createDataFrame([(t, labels[i][1]) for i, t in docs], "text string, side int")
    spelling = toxicity.fit_spelling(toxicity.word_counts(df))
    assert len(spelling.seen.keys) == len(spelling.unseen.keys) == 3
    assert toxicity.Known.of(pd.DataFrame({"key": [], "d": []})).find(np.zeros(2, dtype=np.uint64)).size == 2


def test_all_labels_and_sequences_count(spark, monkeypatch):
    """Beyond what is broadcast, scores come from joins and are the same; no label is left out."""
    docs, labels = toy(spark)
    docs += [(1000, "house river grumpfinger stone"), (1001, "Ünused 𝔸a 𝔸b zzyzx"), (1002, None), (1003, ""), (None, "walk"), (7, "walk walk")]
    docs += [docs[0], (2000, docs[0][1]), (1004, "grumpfoot")]
    # The only row of its class that has this word, so that leaving it out shows.
    docs += [(3000 + i, f"house rarest{'qvxj'[i]}word river") for i in range(4)]
    labels += [(3000 + i, 1) for i in range(4)]
    df = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, _note string")
    known = spark.createDataFrame([*labels, (5, None), (7, 3), (None, 1)], "doc_id long, toxic int")

    def scores():
        return sorted((r.doc_id or 0, r.text or "", r._note, r.held_out, r.predicted, round(r.score, 7)) for r in toxicity.score_documents(df, known).collect())

    want = scores()
    assert len(want) == len(docs)
    monkeypatch.setattr(toxicity, "LABELLED_ROWS", 40, raising=False)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(toxicity, "SEQUENCES", 30)
    assert scores() == want
