import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from blockmill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def inverse(total, marked, drawn, uniform):
    """The least k whose distribution function exceeds ``uniform``."""
    reached = Fraction(0)
    for k in range(max(0, drawn - (total - marked)), min(drawn, marked) + 1):
        reached += Fraction(comb(marked, k) * comb(total - marked, drawn - k), comb(total, drawn))
        if reached > uniform:
            return k
    return min(drawn, marked)


def test_hypergeometric_inverts_the_distribution(spark):
    rng = random.Random(1)
    rows = [(0, 0, 0, 0.3), (5, 0, 3, 0.9), (5, 5, 3, 0.9), (5, 2, 5, 0.0), (5, 2, 0, 0.99), (1000, 500, 500, 0.999)]
    for _ in range(300):
        total = rng.choice([1, 2, 7, 40, 900])
        rows.append((total, rng.randint(0, total), rng.randint(0, total), rng.random()))
    df = spark.createDataFrame(rows, "n long, m long, d long, u double")
    got = df.select("*", mixing.hypergeometric(F.col("n"), F.col("m"), F.col("d"), F.col("u")).alias("k")).collect()
    assert [r.k for r in got] == [inverse(*r) for r in rows]


def test_permutations_hit_every_place(spark):
    for n in (1, 2, 3, 10, 1000):
        df = spark.range(n).select(*(mixing.permuted(F.col("id"), F.lit(n), 5, turn).alias(f"p{turn}") for turn in (0, 1)))
        rows = df.collect()
        assert sorted(r.p0 for r in rows) == sorted(r.p1 for r in rows) == list(range(n))
        assert n < 1000 or [r.p0 for r in rows] != [r.p1 for r in rows]


@pytest.mark.parametrize("shards", [1, 2, 7, 64, 100])
def test_tree_deals_all_blocks_in_equal_parts(spark, shards, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD_NODES", 4)
    quotas = [0, 3, 1000, 40, 7]
    plan = spark.range(1).select(F.array(*(F.lit(q).cast("long") for q in quotas)).alias("counts"))
    rows = sorted(mixing.deal(plan, shards).collect())
    assert [r.shard for r in rows] == list(range(shards))
    assert [sum(r.counts) for r in rows] == [1050 * (i + 1) // shards - 1050 * i // shards for i in range(shards)]
    for s, quota in enumerate(quotas):
        starts = [r.starts[s] for r in rows] + [quota]
        assert starts[0] == 0 and all(r.counts[s] == b - a for r, a, b in zip(rows, starts, starts[1:]))


def test_tree_follows_the_distribution(spark, monkeypatch):
    """The first of two shards of 5 blocks, over many trees that differ in their quotas' names only."""
    plan = spark.range(1).select(F.array(F.lit(4), F.lit(6)).cast("array<bigint>").alias("counts"))
    split = F.get(mixing._split(F.col("counts"), F.lit(5).cast("long"), "try", F.col("id")), F.lit(0))
    seen = Counter(r[0] for r in plan.crossJoin(spark.range(3000)).select(split).collect())
    for k in range(5):
        share = comb(4, k) * comb(6, 5 - k) / comb(10, 5)
        assert abs(seen[k] / 3000 - share) < 0.035


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > limit * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in names}
        fixed |= {s: limit * sizes[s] for s in over}


def made_up(rng, n=200):
    space = [" ", "\n", "\t ", "  "]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "Ä", "z", None]) if i > 3 else f"tiny{i}"
        words = [rng.choice(["a", "bc", "ö", "漢字", "x y"]) for _ in range(rng.choice([0, 1, 3, 20, 90]))]
        text = rng.choice(["", " "]) + "".join(w + rng.choice(space) for w in words)
        rows.append((rng.choice([i, i, i, None, 7]), source, rng.choice([text, text, text, text, None])))
    return rows + [(1, "hot", "same text twice")] * 3 + [(None, "void", ""), (None, "void", None)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK_WORDS": 8, "SOURCE_BLOCKS": 4, "SHARD_WORDS": 300, "STRIPE_ROWS": 20, "CHUNK": 5}.items():
        monkeypatch.setattr(mixing, name, value)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_of_small_blocks(spark, small, seed):
    rows = made_up(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns(
        {c: F.lit(9) for c in ("rank", "start", "place", "size", "key", "words")}
    )
    got = sorted(map(tuple, mixing.mix_digest(df).collect()), key=repr)
    assert got == sorted(map(tuple, mixing.mix_digest(df.repartition(3)).collect()), key=repr)
    count = lambda text: len(WORD.findall(text or ""))
    assert Counter((r[0], r[1]) for r in got) == Counter((d, count(t)) for d, _, t in rows)
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    targets = brute_targets(sizes)
    assert {(r[2], round(r[3], 6)) for r in got} == {(sizes[s], round(t, 6)) for s, t in targets.items()}
    assert all(r[4] <= 3 * r[1] for r in got)

    mix = mixing.Mix(df, keep_text=True)
    pieces = mix.texts().collect()
    assert mix.shards > 5
    taken = Counter()
    for r in pieces:
        taken[r.key] += r.words
        assert count(r.text) == r.words
    want = Counter()
    for r in got:
        want[r[0]] += r[4]
    assert taken == Counter({k: n for k, n in want.items() if n})
    # Every piece is a stretch of a text with its key, whole pieces make whole texts.
    of_key = {}
    for key, _, text in rows:
        of_key.setdefault(key, []).append(text or "")
    assert all(any(r.text in t for t in of_key[r.key]) for r in pieces)
    # Words taken come near the targets: half a block and the last, shorter block.
    source_of = {}
    for key, source, _ in rows:
        source_of.setdefault(key, set()).add(source)
    per_target = Counter()
    for r in got:
        per_target[r[2], round(r[3], 6)] += r[4]
    blocks = {s: min(8, max(1, sizes[s] // 4)) for s in sizes}
    for s, t in targets.items():
        same = [o for o in targets if (sizes[o], round(targets[o], 6)) == (sizes[s], round(t, 6))]
        assert abs(per_target[sizes[s], round(t, 6)] - t * len(same)) <= 1.5 * blocks[s] * len(same)
    # Places of a shard are 1..n, and all shards hold about as many blocks.
    for shard in {r.shard for r in pieces}:
        places = sorted(r.place for r in pieces if r.shard == shard)
        assert places == list(range(1, len(places) + 1))
    drawn = mix.draws().collect()
    per_shard = Counter(r.shard for r in drawn)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    assert max(Counter((r["rank"], r["number"]) for r in drawn).values()) <= 3


def test_whole_texts_come_back(spark, small):
    """With equal weights and one source every text is in the mix once, piece by piece."""
    rows = [(i, "s", f" text {i} of\tsome  words and a line\n of more {i}\n") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pieces = mixing.Mix(df, weights=[1], keep_text=True).texts().collect()
    for key, _, text in rows:
        mine = sorted((r.first, r.text) for r in pieces if r.key == key)
        assert "".join(t for _, t in mine) == text


def test_odd_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_digest(empty).count() == 0
    wordless = spark.createDataFrame([(1, "a", " "), (2, None, None), (2, None, None)], empty.schema)
    assert sorted(map(tuple, mixing.mix_digest(wordless).collect())) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)
    ]
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError, match="2 sources"):
        mixing.mix_digest(wordless)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string")
    plan = mixing.mix_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
