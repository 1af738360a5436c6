import random
import time

import numpy as np
import pytest

from blockmill.llm import passages, queries
from tests.helpers import DATA


def slow_windows(values, low, high, length):
    if high - low + 1 < length:
        return []
    c = min(range(low, high + 1), key=lambda i: (values[i], i * passages._SCATTER % 2**20))
    return [(low, c, high), *slow_windows(values, low, c - 1, length), *slow_windows(values, c + 1, high, length)]


def test_windows_are_those_of_the_tree():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 40, 400).astype(np.uint64) << np.uint64(20)
    firsts, lasts = np.array([0, 150, 160]), np.array([149, 159, 399])
    got = sorted(zip(*(x.tolist() for x in passages.compact_windows(values, firsts, lasts, 7)[:3])))
    want = sorted(w for a, b in zip(firsts, lasts) for w in slow_windows(values.tolist(), a, b, 7))
    assert got == want


def test_runs_cover_every_beginning():
    rng = np.random.default_rng(2)
    shingles = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    firsts, lasts = np.array([0, 300, 346]), np.array([299, 345, 899])
    for band, (a, b, c, value) in enumerate(passages._runs(shingles, firsts, lasts)):
        covered = [i for x, y in zip(a, b) for i in range(x, y + 1)]
        assert covered == [i for f, l in zip(firsts, lasts) for i in range(f, l - passages._LENGTH + 2)]
        mixed = [passages._mixed(shingles, 1 + band * passages.FUNCTIONS + n) >> np.uint64(20) for n in range(passages.FUNCTIONS)]
        seen = {}
        for x, y, at, v in zip(a, b, c, value):
            for i in range(x, y + 1):
                least = tuple(int(m[i : i + passages._LENGTH].min()) for m in mixed)
                assert seen.setdefault(int(v), least) == least
                assert int(mixed[0][at]) == least[0] and i <= at < i + passages._LENGTH


def sets(text):
    words = passages.words_of(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return [set(grams[i : i + 46]) for i in range(len(grams) - 45)]


def make_docs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: rng.choices(words, k=n)
    line = text(12)  # common, but too short to be a passage
    shared = {n: text(n) for n in (50, 51, 60, 75, 120)}
    docs, holders = [], {}
    for n, passage in shared.items():
        for _ in range(6):
            docs.append([*text(rng.randint(0, 90)), *passage, *text(rng.randint(0, 90))])
            holders.setdefault(n, []).append(len(docs) - 1)
    for _ in range(40):
        docs.append([*text(80), *line, *text(80)])
    long = text(200)
    changed = long.copy()
    for i in range(40, 200, 80):
        changed[i] = "other"
    docs += [long, changed, long, text(49), []]
    return [(i, " ".join(d)) for i, d in enumerate(docs)], holders


def test_planted_passages(spark):
    docs, holders = make_docs()
    df = spark.createDataFrame([*docs, (900, None), (None, docs[0][1])], "doc_id long, text string")
    got = passages.repeated_passages(df.withColumn("low", df.doc_id)).collect()
    found = {(r.doc_id, r.partner_id) for r in got}
    for ids in holders.values():
        assert {(i, ids[0]) for i in ids[1:]} <= found
    n = len(docs)
    assert {(n - 4, n - 5), (n - 3, n - 5)} <= found
    texts = dict(docs)
    for r in got:
        assert r.partner_id < r.doc_id and r.last_word - r.first_word >= 49 and r.similarity >= 0.8
        a, b = sets(texts[r.doc_id]), sets(texts[r.partner_id])
        x, y = a[r.first_word], b[r.partner_first_word]
        assert len(x & y) / len(x | y) >= 0.8
    planted = {i for ids in holders.values() for i in ids} | {n - 5, n - 4, n - 3}
    assert {r.doc_id for r in got} | {r.partner_id for r in got} == planted


@pytest.mark.parametrize("size", [300, 1 << 19])
def test_long_texts_in_pieces(spark, size, monkeypatch):
    monkeypatch.setattr(passages, "BATCH_WORDS", size)
    rng = random.Random(4)
    text = " ".join(f"x{rng.randint(0, 500)}" for _ in range(1500))
    df = spark.createDataFrame([(1, text), (2, "And " + text), (2, "short")], "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    assert [(r.doc_id, r.partner_id, r.first_word, r.partner_first_word) for r in got] == [(2, 1, 1, 0)]
    assert 1450 < got[0].last_word <= 1500


def test_empty(spark):
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_finds_exact_repeats(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    holders = {}
    for r in docs:
        words = passages.words_of(r.text)
        for i in range(len(words) - 49):
            holders.setdefault(tuple(words[i : i + 50]), set()).add(r.doc_id)
    want = {(d, min(h)) for h in holders.values() if len(h) > 1 for d in h if d != min(h)}
    got = queries.op5_passages(spark, DATA).collect()
    assert want and {d for d, _ in want} | {d for _, d in want} <= {r.doc_id for r in got} | {r.partner_id for r in got}
    assert want <= {(r.doc_id, r.partner_id) for r in got}
    texts = {r.doc_id: sets(r.text) for r in docs}
    for r in got:
        x, y = texts[r.doc_id][r.first_word], texts[r.partner_id][r.partner_first_word]
        assert len(x & y) / len(x | y) >= 0.8


def like(text, *places):
    return [f"other{i}" if i in places else w for i, w in enumerate(text)]


@pytest.mark.parametrize("block", [2, 1024])
def test_links_that_are_not_transitive(spark, block, monkeypatch):
    """B is like A and C like B, but C is not like A; and D is like two that are not alike."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(8)
    docs, want = [], set()
    for _ in range(30):
        a = [f"v{rng.randint(0, 10**6)}" for _ in range(50)]
        n = len(docs)
        docs += [a, like(a, 12), like(a, 12, 37), like(a, 25), like(a, 12, 25)]
        want |= {(n + 1, n), (n + 2, n + 1), (n + 3, n), (n + 4, n + 1)}
    texts = [" ".join(d) for d in docs]
    got = {(r.doc_id, r.partner_id) for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for u, v in got:
        (x,), (y,) = sets(texts[u]), sets(texts[v])
        assert len(x & y) / len(x | y) >= 0.8
    assert len(want & got) >= 0.97 * len(want)


def test_every_match_of_a_meeting_is_linked():
    """All runs of a band value: whatever matches is linked, directly or through others."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 30, 46).astype(np.int32)
    rows = []
    for n in range(60):
        mine = base.copy()
        for at in rng.choice([0, 10, 20, 30, 40], rng.integers(0, 4), replace=False):
            mine[at + 1 : at + 6] = rng.integers(0, 1 << 30, 5) if at % 20 else np.arange(5) + at
        mine[0] = 7
        rows.append([n, 0, 0, mine, False, None])
    links = {(v, u) for v, u, *_ in passages._links_of(rows)}
    near = {
        (v, u) for v in range(60) for u in range(v)
        if len(set(rows[u][3]) & set(rows[v][3])) / len(set(rows[u][3]) | set(rows[v][3])) >= 0.8
    }
    assert links <= near and {(v, min(u for w, u in near if w == v)) for v in {v for v, _ in near}} <= links
    group = list(range(60))
    for v, u in links:
        group = [group[u] if g == group[v] else g for g in group]
    assert all(group[v] == group[u] for v, u in near) and len(set(group)) > 1


def test_chain_in_one_meeting():
    a = list(range(46))
    b, c = a.copy(), a.copy()
    b[30:35] = c[30:35] = range(100, 105)
    c[10:15] = range(200, 205)
    rows = [[n, 0, 0, np.array(x, dtype=np.int32), n == 1, None] for n, x in enumerate([c, b])]
    # b matches the first run of the value, c does not: still c and b are compared.
    assert [(v, u) for v, u, *_ in passages._links_of(rows)] == [(1, 0)]


def test_a_run_stands_for_equal_runs_only():
    rng = np.random.default_rng(10)
    one = rng.integers(0, 1 << 63, 80).astype(np.uint64)
    other = one.copy()
    other[60:] = rng.integers(0, 1 << 63, 20)
    rows = [next(passages._rows([(d, 0, s)])) for d, s in enumerate([one, other, one])]
    keys = [dict(zip(zip(r["band"], r["first"], r["last"]), r["content"])) for r in rows]
    assert keys[0] == keys[2]
    for (band, first, last), content in keys[0].items():
        same = keys[1].get((band, first, last))
        assert same is None or (same == content) == (last + passages._LENGTH <= 60)


@pytest.mark.parametrize("n_words", [50, 55, 60])
def test_recall_of_near_copies(spark, n_words):
    """Passages of one changed word against brute force over all their pairs."""
    rng = random.Random(n_words)
    docs = []
    for _ in range(200):
        text = [f"r{rng.randint(0, 10**6)}" for _ in range(n_words)]
        docs += [text, like(text, rng.randint(n_words // 2 - 2, n_words // 2 + 2))]
    texts = [" ".join(d) for d in docs]
    held = [sets(t) for t in texts]
    want = {(n + 1, n) for n in range(0, len(docs), 2) if any(len(x & y) / len(x | y) >= 0.8 for x in held[n] for y in held[n + 1])}
    got = {(r.doc_id, r.partner_id) for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(want) == 200 and got <= want
    assert len(got) >= 0.97 * len(want)


def test_stretches_reach_their_end(spark):
    rng = random.Random(11)
    text = lambda n: [f"u{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = {n: text(90 + n) for n in range(20)}
    docs = [(2 * n + k, " ".join([*text(60), *s, *text(60)])) for n, s in shared.items() for k in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    ends = {}
    for r in got:
        ends.setdefault(r.doc_id // 2, []).append((r.first_word, r.last_word))
    for n, s in shared.items():
        assert min(a for a, _ in ends[n]) <= 60 and max(b for _, b in ends[n]) >= 60 + len(s) - 1


@pytest.mark.parametrize("kinds", [40, 1 << 30])
def test_similarities_of_long_stretches(kinds):
    """With and without repeated shingles, against sets."""
    rng = np.random.default_rng(kinds)
    x = rng.integers(0, kinds, 300).astype(np.int32)
    y = x.copy()
    y[rng.choice(300, 20, replace=False)] = rng.integers(0, kinds, 20)
    y[100:103] = y[[102, 100, 101]]
    size = passages._LENGTH
    want = [(set(x[n : n + size]), set(y[n : n + size])) for n in range(300 - size + 1)]
    assert np.allclose(passages._alike(x, y), [len(a & b) / len(a | b) for a, b in want])


def test_all_matches_of_a_meeting_are_linked():
    """Also of runs that others link already."""
    a = list(range(46))
    rows = []
    for n, at in enumerate((5, 20, 40, 30)):
        mine = a.copy()
        mine[at] = 100 + n
        rows.append([n, 0, 0, np.array(mine, dtype=np.int32), False, None])
    assert {(v, u) for v, u, *_ in passages._links_of(rows)} == {(v, u) for v in range(4) for u in range(v)}


def classes_of(pairs, n):
    group = list(range(n))
    for v, u in pairs:
        low, high = sorted((group[v], group[u]))
        group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize("block", [2, 1024])
def test_classes_of_near_copies(spark, block, monkeypatch):
    """Many versions of one passage: those connected by matches are of one class."""
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(12)
    docs = []
    for _ in range(10):
        text = [f"n{rng.randint(0, 10**6)}" for _ in range(50)]
        docs += [like(text, at) for at in (0, 1, 2, 47, 48, 49)]
    texts = [" ".join(d) for d in docs]
    held = [sets(t)[0] for t in texts]
    near = {(v, u) for v in range(len(docs)) for u in range(v) if len(held[v] & held[u]) / len(held[v] | held[u]) >= 0.8}
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.partner_id) for r in rows} <= near
    want, got = classes_of(near, len(docs)), dict(enumerate(range(len(docs)))) | {r.doc_id: r.component_id for r in rows}
    assert [got[n] for n in range(len(docs))] == want and len(set(want)) < len(docs)


def test_links_grow_with_the_runs_not_with_their_pairs():
    """A meeting gives a spanning forest of all its links."""
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 30, 46).astype(np.int32)
    rows = []
    for n in range(400):
        mine = base.copy()
        at = rng.choice(np.arange(1, 46), rng.integers(2, 6), replace=False)
        mine[at] = rng.integers(0, 1 << 30, len(at))
        rows.append([n, 0, 0, mine, False, None])
    told = [np.array(x) for x in list(zip(*rows))[:3]]
    met = passages._Meetings(np.zeros(400, dtype=np.int64), *told, told[0] < 0, np.full(400, -1), [r[3] for r in rows])
    pairs = [(v, u) for found in met.forest() for v, u in zip(found[0].tolist(), found[1].tolist())]
    every = {(v, u) for v, u, *_ in passages._links_of(rows)}
    group = classes_of(every, 400)
    assert set(pairs) <= every and len(every) > 400
    assert classes_of(pairs, 400) == group and len(pairs) == 400 - len(set(group))


def test_many_runs_of_a_band_value_are_compared_together():
    """A quarter of a million pairs take well under the 20 s and more that one by one took."""
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 30, 91).astype(np.int32)
    rows = []
    for n in range(700):
        mine = base.copy()
        mine[rng.choice([*range(45), *range(46, 91)], 8, replace=False)] = rng.integers(0, 1 << 30, 8)
        rows.append([n, 0, 45, mine, False, None])
    start = time.process_time()
    links = passages._links_of(rows)
    assert time.process_time() - start < 10
    size = passages._LENGTH
    table = np.array([r[3] for r in rows])
    for v in (1, 350, 699):
        both = (table[v] == table[:v]).astype(int).cumsum(axis=1)
        both = np.pad(both, ((0, 0), (1, 0)))
        both = both[:, size:] - both[:, :-size]
        want = {(u, k) for u, k in np.argwhere(both / (2 * size - both) >= 0.8).tolist()}
        assert {(u, k) for w, u, _, low, high, _ in links if w == v for k in range(low, high + 1)} == want


@pytest.mark.parametrize("kinds", [12, 1 << 30])
def test_pairs_of_a_meeting_against_sets(kinds):
    """With words put in, left out and repeated; at the shared min-hash, or near it where
    a run holds it several times."""
    rng = np.random.default_rng(kinds)
    size, total = passages._LENGTH, 0
    for _ in range(60):
        base, rows = rng.integers(0, kinds, 130).tolist(), []
        for n in range(8):
            mine = base.copy()
            for at in rng.integers(0, 120, rng.integers(0, 4)).tolist():
                mine[at : at + int(rng.integers(0, 2))] = [int(x) for x in rng.integers(0, 1 << 30, rng.integers(0, 2))]
            first = int(rng.integers(15, 60))
            last = int(rng.integers(first, 61))
            mine = np.array(mine, dtype=np.int32)
            rows.append([n, first, 60, mine[first : last + size], bool((mine[first : last + size] == mine[60]).sum() > 1), None])
        got = {}
        for v, u, shift, low, high, sim in passages._links_of(rows):
            got.setdefault((v, u, shift), {}).update(dict.fromkeys(range(low, high + 1), sim))
        for (v, u, shift), found in got.items():
            for at, least in found.items():
                x, y = (set(r[3][p - r[1] : p - r[1] + size].tolist()) for r, p in ((rows[v], at), (rows[u], at + shift)))
                assert len(x & y) / len(x | y) >= max(0.8, least)
        total += len(got)
        for v in range(8):
            for u in range(v):
                (_, a, _, x, _, _), (_, b, _, y, _, _) = rows[v], rows[u]
                want = set()
                for at in range(max(a, b), min(a + len(x), b + len(y)) - size + 1):
                    one, other = set(x[at - a : at - a + size].tolist()), set(y[at - b : at - b + size].tolist())
                    if len(one & other) / len(one | other) >= 0.8:
                        want.add(at)
                assert want == set(got.get((v, u, 0), {})) or not want
    assert total > 100


def test_shingles_of_two_documents_travel_once(spark):
    """Not once for every run of every band: links and bytes of near copies."""
    rng = random.Random(15)
    docs = []
    for n in range(12):
        text = [f"t{rng.randint(0, 10**6)}" for _ in range(500)]
        if n % 3 == 0:
            text[200:240] = text[100:140]
        docs += [text, like(text, *rng.sample(range(500), 8))]
    own = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc long, text string")
    runs = passages._runs_of(own, passages._COLUMNS)
    rows = runs.toPandas().sort_values(["doc", "first"]).drop_duplicates(["band", "content"])
    stands = spark.createDataFrame(rows.astype(object).values.tolist(), runs.schema)
    met = passages._meetings(own, stands).collect()
    apart = rows.groupby("band").filter(lambda x: x["doc"].nunique() > 1)
    wide = (apart["last"] - apart["first"] + passages._LENGTH).sum()
    sent = sum(len(r.shingles) for r in met)
    assert len(apart) == sum(len(r.band) for r in met) and wide > 3 * sent > 0
    # The links are those of every band value compared by itself.
    hashes = [(passages.shingle_hashes(d) >> np.uint64(32)).astype(np.uint32).view(np.int32) for d in docs]
    want, got = {}, {}
    for _, x in apart.sort_values(["doc", "first"]).groupby("band"):
        told = [x[c].to_numpy() for c in ("doc", "first", "at", "again")]
        held = [hashes[d][a : b + passages._LENGTH] for d, a, b in zip(x["doc"], x["first"], x["last"])]
        alone = passages._Meetings(np.zeros(len(x), dtype=np.int64), *told, np.full(len(x), -1), held)
        for links in alone.forest():
            for v, u, shift, low, high, _ in zip(*(c.tolist() for c in links)):
                want.setdefault((v, u, shift), set()).update(range(low, high + 1))
    linked = passages._meetings(own, stands).repartition(3, "meeting").sortWithinPartitions("meeting").mapInArrow(passages._meet, passages._LINKED)
    for r in linked.collect():
        got.setdefault((r.doc, r.p_doc, r.shift), set()).update(range(r.low, r.high + 1))
    assert len(want) >= 12 and got == want


def test_windows_in_blocks_are_those_of_all_texts(monkeypatch):
    rng = np.random.default_rng(16)
    gathered = [(n, 0, rng.integers(0, 60, int(rng.integers(0, 400))).astype(np.uint64)) for n in range(30)]
    told = []
    for size in (1 << 17, 1000):
        monkeypatch.setattr(passages, "BLOCK_SHINGLES", size)
        found = list(passages._rows(gathered))
        told.append(sorted(tuple(x) for rows in found for x in rows.to_numpy().tolist()))
        assert (len(found) > 3) == (size == 1000)
    assert told[0] == told[1]
