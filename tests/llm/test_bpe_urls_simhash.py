import hashlib
import random
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from blockmill.llm import bpe, queries, simhash, tables, urls
from tests.helpers import DATA


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(queries.VOCABULARY)


def test_bpe_matches_tiktoken(ranks):
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    rng = random.Random(1)
    alphabet = "aab eéñ漢字🙂\x1c\x85\u200b\n\t '’sS1२$_" + "".join(map(chr, range(0x250, 0x280)))
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 5000, "ab" * 4000, "e\u0301" * 1000, " " * 3000, "thththththth" * 300]
    texts += ["".join(rng.choices("etaoinhrsd", k=400)) for _ in range(200)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
        assert ids == theirs.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_bpe_query_handles_nulls_and_other_columns(spark, ranks):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "Hi there", 7), (None, "x", 8)], "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.token_digests(df, queries.VOCABULARY, public_tokenizers.PATTERN).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1, 0].ids_sha256 == got[2, 0].decoded_sha256 == empty
    assert got[2, 2].decoded_sha256 == hashlib.sha256(b"Hi there").hexdigest()
    assert (None, 1) in got
    assert bpe.token_digests(df.limit(0), queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_url_trie(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?y"), (2, "https://example.org/en/123#t"), (3, "http://example.org/en/2"),
        (4, "http://x.com/fr/"), (5, "http://x.com/de/1"), (6, "http://x.com/es/"), (7, None), (8, "nothing"),
        (9, "http://org"), (10, "http://notexample.org/es/"), (11, "a://b://c.org/d"), (12, "http:///x"), (12, "http:///x"),
    ]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, rule string")
    got = urls.judge_urls(df, queries.URL_RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"),
        ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert (got[0].host, got[0].path, got[6].host, got[10].host) == ("a.example.org", "/es/x", "", "b:")
    assert urls.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_url_trie_longest_wins():
    trie = urls.UrlTrie([("a.b", "/x", "allow"), ("a.b", "/x/y/", "block"), ("b", "/x/y/z", "allow"), ("c", "", "block")])
    assert trie.find("q.a.b", "/x/y/z") == ("a.b/x/y/", "block")
    assert trie.find("a.b", "/xy") == ("a.b/x", "allow")
    assert trie.find("b", "/x/y/zz") == ("b/x/y/z", "allow")
    assert trie.find("k.c", "") == ("c", "block")


def test_url_trie_equals_all_rules_tried_in_turn():
    rng = random.Random(3)
    part = lambda: "".join(rng.choices("ab", k=rng.randint(0, 3)))
    host = lambda: ".".join(part() or "c" for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + part() for _ in range(rng.randint(0, 3)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)]
    trie, hits = urls.UrlTrie(rules), 0
    for _ in range(3000):
        h, p = host(), path()
        fits = [r for r in rules if ("." + h).endswith("." + r[0]) and p.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
        assert trie.find(h, p) == (best and (best[0] + best[1], best[2]))
        hits += best is not None
    assert hits > 1000


def test_url_trie_longer_path_before_deeper_host():
    trie = urls.UrlTrie([("org", "/es/long/path", "allow"), ("example.org", "/es/", "block")])
    assert trie.find("example.org", "/es/long/path/x") == ("org/es/long/path", "allow")
    assert trie.find("example.org", "/es/other") == ("example.org/es/", "block")


def test_many_rules_of_one_segment():
    trie = urls.UrlTrie([("a.b", f"/p{i}", "block") for i in range(100_000)])
    started = time.perf_counter()
    assert all(trie.find("a.b", f"/p{i}x") == (f"a.b/p{i}", "block") for i in range(20_000))
    assert time.perf_counter() - started < 5


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["Aa", "bé", "c\u00a0d", "E\tf"], k=n)) for n in range(60)] + [None, " \x0b "]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("añb c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("añb c", seed=42)


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_as_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 6)
    rng = random.Random(3)
    fps = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 25])):
            fps.append(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), block=block)
    roots = {r.node % 2**64: r.root for r in tables.connected(links).collect()}
    want = slow_components(fps)
    classes = {}
    for f, c in zip(fps, want, strict=True):
        classes.setdefault(c, set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, got.values()))


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d e"), (3, "A b c d e"), (None, "a b c d e"), (9, None), (8, ""), (7, "other words in here now"), (7, "other words in here now")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    fps = [slow_fingerprint(t) for _, t in docs]
    want = {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, slow_components(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, DATA).collect()}
    assert got == want
