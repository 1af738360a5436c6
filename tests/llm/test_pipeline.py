import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from blockmill.llm import bpe, decontamination, queries, simhash, surrogates, toxicity
from tests.helpers import DATA
from tests.llm.test_bpe_urls_simhash import slow_components, slow_fingerprint


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    scores = rows(toxicity.score_documents(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    names, stages = zip(*pipeline.STAGES, strict=True)
    assert len(names) == 5

    out = stages[0](spark, docs, DATA)
    before, after = rows(docs), rows(out)
    assert out.columns == columns and set(after) == {d for d in before if scores[d].predicted == 0}
    docs, before = spark.createDataFrame(list(after.values()), out.schema), after

    out = stages[1](spark, docs, DATA)
    ids = sorted(before)
    classes = slow_components([slow_fingerprint(before[d].text) for d in ids])
    after = rows(out)
    assert out.columns == columns and set(after) == {ids[c] for c in set(classes)}
    docs, before = spark.createDataFrame(list(after.values()), out.schema), after

    out = stages[2](spark, docs, DATA)
    items = [t for t, in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]

    def holds(item, text):
        words = decontamination.words_of(text)
        return all(
            decontamination._share(decontamination.shingles(decontamination.words_of(p)), words) >= 0.8
            for p in decontamination.split_item(item)
        )

    after = rows(out)
    assert out.columns == columns
    assert set(after) == {d for d, r in before.items() if not any(holds(i, r.text) for i in items)}
    docs, before = spark.createDataFrame(list(after.values()), out.schema), after

    out = stages[3](spark, docs, DATA)
    after = rows(out)
    assert out.columns == columns and set(after) == set(before)
    assert all(r.n_chars == len(r.text) for r in after.values())
    marked = surrogates.mark_entities(docs).filter(F.size("_found") > 0)
    assert {d for d in before if before[d].text != after[d].text} == {r.doc_id for r in marked.collect()}
    docs, before = spark.createDataFrame(list(after.values()), out.schema), after

    out = stages[4](spark, docs, DATA)
    own = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.VOCABULARY), special_tokens={}
    )
    after = rows(out)
    assert set(after) == set(before) and all(r.round_trip for r in after.values())
    for d, r in after.items():
        ids = own.encode_ordinary(before[d].text)
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids and r.n_tokens == len(ids)

    assert {r.doc_id: bytes(r.ids) for r in pipeline.run(spark, DATA).collect()} == {d: bytes(r.ids) for d, r in after.items()}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    bench = duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    texts = [(1, None), (2, ""), (3, bench), (4, "mail a.b@c.de"), (4, "mail a.b@c.de"), (None, "no id " * 30), (None, "no id " * 30), (5, "x " * 50_000)]
    df = spark.createDataFrame(
        [(i, t, "en", "s", None, 7, 0.5) for i, t in texts],
        "doc_id long, text string, lang string, source string, n_chars long, score int, predicted double",
    )
    got = df
    for n, (_, stage) in enumerate(pipeline.STAGES):
        got = stage(spark, got, DATA)
        assert n == 4 or got.columns == df.columns
    kept = sorted((r.doc_id or 0, r.n_tokens > 0) for r in got.collect())
    assert kept == [(0, True), (1, False), (4, True), (5, True)]
    for _, stage in pipeline.STAGES:
        assert stage(spark, df.limit(0), DATA).count() == 0


def test_keep_one(spark):
    df = spark.createDataFrame([(2, "a b c"), (1, "A b c"), (1, "A b c"), (1, "other text"), (None, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(df).collect())
    assert got == [(0, "z"), (1, "A b c"), (1, "other text")]


def test_keep_one_sorts_no_texts(spark):
    """Texts go to the names that are kept and past; sorted with them they took an executor's memory."""
    rows = [(n // 2 if n % 7 else None, f"text {n // 3} of many words " * 5) for n in range(60)]
    df = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string")
    one = simhash.keep_one(df.distinct())
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join LeftSemi", 1)[0] and "strategy=shuffle_hash" in plan
    pairs = lambda got: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect())
    assert pairs(simhash.keep_one(df)) == pairs(one)
    classes = slow_components([slow_fingerprint(t) for t in sorted({t for _, t in rows})])
    assert one.count() == len(set(classes))
