"""The registered queries of the operators for training text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm import (
    bpe,
    decontamination,
    density,
    dialogues,
    infill,
    mixing,
    passages,
    pivots,
    simhash,
    surrogates,
    toxicity,
    urls,
    warc,
)
from blockmill.llm.tables import table
from workload.registry import query

#: The rules of the url query: (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query(
    "op3_url_trie",
    r"""
    WITH parts AS (
      SELECT page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages
    ), rules(rule_host, rule_path, verdict) AS (VALUES
      ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ), judged AS (
      SELECT p.*, (
        SELECT max_by({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path))
        FROM rules
        WHERE ends_with('.' || p.host, '.' || rule_host) AND starts_with(p.path, rule_path)
      ) AS found
      FROM parts p
    )
    SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, 'allow') AS verdict
    FROM judged
    """,
)
def op3_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).drop("url")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.token_digests(docs, VOCABULARY, public_tokenizers.PATTERN)


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query("op5_passages")
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op1_warc_derivatives")
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.derive(warc.responses_of_pages(pages)).select(
        "page_id", "warc_type", F.col("derived_id").alias("record_id"), "refers_to", "target_uri", "warc_date",
        "content_type", "payload_digest", "block_digest", "content_length", "header", "block",
    )


#: Key of the surrogates in the queries; a real run passes a secret of its own.
SURROGATE_KEY = "surrogate key of the queries"


@query("op8_surrogates")
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_private(docs, SURROGATE_KEY)


@query(
    "op2_pivot_search",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id
      WHERE q.vec_id % 100 = 0
    ), ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
      FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", pivots.quantised(F.col("embedding")).alias("vector")
    )
    return pivots.top_products(vectors, F.col("vec_id") % 100 == 0)


@query("op9_text_density")
def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", density.main_texts("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query(
    "op12_infill",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
    ), u AS (
      SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
        ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
        ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4
      FROM d
    ), c AS (
      SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
          THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM u
    ), p AS (
      SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix,
        array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
      FROM c
    )
    SELECT doc_id, n, form,
      CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM p
    """,
)
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.example_digests(table(spark, sf_dir, "documents"))


@query("op13_dialogues")
def op13_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.audit_damaged(table(spark, sf_dir, "conversations"))


@query(
    "op11_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS place
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
      FROM d GROUP BY source
    ), a AS (
      SELECT list({'w': (rank % 3 + 1)::DOUBLE, 'most': (3 * w)::DOUBLE}) AS l, sum(w)::DOUBLE AS total FROM s
    ), t AS (
      SELECT list_reduce(list_concat([0::DOUBLE], list_transform(range(0, len(l) + 1), lambda i: 0::DOUBLE)),
        lambda v, i: coalesce((total - coalesce(list_sum([s.most for s in l if s.w * v > s.most]), 0))
          / nullif(coalesce(list_sum([s.w for s in l if s.w * v <= s.most]), 0), 0), v)) AS level
      FROM a
    ), g AS (
      SELECT source, rank, w, least((3 * w)::DOUBLE, (rank % 3 + 1)::DOUBLE * level) AS target,
        least(1024, greatest(1, w // 256)) AS block
      FROM s, t
    ), q AS (
      SELECT *, ((w + block - 1) // block)::BIGINT AS blocks,
        CASE WHEN w > 0 THEN floor(target / w)::BIGINT ELSE 0 END AS passes FROM g
    ), r AS (
      SELECT *, least(blocks, floor((target - passes * w) / block + 0.5))::BIGINT AS extra FROM q
    ), e AS (
      SELECT rank, list_reduce(list_concat([k], range(0, 32)), lambda x, i: CASE
          WHEN md5('bit:' || rank || ':' || passes || ':' || i || ':' || greatest(x,
            (('0x' || md5('key:' || rank || ':' || passes || ':' || i)[1:12])::BIGINT % blocks - x + blocks) % blocks
          ))[1:1] < '8' THEN x
          ELSE (('0x' || md5('key:' || rank || ':' || passes || ':' || i)[1:12])::BIGINT % blocks - x + blocks) % blocks
        END) AS number
      FROM (SELECT *, unnest(range(0, extra)) AS k FROM r)
    ), p AS (
      SELECT d.doc_id, d.size, r.*,
        (sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start,
        row_number() OVER () AS row_id
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
    ), c AS (
      SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS number FROM p WHERE size > 0
    ), x AS (
      SELECT c.row_id, sum((least(start + size, (c.number + 1) * block) - greatest(start, c.number * block))
        * (passes + (e.rank IS NOT NULL)::INT))::BIGINT AS taken
      FROM c LEFT JOIN e ON c.rank = e.rank AND c.number = e.number GROUP BY c.row_id
    )
    SELECT doc_id, size, w AS source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN x USING (row_id)
    """,
)
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))
