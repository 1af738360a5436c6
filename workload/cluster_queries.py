"""Block models, clusterings and their agreement over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.hashing import bucket_hash
from blockmill.functions.vectors import array_to_vector, euclidean_distance, vector_to_array
from blockmill.operators import ensemble, learn, lloyd, neighbours, propagation, quality, spectral, trees
from blockmill.operators.blocks import assign_blocks, blocks_at
from blockmill.runtime import store
from workload.fixtures import SEED, baskets, sql_hash, sql_pairs, table
from workload.registry import query

#: Blocks the embeddings are cut into, how many train and which ones test.
VEC_BLOCKS = 4
TRAIN, TEST = [0, 1, 2], [3]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label, features, block_id)"""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )
    return assign_blocks(rows, VEC_BLOCKS, "id", SEED).withColumn("features", array_to_vector("vec"))


_VEC = (
    f"e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label, "
    f"{sql_hash(SEED, 'vec_id')} % {VEC_BLOCKS} AS block_id FROM embeddings)"
)
_MEANS = (
    "c AS (SELECT label, list(m ORDER BY p) AS mean FROM (SELECT label, p, avg(vec[p]) AS m "
    "FROM e, range(1, 65) t(p) GROUP BY 1, 2) GROUP BY label)"
)

# --- block models ----------------------------------------------------------


def _sql_rows(where: str = "TRUE") -> str:
    return f"rows AS (SELECT block_id AS g, id, vec, label FROM e WHERE {where})"


def _sql_trees(max_depth: int, node_size: int) -> str:
    """Ranges, then per level the counts, the splits of least impurity, and where rows go."""
    ctes = [
        _sql_rows(),
        "x AS (SELECT g, id, label, p - 1 AS f, vec[p] AS v FROM rows, range(1, len(vec) + 1) t(p))",
        "z AS (SELECT g, f, min(v) AS low, max(v) - min(v) AS width FROM x GROUP BY 1, 2)",
        "b AS (SELECT g, id, label, f, least(31, greatest(0, floor(coalesce((v - low) / nullif(width, 0), 0) * 32)))"
        "::INTEGER AS bin FROM x JOIN z USING (g, f))",
        "s0 AS (SELECT g, id, label, 1 AS node FROM rows)",
    ]
    for d in range(max_depth):
        ctes += [
            f"n{d} AS (SELECT g, node, label, count(*) AS c FROM s{d} GROUP BY 1, 2, 3)",
            f"t{d} AS (SELECT g, node, sum(c)::BIGINT AS n, sum(c * c)::BIGINT AS sq, "
            f"arg_min(label, {{'c': -c, 'l': label}}) AS label FROM n{d} GROUP BY 1, 2)",
            f"u{d} AS (SELECT DISTINCT g, node, f, bin FROM s{d} JOIN b USING (g, id))",
            f"l{d} AS (SELECT u.g, u.node, u.f, u.bin, b.label, count(*) AS c FROM u{d} u JOIN s{d} s ON "
            "s.g = u.g AND s.node = u.node JOIN b ON b.g = s.g AND b.id = s.id AND b.f = u.f AND b.bin <= u.bin "
            "GROUP BY 1, 2, 3, 4, 5)",
            f"p{d} AS (SELECT l.g, l.node, l.f, l.bin, sum(l.c)::BIGINT AS nl, sum(l.c * l.c)::BIGINT AS sl, "
            f"(any_value(t.sq) + sum(l.c * l.c - 2 * l.c * n.c))::BIGINT AS sr FROM l{d} l "
            f"JOIN n{d} n ON n.g = l.g AND n.node = l.node AND n.label = l.label "
            f"JOIN t{d} t ON t.g = l.g AND t.node = l.node GROUP BY 1, 2, 3, 4)",
            f"c{d} AS (SELECT p.*, sl / nl + sr / (n - nl) AS score FROM p{d} p JOIN t{d} USING (g, node) "
            f"WHERE nl >= {node_size} AND n - nl >= {node_size} AND sl / nl + sr / (n - nl) - sq / n > 1e-9 * n)",
            f"w{d} AS (SELECT g, node, arg_min({{'f': f, 'bin': bin}}, {{'s': -score, 'f': f, 'bin': bin}}) AS best "
            f"FROM c{d} GROUP BY 1, 2)",
            f"m{d} AS (SELECT t.g, t.node, best.f AS feature, best.bin AS bin, label, n FROM t{d} t "
            f"LEFT JOIN w{d} USING (g, node))",
            f"s{d + 1} AS (SELECT s.g, s.id, s.label, 2 * s.node + (b.bin > m.bin)::INT AS node FROM s{d} s "
            f"JOIN m{d} m USING (g, node) JOIN b ON b.g = s.g AND b.id = s.id AND b.f = m.feature)",
        ]
    d = max_depth
    ctes.append(
        f"m{d} AS (SELECT g, node, NULL AS feature, NULL AS bin, arg_min(label, {{'c': -c, 'l': label}}) AS label, "
        f"sum(c)::BIGINT AS n FROM (SELECT g, node, label, count(*) AS c FROM s{d} GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    )
    every = " UNION ALL ".join(f"SELECT * FROM m{d}" for d in range(max_depth + 1))
    return f"{_VEC}, {', '.join(ctes)}, trees AS ({every})"


@query(
    "block_trees",
    f"""WITH {_sql_trees(3, 10)} SELECT g AS block_id, t.node::BIGINT AS node, t.feature::INTEGER AS feature,
      round(low + (bin + 1) * width / 32, 6) AS threshold, label::BIGINT AS label, n
    FROM trees t LEFT JOIN z ON z.g = t.g AND z.f = t.feature""".replace("SELECT g AS", "SELECT t.g AS"),
)
def block_trees(spark, sf_dir):
    """The models themselves: one row per node of the tree of every block."""
    grown = trees.grow(vectors(spark, sf_dir), max_depth=3, node_size=10)
    return grown.select("block_id", "node", "feature", F.round("threshold", 6).alias("threshold"), "label", "n")


@query("block_forests")
def block_forests(spark, sf_dir):
    """Nodes of the trees of every block; trees are grown on hashed samples."""
    grown = trees.grow(
        vectors(spark, sf_dir), trees=10, max_depth=4, node_size=2, features=8, bootstrap=True
    )
    return grown.select("block_id", "tree", "node", "feature", F.round("threshold", 6).alias("threshold"), "label", "n")


@query(
    "block_model_accuracy",
    f"""WITH {_sql_trees(3, 10)},
    q AS (SELECT m.g AS model, r.g AS block_id, r.id, r.label, 1 AS node FROM rows r, (SELECT DISTINCT g FROM trees) m),
    {", ".join(
        f"q{d} AS (SELECT q.model, q.block_id, q.id, q.label, CASE WHEN t.feature IS NULL THEN q.node ELSE 2 * q.node + "
        "(least(31, greatest(0, floor(coalesce((v.v - z.low) / nullif(z.width, 0), 0) * 32))) > t.bin)::INT END AS node "
        f"FROM {'q' if d == 0 else f'q{d - 1}'} q JOIN trees t ON t.g = q.model AND t.node = q.node "
        "LEFT JOIN z ON z.g = t.g AND z.f = t.feature LEFT JOIN x v ON v.g = q.block_id AND v.id = q.id AND v.f = t.feature)"
        for d in range(3)
    )}
    SELECT q2.model, q2.block_id, round(avg((q2.label = t.label)::INT), 6) AS accuracy
    FROM q2 JOIN trees t ON t.g = q2.model AND t.node = q2.node GROUP BY 1, 2""",
)
def block_model_accuracy(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    grown = trees.grow(rows, max_depth=3, node_size=10)
    judged = trees.predictions(rows.select("block_id", "id", "vec", "label"), grown)
    return trees.accuracy(judged).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "trim_models",
    """WITH s AS (SELECT l_suppkey AS model, avg((l_returnflag = 'R')::INT) AS accuracy
      FROM lineitem GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY accuracy, model) - 1 AS i, count(*) OVER () AS n FROM s)
    SELECT model, round(accuracy, 6) AS accuracy FROM r
    WHERE i >= 0.1::DOUBLE * n AND i <= (1 - 0.1)::DOUBLE * n - 1""",
)
def trim_models(spark, sf_dir):
    hit = (F.col("l_returnflag") == "R").cast("int")
    scores = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("model"))
        .agg(F.avg(hit).alias("accuracy"))
    )
    return learn.trim_models(scores, "model").select("model", F.round("accuracy", 6).alias("accuracy"))


def _sql_kmeans(k: int, steps: int) -> str:
    """Centres from the first rows by hash, then assignments and means in turns."""
    ctes = [
        f"c0 AS (SELECT g, (n - 1)::INTEGER AS cluster, vec AS centre FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY g ORDER BY {sql_hash(SEED, 'id')}, id) AS n FROM rows) WHERE n <= {k})"
    ]
    for t in range(steps):
        ctes += [
            f"a{t} AS (SELECT r.g, r.id, any_value(r.vec) AS vec, arg_min(c.cluster, "
            f"{{'d': list_distance(r.vec, c.centre), 'c': c.cluster}}) AS cluster "
            f"FROM rows r JOIN c{t} c USING (g) GROUP BY 1, 2)",
            f"v{t} AS (SELECT g, cluster, list(m ORDER BY p) AS centre FROM (SELECT g, cluster, p, avg(vec[p]) AS m "
            f"FROM a{t}, range(1, 65) s(p) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"c{t + 1} AS (SELECT g, cluster, coalesce(v.centre, c.centre) AS centre FROM c{t} c "
            f"LEFT JOIN v{t} v USING (g, cluster))",
        ]
    return ", ".join(ctes)


#: Steps of k-means in the queries, few as SQL takes them one by one.
_STEPS = 3


@query(
    "block_kmeans",
    f"""WITH {_VEC}, {_sql_rows()}, {_sql_kmeans(10, _STEPS)},
    s AS (SELECT g, cluster, count(*) AS n FROM a{_STEPS - 1} GROUP BY 1, 2)
    SELECT g AS block_id, cluster, coalesce(n, 0) AS n, p AS pos, round(centre[p], 6) AS value
    FROM c{_STEPS} LEFT JOIN s USING (g, cluster), range(1, 65) t(p)""",
)
def block_kmeans(spark, sf_dir):
    """The centres of every block's model, component by component."""
    centres = lloyd.kmeans(vectors(spark, sf_dir), 10, steps=_STEPS, tol=0.0, seed=SEED)
    return centres.select("block_id", "cluster", "n", F.posexplode("centre").alias("p", "value")).select(
        "block_id", "cluster", "n", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query("cluster_global")
def cluster_global(spark, sf_dir):
    return learn.cluster_global(vectors(spark, sf_dir), k=10)


@query(
    "cluster_global_kmeans",
    f"""WITH {_VEC}, rows AS (SELECT 0 AS g, id, vec, label FROM e), {_sql_kmeans(10, _STEPS)}
    SELECT r.id, arg_min(c.cluster, {{'d': list_distance(r.vec, c.centre), 'c': c.cluster}}) AS prediction
    FROM rows r JOIN c{_STEPS} c USING (g) GROUP BY 1""",
)
def cluster_global_kmeans(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("g", F.lit(0))
    centres = lloyd.kmeans(rows, 10, steps=_STEPS, tol=0.0, group="g", seed=SEED)
    return lloyd.with_own_label(rows, centres, "g").select("id", "prediction")


# --- vectors ---------------------------------------------------------------


@query(
    "vec_convert",
    "SELECT vec_id, p AS pos, round(embedding[p]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) t(p)",
)
def vec_convert(spark, sf_dir):
    there = array_to_vector(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", there.alias("features"))
    back = rows.select("vec_id", F.posexplode(vector_to_array("features")).alias("p", "value"))
    return back.select(
        "vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query(
    "euclidean_distance",
    f"WITH {_VEC}, {_MEANS} SELECT id, round(list_distance(vec, mean), 6) AS distance "
    "FROM e JOIN c USING (label)",
)
def distance_to_mean(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    joined = rows.join(learn.group_mean_vector(rows), "label")
    distance = euclidean_distance(F.col("vec"), F.col("mean"))
    return joined.select("id", F.round(distance, 6).alias("distance"))


@query(
    "group_mean_vector",
    f"WITH {_VEC} SELECT label, p AS pos, round(avg(vec[p]), 6) AS value "
    "FROM e, range(1, 65) t(p) GROUP BY 1, 2",
)
def group_mean_vector(spark, sf_dir):
    means = learn.group_mean_vector(vectors(spark, sf_dir))
    return means.select("label", F.posexplode("mean").alias("p", "value")).select(
        "label", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


def _sql_knn(k: int) -> str:
    return f"""WITH {_VEC}, {_MEANS},
    d AS (SELECT id, c.label, row_number() OVER (PARTITION BY id
      ORDER BY list_distance(vec, mean), c.label) AS rn FROM e, c),
    v AS (SELECT id, label, count(*) AS n FROM d WHERE rn <= {k} GROUP BY 1, 2)
    SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id
      ORDER BY n DESC, label) AS rn FROM v) WHERE rn = 1"""


def _means_as_points(rows: DataFrame) -> DataFrame:
    return learn.group_mean_vector(rows).select(
        F.col("label").cast("bigint").alias("id"), F.col("mean").alias("vec"), "label"
    )


@query("knn_label", _sql_knn(1))
def knn_label(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return neighbours.knn_label(rows, _means_as_points(rows))


@query("knn_label_3", _sql_knn(3))
def knn_label_3(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return neighbours.knn_label(rows, _means_as_points(rows), k=3)


# --- agreement with labels -------------------------------------------------


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("label"), F.col("source").alias("prediction")
    )


@query(
    "purity",
    "SELECT round(sum(top) / sum(n), 6) AS purity FROM (SELECT source, max(n) AS top, sum(n) AS n "
    "FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source)",
)
def purity(spark, sf_dir):
    return quality.purity(labelled_documents(spark, sf_dir)).select(F.round("purity", 6).alias("purity"))


@query(
    "nmi",
    """WITH j AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2),
    a AS (SELECT lang, sum(n) AS n FROM j GROUP BY 1), b AS (SELECT source, sum(n) AS n FROM j GROUP BY 1),
    t AS (SELECT sum(n) AS n FROM j),
    mi AS (SELECT sum(j.n / t.n * ln(j.n / t.n / (a.n / t.n * b.n / t.n))) AS v
      FROM j JOIN a USING (lang) JOIN b USING (source), t),
    ha AS (SELECT -sum(a.n / t.n * ln(a.n / t.n)) AS v FROM a, t),
    hb AS (SELECT -sum(b.n / t.n * ln(b.n / t.n)) AS v FROM b, t)
    SELECT round(mi.v / sqrt(ha.v * hb.v), 6) AS nmi FROM mi, ha, hb""",
)
def nmi(spark, sf_dir):
    return quality.nmi(labelled_documents(spark, sf_dir)).select(F.round("nmi", 6).alias("nmi"))


# --- several clusterings ---------------------------------------------------

_H, _K = 3, 4


def clusterings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, labels): three groupings of the customers, at most four groups each"""
    third = bucket_hash(SEED, F.col("c_custkey")) % 3
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array(
            (F.col("c_custkey") % 3).cast("int"), F.col("c_nationkey") % 4, third.cast("int")
        ).alias("labels"),
    )


_CLUSTERINGS = (
    f"k AS (SELECT c_custkey AS id, [c_custkey % 3, c_nationkey % 4, {sql_hash(SEED, 'c_custkey')} % 3]"
    "::INTEGER[] AS labels FROM customer)"
)
_COLS = f"o AS (SELECT id, h, h * {_K} + labels[h + 1] AS col FROM k, range(0, {_H}) t(h))"


@query("one_hot_clusters", f"WITH {_CLUSTERINGS}, {_COLS} SELECT id, col FROM o")
def one_hot_clusters(spark, sf_dir):
    return ensemble.one_hot_clusters(clusterings(spark, sf_dir), _K)


@query(
    "label_majority",
    f"""WITH {_CLUSTERINGS}, v AS (SELECT id, labels[h] AS label, count(*) AS n
      FROM k, range(1, {_H + 1}) t(h) GROUP BY 1, 2)
    SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id
      ORDER BY n DESC, label) AS rn FROM v) WHERE rn = 1""",
)
def label_majority(spark, sf_dir):
    rows = clusterings(spark, sf_dir)
    wide = rows.select("id", *(F.col("labels")[h].alias(f"label{h}") for h in range(_H)))
    return neighbours.vote_columns(wide, [f"label{h}" for h in range(_H)]).select("id", "label")


@query(
    "coassociation",
    f"""WITH {_CLUSTERINGS}, s AS (SELECT labels, count(*) AS n FROM k GROUP BY 1),
    p AS (SELECT array_to_string(a.labels, ',') AS labels_i, array_to_string(b.labels, ',') AS labels_j,
      a.n AS n_i, b.n AS n_j, ((a.labels[1] = b.labels[1])::INT + (a.labels[2] = b.labels[2])::INT
      + (a.labels[3] = b.labels[3])::INT) / {_H} AS share FROM s a, s b)
    SELECT labels_i, labels_j, n_i, n_j, round(share, 6) AS share FROM p WHERE share > 0""",
)
def coassociation(spark, sf_dir):
    text = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return ensemble.coassociation(clusterings(spark, sf_dir)).select(
        text("labels_i"), text("labels_j"), "n_i", "n_j", F.round("share", 6).alias("share")
    )


_PAIRS = (
    "q AS (SELECT DISTINCT o_custkey AS i, lead(o_custkey) OVER (PARTITION BY o_orderdate::DATE "
    "ORDER BY o_orderkey) AS j FROM orders)"
)


@query(
    "coassociation_pairs",
    f"""WITH {_CLUSTERINGS}, {_PAIRS} SELECT i, j, round(((a.labels[1] = b.labels[1])::INT
      + (a.labels[2] = b.labels[2])::INT + (a.labels[3] = b.labels[3])::INT) / {_H}, 6) AS share
    FROM q JOIN k a ON a.id = i JOIN k b ON b.id = j""",
)
def coassociation_pairs(spark, sf_dir):
    """Customers of consecutive orders of a day."""
    from pyspark.sql import Window

    day = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    pairs = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_custkey").alias("i"), F.lead("o_custkey").over(day).alias("j"))
        .distinct()
    )
    return ensemble.coassociation_of(pairs, clusterings(spark, sf_dir)).select(
        "i", "j", F.round("share", 6).alias("share")
    )


@query(
    "ensemble_pick",
    f"""WITH {_CLUSTERINGS}, {_COLS},
    b AS (SELECT x.id AS i, y.id AS j, count(*) / {_H} AS share FROM o x JOIN o y USING (col) GROUP BY 1, 2),
    m AS (SELECT x.h, x.id AS i, y.id AS j FROM o x JOIN o y USING (col)),
    g AS (SELECT h, b.i, b.j, share FROM b, range(0, {_H}) t(h)),
    d AS (SELECT g.h, sum(abs((m.i IS NOT NULL)::INT - share)) AS distance
      FROM g LEFT JOIN m ON g.h = m.h AND g.i = m.i AND g.j = m.j GROUP BY g.h)
    SELECT h, round(distance, 4) AS distance FROM d ORDER BY distance, h LIMIT 1""",
)
def ensemble_pick(spark, sf_dir):
    return ensemble.ensemble_pick(clusterings(spark, sf_dir)).select(
        F.col("h").cast("bigint").alias("h"), F.round("distance", 4).alias("distance")
    )


@query(
    "ncut_matrix",
    f"""WITH {_CLUSTERINGS}, {_COLS}, s AS (SELECT col, count(*) AS s FROM o GROUP BY 1),
    c AS (SELECT x.col AS col_i, y.col AS col_j, count(*) AS n FROM o x JOIN o y USING (id) GROUP BY 1, 2)
    SELECT col_i, col_j, round(n / ({_H} * sqrt((a.s + 1e-6) * (b.s + 1e-6))), 6) AS value
    FROM c JOIN s a ON a.col = col_i JOIN s b ON b.col = col_j""",
)
def ncut_matrix(spark, sf_dir):
    return ensemble.ncut_matrix(clusterings(spark, sf_dir), _H, _K).withColumn(
        "value", F.round("value", 6)
    )


@query("ensemble_ncut")
def ensemble_ncut(spark, sf_dir):
    return ensemble.ensemble_ncut(vectors(spark, sf_dir), TRAIN, TEST, k=10, k_final=5)


@query(
    "anchor_labels",
    f"""WITH {_VEC}, rows AS (SELECT 0 AS g, id, vec, label FROM e WHERE block_id = {TEST[0]}), {_sql_kmeans(20, _STEPS)},
    n AS (SELECT c.cluster, any_value(c.centre) AS centre, arg_min(r.label, {{'d': list_distance(r.vec, c.centre), 'i': r.id}}) AS label
      FROM c{_STEPS} c, rows r GROUP BY 1)
    SELECT e.id, arg_min(n.label, {{'d': list_distance(e.vec, n.centre), 'c': n.cluster}}) AS label FROM e, n GROUP BY 1""",
)
def anchor_labels(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return spectral.anchor_labels(rows, blocks_at(rows, TEST), k=5, per_cluster=4, steps=_STEPS)


# --- spectral --------------------------------------------------------------


@query("spectral_gaussian")
def spectral_gaussian(spark, sf_dir):
    """The centres of all blocks' models, clustered."""
    centres = lloyd.kmeans(vectors(spark, sf_dir), 10, seed=SEED)
    rows = centres.select((F.col("block_id") * 10 + F.col("cluster")).alias("id"), F.col("centre").alias("vec"))
    return spectral.spectral_gaussian(rows, k=3)


@query(
    "spectral_similarity",
    f"""WITH {_VEC}, d AS (SELECT x.block_id AS g, x.id AS i, y.id AS j,
      list_distance(x.vec, y.vec) ** 2 AS d FROM e x JOIN e y ON x.block_id = y.block_id AND x.id <> y.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS rn FROM d),
    n AS (SELECT *, sum(d) OVER (PARTITION BY g, i) AS s FROM r WHERE rn <= 30)
    SELECT g, i, j, round(greatest((s - 29 * d) / s, 0), 6) AS w FROM n""",
)
def spectral_similarity(spark, sf_dir):
    return spectral.adaptive_similarity(vectors(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query("spectral_adaptive")
def spectral_adaptive(spark, sf_dir):
    return spectral.spectral_adaptive(vectors(spark, sf_dir), k=5)


# --- message passing -------------------------------------------------------


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, k, s): share of the orders that hold both brands, both ways round."""
    orders = store(baskets(spark, sf_dir), "baskets")
    number = lambda name: F.regexp_extract(name, "[0-9]+", 0).cast("int")
    first = orders.select("items", F.explode("items").alias("x"))
    both = first.select("x", F.explode("items").alias("y")).where("x <> y")
    counts = both.groupBy(number("x").alias("i"), number("y").alias("k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select("i", "k", (F.col("n") / F.lit(orders.count())).alias("s"))


def _sql_rounds(rounds: int) -> str:
    ctes = [
        sql_pairs(),
        "m0 AS (SELECT replace(x.item, 'Brand#', '')::INTEGER AS i, replace(y.item, 'Brand#', '')::INTEGER AS k, "
        "0::DOUBLE AS r, count(*) / (SELECT count(DISTINCT txn_id) FROM base) AS a "
        "FROM base x JOIN base y ON x.txn_id = y.txn_id AND x.item <> y.item GROUP BY 1, 2)",
    ]
    for t in range(rounds):
        ctes.append(
            f"r{t + 1} AS (SELECT x.i, x.k, any_value(0.5::DOUBLE * x.r + 0.5::DOUBLE * (x.a)) "
            f"+ 0.5::DOUBLE * (coalesce(max(y.a) FILTER (WHERE y.k <> x.k), 0) - max(y.a)) AS r "
            f"FROM m{t} x JOIN m{t} y ON x.i = y.i GROUP BY 1, 2)"
        )
        ctes.append(
            f"p{t + 1} AS (SELECT x.i, x.k, any_value(x.r) AS r, "
            f"coalesce(sum(greatest(y.r, 0)) FILTER (WHERE y.k <> x.k), 0) AS p "
            f"FROM r{t + 1} x JOIN r{t + 1} y ON x.i = y.i GROUP BY 1, 2)"
        )
        ctes.append(
            f"m{t + 1} AS (SELECT i, k, r, 0.5::DOUBLE * p + 0.5::DOUBLE * (CASE WHEN i = k THEN p "
            f"ELSE least(0, p + r) END) AS a FROM p{t + 1})"
        )
    return ", ".join(ctes)


@query(
    "message_passing",
    f"WITH {_sql_rounds(2)} SELECT i, k, round(r, 6) AS r, round(a, 6) AS a FROM m2",
)
def message_passing(spark, sf_dir):
    state = propagation.run_rounds(similarities(spark, sf_dir), 2)
    return state.select("i", "k", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))


@query(
    "message_passing_centres",
    f"WITH {_sql_rounds(30)}, best AS (SELECT i, max(a + r) AS v FROM m30 GROUP BY 1) "
    "SELECT i, min(k) AS centre FROM m30 JOIN best USING (i) WHERE a + r >= v - 1e-9 * abs(v) GROUP BY 1",
)
def message_passing_centres(spark, sf_dir):
    """A hundred rounds, or as many as it takes until the centres stay the same;
    on the given tables that is before the thirtieth, where the SQL ends."""
    return propagation.message_passing(similarities(spark, sf_dir))
