import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockmill.functions.hashing import bucket_hash
from blockmill.functions.vectors import array_to_vector, euclidean_distance, majority, vector_to_array
from blockmill.operators import ensemble, learn, lloyd, neighbours, propagation, quality, spectral, subspace, trees
from blockmill.operators.blocks import assign_blocks


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centre = np.repeat(np.array([[0.0, 0], [8, 8], [0, 9]]), 40, axis=0)
    return centre + rng.normal(size=centre.shape)


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, [float(x) for x in p], i // 40) for i, p in enumerate(points)]
    made = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    return assign_blocks(made, 3, "id").withColumn("features", array_to_vector("vec")).cache()


def brute_nearest(points, k, skip_self):
    dist = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    if skip_self:
        np.fill_diagonal(dist, np.inf)
    return {i: list(np.argsort(row, kind="stable")[:k]) for i, row in enumerate(dist)}


@pytest.mark.parametrize("ship", ["candidates", "queries", "tiles"])
@pytest.mark.parametrize("skip_self", [False, True])
def test_every_way_finds_the_same_neighbours(spark, table, points, ship, skip_self, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 17)
    queries, rows = table.select("id", "vec"), table.select("id", "vec", "label")
    if ship == "queries":
        found = neighbours._gather(
            neighbours._ship_queries(queries, rows, 4, skip_self).select(
                "q", F.explode("hits").alias("h")
            ).select("q", "h.*"),
            4,
        )
    else:
        limit = 1000 if ship == "candidates" else 10
        found = neighbours.nearest(queries, rows, 4, skip_self, ship_rows=limit)
    got = {r.q: [h.id for h in r.hits] for r in found.collect()}
    assert got == brute_nearest(points, 4, skip_self)


def test_few_queries_against_many_rows(table):
    few = table.where("id < 5").select("id", "vec")
    found = neighbours.knn_label(few, table.select("id", "vec", "label"), 3, ship_rows=10)
    assert {r.label for r in found.collect()} == {0} and found.count() == 5


def test_neighbours_stay_within_the_group(table, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 9)
    block = {r.id: r.block_id for r in table.collect()}
    found = neighbours.nearest_within(table, "block_id", 5).collect()
    assert len(found) == 120
    for r in found:
        assert len(r.hits) == 5 and all(block[h.id] == block[r.q] != None for h in r.hits)  # noqa: E711
        assert r.q not in [h.id for h in r.hits]


def test_sifted_candidates_are_the_nearest(monkeypatch):
    """Whole numbers far from 0: many ties, and products that lose the last digits."""
    monkeypatch.setattr(neighbours, "STEP_ROWS", 7)
    rng = np.random.default_rng(5)
    vecs = rng.integers(0, 3, (60, 4)) + 1e7
    vecs[50] = np.nan
    ids = rng.permutation(60)
    tile = neighbours._Tile(3, 5, True)
    tile.add(ids[:20], vecs[:20])
    tile.add(ids[20:], vecs[20:])
    for low in (0, 25):
        tile.see(ids[low : low + 25 + low], vecs[low : low + 25 + low], np.zeros(60, np.int64)[low : low + 25 + low])
    (found,) = tile.hits()
    got = {r["q"]: [(h["sq_dist"], h["id"]) for h in r["hits"]] for r in found.to_pylist()}
    for n in range(60):
        dist = ((vecs - vecs[n]) ** 2).sum(axis=1)
        want = sorted((d, i) for d, i in zip(dist, ids) if i != ids[n] and np.isfinite(d))[:5]
        assert got.get(ids[n], []) == want


def test_majority_and_distance(spark):
    row = spark.createDataFrame(
        [([3, 1, 1, 3, 2], [0.0, 3.0], [4.0, 0.0])], "l array<int>, a array<double>, b array<double>"
    ).select(majority(F.col("l")).alias("m"), euclidean_distance(F.col("a"), F.col("b")).alias("d"))
    assert tuple(row.first()) == (1, 5.0)


def test_vectors_round_trip(table):
    row = table.select("vec", vector_to_array("features").alias("back")).first()
    assert row.vec == row.back


def test_purity_and_nmi(spark):
    rows = [("a", 1)] * 4 + [("b", 1)] * 4 + [("b", 2)] * 2
    df = spark.createDataFrame(rows, "label string, prediction int")
    assert quality.purity(df).first()[0] == pytest.approx(0.6)
    flat = spark.createDataFrame([("a", 1), ("a", 2)], "label string, prediction int")
    assert quality.nmi(flat).first()[0] == 0.0
    same = spark.createDataFrame([("a", 1), ("b", 2)], "label string, prediction int")
    assert quality.nmi(same).first()[0] == pytest.approx(1.0)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(3), rng.randrange(2), rng.randrange(3)]) for i in range(60)]
    return rows, spark.createDataFrame(rows, "id bigint, labels array<int>")


def test_ensemble_distances_equal_the_full_matrices(labelled):
    rows, df = labelled
    z = np.array([labels for _, labels in rows])
    m = np.stack([z[:, h][:, None] == z[:, h][None] for h in range(3)]).astype(float)
    want = np.abs(m - m.mean(axis=0)).sum(axis=(1, 2))
    got = {r.h: r.distance for r in ensemble.ensemble_distances(df).collect()}
    assert [got[h] for h in range(3)] == pytest.approx(list(want))
    assert ensemble.ensemble_pick(df).first().h == int(want.argmin())


def test_coassociation_covers_the_whole_matrix(labelled):
    rows, df = labelled
    z = [tuple(labels) for _, labels in rows]
    want = Counter()
    for a in z:
        for b in z:
            want[a, b] += sum(x == y for x, y in zip(a, b)) / 3
    got = {
        (tuple(r.labels_i), tuple(r.labels_j)): r.share * r.n_i * r.n_j
        for r in ensemble.coassociation(df).collect()
    }
    assert got == pytest.approx({k: v for k, v in want.items() if v})


def test_ncut_matrix_equals_dense_algebra(labelled):
    rows, df = labelled
    b = np.zeros((60, 9))
    for i, labels in rows:
        for h, c in enumerate(labels):
            b[i, h * 3 + c] = 1
    a = b / math.sqrt(3) / np.sqrt(b.sum(axis=0) + 1e-6)
    want = a.T @ a
    got = np.zeros((9, 9))
    for i, j, v in ensemble.ncut_matrix(df, 3, 3).collect():
        got[i, j] = v
    assert np.allclose(got, want)


@pytest.mark.parametrize("keep_first", [True, False])
def test_ensemble_finds_the_three_groups(table, keep_first):
    got = {r.id: r.label for r in ensemble.ensemble_ncut(table, [0, 1], [2], 4, 3, keep_first).collect()}
    assert len(got) == 120 and set(got.values()) <= {0, 1, 2}
    if keep_first:
        for start in (0, 40, 80):
            share = Counter(got[i] for i in range(start, start + 40)).most_common(1)[0][1] / 40
            assert share > 0.8


def test_ensemble_has_a_bound(labelled, monkeypatch):
    monkeypatch.setattr(ensemble, "MAX_CENTRES", 8)
    with pytest.raises(ValueError, match="at most 8"):
        ensemble.ncut_centre_labels(labelled[1], 3, 3, 2)


def symmetric(rng, n, density):
    """A random sparse symmetric matrix with eigenvalues in [-1, 1]."""
    m = rng.random((n, n)) * (rng.random((n, n)) < density)
    m = (m + m.T) / 2
    return m / np.abs(np.linalg.eigvalsh(m)).max()


def test_leading_vectors_equal_numpy(spark):
    rng = np.random.default_rng(3)
    two = np.zeros((50, 50))
    two[:20, :20], two[20:, 20:] = symmetric(rng, 20, 0.4), symmetric(rng, 30, 0.3)
    matrices = {0: symmetric(rng, 40, 0.3), 7: two, 9: np.array([[0.5]])}
    cells = [(g, i, j, float(m[i, j])) for g, m in matrices.items() for i in range(len(m)) for j in range(len(m)) if m[i, j]]
    nodes = [(g, i) for g, m in matrices.items() for i in range(len(m))]
    given = spark.createDataFrame(cells, "g bigint, i bigint, j bigint, w double"), spark.createDataFrame(nodes, "g bigint, i bigint")
    vectors, values = subspace.leading_vectors(*given, 3)
    rows, values = vectors.collect(), {(r.g, r["rank"]): r.value for r in values.collect()}
    for g, m in matrices.items():
        want = np.linalg.eigvalsh(m)[::-1][:3]
        assert [values[g, r] for r in range(len(want))] == pytest.approx(list(want), abs=1e-8)
        x = np.array([r.vec for r in sorted(rows) if r.g == g])[:, : len(want)]
        assert np.allclose(x.T @ x, np.eye(len(want)), atol=1e-6)
        assert np.allclose(m @ x, x * want, atol=1e-4)
        assert all(column[np.abs(column).argmax()] > 0 for column in x.T)
    again, _ = subspace.leading_vectors(given[0].repartition(5), given[1].repartition(3), 3)
    assert sorted(again.collect()) == sorted(rows)


def test_spectral_adaptive_is_the_same_each_time(table):
    rows = table.where("id % 2 = 0").select("id", "vec", F.lit(0).alias("block_id"))
    got, again = (
        {r.id: r.prediction for r in spectral.spectral_adaptive(part, 3, k_max=10).collect()}
        for part in (rows, rows.repartition(5))
    )
    assert got == again and len(got) == 60 and set(got.values()) == {0, 1, 2}
    # The groups are far apart, so each is one cluster; numbers follow the smallest members.
    assert [got[i] for i in range(0, 120, 2)] == [0] * 20 + [1] * 20 + [2] * 20


def test_spectral_gaussian_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(spectral, "MAX_CENTRES", 3)
    centres = spark.range(4).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    with pytest.raises(ValueError, match="at most 3"):
        spectral.spectral_gaussian(centres, 2)


def test_gaussian_laplacian_equals_numpy(spark, table, points):
    centres = table.where("id % 10 = 0").select("id", "vec")
    ids = list(range(0, 120, 10))
    own = points[ids]
    similar = np.exp(-((own[:, None] - own[None]) ** 2).sum(axis=2) / 2)
    laplacian = np.diag(similar.sum(axis=1)) - similar
    got = np.zeros((12, 12))
    for r in spectral.gaussian_laplacian(centres).collect():
        got[ids.index(r.i), ids.index(r.j)] += r.w
    scale = 2 * (similar.sum(axis=1) - 1).max()
    assert np.allclose(got, np.eye(12) - 2 * laplacian / scale, atol=1e-9)


def test_spectral_similarity_has_the_components_as_top_vectors(table, points):
    """Groups far apart: the top singular value is 1, once per group."""
    weights = spectral.normalised_similarity(
        spectral.adaptive_similarity(table.select(F.lit(0).alias("block_id"), "id", "vec"), 10)
    )
    dense = np.zeros((120, 120))
    for r in weights.collect():
        dense[r.i, r.j] = r.w
    assert np.allclose(dense, dense.T)
    values = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(values[:3], 1.0) and values[3] < 1.0


def test_spectral_gaussian_and_anchors(table):
    centres = table.where("id IN (0, 1, 40, 41, 80, 81)").select("id", "vec")
    got = {r.id: r.prediction for r in spectral.spectral_gaussian(centres, 3).collect()}
    assert got[0] == 0 and len(set(got.values())) == 3
    assert got[0] == got[1] and got[40] == got[41] and got[80] == got[81]
    labels = spectral.anchor_labels(table.select("id", "vec"), table, 3, per_cluster=3)
    right = sum(r.label == r.id // 40 for r in labels.collect())
    assert right >= 118


def brute_kmeans(rows, k, steps):
    """Lloyd steps on [(id, vector)] in the order of their start; (centres, counts)"""
    centres = np.array([v for _, v in rows[:k]])
    x = np.array([v for _, v in rows])
    counts = np.zeros(len(centres), int)
    for _ in range(steps):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.array([x[near == c].mean(axis=0) if counts[c] else centres[c] for c in range(len(centres))])
    return centres, counts


@pytest.mark.parametrize("wave_bytes", [64 << 20, 50])
def test_kmeans_of_all_blocks_equals_plain_steps(spark, table, points, wave_bytes, monkeypatch):
    monkeypatch.setattr(lloyd, "WAVE_BYTES", wave_bytes)
    # Copies make empty clusters and ties; block 9 has fewer rows than centres; nulls take no part.
    more = [(500 + i, [1.0, 1.0], 5) for i in range(20)] + [(600, [2.0, 3.0], 9), (601, None, 9), (602, [1.0, 1.0], None)]
    rows = table.select("id", "vec", "block_id").unionByName(
        spark.createDataFrame(more, "id bigint, vec array<double>, block_id bigint")
    )
    got = lloyd.kmeans(rows, 4, steps=3, tol=0.0).collect()
    assert sorted(lloyd.kmeans(rows.repartition(7), 4, steps=3, tol=0.0).collect()) == sorted(got)
    hashed = rows.where("vec IS NOT NULL AND block_id IS NOT NULL").withColumn("h", bucket_hash(42, F.col("id")))
    blocks = {}
    for r in sorted(hashed.collect(), key=lambda r: (r.h, r.id)):
        blocks.setdefault(r.block_id, []).append((r.id, r.vec))
    assert {r.block_id for r in got} == set(blocks) == {0, 1, 2, 5, 9}
    for block, mine in blocks.items():
        centres, counts = brute_kmeans(mine, 4, 3)
        found = sorted(r for r in got if r.block_id == block)
        assert [r.n for r in found] == list(counts) and np.allclose([r.centre for r in found], centres)


def test_kmeans_starts_and_labels(table, spark):
    far = lloyd.kmeans(table.withColumn("g", F.lit(1)), 3, group="g", start="spread")
    labelled = lloyd.with_own_label(table.withColumn("g", F.lit(1)), far, "g")
    got = {r.id: r.prediction for r in lloyd.by_smallest_member(labelled, "prediction", "g").collect()}
    assert [got[i] for i in range(120)] == [0] * 40 + [1] * 40 + [2] * 40
    centres = lloyd.kmeans(table, 2)
    rows = lloyd.with_labels(table.select("id", "vec"), centres).collect()
    models = {}
    for r in sorted(centres.collect()):
        models.setdefault(r.block_id, []).append(r.centre)
    for r in rows:
        want = [int(((np.array(models[b]) - r.vec) ** 2).sum(axis=1).argmin()) for b in sorted(models)]
        assert r.labels == want
    odd = spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 77), (3, [0.0, 0.0], None)], "id bigint, vec array<double>, block_id bigint")
    assert [r.prediction for r in lloyd.with_own_label(odd, centres).collect()] == [None] * 3
    assert lloyd.kmeans(odd.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="hash or spread"):
        lloyd.kmeans(table, 2, start="any")


def plain_tree(rows, ranges, depth, node_size, node=1):
    """{node: (feature, bin, label, n)} over [(bins, label)], every split tried."""
    counts = Counter(label for _, label in rows)
    top = min(counts, key=lambda c: (-counts[c], c))
    out = {node: (None, None, top, len(rows))}
    if not depth:
        return out
    parent = sum(c * c for c in counts.values()) / len(rows)
    best = None
    for f in range(len(rows[0][0])):
        for b in sorted({bins[f] for bins, _ in rows}):
            left = [label for bins, label in rows if bins[f] <= b]
            right = [label for bins, label in rows if bins[f] > b]
            if min(len(left), len(right)) < max(node_size, 1):
                continue
            score = sum(sum(c * c for c in Counter(side).values()) / len(side) for side in (left, right))
            if score - parent > 1e-9 * len(rows) and (best is None or score > best[0]):
                best = (score, f, b)
    if best:
        _, f, b = best
        out[node] = (f, b, top, len(rows))
        for side, part in enumerate(([r for r in rows if r[0][f] <= b], [r for r in rows if r[0][f] > b])):
            out |= plain_tree(part, ranges, depth - 1, node_size, 2 * node + side)
    return out


def in_bins(vectors):
    x = np.array(vectors)
    low, width = x.min(axis=0), x.max(axis=0) - x.min(axis=0)
    part = np.floor(np.divide(x - low, width, out=np.zeros_like(x), where=width > 0) * trees.BINS)
    return np.clip(part, 0, trees.BINS - 1).astype(int).tolist()


@pytest.mark.parametrize("depth, node_size", [(3, 1), (8, 2)])
def test_trees_of_all_blocks_equal_plain_ones(spark, depth, node_size, monkeypatch):
    monkeypatch.setattr(trees, "STORED_LEVELS", 2)
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 1.0, 2.5]), 3.0, rng.random()], rng.randrange(3), rng.choice([0, 0, 0, 4])) for i in range(150)]
    rows += [(900, [1.0, 1.0, 1.0], 2, 6), (901, None, 1, 0), (902, [1.0, 1.0, 1.0], None, 0)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, label int, block_id bigint").withColumn("node", F.lit("x"))
    got = {}
    for r in trees.grow(df, max_depth=depth, node_size=node_size).collect():
        got.setdefault(r.block_id, {})[r.node] = (r.feature, r.bin, r.label, r.n)
        if r.feature is not None:
            assert r.threshold == pytest.approx(r.low + (r.bin + 1) * r.width / trees.BINS)
    for block in (0, 4, 6):
        mine = [r for r in rows if r[3] == block and r[1] is not None and r[2] is not None]
        binned = list(zip(in_bins([r[1] for r in mine]), [r[2] for r in mine]))
        assert got[block] == plain_tree(binned, None, depth, node_size)


def walk(nodes, vec):
    node = 1
    while nodes[node].feature is not None:
        r = nodes[node]
        part = math.floor((vec[r.feature] - r.low) / r.width * trees.BINS) if r.width else 0
        node = 2 * node + (min(trees.BINS - 1, max(0, part)) > r.bin)
    return nodes[node].label


def test_block_models_judge_every_block(table):
    grown = trees.grow(table, max_depth=3, node_size=2)
    rows = table.select("block_id", "id", "vec", "label")
    judged = trees.predictions(rows, grown)
    nodes = {}
    for r in grown.collect():
        nodes.setdefault(r.block_id, {})[r.node] = r
    got = judged.collect()
    assert len(got) == 3 * 120 and all(r.prediction == walk(nodes[r.model], r.vec) for r in got)
    scores = trees.accuracy(judged).collect()
    assert {(r.model, r.block_id) for r in scores} == {(m, b) for m in (0, 1, 2) for b in (0, 1, 2)}
    assert min(r.accuracy for r in scores) > 0.9


def test_forests(table):
    made = dict(trees=7, max_depth=3, features=1, bootstrap=True)
    grown = trees.grow(table, **made)
    rows = grown.collect()
    assert {(r.block_id, r.tree) for r in rows} == {(b, t) for b in (0, 1, 2) for t in range(7)}
    assert sorted(trees.grow(table.repartition(5), **made).collect(), key=str) == sorted(rows, key=str)
    # Samples differ from tree to tree and hold about as many rows as the block.
    roots = [r.n for r in rows if r.node == 1]
    assert len(set(roots)) > 3 and 0.7 < sum(roots) / (7 * 120) < 1.3
    scores = trees.accuracy(trees.predictions(table.select("block_id", "id", "vec", "label"), grown)).collect()
    assert min(r.accuracy for r in scores) > 0.9


@pytest.mark.parametrize("kind", ["mixture", "kmeans", "bisecting"])
def test_global_clusterings(table, kind):
    rows = learn.cluster_global(table, 3, kind)
    assert rows.columns == ["label", "prediction"] and rows.count() == 120
    assert {r.prediction for r in rows.collect()} <= {0, 1, 2}
    with pytest.raises(ValueError):
        learn.cluster_global(table, 3, "other")


@pytest.mark.parametrize("values", [20, 3, 1])
def test_trimmed_models(spark, values):
    rows = [(i, (i * 7 % values) / 20) for i in range(20)]
    scores = spark.createDataFrame(rows, "m int, accuracy double")
    kept = sorted((r.accuracy, r.m) for r in learn.trim_models(scores, "m").collect())
    assert kept == sorted((a, m) for m, a in rows)[2:18]
    assert learn.trim_models(scores.limit(0), "m").count() == 0


def literal_rounds(sims, rounds, d=0.5):
    """The recurrence, read literally."""
    state = {key: (0.0, s) for key, s in sims.items()}
    for _ in range(rounds):
        r_new, a_new = {}, {}
        for (i, k), (r, a) in state.items():
            row = {kk: v[1] for (ii, kk), v in state.items() if ii == i}
            others = [v for kk, v in row.items() if kk != k]
            r_new[i, k] = d * r + (1 - d) * (a + (max(others) if others else 0.0) - max(row.values()))
        for (i, k), r in r_new.items():
            p = sum(max(v, 0.0) for (ii, kk), v in r_new.items() if ii == i and kk != k)
            a_new[i, k] = d * p + (1 - d) * (p if i == k else min(0.0, p + r))
        state = {key: (r_new[key], a_new[key]) for key in state}
    return state


@pytest.mark.parametrize("row_piece", [1, 100])
def test_message_passing_follows_the_recurrence(spark, row_piece):
    sims = {(1, 2): 0.9, (1, 3): 0.4, (1, 4): 0.5, (2, 3): 0.3, (2, 4): 0.2, (3, 4): 0.8}
    rng = random.Random(7)
    sims |= {(5, k): rng.random() for k in range(1, 12)}
    df = spark.createDataFrame([(i, k, s) for (i, k), s in sims.items()], "i int, k int, s double")
    state = propagation.run_rounds(df, 3, row_piece=row_piece).collect()
    want = literal_rounds(sims, 3)
    assert {(r.i, r.k): r.r for r in state} == pytest.approx({k: v[0] for k, v in want.items()})
    assert {(r.i, r.k): r.a for r in state} == pytest.approx({k: v[1] for k, v in want.items()})
    for rounds, patience in ((1, None), (3, 20)):
        state = literal_rounds(sims, rounds)
        best = {i: max(sum(v) for (ii, _), v in state.items() if ii == i) for i in (1, 2, 3, 5)}
        lowest = {i: min(k for (ii, k), v in state.items() if ii == i and sum(v) >= b - 1e-9 * abs(b)) for i, b in best.items()}
        found = propagation.message_passing(df, rounds, row_piece=row_piece, patience=patience)
        assert {r.i: r.centre for r in found.collect()} == lowest


def test_message_passing_stops_when_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(propagation, "LOOK", 2)
    ran = []
    step = propagation.availabilities
    monkeypatch.setattr(propagation, "availabilities", lambda *a: ran.append(1) or step(*a))
    # Two equal best values: a tie goes to the lower k.
    df = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 1, 0.4)], "i int, k int, s double")
    found = propagation.message_passing(df, rounds=30, patience=4)
    assert {r.i: r.centre for r in found.collect()} == {1: 2, 2: 1} and len(ran) == 6


def test_vectors_carried_together_are_those_carried_apart(spark, monkeypatch):
    """One row per vector or one for all: the same to the last bit."""
    entries = [(0, i, j, 0.2) for i in range(30) for j in range(30) if i != j and (i // 10 == j // 10) and (i + j) % 3]
    df = spark.createDataFrame(entries, "g bigint, i bigint, j bigint, w double")
    nodes = spark.range(30).select(F.lit(0).cast("bigint").alias("g"), F.col("id").alias("i"))
    monkeypatch.setattr(subspace, "MAX_ROUNDS", 2)
    found = []
    for wide in (0, 1_000):
        monkeypatch.setattr(subspace, "WIDE_ROWS", wide)
        found.append(sorted((r.i, *r.vec) for r in subspace.leading_vectors(df, nodes, 2)[0].collect()))
    assert found[0] == found[1] and len(found[0]) == 30


def test_large_matrices_broadcast_no_vectors(spark, monkeypatch):
    """Stripes give the vectors of the joined way to the last bit; nothing that grows with the rows is broadcast."""
    rng = np.random.default_rng(9)
    cells = [(g, i, j, float(w)) for g, n in ((0, 23), (4, 9)) for (i, j), w in np.ndenumerate(symmetric(rng, n, 0.3)) if w]
    df = spark.createDataFrame([*cells, (0, 3, 99, 0.5), (0, 99, 3, 0.5)], "g bigint, i bigint, j bigint, w double")
    nodes = spark.createDataFrame([(0, i) for i in range(24)] + [(4, i) for i in range(9)], "g bigint, i bigint")
    monkeypatch.setattr(subspace, "MAX_ROUNDS", 2)
    want = subspace.leading_vectors(df.where("i < 99 AND j < 99"), nodes, 2)[0].collect()
    monkeypatch.setattr(subspace, "WIDE_ROWS", 0)
    monkeypatch.setattr(subspace, "STRIPE_ROWS", 8)
    monkeypatch.setattr(subspace, "PIECE_ENTRIES", 5)
    monkeypatch.setattr(subspace, "join_checked", None)
    got = subspace.leading_vectors(df, nodes, 2)[0].select("g", "i", "vec").collect()
    assert sorted(got) == sorted(want) and len(got) == 33
