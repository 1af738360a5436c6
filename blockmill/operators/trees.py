"""Gini trees and forests of all blocks, grown level by level in one plan.

A level is one aggregate: rows are counted by (block, tree, node, feature, bin,
label), on the map side first. Running sums over the bins of a feature give the
Gini impurity of every split at once; as counts are whole numbers, so are the sums
of their squares, and equal calls choose equal splits. Only the nodes of a level,
never rows, are kept between levels; they are broadcast after a look at their
number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.functions.hashing import HASH_RANGE, bucket_hash
from blockmill.operators.blocks import BLOCK
from blockmill.runtime import join_checked, store, store_counted

#: Parts of equal width into which the range of a feature is cut.
BINS = 32

#: Levels after which the rows are stored with their nodes.
STORED_LEVELS = 6

#: Least gain of a split, as a share of the node's rows.
LEAST_GAIN = 1e-9

#: Distribution function of the number of times a row is drawn into a tree's sample.
_DRAWN = [0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152, 0.9999167589, 0.9999897508]

_NODE = ["g", "tree", "node"]


def bin_of(value: Column, low: Column, width: Column) -> Column:
    """The part of [low, low + width] that holds a value; values outside count to the ends."""
    part = F.floor(F.coalesce(F.try_divide(value - low, width), F.lit(0.0)) * BINS)
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), part)).cast("int")


def _ranges(rows: DataFrame) -> DataFrame:
    """(g, lows, widths): per block, feature by feature."""
    each = rows.select("g", F.posexplode("vec").alias("f", "x")).groupBy("g", "f").agg(
        F.min("x").alias("low"), (F.max("x") - F.min("x")).alias("width")
    )
    listed = each.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("f", "low", "width"))).alias("all"))
    return listed.select("g", F.col("all.low").alias("lows"), F.col("all.width").alias("widths"))


def _features(tree: Column, node: Column, count: int, chosen: int, seed: int) -> Column:
    """The ``chosen`` features of a node, first ones by the hash of (node, feature)."""
    every = F.sequence(F.lit(0), F.lit(count - 1))
    if chosen >= count:
        return every
    placed = F.transform(
        every, lambda f: F.struct(F.xxhash64(F.lit(seed), F.col("g"), tree, node, f).alias("h"), f.alias("f"))
    )
    return F.transform(F.slice(F.sort_array(placed), 1, chosen), lambda x: x["f"])


def _histogram(state: DataFrame) -> DataFrame:
    return (
        state.select(*_NODE, "label", "weight", "bins", F.explode("features").alias("f"))
        .groupBy(*_NODE, "f", F.get("bins", F.col("f")).alias("bin"), "label")
        .agg(F.sum("weight").alias("c"))
    )


def _best_splits(histogram: DataFrame, node_size: int) -> DataFrame:
    """(g, tree, node, label, n, f, bin): per node its label, its rows, and the split
    with the least impurity, null where none is allowed; ties to the first feature, then bin."""
    by_label = Window.partitionBy(*_NODE, "f", "label")
    before = by_label.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = histogram.withColumns(
        {"left": F.coalesce(F.sum("c").over(before), F.lit(0)), "all": F.sum("c").over(by_label)}
    )
    # What moving these rows to the left adds to the left's and takes from the right's sum of squares.
    gained = F.col("c") * (2 * F.col("left") + F.col("c"))
    lost = F.col("c") * (2 * (F.col("all") - F.col("left")) - F.col("c"))
    by_bin = counted.groupBy(*_NODE, "f", "bin").agg(
        F.sum("c").alias("c"),
        F.sum(gained).alias("gained"),
        F.sum(lost).alias("lost"),
        # The node's commonest label is found where each label is counted for the first time.
        F.max(F.when(F.col("left") == 0, F.struct(F.col("all").alias("n"), (-F.col("label")).alias("neg")))).alias("top"),
    )
    over = Window.partitionBy(*_NODE, "f")
    upto = over.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by_bin.withColumns(
        {
            "nl": F.sum("c").over(upto),
            "sl": F.sum("gained").over(upto),
            "moved": F.sum("lost").over(upto),
            "n": F.sum("c").over(over),
            "squares": F.sum("lost").over(over),
        }
    )
    nr, sr = F.col("n") - F.col("nl"), F.col("squares") - F.col("moved")
    score = F.col("sl") / F.col("nl") + F.try_divide(sr, nr)
    allowed = (
        (F.col("nl") >= node_size)
        & (nr >= node_size)
        & (score - F.col("squares") / F.col("n") > LEAST_GAIN * F.col("n"))
    )
    best = F.max(F.when(allowed, F.struct(score.alias("s"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))))
    found = run.groupBy(*_NODE).agg(F.max("n").alias("n"), F.max("top").alias("top"), best.alias("best"))
    return found.select(
        *_NODE, (-F.col("top.neg")).alias("label"), "n", (-F.col("best.f")).alias("f"), (-F.col("best.bin")).alias("bin")
    )


def grow(
    df: DataFrame,
    trees: int = 1,
    max_depth: int = 2,
    node_size: int = 2,
    features: int | None = None,
    bootstrap: bool = False,
    group: str = BLOCK,
    id: str = "id",
    vec: str = "vec",
    label: str = "label",
    seed: int = 42,
) -> DataFrame:
    """(block, tree, node, feature, bin, low, width, threshold, label, n): ``trees``
    trees for each block, all blocks at once.

    ``label`` is a whole number, ``vec`` has one length. Node 1 is the root, the
    children of node v are 2 v (values below ``threshold``) and 2 v + 1; a leaf has no
    feature. Splits lie at the ends of ``BINS`` parts of a feature's range within
    the block. Both sides hold at least ``node_size`` rows. With ``bootstrap`` a
    tree draws rows with replacement (each a Poisson number of times, from the
    hash of its id); ``features`` is the number of features tried at a node.
    Rows with a null vector, label or block take no part.
    """
    rows = df.select(
        F.col(group).cast("bigint").alias("g"), F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec"),
        F.col(label).cast("bigint").alias("label"),
    ).where("g IS NOT NULL AND vec IS NOT NULL AND label IS NOT NULL")
    ranges, n_blocks = store_counted(_ranges(rows), "ranges")
    known = join_checked(rows, ranges, ["g"], n_blocks, F.col("id"))
    numbers = F.sequence(F.lit(0), F.size("vec") - 1)
    bins = F.transform(numbers, lambda f: bin_of(F.get("vec", f), F.get("lows", f), F.get("widths", f)).cast("tinyint"))
    binned = store(known.select("g", "id", "label", bins.alias("bins")), "binned")
    first = binned.select(F.size("bins").alias("d")).first()
    count = first["d"] if first else 0
    chosen = min(features or count, count)

    tree, node = F.col("tree"), F.col("node")
    state = binned.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(1).cast("bigint"))
    if bootstrap:
        place = F.pmod(F.xxhash64(F.lit(seed), F.col("g"), tree, F.col("id")), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))
        drawn = reduce(lambda total, limit: total + (place >= limit).cast("int"), _DRAWN, F.lit(0))
        state = state.withColumn("weight", drawn.cast("bigint")).where("weight > 0")
    else:
        state = state.withColumn("weight", F.lit(1).cast("bigint"))
    if chosen >= count:
        state = state.withColumn("features", F.sequence(F.lit(0), F.size("bins") - 1))
    else:
        state = state.withColumn("features", _features(tree, node, count, chosen, seed))

    levels = []
    for depth in range(max_depth):
        nodes, n_nodes = store_counted(_best_splits(_histogram(state), node_size), "nodes")
        levels.append(nodes)
        if nodes.where("f IS NOT NULL").isEmpty():
            break
        inner = nodes.where("f IS NOT NULL").select(*_NODE, "f", F.col("bin").alias("cut"))
        right = (F.get("bins", F.col("f")) > F.col("cut")).cast("bigint")
        if chosen < count:
            inner = inner.withColumn(
                "tried", F.array(*(_features(tree, 2 * node + side, count, chosen, seed) for side in (0, 1)))
            )
        moved = join_checked(state, inner, _NODE, n_nodes, F.col("id"))
        tried = F.get("tried", right.cast("int")) if chosen < count else F.col("features")
        state = moved.select(
            "g", "tree", "id", "label", "bins", "weight", tried.alias("features"), (2 * node + right).alias("node")
        )
        if depth % STORED_LEVELS == STORED_LEVELS - 1:
            state = store(state, "grown")
    else:
        counts = state.groupBy(*_NODE, "label").agg(F.sum("weight").alias("c"))
        leaves = counts.groupBy(*_NODE).agg(
            F.max(F.struct("c", (-F.col("label")).alias("neg"))).alias("top"), F.sum("c").alias("n")
        )
        none = F.lit(None)
        levels.append(
            leaves.select(
                *_NODE, (-F.col("top.neg")).alias("label"), "n", none.cast("int").alias("f"), none.cast("int").alias("bin")
            )
        )
    grown = reduce(DataFrame.unionByName, levels)
    low, width = (F.get(name, F.col("f")) for name in ("lows", "widths"))
    return store(
        grown.join(F.broadcast(ranges) if n_blocks <= 10_000 else ranges, "g").select(
            F.col("g").cast(df.schema[group].dataType).alias(group),
            "tree",
            "node",
            F.col("f").alias("feature"),
            "bin",
            low.alias("low"),
            width.alias("width"),
            (low + (F.col("bin") + 1) * width / BINS).alias("threshold"),
            "label",
            "n",
        ),
        "trees",
    )


def predictions(df: DataFrame, trees: DataFrame, group: str = BLOCK, id: str = "id", vec: str = "vec") -> DataFrame:
    """The columns of ``df`` with ``model`` and ``prediction``: every row judged by
    the trees of every block, the lowest of the commonest labels.

    A row goes down all trees level by level, one join with their nodes a level.
    """
    depth = trees.agg(F.max("node")).first()[0]
    models = sorted(tuple(r) for r in trees.select(group, "tree").distinct().collect())
    pairs = F.array(*(F.struct(F.lit(g).cast("bigint").alias("m"), F.lit(t).alias("tree")) for g, t in models))
    nodes = trees.select(
        F.col(group).cast("bigint").alias("m"), "tree", "node", "feature", "bin", "low", "width", F.col("label").alias("leaf")
    )
    n_nodes = nodes.count()
    state = df.withColumn("_key", F.col(id)).withColumn("_pair", F.explode(pairs)).select(
        "*", "_pair.m", "_pair.tree", F.lit(1).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("prediction")
    ).drop("_pair")
    kept = [*df.columns, "_key", "m", "tree"]
    for _ in range(int(depth or 1).bit_length()):
        inner = join_checked(state, nodes, ["m", "tree", "node"], n_nodes, F.col("_key"), "left")
        right = bin_of(F.get(F.col(vec), F.col("feature")), F.col("low"), F.col("width")) > F.col("bin")
        state = inner.select(
            *kept,
            F.when(F.col("feature").isNotNull(), 2 * F.col("node") + right.cast("bigint")).otherwise(F.lit(0)).alias("node"),
            F.coalesce("leaf", "prediction").alias("prediction"),
        )
    if len({g for g, _ in models}) == len(models):
        return state.select(*df.columns, F.col("m").alias("model"), "prediction")
    votes = state.groupBy(*(c for c in kept if c != "tree"), "prediction").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("prediction")).alias("neg"))).alias("best")
    return votes.groupBy(*(c for c in kept if c != "tree")).agg(best).select(
        *df.columns, F.col("m").alias("model"), (-F.col("best.neg")).alias("prediction")
    )


def accuracy(judged: DataFrame, group: str = BLOCK, label: str = "label") -> DataFrame:
    """(model, block_id, accuracy): every block's model on every block of rows."""
    hit = (F.col("prediction") == F.col(label)).cast("double")
    return judged.groupBy("model", group).agg(F.avg(hit).alias("accuracy"))
