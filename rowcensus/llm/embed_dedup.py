"""Embedding near-deduplication: a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stage
from .graph import components
from .joins import keep_matching

COSINE = 0.93
TREES = 12
LEAF = 1_000
#: Half the width of the spill, in standard deviations of a direction.
OVERLAP = 0.05
#: Values of the sample on which the forest is fitted, and rows at most and at least.
FIT_VALUES, FIT_ROWS, FIT_LEAST = 1_280_000, 20_000, 256
#: Directions drawn for a split, of which the one with the largest spread is taken.
DRAWS = 4
#: Sample rows a node needs for a split of its own; levels that may have such nodes.
NODE_ROWS, NODE_LEVELS = 32, 10
#: A node is dense, and stays whole, if so large a share of its pairs is linked.
DENSE = 0.2


@dataclass(frozen=True)
class Forest:
    """Splits of vectors of one width, fitted on a sample and small enough for every task.

    ``directions`` has a column per tree and level. ``cuts`` and ``dense`` are indexed by
    tree and node; nodes are numbered as in a heap, the root is 1. Nodes that the sample does
    not describe are cut at their level's ``middle``.
    """

    directions: np.ndarray
    middle: np.ndarray
    spill: np.ndarray
    cuts: np.ndarray
    dense: np.ndarray

    def routes(self, x: np.ndarray, depth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tree, rows, nodes): the leaves of every row, which may be several in a tree.

        A row goes down ``depth`` levels, or until it meets a dense node.
        """
        trees, levels = self.middle.shape
        at = (x @ self.directions).reshape(len(x), trees, levels)
        for tree in range(trees):
            rows, nodes = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
            for level in range(levels):
                known = nodes < self.cuts.shape[1]
                near = np.where(known, nodes, 0)
                stop = (depth[rows] <= level) | (known & self.dense[tree, near])
                if stop.any():
                    yield tree, rows[stop], nodes[stop]
                    rows, nodes, known, near = (v[~stop] for v in (rows, nodes, known, near))
                if not len(rows):
                    break
                cut = np.where(known, self.cuts[tree, near], self.middle[tree, level])
                here, spill = at[rows, tree, level], self.spill[tree, level]
                left, right = here <= cut + spill, here >= cut - spill
                rows = np.concatenate((rows[left], rows[right]))
                nodes = np.concatenate((2 * nodes[left], 2 * nodes[right] + 1))
            if len(rows):
                yield tree, rows, nodes


def fit_forest(sample: np.ndarray, trees: int, levels: int, overlap: float, cosine: float, seed: int) -> Forest:
    """A forest whose nodes split the unit vectors of ``sample`` at their medians."""
    random, width = np.random.default_rng(seed), sample.shape[1]
    own = min(levels, NODE_LEVELS)
    directions = np.empty((width, trees, levels))
    for tree in range(trees):
        for level in range(levels):
            drawn = random.standard_normal((width, DRAWS))
            drawn /= np.linalg.norm(drawn, axis=0)
            directions[:, tree, level] = drawn[:, (sample @ drawn).std(axis=0).argmax()]
    flat = directions.reshape(width, trees * levels)
    at = (sample @ flat).reshape(len(sample), trees, levels)
    middle = np.median(at, axis=0) if len(sample) else np.zeros((trees, levels))
    spread = at.std(axis=0) if len(sample) else np.zeros((trees, levels))
    cuts = np.zeros((trees, 1 << own))
    dense = np.zeros((trees, 1 << own), dtype=bool)
    for tree in range(trees):
        members = {1: np.arange(len(sample))}
        for level in range(own):
            below = {}
            for node in range(1 << level, 2 << level):
                rows = members.get(node, np.zeros(0, dtype=np.int64))
                cuts[tree, node] = middle[tree, level]
                if len(rows) < NODE_ROWS:
                    continue
                some = sample[rows[random.permutation(len(rows))[:64]]]
                linked = some @ some.T >= cosine
                if (linked.sum() - len(some)) >= DENSE * len(some) * (len(some) - 1):
                    dense[tree, node] = True
                    continue
                here = at[rows, tree, level]
                cuts[tree, node] = cut = np.median(here)
                below[2 * node], below[2 * node + 1] = rows[here <= cut], rows[here > cut]
            members = below
    return Forest(flat, middle, overlap * spread, cuts, dense)


def routed(classes: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """Rows (id, label, tree, node) of classes (id, label, embedding, depth): one pass over them."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = np.diff(lists.offsets.to_numpy())
            first = np.concatenate(([0], np.cumsum(lengths)))
            depth = batch.column(3).to_numpy()
            for width in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == width)
                x = unit(values[first[of][:, None] + np.arange(width)])
                found = [(0, np.arange(len(of)), np.ones(len(of), dtype=np.int64))]
                if width in forests:
                    found = forests[width].routes(x, depth[of])
                for tree, rows, nodes in found:
                    each = pa.array(of[rows])
                    columns = [batch.column(0).take(each), batch.column(1).take(each)]
                    columns += [pa.array(np.full(len(rows), tree, dtype=np.int32)), pa.array(nodes)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "tree", "node"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, tree int, node long"
    return classes.select("id", "label", "embedding", "depth").mapInArrow(route, schema)


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` with length 1; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grown(
    classes: DataFrame, trees: int, leaf: int, overlap: float, cosine: float, seed: int, stage: Stage
) -> DataFrame:
    """Rows (id, label, tree, node, count): the leaves each vector falls in; ``count`` is the size of those above ``leaf``, else 1.

    A label's vectors go down as many levels as give leaves of about ``leaf``. The forest is
    fitted on a bounded sample drawn by a hash; it decides what is compared, not what is
    linked.
    """
    sizes = classes.groupBy("label").agg(F.count("*").alias("size"))
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / (0.6 * leaf)))).cast("int")
    sizes = sizes.select(F.col("label").alias("_label"), F.when(F.col("size") <= leaf, 0).otherwise(levels).alias("depth"))
    sizes = stage.read(sizes.schema, stage.write(sizes, "sizes"))
    facts = sizes.agg(F.max("depth")).first()[0]
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    forests: dict[int, Forest] = {}
    if facts:
        rows = max(FIT_LEAST, min(FIT_ROWS, FIT_VALUES // width))
        drawn = classes.select("embedding", "id").orderBy(F.xxhash64("id"), "id").limit(rows).select("embedding").toArrow()
        lists = drawn.column(0).combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.concatenate(([0], np.cumsum(lengths)))
        for w in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == w)
            sample = unit(values[first[of][:, None] + np.arange(w)])
            forests[w] = fit_forest(sample, trees, facts, overlap, cosine, seed)
    placed = keep_matching(classes, sizes, F.col("label") == F.col("_label"), "inner")
    leaves = routed(placed, forests)
    leaves = stage.read(leaves.schema, stage.write(leaves, "leaves"))
    key = ["label", "tree", "node"]
    large = leaves.groupBy(*key).agg(F.count("*").alias("count")).where(f"count > {leaf}")
    large = large.select(*[F.col(c).alias(f"_{c}") for c in key], "count")
    large = stage.read(large.schema, stage.write(large, "large"))
    same = F.expr(" AND ".join(f"{c} = _{c}" for c in key))
    return keep_matching(leaves, large, same, "left").selectExpr("id", *key, "coalesce(count, 1L) AS count")


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the symmetric matrix ``near`` joins, at most one per row."""
    open_, found = near.any(axis=1), [np.empty((0, 2), dtype=np.int64)]
    while open_.any():
        root = int(open_.argmax())
        open_[root], reached = False, np.array([root])
        while len(reached):
            reached = np.flatnonzero(near[reached].any(axis=0) & open_)
            open_[reached] = False
            found.append(np.stack([np.full(len(reached), root), reached], axis=1))
    edges = np.concatenate(found)
    return edges[:, 0], edges[:, 1]


def close_pairs(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Pairs of a leaf with cosine >= ``cosine`` in double precision, as rows (a, b, n).

    With two blocks only pairs across them are looked at. Pairs that share a whole node are
    summed up in the first of these: rows with null b say that a has n linked rows, and rows
    with n = 0 join a and b. Other pairs, and those with an id of several vectors, are listed,
    a < b, with n = 1.
    """
    ids = group["id"].to_numpy()
    x = np.array(group["embedding"].tolist(), dtype=np.float64)
    x = unit(x)
    quick = x.astype(np.float32)
    own = group["block"].to_numpy()
    across = group["left"].iloc[0] != group["right"].iloc[0]
    here, several = group["code"].iloc[0], group["several"].to_numpy()
    whole = [set() if w is None else set(w) for w in group["whole"]]
    codes = {code: k for k, code in enumerate(sorted(set().union(*whole)))}
    first = codes.get(here) if group["large"].iloc[0] else None
    inside = np.zeros((len(ids), len(codes)), dtype=np.float32)
    for row, names in enumerate(whole):
        inside[row, [codes[name] for name in names]] = 1
    earlier = inside[:, :first]
    # Rows of the earlier node with most of them come first; pairs among these are known.
    covered = 0
    if earlier.shape[1] and not several.any():
        most = int(earlier.sum(axis=0).argmax())
        order = np.argsort(-earlier[:, most], kind="stable")
        covered = int(earlier[:, most].sum())
        group = group.iloc[order]
        ids, x, quick, own, several, inside = (v[order] for v in (ids, x, quick, own, several, inside))
        earlier = inside[:, :first]
    near = np.zeros((len(ids), len(ids)), dtype=bool) if first is not None else None
    found = []
    starts = [*range(0, covered, 512), *range(covered, len(ids), 512)]
    for at, to in zip(starts, [*starts[1:], len(ids)]):
        low = covered if to <= covered else 0
        hit = quick[at:to] @ quick[low:].T >= cosine - 1e-4
        if across:
            hit &= own[at:to, None] != own[low:]
        if earlier.shape[1]:
            hit &= (earlier[at:to] @ earlier[low:].T == 0) | several[at:to, None] | several[low:]
        rows, columns = np.nonzero(hit)
        rows, columns = rows + at, columns + low
        once = ids[rows] < ids[columns]
        rows, columns = rows[once], columns[once]
        exact = [np.empty(0, dtype=bool)]
        for k in range(0, len(rows), 65_536):
            exact.append(np.einsum("ij,ij->i", x[rows[k : k + 65_536]], x[columns[k : k + 65_536]]) >= cosine)
        exact = np.concatenate(exact)
        rows, columns = rows[exact], columns[exact]
        if near is not None:
            listed = several[rows] | several[columns]
            near[rows[~listed], columns[~listed]] = near[columns[~listed], rows[~listed]] = True
            rows, columns = rows[listed], columns[listed]
        found.append(np.stack([ids[rows], ids[columns]], axis=1))
    both = np.concatenate(found)
    pairs = pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "n": 1})
    if near is None or not near.any():
        return pairs
    counts = near @ group["copies"].to_numpy()
    some = np.flatnonzero(counts)
    a, b = forest(near)
    sums = pd.DataFrame({"a": ids[some], "b": pd.Series([None] * len(some), dtype=object), "n": counts[some]})
    joins = pd.DataFrame({"a": ids[a], "b": ids[b], "n": 0})
    return pd.concat([x.astype({"b": object}) for x in (pairs, sums, joins)], ignore_index=True)


def embedding_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    overlap: float = OVERLAP,
    seed: int = 3,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Vectors with equal labels are linked if their cosine, in double precision, is at least
    ``cosine``. Equal vectors of a label are one class and count as linked. Candidates are
    the pairs of classes that share a leaf of one of the trees; every pair is verified.

    The trees are fitted on a bounded sample of ``FIT_ROWS`` vectors at most: random
    directions, split at the medians of the sample, until a label's leaves have about
    ``leaf`` vectors. All vectors go through all trees in one pass; what lies within
    ``overlap`` standard deviations of a split goes to both sides, so a vector has few leaves
    in each of many trees. A dense node, whose sample pairs are mostly linked, is not split.
    Leaves that are larger than ``leaf`` nevertheless are compared whole, in blocks of
    ``leaf``, each pair of blocks in its own group.

    Vectors that are null, empty, zero or hold null or non-finite components, or have a null
    label or id, are linked with nothing. Rows that share an id are one node. Vectors of
    different lengths are never linked. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    stage = stage or Stage(spark)
    names = {id_col: "id", label_col: "label", vector_col: "embedding"}
    rows = vectors.select(*[F.col(given).alias(name) for given, name in names.items()])
    sound = F.expr(
        """id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0
           AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))
           AND exists(embedding, x -> x != 0)"""
    )
    classes = rows.where(sound).groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = stage.read(classes.schema, stage.write(classes, "classes"))

    if classes.isEmpty():
        empty = F.lit(0).cast("long").alias("n_links")
        return rows.select(F.col("id").alias(id_col), empty, F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    leaves = grown(classes, trees, leaf, overlap, cosine, seed, stage)
    leaves = leaves.withColumns({"code": F.concat_ws(":", "tree", "node"), "large": F.col("count") > leaf})
    whole = leaves.where("large").groupBy("id", "label").agg(F.collect_set("code").alias("whole"))
    whole = stage.read(whole.schema, stage.write(whole, "whole"))
    blocks = F.ceil(F.col("count") / (2 * leaf))
    dealt = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    dealt = dealt.select("id", "label", "tree", "node", "code", "large", "block", "left", "right")
    several = classes.groupBy("id").agg(F.sum("copies").alias("copies"), (F.count("*") > 1).alias("several"))
    own = classes.drop("copies").join(several, "id").join(whole, ["id", "label"], "left")
    own = own.selectExpr("id AS _id", "label AS _label", "embedding", "copies", "several", "whole")
    full = dealt.join(own, F.expr("id = _id AND label = _label"))
    full = full.withColumn("width", F.size("embedding"))
    kind = classes.schema["id"].dataType.simpleString()
    group = full.groupBy("label", "tree", "node", "width", "left", "right")
    found = group.applyInPandas(lambda g: close_pairs(g, cosine), f"a {kind}, b {kind}, n long")
    found = stage.read(found.schema, stage.write(found, "found"))
    links = found.where("n = 1 AND b IS NOT NULL").select("a", "b").distinct()
    links = stage.read(links.schema, stage.write(links, "links"))

    joins = links.union(found.where("n = 0").select("a", "b"))
    parts = components(joins, stage).selectExpr("node AS _part", "component")
    copies = classes.groupBy("id").agg(F.sum("copies").alias("copies"))
    others = links.union(links.selectExpr("b AS a", "a AS b")).join(copies, F.col("b") == F.col("id"))
    others = others.select("a", "copies").union(found.where("b IS NULL").select("a", "n"))
    others = others.groupBy("a").agg(F.sum("copies").alias("others"))
    known = classes.join(others, F.col("id") == F.col("a"), "left").join(parts, F.col("id") == F.col("_part"), "left")
    known = known.select(
        F.col("label").alias("_label"),
        F.col("embedding").alias("_embedding"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    known = stage.read(known.schema, stage.write(known, "known"))
    matched = F.expr("id IS NOT NULL AND label = _label AND embedding = _embedding")
    component = F.coalesce("component", "id")
    return rows.join(known, matched, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
