"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.lookup import lookup_join
from ..sources.staging import Stage

ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour or itself."""
    both = edges.union(edges.selectExpr("b AS a", "a AS b"))
    joined = lookup_join(both, both, {"a": "a"}, {"low": "min(b)"}, "inner")
    return joined.where("b > a").selectExpr("b AS a", "least(a, low) AS b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a > b")
    joined = lookup_join(down, down, {"a": "a"}, {"low": "min(b)"}, "inner")
    return joined.selectExpr("IF(b = low, a, b) AS a", "low AS b")


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """Rows (node, component) for every node of ``edges(a, b)``: the smallest node reachable.

    Each round is written to the stage, which cuts the lineage; it ends when a round changes
    nothing. Neighbours are never gathered: a node sees only their minimum, which is
    combined before the shuffle and joined back by a join that splits hot nodes, so a node
    of any degree does.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    edges = edges.distinct()
    edges = stage.read(edges.schema, stage.write(edges, "edges"))
    summary = edges.selectExpr("count(*)", "bit_xor(xxhash64(a, b))").first()
    for _ in range(ROUNDS):
        if summary[0] == 0:
            break
        step = _small_star(_large_star(edges).distinct()).distinct()
        edges = stage.read(edges.schema, stage.write(step, "edges"))
        before, summary = summary, edges.selectExpr("count(*)", "bit_xor(xxhash64(a, b))").first()
        if before == summary:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    nodes = edges.selectExpr("a AS node", "b AS component")
    return nodes.union(edges.selectExpr("b AS node", "b AS component").distinct())
