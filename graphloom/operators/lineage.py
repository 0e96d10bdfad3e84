"""Lineage and audit: why, roots, contradictions, weak chains, depth, cycles, parent chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import is_contradiction
from ..schema import Graph
from ..shared import cut
from .stats import endpoints
from .walk import ancestors


STEPS = 2  # of an iteration between two lineage cuts


def roots(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").join(graph.edges.select(F.col("child_id").alias("id")), "id", "left_anti")


def why(graph: Graph, node: str) -> DataFrame:
    """(ancestor, hops, is_root) of a node."""
    only = graph.nodes.where(F.col("id") == node)
    parents = graph.edges.select(F.col("child_id").alias("c")).distinct()
    found = ancestors(graph.edges, nodes=only).where(F.col("ancestor") != node)
    return found.join(parents, F.col("ancestor") == F.col("c"), "left").select("ancestor", "hops", F.col("c").isNull().alias("is_root"))


def why_tree(graph: Graph, node: str, most: int = 50) -> dict:
    """The nested chain, heaviest parents first; a node met before is marked, as is one below the depth limit.

    Only the edges above the node come to the driver: the size of its answer.
    """
    above = ancestors(graph.edges, nodes=graph.nodes.where(F.col("id") == node)).select(F.col("ancestor").alias("child_id")).union(graph.nodes.sparkSession.createDataFrame([(node,)], "c string")).distinct()
    up: dict[str, list] = {}
    for r in graph.edges.join(above, "child_id", "left_semi").orderBy(F.desc("weight"), "parent_id").collect():
        up.setdefault(r["child_id"], []).append((r["parent_id"], r["weight"], r["reasoning"]))
    met: set[str] = set()

    def tree(i: str, depth: int) -> dict:
        if i in met:
            return {"id": i, "cycle_detected": True}
        if depth > most:
            return {"id": i, "max_depth": True}
        met.add(i)
        return {"id": i, "depth": depth, "parents": [{"weight": w, "reasoning": r, "node": tree(p, depth + 1)} for p, w, r in up.get(i, [])]}

    return tree(node, 0)


def contradictions(graph: Graph) -> DataFrame:
    return graph.edges.where(is_contradiction()).select("parent_id", "child_id", "weight")


def audit_orphans(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").join(endpoints(graph.edges), "id", "left_anti")


def weak_chains(graph: Graph, below: float = 0.5) -> DataFrame:
    """(id, mean_weight): mean weight of the edges into a node and into all its ancestors, where it is low.

    Weights are added as decimals of 18 places, so the mean doesn't hang on the order in which rows arrive: one of exactly `below` is not low, and
    a half at the seventh place is rounded up. Only where a weight is no such decimal (NaN, infinite, 10^12 or more) doubles are added.
    """
    above = ancestors(graph.edges, None).select("id", F.col("ancestor").alias("child_id"))
    exact = F.when(F.abs("weight") < 1e12, F.col("weight")).try_cast("decimal(38,18)")
    parts = [F.sum("weight").alias("w"), F.sum(exact).alias("x"), (F.count("weight") - F.count(exact)).alias("odd"), F.count("weight").alias("n")]
    into = graph.edges.groupBy("child_id").agg(*parts)
    every = above.where("id <> child_id").union(graph.edges.select(F.col("child_id").alias("id"), "child_id").distinct())
    mean = every.join(into, "child_id").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("w", "x", "odd", "n")]).where("n > 0")
    low = F.when(F.col("odd") == 0, F.col("x") < F.col("n") * F.lit(str(below)).cast("decimal(18,17)")).otherwise(F.col("w") / F.col("n") < below)
    rounded = F.when(F.col("odd") == 0, F.round(F.col("x") / F.col("n"), 6).cast("double")).otherwise(F.round(F.col("w") / F.col("n"), 6))
    return mean.where(low).select("id", rounded.alias("mean_weight"))


def depth(graph: Graph, most: int = 20) -> DataFrame:
    """(id, depth): longest chain of parents, up to `most`; cycles end at the limit."""
    level = cut(roots(graph).withColumn("depth", F.lit(0)))
    best = level
    for d in range(1, most + 1):
        level = cut(level.join(graph.edges, F.col("id") == F.col("parent_id")).select(F.col("child_id").alias("id"), F.lit(d).alias("depth")).distinct())
        if not level.take(1):
            break
        best = best.unionByName(level)
    return best.groupBy("id").agg(F.max("depth").alias("depth"))


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without a parent or without a child have gone, as long as there are any."""
    edges, n = cut(edges.where("parent_id is not null and child_id is not null").select("parent_id", "child_id").distinct()), -1
    while n != (n := edges.count()):
        for _ in range(STEPS if n else 0):
            kept = edges.join(edges.select(F.col("child_id").alias("x")).distinct(), F.col("parent_id") == F.col("x"), "left_semi")
            edges = kept.join(kept.select(F.col("parent_id").alias("y")).distinct(), F.col("child_id") == F.col("y"), "left_semi")
        edges = cut(edges)
    return edges


def strong_components(graph: Graph) -> DataFrame:
    """(id, c): the nodes of strongly connected components of two or more nodes, each with the greatest id of its own.

    What trimming leaves is coloured: the largest id spreads along the edges, and a node that keeps its own colour leads a
    component, which is what reaches it within its colour. These go, and the rest is trimmed and coloured again. Rounds follow
    distances; nothing grows with the square of the nodes.
    """
    found = graph.nodes.sparkSession.createDataFrame([], "id string, c string")
    edges = trimmed(graph.edges.where("parent_id <> child_id"))
    while edges.take(1):
        colour = cut(endpoints(edges).distinct().withColumn("c", F.col("id")))
        while True:
            spread = colour
            for _ in range(STEPS):
                above = edges.join(spread, F.col("parent_id") == F.col("id")).groupBy("child_id").agg(F.max("c").alias("up"))
                spread = spread.join(above, F.col("id") == F.col("child_id"), "left").select("id", F.greatest("c", "up").alias("c"))
            spread = cut(spread)
            moved = spread.join(colour, ["id", "c"], "left_anti").take(1)
            colour = spread
            if not moved:
                break
        inside = cut(edges.join(colour.toDF("parent_id", "cp"), "parent_id").join(colour.toDF("child_id", "cc"), "child_id").where("cp = cc").select("parent_id", "child_id", F.col("cp").alias("c")))
        frontier = reached = cut(colour.where("id = c").select("id", "c"))
        while True:
            back = frontier
            for _ in range(STEPS):
                back = back.unionByName(inside.join(back.toDF("child_id", "c"), ["child_id", "c"]).select(F.col("parent_id").alias("id"), "c")).distinct()
            frontier = cut(back.join(reached, ["id", "c"], "left_anti"))
            if not frontier.take(1):
                break
            reached = cut(reached.unionByName(frontier))
        several = cut(reached.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"))
        found = found.unionByName(reached.join(several, "c").select("id", "c"))
        done = reached.select("id")
        rest = edges.join(done.toDF("parent_id"), "parent_id", "left_anti").join(done.toDF("child_id"), "child_id", "left_anti")
        edges = trimmed(rest)
    return found


def cyclic(graph: Graph) -> DataFrame:
    """Nodes on a cycle: those of strongly connected components of two or more nodes, and those with an edge to themselves."""
    loops = graph.edges.where("parent_id = child_id").select(F.col("parent_id").alias("id"))
    return loops.unionByName(strong_components(graph).select("id")).distinct()


def cycle_lists(graph: Graph) -> DataFrame:
    """(cycle, length): cycles as lists of ids, first and last the same; at least one for each strongly connected component, and one for
    each edge to itself.

    From the leader of each component a breadth-first tree grows by frontier joins; a node hangs on the smallest id of the layer before. Every
    edge that leads back to a node above it in the tree closes a cycle, which is read back up the tree, all at once, one step a
    round. Nothing comes to the driver; a round follows a step of the tree.
    """
    own = cut(strong_components(graph))
    edges = graph.edges.where("parent_id <> child_id").select("parent_id", "child_id").distinct()
    inside = edges.join(own.toDF("parent_id", "c"), "parent_id").join(own.toDF("child_id", "cc"), "child_id").where("c = cc").select("parent_id", "child_id", "c")
    inside = cut(inside)
    frontier = tree = cut(own.where("id = c").select("id", F.lit(None).cast("string").alias("up"), "c"))
    while True:
        for _ in range(STEPS):
            near = inside.join(frontier.select(F.col("id").alias("parent_id")), "parent_id").groupBy(F.col("child_id").alias("id"), "c").agg(F.min("parent_id").alias("up"))
            frontier = near.join(tree.select("id"), "id", "left_anti").select("id", "up", "c")
            tree = tree.unionByName(frontier)
        frontier = cut(frontier)
        if not frontier.take(1):
            break
        tree = cut(tree)
    tree = cut(tree)
    up = tree.select(F.col("id").alias("at"), "up")
    back = cut(inside.select(F.col("child_id").alias("to"), F.col("parent_id").alias("at"), F.array("parent_id", "child_id").alias("cycle")))
    done = None
    while back.take(1):
        for _ in range(STEPS):
            arrived = back.where("at = to")
            done = arrived if done is None else done.unionByName(arrived)
            above = back.where("at <> to").join(up, "at").where("up is not null")  # what comes to the root without its end closes nothing
            back = above.select("to", F.col("up").alias("at"), F.concat(F.array("up"), "cycle").alias("cycle"))
        back, done = cut(back), cut(done)
    loops = graph.edges.where("parent_id = child_id").select(F.array("parent_id", "child_id").alias("cycle")).distinct()
    every = loops if done is None else done.select("cycle").unionByName(loops)
    return every.select("cycle", (F.size("cycle") - 1).alias("length"))


def parent_chain(graph: Graph, steps: int = 3) -> DataFrame:
    """(id, step, ancestor): the chain of heaviest parents of each node."""
    order = Window.partitionBy("child_id").orderBy(F.desc("weight"), "parent_id")
    first = cut(graph.edges.withColumn("r", F.row_number().over(order)).where("r = 1").select("child_id", "parent_id"))
    out = level = first.select(F.col("child_id").alias("id"), F.lit(1).alias("step"), F.col("parent_id").alias("ancestor"))
    for step in range(2, steps + 1):
        level = level.join(first, F.col("ancestor") == F.col("child_id")).select("id", F.lit(step).alias("step"), F.col("parent_id").alias("ancestor"))
        out = out.unionByName(level)
    return out
