"""Walks over the graph: k hops from many seeds, closures, shortest path, beam search.

Walks from few nodes start at the frontier: it is a literal set by which the scan of the edges is filtered at either end, so
a hop is a scan and not a shuffle of all edges. A frontier of more than WIDE nodes is joined instead.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vector import cosine, fault, literal
from ..schema import Graph, live
from ..shared import cut

WIDE = 20_000


def among(column: Column, ids: list[str]) -> Column:
    """Whether a column is one of a driver's ids: a literal set, which reaches the scan as a filter."""
    return column.isin(ids)


def _turned(rows: DataFrame, at: Column) -> DataFrame:
    """(at, to, weight, reasoning, direction): each edge from its ends that `at` (a test of an end's column) lets through."""
    rest = [F.col(c).alias(c) for c in ("weight", "reasoning") if c in rows.columns]
    ends = F.array(*[F.struct(F.col(a).alias("at"), F.col(b).alias("to"), *rest, F.lit(d).alias("direction")) for a, b, d in (("parent_id", "child_id", "outgoing"), ("child_id", "parent_id", "incoming"))])
    return rows.select(F.explode(ends).alias("s")).select("s.*").where(at & F.col("to").isNotNull())


def steps_from(edges: DataFrame, ids: list[str]) -> DataFrame:
    """The steps from a driver's list of nodes: one scan of the edges, no join."""
    return _turned(edges.where(among(F.col("parent_id"), ids) | among(F.col("child_id"), ids)), among(F.col("at"), ids))


def steps(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """The same from a frontier (id) of any size, by two semi-joins."""
    ends = [edges.join(frontier, F.col(c) == F.col("id"), "left_semi") for c in ("parent_id", "child_id")]
    rest = [c for c in ("weight", "reasoning") if c in edges.columns]
    out = ends[0].select(F.col("parent_id").alias("at"), F.col("child_id").alias("to"), *rest, F.lit("outgoing").alias("direction"))
    return out.union(ends[1].select("child_id", "parent_id", *rest, F.lit("incoming"))).where("to is not null")


def khop(graph: Graph, seeds: DataFrame, depth: int, wide: int = WIDE) -> DataFrame:
    """(id, hops): least number of hops from any seed over live edges, either way; seeds must be live."""
    start = [r["id"] for r in live(graph.nodes).select("id").join(seeds.select("id").distinct(), "id", "left_semi").limit(wide + 1).collect()]
    if len(start) > wide:
        return _khop_wide(graph, live(graph.nodes).select("id").join(seeds.select("id").distinct(), "id", "left_semi"), [], depth)
    return khop_from(graph, start, depth, wide)


def khop_from(graph: Graph, here: list[str], depth: int, wide: int = WIDE) -> DataFrame:
    """The same from a driver's list of live nodes. A hop is a scan of the edges and one of the nodes' ids."""
    spark, nodes = graph.nodes.sparkSession, live(graph.nodes).select("id")
    found, met = [(i, 0) for i in here], set(here)
    for hop in range(1, depth + 1):
        if not here:
            break
        reached = steps_from(graph.edges.select("parent_id", "child_id"), here).select("to").distinct().limit(wide + len(met) + 1).collect()
        near = [r["to"] for r in reached if r["to"] not in met]
        if len(near) > wide:
            return _khop_wide(graph, spark.createDataFrame([(i,) for i in here], "id string"), found, depth, hop)
        here = [r["id"] for r in nodes.where(among(F.col("id"), near)).collect()] if near else []
        found += [(i, hop) for i in here]
        met |= set(here)
    return spark.createDataFrame(found, "id string, hops int")


def _khop_wide(graph: Graph, frontier: DataFrame, found: list, depth: int, hop: int = 1) -> DataFrame:
    """The walk from a frontier of any size, by shuffles."""
    alive = live(graph.nodes).select("id")
    frontier = cut(frontier.withColumn("hops", F.lit(hop - 1)))
    seen = graph.nodes.sparkSession.createDataFrame(found, "id string, hops int") if found else frontier
    for n in range(hop, depth + 1):
        reached = steps(graph.edges, frontier.select("id")).select(F.col("to").alias("id")).distinct().join(alive, "id", "left_semi")
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(n)))
        seen = cut(seen.unionByName(frontier))
    return seen


def ancestors(edges: DataFrame, most: int | None = 50, nodes: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, hops): every proper or cyclic ancestor with its least distance.

    A frontier loop; a pair that is known is not followed again, so cycles end. Without `most` it goes on to the end.
    """
    up = cut(edges.where("parent_id is not null and child_id is not null").select("child_id", "parent_id").distinct())
    start = up if nodes is None else up.join(nodes.select(F.col("id").alias("child_id")), "child_id", "left_semi")
    frontier = cut(start.select(F.col("child_id").alias("id"), F.col("parent_id").alias("ancestor"), F.lit(1).alias("hops")))
    seen = frontier
    for hop in count(2) if most is None else range(2, most + 1):
        further = frontier.join(up, F.col("ancestor") == F.col("child_id")).select("id", F.col("parent_id").alias("ancestor")).distinct()
        frontier = cut(further.join(seen, ["id", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.take(1):
            break
        seen = cut(seen.unionByName(frontier)) if hop % 4 == 0 else seen.unionByName(frontier)
    return seen


def _layers(graph: Graph, a: str, b: str, most: int | None) -> list[DataFrame]:
    """(to, at, weight, reasoning, direction) of each layer of nodes around a, until b is in one; [] if it never is. Each node
    has the neighbour of the smallest id in the layer before and the heaviest edge to it.
    """
    spark = graph.nodes.sparkSession
    layers: list[DataFrame] = []
    frontier = known = spark.createDataFrame([(a,)], "id string")
    for _ in count() if most is None else range(most):
        first = F.struct("at", (-F.coalesce("weight", F.lit(0.0))).alias("order"), "direction", "weight", "reasoning")
        step = steps(graph.edges, frontier).groupBy("to").agg(F.min(first).alias("m")).select("to", "m.at", "m.weight", "m.reasoning", "m.direction")
        layers.append(cut(step.join(known, F.col("to") == F.col("id"), "left_anti")))
        if layers[-1].where(F.col("to") == b).take(1):
            return layers
        frontier = layers[-1].select(F.col("to").alias("id"))
        if not frontier.take(1):
            break
        known = cut(known.unionByName(frontier))
    return []


def distance(graph: Graph, a: str, b: str, most: int | None = None) -> DataFrame:
    """(hops): the shortest undirected path between two nodes, decayed ones included; no row if there is none (or none of up to `most` hops)."""
    spark = graph.nodes.sparkSession
    hops = 0 if a == b else len(_layers(graph, a, b, most)) or None
    return spark.createDataFrame([] if hops is None else [(hops,)], "hops int")


def how(graph: Graph, a: str, b: str, most: int | None = None) -> DataFrame:
    """(distance, id, content, node_type, weight, reasoning, direction): the nodes of a shortest path from a to b, each with the
    edge that leads to it; of several paths the one whose nodes, from the end, have the smallest ids. Empty if there is none.
    """
    spark = graph.nodes.sparkSession
    layers = [] if a == b else _layers(graph, a, b, most)
    path, at = [], b
    for d in range(len(layers), 0, -1):
        r = layers[d - 1].where(F.col("to") == at).first()
        path.append((d, at, r["weight"], r["reasoning"], r["direction"]))
        at = r["at"]
    if layers or a == b:
        path.append((0, a, None, None, None))
    rows = spark.createDataFrame(path, "distance int, id string, weight double, reasoning string, direction string")
    named = graph.nodes.select("id", "content", "node_type")
    return F.broadcast(rows).join(named, "id").select("distance", "id", "content", "node_type", "weight", "reasoning", "direction").orderBy("distance")


def beam_events(graph: Graph, query: list[float], seeds: list[tuple[str, float]], picks: int = 3, hops: int = 3, wide: int = WIDE):
    """Yields (level, id, sim, from) as nodes are taken: seeds at level 0, then each frontier node's best new neighbours.

    Frontier nodes choose in order, so a neighbour taken by one is gone for the next. The frontier's neighbours come to the driver
    with their cosines, up to `wide` of them; beyond, they are ranked where they are. A node without a sound vector has similarity 0. Ties go to the smaller id.
    """
    spark = graph.nodes.sparkSession
    taken = dict(seeds)
    frontier = [i for i, _ in seeds]
    for i, s in seeds:
        yield 0, i, s, None
    sound = fault("vector", len(query)).isNull()
    vectors = graph.emb.select("node_id", F.when(sound, cosine(F.col("vector"), literal(query))).alias("cos"))
    edges = graph.edges.select("parent_id", "child_id")
    for level in range(1, hops + 1):
        if not frontier:
            return
        pairs = steps_from(edges, frontier).select("at", "to").where(~among(F.col("to"), list(taken))).distinct()
        few = pairs.limit(wide + 1).collect()
        if len(few) <= wide:
            near: dict[str, list[str]] = {}
            for r in few:
                near.setdefault(r["at"], []).append(r["to"])
            asked = sorted({r["to"] for r in few})
            cos = {r["node_id"]: r["cos"] for r in vectors.where(among(F.col("node_id"), asked)).collect() if r["cos"] is not None} if asked else {}
            ranked = {at: sorted(((cos.get(i, 0.0), i) for i in some), key=lambda x: (-x[0], x[1])) for at, some in near.items()}
        else:
            ranked = _ranked_wide(pairs, vectors, frontier, picks)
        chosen: list[str] = []
        for name in frontier:
            for sim, i in [x for x in ranked.get(name, []) if x[1] not in taken][:picks]:
                taken[i] = sim
                chosen.append(i)
                yield level, i, sim, name
        frontier = chosen


def _ranked_wide(pairs: DataFrame, vectors: DataFrame, frontier: list[str], picks: int) -> dict[str, list[tuple[float, str]]]:
    """The neighbours of each frontier node that can be chosen, best first, where there are too many to rank on the driver: of the node at
    a place only the first picks * (place + 1), so at most picks ** 2 * frontier ** 2 rows come to the driver.
    """
    place = F.broadcast(pairs.sparkSession.createDataFrame([(i, p) for p, i in enumerate(frontier)], "at string, place int"))
    near = pairs.join(vectors, F.col("to") == F.col("node_id"), "left").join(place, "at").select("at", "place", "to", F.coalesce("cos", F.lit(0.0)).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("sim"), "to"))
    out: dict[str, list[tuple[float, str]]] = {}
    for r in near.withColumn("rank", rank).where(F.col("rank") <= picks * (F.col("place") + 1)).orderBy("at", "rank").collect():
        out.setdefault(r["at"], []).append((r["sim"], r["to"]))
    return out
