"""Groups of records linked directly or through others: connected components on a two-dimensional grid.

Vertices are hashed into blocks; the edge (u, v) belongs to the cell (block of u, block of v), so even the edges of one
hub spread over a whole row of cells. Every partition runs union-find over the cells it holds, in a stream of Arrow
batches with memory for its vertices only, and sends (vertex, local representative). Representatives are chosen by a
hash that changes each round, so a chain with rising ids shrinks as fast as any other. The representatives a vertex gets from its row and
its column are exchanged: the least becomes its parent, the others are linked to it, and these links are the edges of
the next, smaller graph. When no edge is left every tree is resolved from the top down. Only aggregates, joins and written
tables are used, and the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.session import stash

#: Edges that one partition takes on; a graph of fewer edges is finished by one union-find.
EDGES_PER_CELL = 400_000


def _local_union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v, hu, hv) -> (vertex, root): the root of a local set has the least hash in it."""
    parent: dict = {}
    order: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for u, v, hu, hv in zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["hu"].tolist(), pdf["hv"].tolist()):
            if u not in parent:
                parent[u], order[u] = u, (hu, u)
            if v not in parent:
                parent[v], order[v] = v, (hv, v)
            a, b = find(u), find(v)
            if a != b:
                if order[b] < order[a]:
                    a, b = b, a
                parent[b] = a
    names = list(parent)
    for i in range(0, len(names), 50_000):
        some = names[i : i + 50_000]
        yield pd.DataFrame({"vertex": some, "root": [find(x) for x in some]})


def components(edges: DataFrame, u: str, v: str, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """(group_id, member): each id of an edge with two different, non-missing ids, with the smallest id (as a string) linked
    to it directly or through others. NULL and '' are missing. Repeated and turned pairs count once; rows of one id
    with itself or without a second id are no links."""
    at = lambda c: F.col(c).cast("string")
    graph = edges.select(at(u).alias("u"), at(v).alias("v")).where("u <> '' and v <> '' and u <> v")
    graph = graph.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    graph, levels, seed = stash(graph, "p5-edges"), [], 0
    while (n := graph.count()) > 0:
        seed += 1
        cells = max(1, -(-n // edges_per_cell))
        side = max(1, round((4 * cells) ** 0.5)) if cells > 1 else 1
        hashed = graph.withColumns({"hu": F.xxhash64(F.lit(seed), "u"), "hv": F.xxhash64(F.lit(seed), "v")})
        grid = hashed.repartition(side * side if cells > 1 else 1, F.pmod("hu", F.lit(side)), F.pmod("hv", F.lit(side)))
        local = stash(grid.mapInPandas(_local_union_find, "vertex string, root string"), "p5-local")
        rank = F.struct(F.xxhash64(F.lit(seed), "root").alias("h"), F.col("root").alias("id"))
        best = local.groupBy("vertex").agg(F.min(rank)["id"].alias("parent"), F.count("*").alias("k"))
        best = stash(best, "p5-parents")
        levels.append(best.where("vertex <> parent").select("vertex", "parent"))
        if cells == 1:
            break
        linked = local.join(best.where("k > 1"), "vertex").where("root <> parent").select(F.least("root", "parent").alias("u"), F.greatest("root", "parent").alias("v"))
        graph = stash(linked.distinct(), "p5-edges")
    if not levels:
        return graph.select(F.col("u").alias("group_id"), F.col("v").alias("member"))
    # from the top down: a vertex takes the root of its parent, or the parent itself where that has none
    root = levels[-1].select("vertex", F.col("parent").alias("root"))
    for level in reversed(levels[:-1]):
        up = root.select(F.col("vertex").alias("parent"), "root")
        low = level.join(up, "parent", "left").select("vertex", F.coalesce("root", "parent").alias("root"))
        root = stash(low.unionByName(root.join(level.select("vertex"), "vertex", "left_anti")), "p5-roots")
    # a vertex that hung on another in an early round may have become the root of all in a later one
    root = root.where("vertex <> root")
    least = root.groupBy("root").agg(F.min("vertex").alias("least")).withColumn("group_id", F.least("least", "root")).drop("least")
    least = stash(least, "p5-least")
    return root.join(least, "root").select("group_id", F.col("vertex").alias("member")).unionByName(least.select("group_id", F.col("root").alias("member")))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/candidates.parquet"), "indv_id_a", "indv_id_b").select("group_id", F.col("member").alias("indv_id"))


def p5_group_sizes(spark, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    return p5_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))
