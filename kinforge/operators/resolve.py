"""From accepted pairs to entities: one-to-one, one-to-many, many-to-many and deduplication crosswalks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators.preprocess import indexed
from kinforge.session import drop_stash, stash

#: Links, and weighted pairs, that one task takes on; larger graphs go in rounds of aggregates and joins until so few are left.
EDGES_PER_TASK, PAIRS_PER_TASK = 400_000, 200_000


def accepted(found: DataFrame, level: str) -> DataFrame:
    """Pairs that a level accepts; a flag that isn't known counts as accepted, review takes all."""
    return found if level == "review" else found.where(F.coalesce(F.col(f"match_{level}"), F.lit(True)))


def components(edges: DataFrame, u: str, v: str, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, root): the smallest id (as a string) linked to each id; an id linked only with itself is its own root.

    Up to edges_per_task distinct links are joined by one union-find, in a stream with memory for the ids. More take alternating
    large-star and small-star steps over 64-bit codes that keep the order of the ids (a large star hangs all greater
    neighbours of a node on the least one it knows, a small star hangs the node and its smaller neighbours on it; both are
    aggregates and joins, so a hub's edges are never gathered), until the links stand still."""
    now = edges.select(F.trim(F.col(u).cast("string")).alias("x"), F.trim(F.col(v).cast("string")).alias("y")).where("x is not null and y is not null")
    links = stash(now.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "cc-links")
    if links.count() <= edges_per_task:
        return links.coalesce(1).mapInPandas(_union_find, "node string, root string")
    ids = links.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    coded = stash(indexed(ids, ["node"], "code"), "cc-codes")
    code = lambda c: coded.select(F.col("node").alias(c), F.col("code").alias(f"c{c}"))
    now = stash(links.where("x <> y").join(code("x"), "x").join(code("y"), "y").select(F.col("cx").alias("x"), F.col("cy").alias("y")), "cc")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.shiftrightunsigned(F.xxhash64("x", "y"), 24))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(low.select("x", F.col("m").alias("y")))
        old, now = now, stash(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "cc")
        drop_stash(old)
        after = mark(now)
        if after == before:
            break
        before = after
    rooted = coded.join(now.withColumnRenamed("x", "code"), "code", "left").select("node", F.coalesce("y", "code").alias("code"))
    return rooted.join(coded.withColumnRenamed("node", "root"), "code").select("node", "root")


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(x, y) -> (node, root), root the smallest id of a set."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        path = [x]
        while above[path[-1]] != path[-1]:
            path.append(above[path[-1]])
        for p in path:
            above[p] = path[-1]
        return path[-1]

    for pdf in batches:
        for pair in zip(pdf["x"].tolist(), pdf["y"].tolist()):
            for x in pair:
                above.setdefault(x, x)
            low, high = sorted(map(top, pair))
            above[high] = low
    nodes = list(above)
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pd.DataFrame({"node": some, "root": [top(x) for x in some]})


def numbered(df: DataFrame, root: str = "root") -> DataFrame:
    """ch_id: groups numbered from 0 in the order of their smallest member, without a task that sees all groups."""
    return df.join(indexed(df.select(root).distinct(), [root], "ch_id"), root)


def dedup(found: DataFrame, ids: DataFrame, level: str = "strict", id_col: str = "indv_id") -> DataFrame:
    """(orig_id, ch_id) for every id of ids, matched or not; ids are trimmed on both sides, NULL ids are left out."""
    linked = components(accepted(found, level), "indv_id_a", "indv_id_b")
    every = ids.select(F.trim(F.col(id_col).cast("string")).alias("node")).where("node is not null").distinct()
    roots = every.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return numbered(roots).select(F.col("node").alias("orig_id"), "ch_id")


def many_to_many(found: DataFrame, level: str = "strict") -> DataFrame:
    """(indv_id_a, indv_id_b, ch_id, passnum): distinct pairs with the component of the bipartite graph they lie in."""
    pairs = accepted(found, level).select(F.trim("indv_id_a").alias("indv_id_a"), F.trim("indv_id_b").alias("indv_id_b"), "passnum").distinct()
    marked = pairs.select(F.concat(F.lit("a_"), "indv_id_a").alias("u"), F.concat(F.lit("b_"), "indv_id_b").alias("v"))
    named = numbered(components(marked, "u", "v")).select(F.col("node").alias("_u"), "ch_id")
    return pairs.join(named, F.concat(F.lit("a_"), "indv_id_a") == F.col("_u")).select("indv_id_a", "indv_id_b", "ch_id", "passnum")


def best_unique(found: DataFrame, one: str, level: str = "strict") -> DataFrame:
    """(indv_id_a, indv_id_b, passnum): every many-side id with its heaviest partner; none if two different partners tie.

    one: the side ('a' or 'b') that may repeat. Aggregates only: no window over the rows of an id."""
    many = "b" if one == "a" else "a"
    rows = accepted(found, level).select(F.col(f"indv_id_{many}").alias("many"), F.col(f"indv_id_{one}").alias("one"), "weight", "passnum", "pass_order")
    top = rows.groupBy("many").agg(F.max("weight").alias("top"))
    at_top = rows.join(top, "many").where("weight = top").groupBy("many").agg(F.min("one").alias("lo"), F.max("one").alias("hi"), F.min(F.struct("pass_order", "passnum"))["passnum"].alias("passnum"))
    sure = at_top.where("lo = hi")
    return sure.select(F.col("lo" if one == "a" else "many").alias("indv_id_a"), F.col("many" if one == "a" else "lo").alias("indv_id_b"), "passnum")


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """entry_weights for all pairs in one task, weight by weight."""
    pairs = sorted((-w, a, b) for pdf in batches for a, b, w in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["weight"].tolist()))
    taken: dict[tuple[str, str], float] = {}
    for less, level in groupby(pairs, key=lambda p: p[0]):
        free = [(("a", a), ("b", b)) for _, a, b in level if ("a", a) not in taken and ("b", b) not in taken]
        taken.update((end, -less) for ends in free for end in ends)
    yield pd.DataFrame([(side, x, w) for (side, x), w in taken.items()], columns=["side", "id", "entry"])


def entry_weights(pairs: DataFrame, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """(a, b, weight) without repeats -> (side, id, entry): the weight at which an id is settled, the greatest one of its pairs
    whose other id isn't settled at a greater weight.

    Each round settles the pairs that are the heaviest left for both their ids, all over the graph at once, and drops what is
    lighter at these ids; what is left below pairs_per_task is finished in one task. Only aggregates and joins: neither the
    pairs of an id nor a component are gathered."""
    done = []
    while pairs.count() > pairs_per_task:
        seen = pairs.join(pairs.groupBy("a").agg(F.max("weight").alias("top_a")), "a").join(pairs.groupBy("b").agg(F.max("weight").alias("top_b")), "b")
        seen = stash(seen.withColumn("free", (F.col("weight") == F.col("top_a")) & (F.col("weight") == F.col("top_b"))), "121-round")
        free = seen.where("free")
        done += [free.select(F.lit(s).alias("side"), F.col(s).alias("id"), F.col("weight").alias("entry")).distinct() for s in "ab"]
        left = seen.where("not free")
        for s in "ab":
            left = left.join(free.select(s, F.lit(True).alias(f"_{s}")).distinct(), s, "left").where(f"_{s} is null or weight = top_{s}")
        pairs = stash(left.select("a", "b", "weight"), "121-left")
    done.append(pairs.coalesce(1).mapInPandas(_entries, "side string, id string, entry double"))
    return reduce(DataFrame.unionByName, done).distinct()


def one_to_one(found: DataFrame, level: str = "strict", pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """(indv_id_a, indv_id_b, passnum): the heaviest pairs win, ambiguous ties are removed.

    A pair is free if neither id is settled at a greater weight. It is matched if both ids have no other free pair of this
    weight. A pair of an id that is settled here with an id that was settled at a greater weight makes both ambiguous and
    removes their matches. Of a pair met several times at its weight the first pass counts. Rows without an id on either
    side match nothing. The result doesn't depend on the order of rows."""
    rows = accepted(found, level).where("indv_id_a is not null and indv_id_b is not null and weight is not null")
    first = F.min(F.struct("pass_order", "passnum"))["passnum"].alias("passnum")
    pairs = rows.groupBy(F.col("indv_id_a").alias("a"), F.col("indv_id_b").alias("b"), F.col("weight").cast("double").alias("weight")).agg(first)
    pairs = stash(pairs, "121-pairs")
    entries = stash(entry_weights(pairs.select("a", "b", "weight"), pairs_per_task), "121-entries")
    at = lambda s: entries.where(F.col("side") == s).select(F.col("id").alias(s), F.col("entry").alias(f"at_{s}"))
    known = stash(pairs.join(at("a"), "a").join(at("b"), "b"), "121-known")
    free = known.where("weight = at_a and weight = at_b")
    late = known.where("weight = at_a and weight < at_b or weight = at_b and weight < at_a")
    matched = free.select("a", "b", "passnum")
    for s in "ab":
        alone = free.groupBy(s).agg(F.count("*").alias("n")).where("n = 1").select(s)
        matched = matched.join(alone, s, "left_semi").join(late.select(s), s, "left_anti")
    return matched.select(F.col("a").alias("indv_id_a"), F.col("b").alias("indv_id_b"), "passnum")


def crosswalk(found: DataFrame, match_type: str, level: str, ids: DataFrame | None = None) -> DataFrame:
    """The crosswalk of a match type; ids (all individual ids) is needed for dedup."""
    if match_type == "121":
        return one_to_one(found, level)
    if match_type == "12M":
        return best_unique(found, "a", level)
    if match_type == "M21":
        return best_unique(found, "b", level)
    if match_type == "M2M":
        return many_to_many(found, level)
    if match_type == "dedup":
        return dedup(found, ids, level)
    raise ValueError(f"unknown match type {match_type}")
