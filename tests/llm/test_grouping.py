import random

import pytest

from kinforge.llm.grouping import components


@pytest.mark.parametrize("per_cell", [5, 400_000])
def test_components_against_union_find(spark, per_cell):
    rng = random.Random(2)
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(80)] + [("hub", f"h{i}") for i in range(40)]
    edges += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)] + [("x", None), ("", "y"), ("z", "z")]
    edges += [(b, a) for a, b in edges[:10]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = [(r["group_id"], r["member"]) for r in components(spark.createDataFrame(edges, "u string, v string"), "u", "v", per_cell).collect()]
    assert len(got) == len(set(got)) and set(got) == {(find(x), x) for x in list(parent)}


def test_no_links(spark):
    assert components(spark.createDataFrame([("a", "a"), (None, "b")], "u string, v string"), "u", "v").count() == 0
