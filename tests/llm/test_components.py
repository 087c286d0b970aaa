import random

from textlab.llm.common import components


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)]  # a chain
    edges += [(0, i) for i in range(1, 50)] + [(7, 7), (None, 3), (3, None)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    edges += edges[:20]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {i: root(i) for i in parent}
    assert len(got) == len(parent)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
