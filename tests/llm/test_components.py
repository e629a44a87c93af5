import random

from oddsmill.llm.components import connected_components


def brute(edges):
    name = {}
    for a, b in edges:
        for x in (a, b):
            name.setdefault(x, x)
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    return name


def test_chains_stars_loops_and_nulls(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300 + rnd.randrange(30), 300 + rnd.randrange(30)) for _ in range(40)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3), (7, None), (999, 999)], "a bigint, b bigint")
    clean = [(a, b) for a, b in edges if a != b]
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(clean)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
