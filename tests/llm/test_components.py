"""Connected components against a plain search."""

import random

import numpy as np

from viewspan.llm.common import Groups, connected_components


def brute(edges):
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            comp[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(comp))


def test_components(spark):
    r = random.Random(4)
    chain = [(k, k + 1) for k in range(-40, 60)]
    hub = [(1000, 1000 + k) for k in range(1, 400)]
    loose = [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)]
    edges = chain + hub + loose + chain[:5] + [(7, 7), (None, 3), (-(2**62), 2**62)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(tuple(x) for x in connected_components(df.repartition(9)).collect()) == brute(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_groups():
    g = Groups(np.array([5, 3, 9, 3, 7]))
    g.join(np.array([0, 2]), np.array([1, 4]))
    low, other = g.stars()
    assert sorted(zip(low.tolist(), other.tolist())) == [(3, 5), (7, 9)]
