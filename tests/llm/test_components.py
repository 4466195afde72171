"""Components by alternating stars, against search."""

import numpy as np

from halocline.llm import ngram_join


def searched(edges):
    root = {}
    find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def test_components(spark):
    rng = np.random.default_rng(4)
    graphs = [[], [(1, 2)], [(5, 1), (5, 2), (5, 3)], [(k, k + 1) for k in range(40)], [(k, 100) for k in range(60)] + [(100, 200), (200, 300)]]
    graphs.append([tuple(map(int, rng.integers(0, 80, 2))) for _ in range(70)])
    for edges in graphs:
        edges = [(a, b) for a, b in edges if a != b]
        df = spark.createDataFrame(edges + edges[:3], "a bigint, b bigint")
        got = ngram_join.components(df).collect()
        assert {r.key: r.component for r in got} == searched(edges) and len(got) == len(searched(edges))
