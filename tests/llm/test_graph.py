"""Connected components in one task and by rounds."""

import random

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm._graph import connected_components, forest


def test_few_edges_take_one_task_and_agree_with_rounds(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(9, 9), (50, 3)]
    edges = spark.createDataFrame(pairs, "u int, v int").select(*[F.unhex(F.md5(F.col(c).cast("string"))).alias(c) for c in "uv"])
    once = connected_components(edges)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, connected_components(edges, small=0).collect()))
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString() and once.filter("node = root").count() > 1
    assert connected_components(edges.limit(0)).count() == 0


def test_a_forest_loses_no_link():
    """Every group of pairs has one root, its least index, whatever the order in which its parts meet."""
    rng = random.Random(7)
    for n, m in ((30, 40), (400, 380), (400, 900)) * 20:
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        want = list(range(n))
        for _ in range(n):
            before = want[:]
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
            if before == want:
                break
        i, j = np.array(pairs).T
        assert forest(n, i, j).tolist() == want
