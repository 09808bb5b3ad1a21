"""Scores on a limit are the same in every order of rows."""

import math
import random

import pytest

from lintlake.operators import findings


@pytest.mark.parametrize("seed", range(3))
def test_scores_on_the_limit(spark, seed):
    per_repo = {"a": [6, 8, 9, 10, 12], "b": [6, 8, 10, 14, 17], "c": [30, 30, 30, 30], "d": [13, 15, 16, 17, 19], "e": [6, 10, 12, 14, 18], "f": [40, 1, 2, 3]}
    rows = [(r, f"f{i}") for r, x in per_repo.items() for i, n in enumerate(x) for _ in range(n)]
    random.Random(seed).shuffle(rows)
    got = {(r.repo, r.file): (r.z_score, r.status) for r in findings.volume_anomalies(spark.createDataFrame(rows, "repo string, file string"), 1).collect()}
    for repo, x in per_repo.items():
        n, mean = len(x), sum(x) / len(x)
        dev = math.sqrt(n * sum(v * v for v in x) - sum(x) ** 2) / n
        for i, v in enumerate(x):
            z = (v - mean) / dev if dev else 0.0
            status = "anomaly" if v > max(mean + dev, 20) else "elevated" if z > 1.5 else "normal"
            assert got[repo, f"f{i}"] == (math.floor(z * 100 + 0.5) / 100, status)
