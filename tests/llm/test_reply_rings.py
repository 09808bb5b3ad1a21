"""Messages that answer each other in rings, and what hangs below them."""

import pytest

from lintlake.llm import chat

SCHEMA = "tree long, id long, parent long, role string, text string, score double"


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7])
def test_rings_have_no_paths(spark, size):
    ring = [(1, 100 + k, 100 + (k + 1) % size, "user", f"r{k}", 0.0) for k in range(size)]
    below = [(1, 200, 100, "user", "below", 9.0), (1, 201, 200, "user", "leaf", 9.0), (1, 202, 200, "user", "other", 9.0)]
    sound = [(1, 1, None, "user", "root", 0.0)] + [(1, k, k - 1, "assistant", f"m{k}", 0.0) for k in range(2, 9)] + [(1, 50, 3, "user", "branch", 1.0)]
    only_ring = [(2, 100 + k, 100 + (k + 1) % size, "user", "x", 0.0) for k in range(size)]
    df = spark.createDataFrame(ring + below + sound + only_ring, SCHEMA)
    walked = {(r.tree, r.leaf): set() for r in chat.paths(df).collect()}
    for r in chat.paths(df).collect():
        walked[(r.tree, r.leaf)].add((r.up, r.id))
    assert walked == {(1, 8): {(k, 8 - k) for k in range(8)}, (1, 50): {(0, 50), (1, 3), (2, 2), (3, 1)}}
    assert {(r.tree, r.leaf) for r in chat.conversations(df, most=9).collect()} == {(1, 8), (1, 50)}
