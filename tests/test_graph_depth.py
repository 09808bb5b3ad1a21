"""A graph deeper than the rounds is an error, not a shorter answer."""

import pytest

from lintlake.operators import graph


def test_deeper_than_the_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    licenses = spark.createDataFrame([(6, "GPL-3.0-only", True)], "package long, license string, copyleft boolean")
    roots = spark.createDataFrame([(0,)], "module long")
    with pytest.raises(RuntimeError):
        graph.transitive_exposure(chain, licenses, roots, rounds=3)
    assert [tuple(x) for x in graph.transitive_exposure(chain, licenses, roots).collect()] == [(0, 6, 6, "GPL-3.0-only", [0, 1, 2, 3, 4, 5, 6])]
    tasks = chain.selectExpr("src AS task", "dst AS depends_on")
    with pytest.raises(RuntimeError):
        graph.waves(tasks, rounds=3)
    assert {x.task: x.wave for x in graph.waves(tasks, rounds=7).collect()} == {6 - k: k for k in range(7)}


def test_routes_take_the_smallest_shortest_way(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 9), (3, 9), (9, 10), (0, 1), (7, 10), (0, 5), (5, 6), (6, 8), (8, 10)], "src long, dst long")
    got = {r.module: (r.distance, r.route) for r in graph.reach(edges, spark.createDataFrame([(10,)], "module long")).collect()}
    assert got[0] == (4, [0, 1, 2, 9, 10]) and got[10] == (0, [10]) and got[7] == (1, [7, 10]) and got[5] == (3, [5, 6, 8, 10]) and got[3] == (2, [3, 9, 10])


def test_components_of_any_size(spark):
    """Against mutual reachability, on random graphs with a long ring, a chain into it and a chain out of it."""
    import random

    r = random.Random(4)
    ring = [(k, (k + 1) % 9) for k in range(9)]
    chains = [(100 + k, 101 + k) for k in range(5)] + [(105, 0), (8, 200)] + [(200 + k, 201 + k) for k in range(5)]
    loose = [(300 + r.randrange(60), 300 + r.randrange(60)) for _ in range(90)]
    edges = ring + chains + loose
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for e in edges for x in e}
    far = {n: reached(n) for n in nodes}
    want = {}
    for n in nodes:
        group = {m for m in far[n] if n in far[m]} | {n}
        if len(group) > 1:
            want[n] = max(group)
    got = {x.module: x.component for x in graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want and len([n for n in got if got[n] == 8]) == 9


def test_circular_imports(spark):
    files = spark.createDataFrame([("r", f"src/{c}.ts") for c in "abcdefg"] + [("q", "src/a.ts")], "repo string, path string")
    pairs = [("a", "./b"), ("b", "./c.ts"), ("c", "../src/d"), ("d", "./e"), ("e", "./a"), ("f", "./a"), ("g", "./g")]
    imports = spark.createDataFrame([("r", f"src/{a}.ts", b) for a, b in pairs] + [("q", "src/a.ts", "./b")], "repo string, path string, specifier string")
    got = {(x.repo, x.path): (x.component, x.size) for x in graph.circular_imports(imports, files).collect()}
    assert got == {("r", f"src/{c}.ts"): ("src/e.ts", 5) for c in "abcde"} | {("r", "src/g.ts"): ("src/g.ts", 1)}


def broadcasts(spark, run) -> int:
    """How many broadcasts the plans that run() starts have, and a check that it started some."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    plans = [store.executionsList(i, 1).head().physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert plans
    return sum(p.count("BroadcastExchange") for p in plans)


def test_components_send_nothing_to_the_driver(spark):
    """Rounds hand their frontiers from task to task: what the driver sends does not grow with the graph or its depth."""
    edges = spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(7, 8), (8, 7), (8, 3), (1, 6)], "src long, dst long")
    got = []
    assert broadcasts(spark, lambda: got.extend(graph.strong_components(edges).collect())) == 0
    assert {r.module: r.component for r in got} == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 7: 8, 8: 8}


def test_cycles_send_nothing_to_the_driver(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(7, 8), (8, 7), (8, 3), (3, 1), (9, 9)], "src long, dst long")
    got = []
    assert broadcasts(spark, lambda: got.extend(graph.cycles(edges).collect())) == 0
    assert sorted(r.nodes for r in got) == [[1, 2, 3], [7, 8], [9]]


def test_components_of_a_graph_without_cycles(spark):
    assert graph.strong_components(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 4)], "src long, dst long")).count() == 0


def test_waves_send_nothing_to_the_driver(spark):
    """A task that waits over several waves keeps its count; a ring and what waits for it have no wave."""
    tasks = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 0), (4, 1), (4, 3), (4, 3), (5, 6), (6, 5), (7, 0), (7, 5)], "task long, depends_on long")
    got = []
    assert broadcasts(spark, lambda: got.extend(graph.waves(tasks).collect())) == 0
    assert {r.task: r.wave for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: None, 6: None, 7: None} and len(got) == 8
