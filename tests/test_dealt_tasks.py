"""What a task sorts does not grow with the table: steps are dealt out by rows, lexed once, and send no growing side to every task."""

import pytest
from pyspark.sql import functions as F

from lintlake.operators import scopes, scratch, structure
from lintlake.operators import syntax as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lexed(spark):
    text = F.element_at(F.array(F.lit("function f(a) {"), F.lit("  const x = a; if (x) { use(x); }"), F.lit("}")), (F.col("id") % 3 + 1).cast("int"))
    return S.lex(spark.range(600).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), F.floor(F.col("id") / 3)).alias("path"), (F.col("id") % 3 + 1).alias("line_no"), text.alias("text")))


def test_more_rows_more_tasks(spark):
    assert [scratch.deal(spark.range(n), n, "id", each=10).rdd.getNumPartitions() for n in (100, 1000)] == [10, 100]


def test_lexed_once(lexed):
    assert "MapInPandas" not in plan(lexed)


def test_no_growing_side_is_broadcast(lexed):
    nodes = S.tree(lexed)
    assert "Broadcast" not in plan(scopes.bindings(nodes)) and "Broadcast" not in plan(structure.structure_grade(lexed, nodes))
    assert {r.complexity for r in S.functions(nodes).collect()} == {2} and S.functions(nodes).count() == 200
    assert scopes.bindings(nodes).where("name = 'x' AND references = 3").count() == 200


def test_pairs_are_dealt_out_by_rows(spark):
    from lintlake.operators import packages as P

    declared = spark.createDataFrame([(1, 1, "prod"), (1, 2, "dev"), (2, 1, "prod"), (2, None, "dev")], "project long, package long, scope string")
    used = spark.createDataFrame([(1, 1), (1, 1), (3, 1), (3, 1)], "project long, package long")
    unused, phantom = P.unused_deps(declared, used, 5 << 18), P.phantom_deps(used, declared, 5 << 18)
    assert "hashpartitioning(project#" in plan(unused) and ", 5)" in plan(unused) and ", 5)" in plan(phantom)
    assert sorted(tuple(r)[::2] for r in unused.collect()) == [(1, "dev"), (2, "dev"), (2, "prod")] and [tuple(r) for r in phantom.collect()] == [(3, 1)]


def test_names_and_chains_need_no_counts(lexed):
    """Scopes, chains and what lies inside of what read a tree without the counts, and find the same."""
    from lintlake.operators import span_rules as R

    whole, slim = S.tree(lexed), S.tree(lexed, counts=False)
    assert not [c for c in slim.columns if c.startswith("all_")] and set(slim.columns) < set(whole.columns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(scopes.bindings(slim)) == rows(scopes.bindings(whole)) and rows(R.scan_inside(slim)) == rows(R.scan_inside(whole))
    assert rows(R.scan_chains(slim, S.spans(slim, counts=False))) == rows(R.scan_chains(whole, S.spans(whole)))


def test_calls_and_chains_are_dealt_out_by_rows(lexed):
    from lintlake.operators import span_rules as R

    nodes = S.tree(lexed)
    found = S.spans(nodes)
    calls, chains = plan(R.scan_calls(nodes, found)), plan(R.scan_chains(nodes, found))
    assert "Broadcast" not in calls and "REPARTITION_BY_NUM" in calls and chains.count("REPARTITION_BY_NUM") == 2


def test_lexer_is_dealt_out_by_rows(spark, monkeypatch):
    """what the lexer sorts follows the lines, not a fixed number of tasks, for files of one block and of several."""
    monkeypatch.setattr(S, "settle", lambda df: df)
    monkeypatch.setattr(S, "TASK", 10)
    lines = spark.range(600).select(F.concat(F.lit("r"), F.floor(F.col("id") / 6)).alias("repo"), F.concat(F.lit("f"), F.floor(F.col("id") / 3)).alias("path"), (F.col("id") % 3 + 1).alias("line_no"), F.lit("a { /* }").alias("text"))
    short, long = plan(S.lex(lines)), plan(S.lex(lines, block=2))
    for text in (short, long):
        assert text.count("REPARTITION_BY_NUM") and text.count("REPARTITION_BY_NUM") == text.count(", 60), REPARTITION_BY_NUM") == text.count("Exchange hashpartitioning")
    assert short.count("MapInPandas") == 1 and long.count("MapInPandas") == 3
    assert sorted(map(str, S.lex(lines, block=2).collect())) == sorted(map(str, S.lex(lines).collect()))


def test_views_number_lines_where_documents_are_dealt(spark):
    """lines are numbered in tasks that follow the documents; the lines themselves are not shuffled."""
    import lintlake.plans.blocks  # noqa: F401
    from lintlake.plans.base import DEALT, Source

    for name in DEALT:
        text = plan(Source(spark, "/root/testdata/sf0.001").view(name))
        assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 1 and "Window" in text


def test_findings_inside_are_dealt_out_by_rows(lexed):
    """findings are made distinct in tasks that follow the pieces."""
    from lintlake.operators import span_rules as R

    text = plan(R.scan_inside(S.tree(lexed, counts=False)))
    assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 1
