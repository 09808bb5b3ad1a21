"""Queries that had become smaller: every class of bodies, both fixtures of code."""

from lintlake.plans import register

SF = "/root/testdata/sf0.001"


def test_bodies_of_any_length_and_pairs(spark):
    got = register.queries()["a45_duplicate_bodies"](spark, SF).collect()
    assert any(r.copies == 2 for r in got) and any(r.lines < 3 for r in got) and any(r.copies > 2 and r.lines > 2 for r in got)


def test_next_lines_of_both_fixtures(spark):
    got = register.queries()["r32_scan_catalog_next"](spark, SF).collect()
    of_script = [r for r in got if r.path.startswith("script/")]
    assert 0 < len(of_script) < len(got)
