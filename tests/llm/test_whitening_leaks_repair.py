"""Whitening, decontamination and conversation repair against brute force, and on edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import decontaminate, repair, whitening
from lintlake.llm.queries import damaged

CLASH = ["id", "row", "h", "n", "words", "at", "conv", "x", "component", "item", "gram", "length", "said", "blank", "audit"]


def with_clashes(df):
    return df.select("*", *[F.lit("other").alias(c) for c in CLASH if c not in df.columns])


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, centred, values[::-1], turn[:, ::-1]


@pytest.mark.parametrize("width,rows", [(5, 40), (48, 300)])
def test_whitening_against_eigh(spark, width, rows):
    r = np.random.default_rng(width)
    data = (r.normal(size=(rows, width)) * np.linspace(0.05, 0.6, width)).astype(np.float32)
    df = with_clashes(spark.createDataFrame([(k, [float(c) for c in v], 0) for k, v in enumerate(data)], VECTORS).repartition(3))
    got = whitening.whiten(df).toPandas()
    x, n, sums, centred, values, turn = brute_whitening(data)
    k = min(8, width)
    assert len(got) == rows * k and set(got["n"]) == {n}
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}
    assert all(int(d) == exact[i] for i, d in zip(got["vec_id"], got["deviation"], strict=True))
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = centred @ turn[:, :k] / np.sqrt(values[:k])
    signs = np.sign((table * want).sum(0))
    assert np.abs(table * signs - want).max() < 1e-8
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values[:k] / values.sum(), rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    assert np.abs(np.cov(table.T, bias=True) - np.eye(k)).max() < 1e-10


def test_whitening_filter_and_bounds():
    r = np.random.default_rng(1)
    basis = np.linalg.qr(r.normal(size=(60, 60)))[0]
    values = np.linspace(100, 1, 60)
    v = (basis * values) @ basis.T
    q = np.linalg.qr(r.normal(size=(60, 12)))[0]
    m = whitening.degree(values, 4, 30, 29, 12)
    out = whitening.chebyshev(lambda p: v @ p, q, v @ q, 1.0, 60.0, m)
    kept = lambda p: np.linalg.norm(basis[:, :20].T @ p) / np.linalg.norm(basis[:, 20:].T @ p)
    assert m > 1 and kept(out) > 10 * kept(q)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, None, 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0, 3.0], 0), (8, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 2: 2} and {r.n for r in got} == {4}
    one = [r for r in got if r.vec_id == 1 and r.component == 1]
    assert one[0].whitened == one[1].whitened and one[0].deviation == one[1].deviation
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0], 0)] * 3, "vec_id long, embedding array<double>, label int")).count() == 0
    huge = spark.createDataFrame([(k, [float(k) * 2.0**40, 1.0], 0) for k in range(5)], "vec_id long, embedding array<double>, label int")
    x = [k * 2**50 + 100_000 for k in range(5)]
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(huge).collect()} == {k: (5 * x[k] - sum(x)) ** 2 for k in range(5)}


# ---------------------------------------------------------------- decontamination


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = brute_words(text)
        for s in range(max(len(w) - span, 0) + 1) if w else ():
            windows.setdefault(tuple(w[s : s + span]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = brute_words(text), set(), set()
        for n in {len(g) for g in windows}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= {i for i in windows[g] if i is not None}
        out.append((doc, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


def leaks(spark, docs, items):
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    b = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    return sorted([(r.id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(d, b).collect()], key=str)


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["a", "b", "É", "é", "x9", "The", "the", "ΟΔΟΣ", "οδος", "naïve", "7"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "!"]) for _ in range(n))
    items = [(k, say(r.choice([2, 3, 8, 10, 11, 30]))) for k in range(25)]
    docs = []
    for k in range(60):
        parts = [say(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            text = r.choice(items)[1]
            parts += [r.choice([text, text.upper(), text.replace(" ", "\n--"), " ".join(text.split()[1:])]), say(5)]
        docs.append((k, " ".join(parts)))
    got = leaks(spark, docs, items)
    assert got == brute_leaks(docs, items) and any(g[2] for g in got)


def test_leaks_edges(spark):
    passage = " ".join(f"w{k}" for k in range(14))
    docs = [(1, None), (2, ""), (3, "?!"), (4, passage), (4, passage), (None, "x " + passage + " y"), (5, "lorem " * 30000 + passage.upper()), (6, "one"), (7, "same " * 40)]
    items = [(1, passage), (2, passage), (2, "one"), (None, "w3 w4"), (3, None), (4, "..."), (5, "same " * 12)]
    assert leaks(spark, docs, items) == brute_leaks(docs, items)
    assert leaks(spark, docs, []) == brute_leaks(docs, [])
    assert leaks(spark, [], items) == []


def test_rare_shingles_lead(spark):
    docs = spark.createDataFrame([(k, "alpha beta gamma delta") for k in range(50)] + [(99, "beta gamma rare delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma rare delta")], "item_id long, text string")
    every = decontaminate.windows(items)
    (best,) = decontaminate.anchors(docs, every).collect()
    assert best.offset == 0 + 2 or best.offset == 1  # not the shingle of fifty documents
    assert best.gram == "alpha beta gamma rare delta"


# ---------------------------------------------------------------- conversation repair


def brute_repair(rows):
    """rows: (turn, role, text) in order. Exhaustive dynamic programme over (row, state) with whole audits."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}
    closure = lambda b: _closed(b, after)
    best = closure(best)
    for (_, role, _), fault in zip(rows, faults, strict=True):
        found = {}

        def offer(state, cost, audit, found=found):
            if state not in found or (cost, audit) < found[state]:
                found[state] = (cost, audit)

        for state, (cost, audit) in best.items():
            offer(state, cost + 2, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            first = role[:1]
            if first and (first == after[state] or (first == "s" and state == "")):
                offer(first, cost + more, audit + "K")
            offer(after[state], cost + 1 + more, audit + "R")
        best = closure(found)
    cost, audit = min(best[s] for s in ("", "a") if s in best)
    out, state, at = [], "", 0
    for edit in audit:
        if edit != "D":
            state = rows[at][1][:1] if edit == "K" else after[state]
            name = rows[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            out.append(f"{name}:{'' if edit == 'I' else rows[at][2]}")
        at += edit != "I"
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _closed(best, after):
    best, changed = dict(best), True
    while changed:
        changed = False
        for state, (cost, audit) in list(best.items()):
            to, new = after[state], (cost + 5, audit + "I")
            if to not in best or new < best[to]:
                best[to], changed = new, True
    return best


TEXTS = ["Yes.", "No!", "cut of", "", " \n", "Why?", "and then"]
ROLES = ["user", "assistant", "system", "tool", "", "admin"]


def conversation(r, n):
    return [(t, r.choice(ROLES[:3] * 3 + ROLES), r.choice(TEXTS) + (f" {r.randrange(9)}." if r.random() < 0.6 else "")) for t in range(n)]


@pytest.mark.parametrize("piece", [512, 3])
def test_repair_against_brute_force(spark, piece):
    r = random.Random(3)
    talks = {k: conversation(r, r.choice([1, 2, 3, 5, 8, 13])) for k in range(60)} | {100: conversation(r, 90)}
    rows = with_clashes(spark.createDataFrame([(k, *row) for k, talk in talks.items() for row in talk], "conv_id long, turn long, role string, text string").repartition(5))
    report, turns = repair.repair(rows, piece=piece)
    sha = {x.conv: x.sha256 for x in repair.digests(turns).collect()}
    got = {x.conv: (x.cost, x.audit, sha.get(x.conv, hashlib.sha256(b"").hexdigest())) for x in report.collect()}
    assert got == {f"={k}": brute_repair(talk) for k, talk in talks.items()}


def test_search_finds_least_audit():
    """All audits up to a length, by enumeration."""
    r = random.Random(9)
    for _ in range(150):
        codes = bytes(4 * r.randrange(4) + r.choice([0, 0, 0, 1, 2]) for _ in range(r.randrange(5)))
        out, _ = repair.lattice(codes)
        found = []

        def walk(node, cost, audit, codes=codes, out=out, found=found):
            if node[0] == len(codes) and node[1] in repair.ENDS:
                found.append((cost, audit))
            for to, price, label in out(node):
                if cost + price <= 15 and audit.count("I") < 3:
                    walk(to, cost + price, audit + label)

        walk((0, 0), 0, "")
        assert repair.solve(codes, [0], [*repair.ENDS]) == min(found)


def test_repair_edges(spark):
    rows = [
        (1, None, "user", "Hi."),
        (1, 0, None, None),
        (1, 5, "assistant", "Yes."),
        (1, 5, "assistant", "Yes."),
        (2, None, None, None),
        (None, 3, "user", "x" * 300000),
        (None, 4, "assistant", "Good."),
        (4, 1, "user", "Hi."),
        (4, 9, "user", "So?"),
    ]
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    report, turns = repair.repair(df)
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    assert got["=1"] == (4, 1, 1, 0, 3, 4, "KDKD")
    assert got["=2"] == (0, 1, 0, 0, 0, 2, "D")
    assert got["null"] == (0, 0, 0, 1, 0, 4, "DD")
    assert got["=4"] == (7, 0, 0, 0, 1, 1, "KR")
    assert [(t.at, t.role, t.text) for t in turns.where("conv = '=4'").orderBy("at").collect()] == [(0, "user", "Hi."), (1, "assistant", "So?")]
    report, turns = repair.repair(df.limit(0))
    assert report.count() == 0 and turns.count() == 0 and repair.digests(turns).count() == 0


def test_damage_covers_all_kinds(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c, t in itertools.product(range(40), range(10))] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    out = [(r.conv_id, r.turn, r.role, r.text) for r in damaged(rows).collect()]
    kinds = Counter()
    import zlib

    for c, t in itertools.product(range(40), range(10)):
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [], 1: [("assistant", "")], 2: [("assistant", "One Two")], 3: [("assistant", "One. Two!")] * 2, 4: [("user", "One. Two!")]}.get(k, [("assistant", "One. Two!")])
        assert [x[2:] for x in out if x[:2] == (c, t)] == want
        kinds[min(k, 5)] += 1
    assert set(kinds) == set(range(6))
