"""Large groups of ties and repeated rows."""

import numpy as np

from lintlake.llm import vptree


def plain(ids, v, q, k):
    found = {(s, i) for i, s in zip(ids.tolist(), vptree.cosine(np.broadcast_to(v[q], v.shape), v).tolist(), strict=True) if i != ids[q]}
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def check(ids, v, k=5):
    tree = vptree.VpTree(ids, v, k + 1)
    asked = np.arange(0, len(ids), 7)
    assert tree.nearest(ids[asked], v[asked], k, 1.0) == [plain(ids, v, q, k) for q in asked]


def test_scaled_and_close_copies():
    r = np.random.default_rng(2)
    base = r.normal(size=(20, 8))
    scaled = np.concatenate([base * 2.0**f for f in range(40)])
    close = np.concatenate([base[:4] + r.normal(size=(4, 8)) * 1e-9 for _ in range(60)])
    v = np.concatenate([scaled, close])
    check(r.permutation(len(v)), v)


def test_repeated_rows():
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8))
    ids = np.concatenate([np.arange(300), np.repeat(np.arange(40), 9)])
    check(ids, np.concatenate([v, np.repeat(v[:40], 9, axis=0)]))


def test_trees_pass_once_for_a_run_of_blocks(spark):
    """Many blocks, runs and shards give what one block and one shard give, shards without a vector included."""
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=6)]) for k in range(400)]
    df = vptree.usable(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = []
    for shards, size, per in ((1, 1000, 1), (7, 9, 3), (300, 50, 2)):
        out = vptree.search(vptree.build(df, 6, shards), df.where("id % 5 = 0"), shards, block_rows=size, blocks_per_tree=per)
        got.append(sorted((x.query_id, x.rank, x.vec_id, x.score) for x in out.collect()))
    assert len(got[0]) == 400 and got[0] == got[1] == got[2]


def test_rows_of_one_id_and_their_twin(spark):
    """Exact repeats are one row, other rows of an id are candidates of their own, in the operator and in its SQL."""
    import duckdb

    r = np.random.default_rng(8)
    base = [[float(x) for x in r.normal(size=4)] for _ in range(60)]
    rows = [(k, v) for k, v in enumerate(base)] + [(1, base[1])] * 3 + [(1, [2 * x for x in base[1]]), (2, base[1]), (50, base[3]), (50, base[0]), (100, base[50])]
    rows += [(None, base[0]), (7, None), (8, [0.0] * 4), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in vptree.neighbours(df, df.where("vec_id % 50 = 0"), rows_per_shard=20).collect())
    duck = duckdb.connect()
    table = df.toPandas()
    duck.register("embeddings_in", table)
    duck.execute("CREATE TABLE embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings_in WHERE embedding IS NULL OR len(embedding) = 4")
    assert got == sorted(duck.sql(vptree.NEIGHBOURS_SQL).fetchall())
    assert len([1 for q, _, i, s in got if q == 0 and i == 50 and s > 0.999999]) == 1


def test_any_size_of_doubles(spark):
    r = np.random.default_rng(9)
    rows = [(k, [float(x) for x in r.normal(size=5)]) for k in range(80)]
    plain_rows = vptree.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:10], "vec_id long, embedding array<double>"))
    want = sorted(tuple(x) for x in plain_rows.collect())
    scaled = [(k, [float(np.ldexp(x, (-660, 0, 660)[k % 3])) for x in v]) for k, v in rows]
    got = vptree.neighbours(spark.createDataFrame(scaled, "vec_id long, embedding array<double>"), spark.createDataFrame(scaled[:10], "vec_id long, embedding array<double>"))
    assert sorted(tuple(x) for x in got.collect()) == want


def test_margin_covers_rounding():
    r = np.random.default_rng(10)
    for width in (2, 64, 1024):
        v = r.normal(size=(200, width))
        near = v + r.normal(size=v.shape) * 1e-12
        d = np.array([vptree._distances(vptree._unit(v[[k]]), vptree._unit(near[[k]]))[0, 0] for k in range(200)])
        assert d.max() < vptree.margin(width)
