"""The pipeline's near-duplicate stage against all pairs of exact shingle sets."""

import random

import pytest

import corpus_pipeline
from lintlake.llm import jaccard


def plain(rows, least=0.8, words=5):
    """The smallest id of each component, by comparing every pair."""
    sets, lead = {}, {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    for i in sorted(sets):
        near = {lead[j] for j in lead if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and sets[i] & sets[j]}
        first = min([i, *near])
        lead = {j: first if g in near else g for j, g in lead.items()} | {i: first}
    return sorted(set(lead.values()))


def corpus():
    r = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(400)]
        for edits in (0, 0, 2, 5, 9, 14, 30, 80):  # up to about 9 edits of 400 words stay at 0.8
            text = list(base)
            for at in r.sample(range(400), edits):
                text[at] = f"x{r.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_stage_drops_edited_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == plain(rows)


@pytest.mark.parametrize("bucket", [1, 3])
def test_hot_buckets_lose_nothing(spark, bucket):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in jaccard.keep_one(docs, bucket=bucket).collect()) == plain(rows)


def test_crowded_near_copies(spark):
    """Texts around one long passage, many of them just above or below the limit, in crowded buckets of several blocks."""
    r = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"t{r.randrange(40)}" for _ in range(r.randrange(4, 26))])) for k in range(160)]
    marked = jaccard.mark(spark.createDataFrame(rows, "doc_id long, text string"), "text", 5).select("row", "doc.doc_id", "doc.text", "set.*")
    marked = spark.createDataFrame(marked.collect(), marked.schema)
    sets = marked.selectExpr("row AS node", "size", "fp", "bands")
    found = jaccard.components(jaccard.linked(sets, marked.selectExpr("row AS node", "text"), bucket=4, block=8))
    lead = {x.node: x.root for x in found.collect()}
    groups = {}
    for x in sorted(marked.collect(), key=lambda x: x.doc_id):
        groups.setdefault(lead.get(x.row, x.row), x.doc_id)
    assert sorted(groups.values()) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted(x.doc_id for x in jaccard.keep_one(docs).collect()) == plain(rows)


def test_rows_without_id_and_shared_ids(spark):
    one, two = "a text of seven words and more", "another one with nothing in common"
    rows = [(None, one), (None, one), (5, two), (5, one), (7, None), (8, " "), (None, "x")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.text or "") for x in kept) == sorted([(5, one), (5, two), (7, ""), (0, "x")])
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
