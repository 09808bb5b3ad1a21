"""The pipeline's stages on a small corpus, each against a plain version of what it decides."""

from collections import Counter

import pytest

import corpus_pipeline
from lintlake.llm import langid

#: sf0.001 has 8 bad texts to learn from, and not every kind of junk among them.
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], SF)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def test_columns_and_rows(stages):
    docs, lang, good, single, mix, _ = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert lang.count() >= 0.95 * docs.count()


def test_quality_keeps_good(stages, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in s.select("doc_id").collect()} for s in stages[1:3])
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in good) >= 0.97 * len(good) and sum(d in after for d in bad) <= 0.2 * len(bad)


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_stays(stages):
    """Every pair of five-word shingle sets: the smallest id of each component at 0.8 or more stays."""
    before, after = ({r.doc_id: shingle_set(r.text) for r in s.collect()} for s in stages[2:4])
    lead = {}
    for d in sorted(before):
        near = {lead[e] for e in lead if before[d] == before[e] or 5 * len(before[d] & before[e]) >= 4 * len(before[d] | before[e]) > 0}
        first = min([d, *near])
        for e in [e for e in lead if lead[e] in near]:
            lead[e] = first
        lead[d] = first
    assert set(after) == set(lead.values())


EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "12 34 $$", None, "b"),
    (4, "a word or two of good and plain text that anybody could read at home", "en", "a"),
    (4, "a word or two of good and plain text that anybody could read at home", "en", "a"),
    (None, "the other text has words of its own, and they are not those of the first", "en", None),
    (None, "the other text has words of its own, and they are not those of the first", "en", None),
    (4, "one id may stand on many texts, and each of these has to be looked at alone", "en", "c"),
]
NAMES = ["score", "coverage", "lang_pred", "predicted", "row", "doc", "set", "text_", "id", "fp", "hash", "node", "size", "root", "h", "copies", "n.chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus of edge cases whose columns clash with the operators' own, and labels for it."""
    path = str(tmp_path_factory.mktemp("edge"))
    rows = [*EDGE, *((k, " ".join(["the", "cat", f"word{chr(97 + k % 26)}", f"w{chr(97 + k // 26)}"] * 6), "en", "a") for k in range(10, 110))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *[f"'own' AS `{c}`" for c in NAMES])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(10, 110)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("place", range(4))
def test_stage_edges(spark, folder, place):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.STAGES[place][1](spark, docs, folder)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r[c] == "own" for r in rows for c in NAMES)
    texts = Counter((r.doc_id, r.text) for r in rows)
    if place == 0:
        assert not {1, 2, 3} & {d for d, _ in texts} and texts[EDGE[3][:2]] == 2 and texts[EDGE[5][:2]] == 2
    if place == 2:
        assert {d: n for (d, _), n in texts.items() if d in (1, 2)} == {1: 1} and texts[EDGE[3][:2]] == texts[EDGE[5][:2]] == texts[EDGE[7][:2]] == 1
    nothing = corpus_pipeline.STAGES[place][1](spark, docs.where("false"), folder)
    assert nothing.columns == docs.columns and nothing.count() == 0


def test_unlearned_language_goes(spark, stages):
    """With German left out of the bank, its texts go and the others stay."""
    docs = stages[0].where("length(text) > 200")
    bank = langid.fit(docs.where("lang <> 'de'"))
    kept = Counter(r.lang for r in langid.predict(docs, bank).where(langid.identified()).collect())
    every = Counter(r.lang for r in docs.collect())
    assert kept["de"] <= 0.01 * every["de"] and all(kept[x] >= 0.99 * every[x] for x in ("en", "fr", "es"))


def test_mix_and_pack(stages):
    single, mix, packed = stages[3], stages[4], stages[5]
    words = Counter()
    for r in single.collect():
        words[r.source] += len((r.text or "").split())
    taken = sum(len((r.text or "").split()) for r in mix.collect())
    assert 0.9 <= taken / (1.5 * sum(words.values())) <= 1.1
    assert Counter(r.doc_id for r in mix.collect()) == Counter(r.doc_id for r in packed.where("piece = 0").collect())
