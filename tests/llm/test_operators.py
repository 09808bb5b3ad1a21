"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and
columns whose names clash with its own."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import audio, chat, html_extract, langid, mixing, packing, quality_crf, sharding, simhash, vptree
from lintlake.llm.common import held_out
from lintlake.llm.queries import tokenizer_path

LONG = "lorem ipsum dolor sit amet " * 8000
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t ", None, "b"),
    (4, "word", "en", "a"),
    (4, "word", "en", "a"),
    (None, "a row without id", None, None),
    (6, LONG, "fr", "b"),
    (7, "the cat and the dog", "en", "a"),
    (8, "the cat and the dog", "en", "c"),
]
CLASH = ["id", "fp", "size", "h", "score", "shard", "slot", "unit", "component_id", "lang_pred", "coverage", "predicted", "pieces", "salt", "media", "audio", "copies", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    return docs.select("*", *[F.lit("other").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, n, words):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


EN, FR = "the and of that with from this they were".split(), "le de la que avec dans pour être nous".split()


# ---------------------------------------------------------------- language


def test_language_held_out(spark):
    rows = [(k, prose(k, 40, EN if k % 2 else FR), "en" if k % 2 else "fr", "s") for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("h", held_out(F.col("doc_id"), 4, 2))
    bank = langid.fit(docs.where("NOT h"))
    out = langid.predict(docs.where("h"), bank).select("lang", "lang_pred", "score").collect()
    assert out and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in out)


def test_language_edges(edge, empty, spark):
    bank = langid.fit(spark.createDataFrame([(k, prose(k, 20, EN), "en", "s") for k in range(9)], SCHEMA))
    out = langid.predict(edge, bank)
    assert out.count() == len(EDGE) and out.columns.count("score") == 1
    by = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "en" and by[7] == by[8]
    assert langid.predict(empty, bank).count() == 0
    nobody = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(edge, nobody).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than bits of a long, each with letters of its own."""
    word = lambda k, j: "".join(chr(0x4E00 + 20 * k + (j * 7 + i * 3) % 20) for i in range(6))
    rows = [(k * 10 + j, " ".join(word(k, j + n) for n in range(12)), f"l{k:03}", "s") for k in range(70) for j in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = langid.predict(docs, langid.fit(docs)).collect()
    assert len(out) == 210 and all(r.lang == r.lang_pred for r in out)


def test_trigrams_and_bloom():
    text = "Ça va! L'été, 12 naïve\n" * 3

    def brute(t):
        s = [0, *[int(langid.letters()[ord(c)]) for c in t], 0]
        return Counter((s[i - 1] << 42) | (s[i] << 21) | s[i + 1] for i in range(1, len(s) - 1) if s[i])

    old = langid.BLOCK
    try:
        for langid.BLOCK in (1, 5, 1000):
            got = [Counter() for _ in range(4)]
            for of, keys in langid.trigrams([text, None, "", "x"]):
                for o, k in zip(of, keys, strict=True):
                    got[o][int(k)] += 1
            assert got == [brute(t) for t in (text, "", "", "x")]
    finally:
        langid.BLOCK = old
    keys = np.arange(1, 500, dtype=np.uint64) << np.uint64(21)
    masks = np.where(np.arange(499) % 2, 1, 1 << 9).astype(np.uint64)
    bank = langid.BloomBank.build([f"l{k:02}" for k in range(12)], "l00", keys, masks)
    assert bank.slots.shape[1] == 2 and (bank.fpr < 0.01).all()
    for at in bank._slots_of(keys, int(bank.slots.shape[0]).bit_length() - 1):
        row = bank.slots[at].astype(int)
        assert ((row[:, 0] + (row[:, 1] << 8)) & masks.astype(int) == masks.astype(int)).all()


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(capped.values())
        total = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rest / total > most * sizes[s]]
        if not over:
            return capped | {s: weight[s] * rest / total for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    r = random.Random(1)
    rows = [(k, "w " * r.randint(0, 30), None, r.choice(["a", "b", "c", "d", None])) for k in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for x in out:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.copies <= 2
        taken[x.source] += x.size * x.copies
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 15 for s in want)


def test_mixing_is_nested(spark):
    rows = [(k, "w " * (k % 7 + 1), None, "a" if k % 3 else "b") for k in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = []
    for share in (0.4, 0.7):
        out = mixing.mix(docs, share=share).collect()
        kept.append({x.doc_id for x in out if x.copies and x.source == "a"})
    assert kept[0] < kept[1] or kept[1] < kept[0]


def test_mixing_edges(edge, empty):
    out = mixing.mix(edge).collect()
    assert len(out) == len(EDGE) and {x.size for x in out if x.doc_id in (1, 2, 3)} == {0}
    both = mixing.mixed(edge)
    assert both.columns == edge.columns and both.count() == sum(x.copies for x in out)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# ---------------------------------------------------------------- audio


def test_audio_round_trip(spark):
    r = random.Random(3)
    rows = [(k, r.randbytes(r.choice([0, 1, 575, 576, 577, 9000]))) for k in range(40)] + [(99, None), (5, b"x" * 100_000)]
    media = audio.store(spark.createDataFrame(rows, "doc_id long, data binary"), F.col("data"))
    got = audio.analyse(media).collect()
    sent = Counter((k, d or b"") for k, d in rows)
    for x in got:
        data = bytes(x.audio.payload)
        assert len(data) % 576 == 0 and len(data) > 0 and sent[(x.doc_id, data[: x.n_bytes])] and set(data[x.n_bytes :]) <= {255}
        spans, patches = audio.read_tensors(bytes(x.audio.tensors))
        assert bytes(x.media) == audio.wav(data) and patches.shape == (-(-x.audio.frames // audio.SHAPE[0]), *audio.SHAPE) and spans.shape == (len(patches), 2)
    assert len(got) == len(rows)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 4), (2, 1), (5, 3), (1, 1)])
def test_resample_is_filtering(up, down):
    x = np.random.default_rng(0).normal(size=500).astype("f4")
    if up == down:
        assert (audio.resample(x, up, down) == x).all()
        return
    table, delay = audio._phases(up, down)
    h = np.zeros(table.shape[1] * up)
    for p in range(up):
        h[p::up] = table[p, ::-1]
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    want = np.convolve(spread, h)[delay:][::down][: -(-len(x) * up // down)]
    assert np.abs(audio.resample(x, up, down) - want).max() < 1e-5


def test_segments_and_tensors():
    energy = np.array([0, 10, 5, 5, 0, 0, 10, 0, 5, 5.0])
    mean, dev = energy.mean(), energy.std()
    on, want, start = False, [], None
    for k, e in enumerate([*energy, -1e9]):
        if not on and e >= mean + 0.25 * dev:
            on, start = True, k
        elif on and e < mean - 0.25 * dev:
            on = False
            want.append((start, k))
    assert audio.segments(energy) == want


def test_log_mel_by_hand():
    """Frame after frame, band after band, from the formulas; then as stored tensors."""
    data = bytes((37 * k * k + 11 * k) % 256 for k in range(20_000))
    y = audio.resample((np.frombuffer(data, np.uint8).astype("f4") - 128) / 128, audio.TARGET, audio.RATE)
    n = (len(y) - audio.FRAME) // audio.HOP + 1
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + audio.TARGET / 2 / 700), audio.BANDS + 2) / 2595) - 1)
    freqs = np.arange(audio.FRAME // 2 + 1) * audio.TARGET / audio.FRAME
    want = np.zeros((n, audio.BANDS))
    for k in range(n):
        x = y[k * audio.HOP : k * audio.HOP + audio.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1)))
        power = np.abs(np.fft.rfft(x)) ** 2
        for b in range(audio.BANDS):
            low, mid, high = edges[b : b + 3]
            weight = np.clip(np.minimum((freqs - low) / (mid - low), (high - freqs) / (high - mid)), 0, None)
            want[k, b] = np.log10(max((power * weight).sum(), audio.FLOOR))
    found = audio.describe(audio.wav(data))
    spans, patches = audio.read_tensors(found["tensors"])
    assert found["frames"] == n and np.abs(patches.reshape(-1, audio.BANDS)[:n] - want).max() < 1e-3
    assert np.allclose(patches.reshape(-1, audio.BANDS)[n:], np.log10(audio.FLOOR))
    step = audio.HOP / audio.TARGET
    assert spans[0].tolist() == [0.0, 31 * step + audio.FRAME / audio.TARGET] and spans[1][0] == 32 * step


def test_audio_edges(edge, empty):
    out = audio.analyse(audio.store(edge, F.col("text").cast("binary"))).collect()
    assert len(out) == len(EDGE) and len({bytes(x.media) for x in out if x.doc_id in (7, 8)}) == 1
    assert audio.analyse(audio.store(empty, F.col("text").cast("binary"))).count() == 0


# ---------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div class="cookie-notice">We use cookies, really.</div>{open}<h2>A  title</h2><p>First <b>bold</b> text, with&nbsp;marks &amp; more.<p>Second one<br>goes on. It is long, and has commas, too.</p><ul><li>point</li></ul><form><input><button>Send</button></form>
<div id="comments"><p>Reader says no, and again no.</p></div>{close}<aside><p>Sidebar, with text. And more of it, here.</p></aside><footer>(c)</footer>"""


@pytest.mark.parametrize(("a", "z"), [("<article>", "</article>"), ("<main>", "</main>"), ("<div><div>", "</div></div>")])
def test_html(a, z):
    want = "A title\nFirst bold text, with marks & more.\nSecond one goes on. It is long, and has commas, too.\npoint"
    assert html_extract.main_text(PAGE.replace("{open}", a).replace("{close}", z)) == want


def test_html_edges(spark):
    pages = [(1, None), (2, ""), (3, "plain"), (4, "<p>a<p>b"), (5, "<nav><a>x</a></nav>"), (6, '<article><p>a "b <x y="c>d</p></article>'), (6, "<article><p>same</p></article>"), (7, "<article>" + "<p>text, here.</p>" * 5000 + "</article>"), (8, "<" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    out = {(r.page_id, r.html): r for r in html_extract.extract(df).collect()}
    assert len(out) == len(pages) and out[(1, None)].text == out[(2, "")].text == out[(5, pages[4][1])].text == ""
    assert out[(4, "<p>a<p>b")].text == "a\nb" and out[(3, "plain")].text == "plain"
    assert out[(7, pages[7][1])].n_chars == 5000 * 12 - 1
    assert html_extract.extract(df.where("false")).count() == 0


# ---------------------------------------------------------------- packing


def test_plan_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([5, 12, 50])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 80))), reverse=True)
        rooms = []
        for n in lengths:
            fits = [k for k, room in enumerate(rooms) if room >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(capacity - n)
        used, spans, number = defaultdict(int), defaultdict(list), Counter()
        rows = packing.plan(dict(Counter(lengths)), capacity)
        for n in lengths:
            own = [x for x in rows if x[0] == n and x[1] <= number[n]][-1]
            k = number[n] - own[1]
            spans[own[2] + k // own[3]].append((own[4] + n * (k % own[3]), n))
            number[n] += 1
        for b, placed in spans.items():
            for at, n in sorted(placed):
                assert at == used[b]
                used[b] += n
            assert used[b] <= capacity
        assert sorted(used.values()) == sorted(capacity - room for room in rooms)


def brute_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_word_tokenizer():
    own = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"), remember=5)
    assert own.fast
    texts = ["<|endoftext|> a<|endoftext|>b", "don't I'll we've 's", "É CAFÉ café x", "a b　c", "İstanbul ΣΑΣ ß ſ", "😀 a​b", "\x1cx\x1dy", "a\r\nb\tc\x0bd", "", "   ", None, "1234 12.5% a_b", "ﬁ ½", "it's ''s ('s !'t", LONG[:5000], "Ÿ ŸŸ ÀÖØ×÷"]
    for text in texts * 2:
        assert own.ids(text).tolist() == brute_ids(text).tolist(), text


def test_packing(edge, empty):
    out = packing.pack(edge, tokenizer_path("word_bpe_49k.json"), capacity=2048).collect()
    want = Counter()
    for doc_id, text, *_ in EDGE:
        ids = brute_ids(text)
        for k, at in enumerate(range(0, len(ids), 2048)):
            p = ids[at : at + 2048]
            want[(doc_id, k, at, len(p), zlib.crc32(p.tobytes()))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for placed in bins.values():
        placed.sort()
        assert [a for a, _ in placed] == list(itertools.accumulate([0, *[n for _, n in placed[:-1]]])) and sum(n for _, n in placed) <= 2048
    assert packing.pack(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


# ---------------------------------------------------------------- quality


def test_marginals_match_enumeration():
    r = np.random.default_rng(0)
    sizes, trans = np.array([3, 1, 5]), r.normal(size=(2, 2))
    odds = r.normal(size=9) * 2
    fwd, bwd = quality_crf.messages(odds, trans, sizes)
    got, at = quality_crf._sigmoid(fwd + bwd), 0
    for n in sizes:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(odds[at + i] for i in range(n) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_quality_held_out(spark):
    docs = [(k, "\n".join(prose(k * 100 + j, 12, EN).capitalize() + "." if k % 3 or j == 0 else " | ".join(EN) for j in range(6)), None, None) for k in range(300)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("h", held_out(F.col("doc_id"), 5, 0))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)], "doc_id long, quality int, toxic int")
    model = quality_crf.fit(df.where("NOT h"), labels)
    out = quality_crf.score(df.where("h"), model).collect()
    assert out and all(x.predicted == int(x.doc_id % 3 > 0) for x in out)


def test_quality_sample_is_bounded(spark):
    """A text of very many lines is scored, but not learned from."""
    docs = [(k, "\n".join(prose(k * 100 + j, 12, EN).capitalize() + "." if k % 2 else " | ".join(EN) for j in range(4)), None, None) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(61)], "doc_id long, quality int, toxic int")
    plain = quality_crf.fit(spark.createDataFrame(docs, SCHEMA), labels, lines_per_text=50)
    long = spark.createDataFrame([*docs, (60, "\n".join(["A line."] * 500), None, None)], SCHEMA)
    model = quality_crf.fit(long, labels, lines_per_text=50)
    assert np.allclose(plain.weights, model.weights) and quality_crf.score(long, model).where("score is not null").count() == 61


def test_quality_edges(edge, empty, spark):
    labels = spark.createDataFrame([(7, 1, 0), (4, 0, 0), (6, 1, 0), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.fit(edge, labels)
    out = quality_crf.score(edge, model).collect()
    assert len(out) == len(EDGE) and all(0 <= x.score <= 1 for x in out)
    assert len({x.score for x in out if x.doc_id in (1, 2)}) == 1 and len({x.score for x in out if x.doc_id in (7, 8)}) == 1
    assert quality_crf.score(empty, model).count() == 0
    assert {x.score for x in quality_crf.score(edge, quality_crf.fit(edge, labels.where("quality = 1"))).collect()} == {1.0}
    assert {x.score for x in quality_crf.score(edge, quality_crf.fit(empty, labels)).collect()} == {0.5}


# ---------------------------------------------------------------- shards


def test_differencing():
    parts = sharding.differencing([("a", 8), ("b", 7), ("c", 6), ("d", 5), ("e", 4)], 2)
    sums = [sum(w for k, w in [("a", 8), ("b", 7), ("c", 6), ("d", 5), ("e", 4)] if parts[k] == p) for p in (0, 1)]
    assert sorted(sums) == [14, 16]  # the known outcome of differencing this list
    assert sharding.differencing([], 3) == {}


def test_shards(spark):
    r = random.Random(2)
    rows = [(k, "copy of one text" if k % 3 == 0 else prose(k, r.randint(1, 60), EN), None, None) for k in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=8, buckets=256, rows_per_unit=50).collect()
    text = {k: t for k, t, *_ in rows}
    group, load, slots = {}, Counter(), defaultdict(list)
    for x in out:
        assert x.size == len(text[x.doc_id].encode()) + 1 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode())
        assert group.setdefault(text[x.doc_id], x.shard) == x.shard
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(load.values()) <= 1.05 * min(load.values())


def test_shard_edges(edge, empty):
    out = sharding.shard(edge).collect()
    assert len(out) == len(EDGE) and len({x.shard for x in out if x.doc_id in (1, 2)}) == 1 and {x.size for x in out if x.doc_id == 1} == {1}
    assert sharding.shard(empty).count() == 0


# ---------------------------------------------------------------- chat


def test_reply_trees(spark):
    r = random.Random(4)
    rows = []
    for tree in [1, 2, None]:
        for k in range(60):
            rows.append((tree, k, None if k == 0 else r.randrange(max(0, k - 4), k), r.choice(["user", "assistant", None, "a\nb"]), r.choice([None, "", "x<turn>\\l", "</turn>\n", "plain\n"]), r.choice([None, 0.0, 1.0])))
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    got = chat.conversations(df.withColumn("up", F.lit(1)).withColumn("leaf", F.lit(2)), most=3)
    got = got.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for tree in [1, 2, None]:
        own = {k: (p, role or "", text or "", s or 0.0) for t, k, p, role, text, s in rows if t == tree}
        leaves = set(own) - {p for p, *_ in own.values()}
        ranked = []
        for leaf in leaves:
            path, k = [], leaf
            while k is not None:
                path.append(k)
                k = own[k][0]
            ranked.append((-np.mean([own[k][3] for k in path]), leaf, path[::-1]))
        ranked.sort(key=lambda x: (round(x[0], 12), x[1]))
        mine = sorted((x for x in got if x.tree == tree), key=lambda x: x.branch)
        assert [x.leaf for x in mine] == [leaf for _, leaf, _ in ranked[:3]]
        for x, (_, _, path) in zip(mine, ranked, strict=False):
            assert [(t.role, t.text) for t in x.turns] == [(own[k][1], own[k][2]) for k in path]
            assert x.loss == "".join(own[k][2] for k in path if own[k][1] == "assistant")


def test_reply_edges(spark):
    schema = "tree long, id long, parent long, role string, text string, score double"
    loop = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (2, 5, 9, "user", "orphan is a root", 0.0), (2, 5, 9, "user", "orphan is a root", 0.0)]
    out = chat.conversations(spark.createDataFrame(loop, schema)).collect()
    assert [(x.tree, x.leaf) for x in out] == [(2, 5)]
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 3, "assistant", "x")], "conv_id long, turn long, role string, text string")
    read = {x.tree: x for x in chat.conversations(chat.threads(rows)).select("*", F.size(chat.parse(F.col("formatted"))).alias("n")).collect()}
    assert read[1].n == 3 and read[None].n == 1


# ---------------------------------------------------------------- neighbours


def brute_neighbours(vectors, asked, k):
    ids, m = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for q, v in asked:
        s = vptree.cosine(np.broadcast_to(np.array(v, float), m.shape), m)
        best = sorted(((-x, i) for x, i in zip(s, ids, strict=True) if i != q))[:k]
        out[q] = [(int(i), -x) for x, i in best]
    return out


def test_neighbours_exact_and_relaxed(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16)) * 3
    vectors = [(k, (centres[k % 20] + r.normal(size=16)).tolist()) for k in range(1500)] + [(5000 + k, [1.0] * 16) for k in range(300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = [v for v in vectors if v[0] % 50 == 0]
    want = brute_neighbours(vectors, asked, 5)
    for slack, least in ((1.0, 1.0), (0.6, 0.9)):
        got = defaultdict(list)
        for x in sorted(vptree.neighbours(df, df.where("vec_id % 50 = 0"), 5, slack, rows_per_shard=400).collect(), key=lambda x: x.rank):
            got[x.query_id].append((x.vec_id, x.score))
        if slack == 1.0:
            assert got == want
        hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hit >= least * 5 * len(want)


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(1))
    out = [(x.query_id, x.rank, x.vec_id) for x in vptree.neighbours(df, df, 5).collect() if x.query_id == 0]
    assert sorted(out) == [(0, 1, 7), (0, 2, 8)]
    assert vptree.neighbours(df.where("false"), df.where("false")).count() == 0


# ---------------------------------------------------------------- near duplicates


def test_allocation_and_groups():
    costs = [[0, 5, 50], [0, 1, 9], [0, 2, 4]]
    best = min((sum(c[t + 1] for c, t in zip(costs, ts, strict=True)), ts) for ts in itertools.product((-1, 0, 1), repeat=3) if sum(ts) == 0)
    assert simhash.allocate(costs, 0)[0] == best[0]
    r = np.random.default_rng(0)
    sample = r.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    sample = (sample & ~np.uint64(2)) | ((sample & np.uint64(1 << 40)) >> np.uint64(39))  # bit 1 follows bit 40
    groups = simhash.group_bits(sample, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({1, 40} <= set(g) for g in groups)
    plan = simhash.search_plan(sample, 10_000, 2)
    assert sum(t for _, t in plan) - (simhash_parts(plan) - len(plan)) <= 2


def simhash_parts(plan):
    return round(64 / len(plan[0][0]))


@pytest.mark.parametrize("bucket", [0, 3, 64])
def test_links_and_components(spark, bucket):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    near = {b ^ sum(1 << x for x in r.sample(range(64), r.choice([0, 1, 2, 3]))) for b in base for _ in range(6)}
    chain, x = [], base[0]
    for k in range(20):  # each two bits from the last
        x ^= 3 << (3 * k)
        chain.append(x)
    values = sorted({*base, *near, *chain, 0, 1, 6})
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    got = {x.node % (1 << 64): x.root for x in simhash.components(simhash.link(df, 2, bucket)).collect()}
    classes = defaultdict(set)
    for v in values:
        classes[root(v)].add(v)
    for members in classes.values():
        assert len({got.get(v, ("alone", v)) for v in members}) == 1
    assert len({got.get(v, ("alone", v)) for v in values}) == len(classes)


def test_fingerprint_by_hand():
    import xxhash

    text = "One two\tTHREE four\x0bfive ünï"
    words = ["one", "two", "three", "four", "five", "ünï"]
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(4)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) > 2)
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicate_edges(edge, empty):
    out = simhash.near_duplicates(edge).collect()
    assert len(out) == len(EDGE)
    assert {x.component_id for x in out if x.doc_id in (1, 2, 3)} == {1} and {x.component_id for x in out if x.doc_id in (7, 8)} == {7}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == [(False, 1), (False, 4), (False, 6), (False, 7), (True, 0)]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_by_row(spark):
    one, two = "one text that stands here under two ids", "and another that stands under one of them alone"
    rows = [(3, two), (5, two), (5, one), (9, "a third"), (None, "a fourth one"), (None, "a fourth one")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.text) for x in kept) == [(0, "a fourth one"), (3, two), (5, one), (9, "a third")]
