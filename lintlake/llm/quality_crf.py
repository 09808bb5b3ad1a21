"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character classes, repeated neighbouring words, word
count and length, together with those of the line before and after; the chain adds transitions between labels. A text's
good share is the mean of its lines' forward-backward marginals, weighted by line length; a logistic curve fitted on
the labelled sample turns it into the score.

Only texts carry labels. fit() starts with each line labelled like its text, then relabels the lines of bad
texts by their marginals (at least the worst stays bad) and fits again.

Defined results: null and empty texts are one empty line and get its score; with labels of one kind only, or none,
every score is the share of label 1 (0.5 without labels); repeated rows get equal scores; several labels of one id
count as the lowest; columns besides text are carried along, and columns named like the outputs are replaced.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import text_batches

LINE_FEATURES = ("plain", "upper", "exclamation", "bar", "symbol", "stop", "other", "repeated", "words", "word_size", "empty")
CLASSES = 7  # the first of these are character classes: as parts of the line's characters, marks a word. Digits are plain.
BLOCK = 1 << 20


@functools.cache
def classes() -> np.ndarray:
    """Code point -> character class, in the order of LINE_FEATURES; white space has class 7."""
    table = np.full(sys.maxunicode + 1, 6, np.uint8)
    for point in range(0x3000):
        ch = chr(point)
        table[point] = 1 if ch.isupper() else 0 if ch.isalnum() else CLASSES if ch.isspace() else 6
    table[0x3400:0xE000] = 0  # further letters without case
    table[ord("!")], table[ord("|")] = 2, 3
    table[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 4
    table[[ord(c) for c in ".,;:?"]] = 5
    return table


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line lengths, number of lines of each text)."""
    table, lines = classes(), [(t or "").split("\n") for t in texts]
    per_text = np.array([len(x) for x in lines], np.int64)
    flat = [line for own in lines for line in own]
    size = np.array([len(x) for x in flat], np.int64)
    counts, at = np.zeros((len(flat), CLASSES + 1)), 0
    while at < len(flat):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), BLOCK)) + at)
        points = np.frombuffer("".join(flat[at:upto]).encode("utf-32-le", "surrogatepass"), np.uint32)
        for cut in range(0, len(points), BLOCK):
            part = points[cut : cut + BLOCK]
            of = np.repeat(np.arange(upto - at), size[at:upto])[cut : cut + BLOCK]
            counts[at:upto] += np.bincount(of * (CLASSES + 1) + table[part], minlength=(upto - at) * (CLASSES + 1)).reshape(-1, CLASSES + 1)
        at = upto
    x = np.zeros((len(flat), len(LINE_FEATURES)), np.float32)
    seen = np.maximum(size - counts[:, CLASSES], 1)
    x[:, :CLASSES] = counts[:, :CLASSES] / seen[:, None]
    for n, line in enumerate(flat):
        words = line.split()
        if words:
            x[n, 7] = sum(map(eq, words, words[1:])) / len(words)
            x[n, 8] = np.log1p(len(words)) / 5
    words = np.expm1(x[:, 8] * 5)
    x[:, 2:5] = np.minimum(counts[:, 2:5] * 4 / np.maximum(words, 1)[:, None], 1)  # one mark in four words is as good as many
    x[:, 9] = np.where(words > 0.5, seen / np.maximum(words, 1) / 10, 0)
    x[:, 10] = words < 0.5
    return x, size, per_text


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Features of a line, of the one before and of the one after (zeros beyond a text's ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(per_text)
    before[ends - per_text] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


def messages(odds: np.ndarray, trans: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all lines as log odds of good; texts side by side, line after line."""
    order = np.argsort(-per_text, kind="stable")
    starts = (np.cumsum(per_text) - per_text)[order]
    sizes = per_text[order]
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]) if len(sizes) else 0)]  # texts with more than t lines
    fwd, bwd = odds.astype(float).copy(), np.zeros(len(odds))
    (bb, bg), (gb, gg) = trans
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        last = fwd[at - 1]
        fwd[at] += np.logaddexp(gg + last, bg) - np.logaddexp(gb + last, bb)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        here = odds[at] + bwd[at]
        bwd[at - 1] = np.logaddexp(gg + here, gb) - np.logaddexp(bg + here, bb)
    return fwd, bwd


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class LineCrf:
    weights: np.ndarray | None = None
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (0.0, 0.0)
    constant: float | None = 0.5

    def marginals(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        fwd, bwd = messages(x @ self.weights, self.trans, per_text)
        return _sigmoid(fwd + bwd)

    def learn(self, x: np.ndarray, per_text: np.ndarray, good: np.ndarray, steps: int = 100, rate: float = 0.1, decay: float = 1e-3) -> None:
        """Adam on the log likelihood of the lines' labels."""
        first = np.cumsum(per_text) - per_text
        inner = np.ones(len(x), bool)
        inner[first] = False
        to = np.flatnonzero(inner)  # lines with a line before them in their text
        seen = np.bincount(2 * good[to - 1] + good[to], minlength=4).reshape(2, 2)
        theta = np.concatenate([self.weights if self.weights is not None else np.zeros(x.shape[1]), self.trans.ravel()])
        mean, var = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            odds = x @ w
            fwd, bwd = messages(odds, trans, per_text)
            here, last = odds[to] + bwd[to], fwd[to - 1]
            joint = np.stack([np.full(len(to), trans[0, 0]), trans[0, 1] + here, trans[1, 0] + last, trans[1, 1] + last + here], 1)
            joint = np.exp(joint - joint.max(1, keepdims=True))
            expected = (joint / joint.sum(1, keepdims=True)).sum(0) if len(to) else np.zeros(4)
            grad = np.concatenate([x.T @ (good - _sigmoid(fwd + bwd)), seen.ravel() - expected]) / len(x) - decay * theta
            mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
            theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
        self.weights, self.trans = theta[:-4], theta[-4:].reshape(2, 2)

    def good_share(self, texts: list[str | None]) -> np.ndarray:
        x, size, per_text = line_features(texts)
        return _weighted(self.marginals(with_neighbours(x, per_text), per_text), size, per_text)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.constant)
        return _sigmoid(self.curve[0] + self.curve[1] * self.good_share(texts))


def _weighted(good: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    first = np.cumsum(per_text) - per_text
    weight = size + 1e-6
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def train(x: np.ndarray, size: np.ndarray, per_text: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 2) -> LineCrf:
    """A model from line features of labelled texts; `weight` restores the classes' shares for the curve."""
    model, wide = LineCrf(), with_neighbours(x, per_text)
    first = np.cumsum(per_text) - per_text
    of = np.repeat(np.arange(len(per_text)), per_text)
    good = label[of].astype(np.int64)
    model.learn(wide, per_text, good)
    for _ in range(rounds):
        p = model.marginals(wide, per_text)
        worst = p <= np.minimum.reduceat(p, first)[of]
        good = np.where(label[of] == 1, 1, (p >= 0.5) & ~worst).astype(np.int64)
        model.learn(wide, per_text, good, steps=50)
    share = _weighted(model.marginals(wide, per_text), size, per_text)
    design, beta = np.stack([np.ones_like(share), share], 1), np.zeros(2)
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        p = _sigmoid(design @ beta)
        hess = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, design.T @ (weight * (label - p)) - 1e-2 * beta)
        beta = beta + np.clip(move, -5, 5)
    model.curve, model.constant = (float(beta[0]), float(beta[1])), None
    return model


def fit(docs: DataFrame, labels: DataFrame, texts_per_label: int = 1000, lines_per_text: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCrf:
    """Learn from the labelled rows of docs; about `texts_per_label` texts of each label, drawn by a hash of the id (the
    documented bound of the sample). Texts of over `lines_per_text` lines are scored like any others, but nothing is learned from them:
    features are made on the executors, and the driver gets 52 bytes a line of at most 2 * texts_per_label * lines_per_text lines."""
    text_batches(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    labelled = docs.select(F.col(id_col).alias("id")).join(marks, "id")  # without the texts
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return LineCrf(constant=sizes.get(1, 0) / total if total else 0.5)
    chance = F.when(F.col("label") == 1, min(1.0, texts_per_label / sizes[1])).otherwise(min(1.0, texts_per_label / sizes[0]))
    drawn_ids = labelled.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(1 << 24)) < chance * (1 << 24)).distinct()
    drawn_ids = docs.sparkSession.createDataFrame(drawn_ids.collect(), drawn_ids.schema)  # about 2 * texts_per_label ids
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn_ids), "id")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[(t or "").count("\n") < lines_per_text for t in batch["text"]]]
            x, size, per_text = line_features(batch["text"].tolist())
            if not len(batch):
                continue
            cuts = np.cumsum(per_text)[:-1]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "x": [a.tobytes() for a in np.split(x, cuts)], "size": [a.tobytes() for a in np.split(size, cuts)]})

    id_type = sample.schema["id"].dataType.simpleString()
    got = sample.select("id", "label", "text").mapInPandas(lines, f"id {id_type}, label int, x binary, size binary").collect()
    got.sort(key=lambda r: (str(r["id"]), r["label"], r["size"], r["x"]))  # one order at any partitioning
    if len({r["label"] for r in got}) < 2:
        return LineCrf(constant=sizes[1] / total)
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, len(LINE_FEATURES)).astype(float)
    size = np.frombuffer(b"".join(r["size"] for r in got), np.int64)
    label = np.array([r["label"] for r in got])
    drawn = np.bincount(label, minlength=2)
    weight = np.where(label == 1, sizes[1] / drawn[1], sizes[0] / drawn[0]) * len(got) / total
    return train(x, size, np.array([len(r["size"]) // 8 for r in got]), label, weight)


def score(docs: DataFrame, model: LineCrf, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold)."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.drop("score", "predicted").withColumn("score", of(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
