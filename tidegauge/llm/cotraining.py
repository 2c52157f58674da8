"""Quality classifier by co-training.

Two views of a document: its content (presence of hashed character n-grams, repetition of words and
characters) and its page metadata (source, language, length and line layout). A logistic regression
per view is fitted on a bounded sample of labelled rows. Over some rounds each view scores every
unlabelled document, and the ones it is surest of, dealt evenly over sources and languages, are what
the other view learns from. On labelled rows kept aside both are calibrated (Platt) and their
log-odds combined by a further regression.
Every document is scored; the cutoff lies below all but ``LOST`` of the good labelled rows that were
not fitted on.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from tidegauge.llm.common import CHUNK_ROWS, map_rows, unit_hash
from tidegauge.session import spool

#: Labelled rows to learn from, picked by a hash of the id.
LABELLED = 3000
ROUNDS = 4
#: Pseudo-labels that a view may give per round, and the probability from which it is sure.
GIVEN = 300
SURE = 0.98
#: Part of the labelled rows kept aside for calibration and the cutoff.
ASIDE = 0.3
#: Largest part of the good labelled rows not fitted on that the cutoff may lose.
LOST = 0.002
WIDTH = 1 << 12
META_WIDTH = 1 << 8

FEATURES = "doc_id long, content binary, dense array<double>, meta binary, source string, lang string"
SURE_SCHEMA = "view int, quality int, source string, lang string, odds double, doc_id long"


def content(text: str) -> tuple[np.ndarray, list[float]]:
    """Presence of hashed n-grams of 1 to 3 characters, and dense features of repetition and shape."""
    marks = np.zeros(WIDTH, bool)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    gram = np.full(len(points), 11, np.uint64)
    for n in range(min(3, len(points))):
        gram = gram[:len(points) - n] * np.uint64(0x100000001B3) + points[n:] + np.uint64(1)
        marks[(gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)] = True
    words = text.split()
    n_words, n_chars = max(1, len(words)), max(1, len(points))
    again = sum(map(str.__eq__, words, words[1:]))
    letters = ((points | np.uint64(32)) - np.uint64(97) < 26) | (points >= 192)
    upper = np.count_nonzero(points - np.uint64(65) < 26)
    spaces = np.count_nonzero(points == 32)
    marked = len(points) - np.count_nonzero(letters) - spaces
    return marks, [again / n_words, len(set(words)) / n_words, upper / n_chars, marked / n_chars,
                   text.count("!") / n_words, np.count_nonzero(marks) / WIDTH]


def metadata(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """Indicators of source, language, length class and line layout, hashed."""
    marks = np.zeros(META_WIDTH, bool)
    n_lines = text.count("\n") + 1
    per_line = len(text) / n_lines
    for feature in (f"source={source}", f"lang={lang}", f"length={int(2 * math.log2(len(text) + 1))}",
                    f"lines={int(2 * math.log2(n_lines))}", f"per_line={int(2 * math.log2(per_line + 1))}"):
        marks[xxh64_intdigest(feature.encode("utf-8", "replace")) % META_WIDTH] = True
    return marks


def _features(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.coalesce("text", F.lit("")).alias("text"),
                       F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights, bias last, by accelerated gradient; both classes weigh the same. ``x`` is not copied."""
    share = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(x.dtype)

    def back(r):
        return np.r_[x.T @ r, r.sum()].astype(float)
    # Lipschitz bound of the gradient by a few power iterations
    v, size = np.ones(x.shape[1] + 1), 1.0
    for _ in range(20):
        v = back(share * _score(x, v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    rate = 1 / (0.3 * size + ridge)
    w = u = np.zeros(x.shape[1] + 1)
    for t in range(steps):
        step = u - rate * (back(share * (_sigmoid(_score(x, u)) - y).astype(x.dtype)) + ridge * u)
        w, u = step, step + t / (t + 3) * (step - w)
    return w


def _score(x, w):
    return x @ w[:-1].astype(x.dtype) + w[-1]


@dataclass
class Model:
    content: np.ndarray
    meta: np.ndarray
    combine: np.ndarray
    cutoff: float
    given: int

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Combined probability of good quality from the feature rows of both views."""
        odds = np.c_[_score(content, self.content), _score(meta, self.meta)]
        return _sigmoid(_score(odds, self.combine))

    def score_one(self, text: str, source: str | None, lang: str | None) -> float:
        marks, dense = content(text)
        x = np.r_[marks / np.sqrt(max(1, np.count_nonzero(marks))), dense]
        meta = metadata(text, source, lang)
        return float(self.score(x[None], (meta / np.sqrt(max(1, np.count_nonzero(meta))))[None])[0])


def aside_rows(quality: np.ndarray) -> np.ndarray:
    """Which rows are kept aside: they come in a fixed order, and every k-th of each class is."""
    aside = np.zeros(len(quality), bool)
    for c in (0, 1):
        own = np.flatnonzero(quality == c)
        aside[own[::max(2, round(1 / ASIDE))]] = True
    return aside


def co_train(content: np.ndarray, meta: np.ndarray, quality: np.ndarray, ask: Callable,
             rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """Model from feature rows of both views and their ``quality`` (1 or 0).

    ``ask(weights, told, most)`` gives per view the rows ``doc_id, quality, content, meta`` (features)
    it tells the other one: of the unlabelled documents it is sure of, without those ``told`` to that
    other view before (ids), at most ``most[c]`` of class ``c``.
    """
    views = (content, meta)
    aside = aside_rows(quality)
    own = np.flatnonzero(~aside)
    told = [{}, {}]  # by the view that learns: id to class and feature row

    def fitted(v):
        new = list(told[v].values())
        x = np.concatenate([views[v][own], np.array([x for _, x in new], views[v].dtype).reshape(-1, views[v].shape[1])])
        return fit_logistic(x, np.r_[quality[own], [c for c, _ in new]].astype(float))
    weights, n_given = [fitted(0), fitted(1)], 0
    # as many of each class as the labelled rows have
    good = round(given * np.mean(quality[own]))
    for _ in range(rounds):
        answers = ask(weights, [sorted(t) for t in told], {1: good, 0: given - good})
        if not any(answers):
            break
        for v in (0, 1):
            told[1 - v] |= {r[0]: (r[1], r[2 + 1 - v]) for r in answers[v]}
            n_given += len(answers[v])
        weights = [fitted(0), fitted(1)]
    kept = np.flatnonzero(aside)
    odds = np.c_[_score(content[kept], weights[0]), _score(meta[kept], weights[1])]
    y = quality[kept].astype(float)
    # Platt: slope and offset of each view's log-odds on rows it has not seen, then their mix
    platt = [fit_logistic(odds[:, [v]], y) for v in (0, 1)]
    calibrated = np.c_[_score(odds[:, [0]], platt[0]), _score(odds[:, [1]], platt[1])]
    mixed = fit_logistic(calibrated, y)
    for v in (0, 1):  # a view that says nothing must not count against the other
        if mixed[v] < 0:
            mixed = np.zeros(3)
            mixed[[1 - v, 2]] = fit_logistic(calibrated[:, [1 - v]], y)
    combine = np.array([mixed[0] * platt[0][0], mixed[1] * platt[1][0],
                        mixed[0] * platt[0][1] + mixed[1] * platt[1][1] + mixed[2]])
    model = Model(weights[0], weights[1], combine, 0.0, n_given)
    return model


def cutoff(rows: DataFrame, model: Model, fitted: DataFrame) -> float:
    """The score that all but ``LOST`` of the good labelled ``rows`` (features and ``quality``) reach,
    those with ids in ``fitted`` left out; never above even odds, 0 where no such row is left."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                marks, dense, meta = (c.to_pylist() for c in batch.slice(at, CHUNK_ROWS).columns)
                odds = np.c_[_by_row(marks, model.content, np.array(dense)), _by_row(meta, model.meta)]
                yield pa.RecordBatch.from_arrays([pa.array(_sigmoid(_score(odds, model.combine)))], ["score"])
    left = rows.where("quality = 1").join(F.broadcast(fitted), "doc_id", "left_anti")
    found = left.select("content", "dense", "meta").mapInArrow(run, "score double").agg(
        F.percentile_approx("score", LOST, 100_000)).first()[0]
    return 0.0 if found is None else float(min(0.5, found))


def _matrix(packed: list[bytes], width: int, dense: list | None = None) -> np.ndarray:
    """Feature rows in single precision: presence, of length 1, and the dense features after it."""
    dense = np.array(dense) if dense else np.zeros((len(packed), 0))
    x = np.zeros((len(packed), width + dense.shape[1]), np.float32)
    x[:, :width] = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width // 8), axis=1)
    x[:, :width] /= np.sqrt(np.maximum(x[:, :width].sum(1, keepdims=True), 1))
    x[:, width:] = dense
    return x


def _by_row(packed: list[bytes], w: np.ndarray, dense: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of packed feature rows, each summed by itself: the same in whatever batch it comes."""
    bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)
    width = bits.shape[1]
    z = (bits * w[:width]).sum(axis=1) / np.sqrt(np.maximum(bits.sum(axis=1, dtype=np.int64), 1)) + w[-1]
    return z if dense is None else z + (dense * w[width:-1]).sum(axis=1)


def surest(rows: DataFrame, weights: list[np.ndarray], told: list[list[int]], most: dict[int, int],
           sure: float = SURE) -> DataFrame:
    """``view, quality, doc_id`` of the unlabelled ``rows`` (FEATURES) that each view is sure of.

    Every row is scored. Per view and class the surest of each source and language come first, then
    the second of each, up to ``most[class]``; ids of ``told[v]`` are not told to view ``v`` again.
    A task hands on at most that many rows per view, class, source and language.
    """
    shared = rows.sparkSession.sparkContext.broadcast((weights, [set(t) for t in told]))  # bounded by GIVEN
    limit = math.log(sure / (1 - sure))
    schema = pa.schema([("view", pa.int32()), ("quality", pa.int32()), ("source", pa.string()), ("lang", pa.string()),
                        ("odds", pa.float64()), ("doc_id", pa.int64())])

    def run(batches):
        weights, told = shared.value
        best = defaultdict(list)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                ids, marks, dense, meta, source, lang = (c.to_pylist() for c in batch.slice(at, CHUNK_ROWS).columns)
                for v, z in enumerate((_by_row(marks, weights[0], np.array(dense)), _by_row(meta, weights[1]))):
                    for i in np.flatnonzero(np.abs(z) >= limit):
                        c = int(z[i] > 0)
                        if ids[i] in told[1 - v] or not most[c]:
                            continue
                        heap, item = best[v, c, source[i], lang[i]], (abs(float(z[i])), ids[i])
                        (heapq.heappush if len(heap) < most[c] else heapq.heappushpop)(heap, item)
        found = [(*k, *item) for k, heap in best.items() for item in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
    found = rows.select("doc_id", "content", "dense", "meta", "source", "lang").mapInArrow(run, SURE_SCHEMA)
    order = [F.col("odds").desc(), F.col("doc_id").desc()]
    w = Window.partitionBy("view", "quality", "source", "lang").orderBy(*order)
    # the limit comes before the table is written, so that tasks hand on only what can be taken
    found = spool(found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(most.values())))
    picked = [found.where((F.col("view") == v) & (F.col("quality") == c) & (F.col("place") <= n))
              .orderBy("place", *order).limit(n) for v in (0, 1) for c, n in most.items()]
    return picked[0].union(picked[1]).union(picked[2]).union(picked[3]).select("view", "quality", "doc_id")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Model from a bounded sample of labelled rows and all documents without a label; None where the
    labels do not hold both classes. A document with contradicting labels has none; of rows that share
    an id the first by their features is learned from."""
    marked = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
              .agg(F.min("quality").alias("quality"), F.max("quality").alias("_high"))
              .where("quality = _high").select(F.col("doc_id").cast("long").alias("doc_id"),
                                               F.col("quality").cast("int").alias("quality")))

    def start():
        def one(doc_id, text, source, lang):
            marks, dense = content(text)
            return [(doc_id, np.packbits(marks).tobytes(), dense,
                     np.packbits(metadata(text, source, lang)).tobytes(), source, lang)]
        return one
    rows = map_rows(_features(docs.where("doc_id IS NOT NULL")), FEATURES, start)
    # one row per id, however often it repeats
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("content", "dense", "meta", "source", "lang")).alias("_r"))
    rows = spool(rows.join(marked, "doc_id", "left").select("doc_id", "_r.*", "quality"))
    counts = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}  # three rows at most
    if not counts.get(0) or not counts.get(1):
        return None
    u = unit_hash("doc_id", seed=2)
    # half of each class: both need enough rows to be calibrated
    part = F.when(F.col("quality") == 1, F.lit(labelled / 2 / counts[1])).otherwise(F.lit(labelled / 2 / counts[0]))
    # rows of the sample: their number is bounded by the parameter
    sample = (rows.where("quality IS NOT NULL").where(u < part).orderBy(u, "doc_id").limit(labelled)
              .select("doc_id", "quality", "content", "dense", "meta").collect())
    sample = sorted(sample, key=lambda r: xxh64_intdigest(str(r[0])))
    if not sample:
        return None
    unlabelled = rows.where("quality IS NULL")

    def ask(weights, told, most):
        picked = [tuple(r) for r in surest(unlabelled, weights, told, most).collect()]  # 2 * GIVEN at most
        ids = docs.sparkSession.createDataFrame([(i,) for i in sorted({r[2] for r in picked})], "doc_id long")
        found = sorted(map(tuple, unlabelled.join(F.broadcast(ids), "doc_id").select(
            "doc_id", "content", "dense", "meta").collect())) if picked else []
        marks = _matrix([r[1] for r in found], WIDTH, [r[2] for r in found]) if found else ()
        meta = _matrix([r[3] for r in found], META_WIDTH) if found else ()
        place = {r[0]: i for i, r in enumerate(found)}
        return [[(i, c, marks[place[i]], meta[place[i]]) for v, c, i in sorted(picked) if v == view] for view in (0, 1)]
    quality = np.array([r[1] for r in sample])
    model = co_train(_matrix([r[2] for r in sample], WIDTH, [r[3] for r in sample]),
                     _matrix([r[4] for r in sample], META_WIDTH), quality, ask)
    kept = aside_rows(quality)
    fitted = docs.sparkSession.createDataFrame(  # bounded by ``labelled``
        [(r[0],) for r, aside in zip(sample, kept) if not aside] or [(None,)], "doc_id long")
    model.cutoff = cutoff(rows, model, fitted)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, kept`` per row of ``docs`` (``doc_id, text, source, lang``).

    ``score`` is the combined probability of good quality, ``kept`` whether it reaches the model's
    cutoff. Nulls count as an empty text or as a value of their own; repeated rows and null ids stay;
    other columns are ignored. Without a model every score is null and every row is kept. An empty table
    gives an empty one.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"),
                           F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one weight per feature

    def start():
        model = shared.value

        def one(doc_id, text, source, lang):
            p = model.score_one(text, source, lang)
            return [(doc_id, p, p >= model.cutoff)]
        return one
    return map_rows(_features(docs), "doc_id long, score double, kept boolean", start)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose score reaches the cutoff, all columns as they were."""
    model = train(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(text: pd.Series, source: pd.Series, lang: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score_one(t or "", s, g) >= model.cutoff for t, s, g in zip(text, source, lang)],
                         dtype=bool)
    return docs.where(kept("text", F.col("source").cast("string"), F.col("lang").cast("string")))
