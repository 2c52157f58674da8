"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A text is cut into
windows that begin at a word; a window is compressed with either dictionary, and where the toxic one
saves at least a threshold of bytes the window is a hit. Thresholds, one per window size, and the
weights that turn a text's hits into a probability are calibrated on labelled rows kept aside.

* A match costs zstandard some four bytes, as much as a short word's letters. So a window is written as
  four-byte codes of its prefixes of 2, 3, ... bytes: a match is a common beginning, and lengths count
  the letters that a dictionary does not hold.
* Toxic texts consist mostly of ordinary words. The toxic dictionary is trained on those of their
  windows, at the smallest size, that are many times as frequent among toxic texts.

Windows are integers, and every distinct one is compressed once a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import id_text, map_rows, unit_hash
from tidegauge.llm.cotraining import fit_logistic

#: Bytes of a window: the space before a word and what follows it.
SIZES = (5, 7, 9)
#: Labelled rows to learn from, per class, picked by a hash of the id; and windows of each.
TOXIC, ORDINARY, WINDOWS = 2000, 5000, 2048
#: Bytes of the dictionaries, and of the pieces counted while training (a segment is a window).
TOXIC_BYTES, ORDINARY_BYTES, DMER = 16384, 65536, 8
#: Ordinary windows that a dictionary is trained on, evenly spaced.
PLAIN = 300_000
LEVEL = 3
#: A window teaches toxicity where so many times the share of toxic texts has it as of others, and at
#: least so many toxic texts and such a share of them.
LIFT, FEWEST, SHARE = 30.0, 3, 0.02
#: A threshold holds where windows of toxic texts reach it so many times as often as others.
ODDS = 50
#: Score from which a text is predicted to be toxic.
CUTOFF = 0.3
#: Windows whose outcome a task remembers, and rows scored at a time.
MEMO, BATCH = 1 << 19, 64
SCORED = "doc_id long, score double, predicted int"

#: Letters and digits in lower case, other ASCII as spaces; bytes of other characters stay.
_PLAIN = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))



def windows(text: str) -> np.ndarray:
    """The 16 bytes from before each word, rows of two integers whose low bytes come first."""
    packed = b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())
    a = np.frombuffer(b" " + packed + b" " * 16, np.uint8)
    starts = np.flatnonzero((a[:-16] == 32) & (a[1:-15] != 32))
    keys = np.zeros((len(starts), 2), np.uint64)
    for i in range(16):
        keys[:, i // 8] |= a[starts + i].astype(np.uint64) << np.uint64(8 * (i % 8))
    return keys


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(keys: np.ndarray, size: int) -> np.ndarray:
    """One integer per window cut to ``size`` bytes (from more than 8 on a hash)."""
    if size <= 8:
        return _mixed(keys[:, 0] & np.uint64((1 << 8 * size) - 1))
    return _mixed(_mixed(keys[:, 0]) ^ (keys[:, 1] & np.uint64((1 << 8 * (size - 8)) - 1)))


def coded(keys: np.ndarray, size: int) -> list[bytes]:
    """Windows in the code that is compressed: a hash of each of their prefixes."""
    codes = np.stack([cut(keys, n) >> np.uint64(32) for n in range(2, size + 1)], axis=1)
    data, width = codes.astype("<u4").tobytes(), 4 * (size - 1)
    return [data[i:i + width] for i in range(0, len(data), width)]


def held_out() -> Column:
    """Whether a document is kept from learning: CRC-32 of its id, as text, modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


NONE, NO_SAVING = np.empty((0, 2), np.uint64), np.empty(0, np.int64)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: dict[int, int]
    weights: np.ndarray

    def scorer(self):
        return Scorer(self)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained dictionary of at most ``size`` bytes; of few samples a smaller one, or themselves."""
    import zstandard

    while size >= 512:
        try:
            return zstandard.train_dictionary(size, samples, k=4 * (SIZES[-1] - 1), d=DMER, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(dict.fromkeys(samples))[-512:]


def _length(data: bytes):
    """Function from a window to its length when compressed with the dictionary ``data``."""
    import zstandard

    known = zstandard.ZstdCompressionDict(data) if data else None  # raw content if not a trained dictionary
    if known:
        known.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False,
                                        write_dict_id=False, write_checksum=False).compress
    return lambda window: len(compress(window))


class Scorer:
    """Holds compressors and remembered windows of one task."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {size: {} for size in SIZES}
        self.lengths = _length(model.ordinary), _length(model.toxic)
        # what a window takes in which nothing matches, and no dictionary can make it longer
        noise = np.arange(1, 3, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        self.flat = {size: _length(b"")(coded(noise, size)[0]) for size in SIZES}

    def savings(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, per window; 0 where it finds no
        match, since it cannot save any there."""
        distinct, first, back = np.unique(cut(keys, size), return_index=True, return_inverse=True)
        memo = self.memo[size]
        if len(memo) >= MEMO:
            memo.clear()
        ordinary, toxic = self.lengths
        distinct = distinct.tolist()
        new = [i for i, k in enumerate(distinct) if k not in memo]
        flat = self.flat[size]
        for i, w in zip(new, coded(keys[first[new]], size)):
            n = toxic(w)
            memo[distinct[i]] = ordinary(w) - n if n < flat else 0
        return np.array([memo[k] for k in distinct], np.int64)[back]

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        """Per text of windows: logarithms of its hits per window size and of its windows."""
        owner = np.repeat(np.arange(len(texts)), [len(k) for k in texts])
        keys = np.concatenate([NONE, *texts])
        columns = [np.bincount(owner[self.savings(keys, size) >= least], minlength=len(texts))
                   for size, least in self.model.thresholds.items()]
        columns.append(np.bincount(owner, minlength=len(texts)))
        return np.log1p(np.array(columns, float)).T

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        x = self.features(texts)
        # each row summed by itself: the same in whatever batch it comes
        z = (x * self.model.weights[:-1]).sum(axis=1) + self.model.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _telling(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> list[bytes]:
    """Coded windows of the toxic texts that are far more frequent there, by any size."""
    every, out = np.concatenate(toxic), []
    for size in SIZES:
        found, n = np.unique(np.concatenate([np.unique(cut(k, size)) for k in toxic]), return_counts=True)
        others, m = np.unique(np.concatenate([np.unique(cut(k, size)) for k in ordinary]), return_counts=True)
        at = np.minimum(np.searchsorted(others, found), max(0, len(others) - 1))
        m = np.where(others[at] == found, m[at], 0) if len(others) else np.zeros(len(found))
        lift = n / len(toxic) / ((m + 0.5) / len(ordinary))
        told = found[(lift >= LIFT) & (n >= max(FEWEST, SHARE * len(toxic)))]
        here = np.isin(cut(every, size), told)
        out += coded(every[here], SIZES[-1])
        every = every[~here]
    return out


def fit(toxic: list[np.ndarray], ordinary: list[np.ndarray], prior: float) -> Model | None:
    """Model from the windows of toxic and ordinary texts; ``prior`` are the odds of a toxic label.
    Every second text of a class is kept aside for calibration. None where a part has no text, or
    nothing sets the classes apart."""
    aside = toxic[1::2], ordinary[1::2]
    toxic, ordinary = toxic[::2], ordinary[::2]
    if not all(map(len, (toxic, ordinary, *aside))):
        return None
    told, plain = _telling(toxic, ordinary), np.concatenate(ordinary)
    if not told or not len(plain):
        return None
    plain = plain[::-(-len(plain) // PLAIN)]
    model = Model(_dictionary(coded(plain, SIZES[-1]), ORDINARY_BYTES), _dictionary(told, TOXIC_BYTES), {}, np.zeros(0))
    scorer = model.scorer()
    for size in SIZES:
        saved = [np.concatenate([NO_SAVING, *(scorer.savings(k, size) for k in part)]) for part in aside]
        for least in range(1, 4 * size):
            hits = [(s >= least).sum() / len(part) for s, part in zip(saved, aside)]
            if not hits[0]:
                break
            if hits[0] > ODDS * hits[1]:
                model.thresholds[size] = least
                break
    x = np.concatenate([scorer.features(part) for part in aside])
    y = np.repeat([1.0, 0.0], [len(part) for part in aside])
    model.weights = fit_logistic(x, y, ridge=1e-4, steps=2000)
    model.weights[-1] += np.log(prior)  # both classes weighed the same
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from a bounded sample of the labelled rows that are not held out: at most TOXIC and
    ORDINARY documents by a hash of their ids, and WINDOWS windows, evenly spaced, of each.

    Ids that are null, without a label of 0 or 1, or with both teach nothing; of rows that share an id
    the first by text is learned from. None where a class is missing or nothing sets them apart.
    """
    marked = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_high"))
              .where("toxic = _high").select("doc_id", "toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return None
    u = unit_hash("doc_id", seed=11)
    picked = [marked.where(f"toxic = {c}").where(u < 2 * most / counts[c]).orderBy(u, "doc_id").limit(most)
              for c, most in ((1, TOXIC), (0, ORDINARY))]
    sample = picked[0].union(picked[1])  # TOXIC + ORDINARY ids at most
    texts = id_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def start():
        def one(doc_id, toxic, text):
            keys = windows(text)
            return [(doc_id, toxic, keys[::max(1, -(-len(keys) // WINDOWS))].tobytes())]
        return one
    rows = map_rows(texts, "doc_id long, toxic int, keys binary", start).collect()
    rows.sort(key=lambda r: r.doc_id)
    parts = {c: [np.frombuffer(r.keys, np.uint64).reshape(-1, 2) for r in rows if r.toxic == c] for c in (0, 1)}
    return fit(parts[1], parts[0], counts[1] / counts[0])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, predicted`` per row of ``docs`` (``doc_id, text``).

    ``score`` is the probability that the label is 1, ``predicted`` 1 from CUTOFF on. Null and empty
    texts, and texts without a letter or digit, have no window and the score of a text without a hit.
    Without a model every score is 0. Repeated rows and null ids stay; other columns are ignored; whole
    texts are read. An empty table gives an empty one.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"),
                           F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids, texts = batch.slice(at, BATCH).columns
                p = scorer.score([windows(t) for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(p), pa.array(p >= CUTOFF).cast(pa.int32())], ["doc_id", "score", "predicted"])
    return id_text(docs).mapInArrow(run, SCORED)
