"""Language identification with a string kernel.

A text is the set of its character n-grams of 1 to ``ORDER`` characters (blended spectrum, presence
only), hashed to ``WIDTH`` places; the kernel of two texts is the number of shared n-grams over the
geometric mean of their numbers. Landmarks give a Nyström map, on which one ridge regression per
language is fitted (one versus rest). Up to the factor of the text's own norm the kernel with a
landmark is linear in the presence vector, so landmarks, whitening and ridge weights fold into one
``WIDTH`` x languages matrix, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegauge.llm.common import id_text, map_rows, unit_hash

ORDER = 4
WIDTH = 1 << 16
#: Texts to fit on, over all languages, as a hash of the id picks them; the rest is never needed.
SAMPLE = 2000
#: Languages learned: the most frequent ones. Bounds the sample, the landmarks and the weights.
LANGUAGES = 256
#: Texts of the sample that serve as landmarks.
LANDMARKS = 256
RIDGE = 1e-3
#: Texts scored by one product.
BATCH = 64
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Boolean vector of the hashed n-grams of the lower-cased text."""
    marks = np.zeros(WIDTH, bool)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    gram = np.full(len(points), 7, np.uint64)
    for n in range(min(ORDER, len(points))):
        # rolling: an n-gram's hash from that of its first n-1 characters
        gram = gram[:len(points) - n] * np.uint64(0x100000001B3) + points[n:] + np.uint64(1)
        marks[(gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)] = True
    return marks


def held_out() -> Column:
    """Whether a document is kept from learning: CRC-32 of its id, as text, modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _kernel(packed: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    out = []
    for at in range(0, len(packed), BATCH):
        x = np.unpackbits(np.frombuffer(b"".join(packed[at:at + BATCH]), np.uint8)
                          .reshape(-1, WIDTH // 8), axis=1).astype(np.float32)
        out.append((x @ landmarks.T) / np.sqrt(np.maximum(np.outer(x.sum(1), landmarks.sum(1)), 1)))
    return np.concatenate(out).astype(np.float64)


def fit(sample: list[tuple[str, bytes]], n_landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """Languages and ``WIDTH`` x languages weights from ``(language, packed presence)`` rows."""
    languages = sorted({lang for lang, _ in sample})
    by_lang = {c: [p for lang, p in sample if lang == c] for c in languages}
    per = max(1, n_landmarks // len(languages))
    chosen = [p for c in languages for p in by_lang[c][:per]]
    marks = np.unpackbits(np.frombuffer(b"".join(chosen), np.uint8).reshape(-1, WIDTH // 8),
                          axis=1).astype(np.float32)
    values, vectors = np.linalg.eigh(_kernel(chosen, marks))
    good = values > values.max() * 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = _kernel([p for _, p in sample], marks) @ whiten
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for lang, _ in sample])
    # every language weighs the same, however many texts the sample has of it
    weight = np.array([1.0 / len(by_lang[lang]) for lang, _ in sample])
    gram = (z * weight[:, None]).T @ z + ridge * np.eye(z.shape[1])
    solved = whiten @ np.linalg.solve(gram, (z * weight[:, None]).T @ y)
    folded = (marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T @ solved
    return languages, folded


def train(docs: DataFrame, sample: int = SAMPLE, n_landmarks: int = LANDMARKS, most: int = LANGUAGES):
    """Model from the rows of ``docs`` (``doc_id, text, lang``) that are not held out.

    Rows without an id, language or letter teach nothing, nor do languages beyond the ``most`` of most
    ids (ties: the first by name). The sample is bounded by ``sample``, in equal parts per language, at
    least 4 texts each (a part that one language cannot fill stays unfilled); of rows that share an id
    and a language only the first by text teaches.
    """
    usable = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    ids = usable.select("lang", "doc_id").distinct()
    by_size = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = {r[0]: r[1] for r in by_size.limit(most).collect()}
    if not counts:
        return [], np.zeros((WIDTH, 0))
    part = max(4.0, sample / len(counts))
    share = F.try_element_at(F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, part / n))),
                         F.col("lang"))
    chosen = id_text(usable.where(unit_hash("doc_id", seed=5) < share), "lang")
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")

    def start():
        return lambda doc_id, text, lang: ([(doc_id, lang, np.packbits(presence(text)).tobytes())]
                                           if has_letter(text) else [])
    rows = map_rows(chosen, "doc_id long, lang string, marks binary", start).collect()
    ordered = sorted(((r.doc_id, r.lang, bytes(r.marks)) for r in rows))
    if not ordered:
        return [], np.zeros((WIDTH, 0))
    return fit([(lang, marks) for _, lang, marks in ordered], n_landmarks)


def predict(docs: DataFrame, model) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs`` (``doc_id, text``).

    ``score`` is the winning regression value brought from [-1, 1] to [0, 1], at nine digits, which do
    not depend on the batch a text comes in; ties go to the first language. A text that is null, empty or without a letter is ``und`` with score 0, as is every
    text under a model that has learned nothing. Repeated rows and null ids stay; other columns are
    ignored; whole texts are read. An empty table gives an empty one.
    """
    languages, weights = model
    # WIDTH x languages: fixed by the model, whatever the number of documents
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    target = to_arrow_schema(T.StructType.fromDDL(PREDICTED))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids, texts = (c.to_pylist() for c in batch.slice(at, BATCH).columns)
                x = np.stack([presence(t) for t in texts]).astype(float)
                scores = ((x @ shared.value) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))).round(9)
                rows = [(i, languages[s.argmax()], round(float(min(1, max(0, (s.max() + 1) / 2))), 9))
                        if languages and has_letter(t) else (i, UNKNOWN, 0.0)
                        for i, t, s in zip(ids, texts, scores)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return id_text(docs).mapInArrow(run, PREDICTED)
