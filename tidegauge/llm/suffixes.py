"""Repeated passages by a sparse suffix array.

Suffixes are kept only where they start at a minimiser: the least hash of ``GRAM`` words among
``WINDOW`` neighbouring ones. A passage of ``length`` words that occurs twice has, within its first
``WINDOW`` words, the same minimiser in both places, and from there at least ``length - WINDOW + 1``
words in common. So the suffixes, sorted by the hash of that many first words, show a repeated
passage as neighbours with an equal prefix; the sort is by ranges of prefix, text and position, which
split a prefix that many texts share. Matches are then extended: for each kept suffix with an equal
neighbour the windows of ``length`` words around it, as far left as its minimiser reaches, are
compared with those of all other such suffixes, again by hash, so that a match counts exactly if
``length`` words are equal. Windows that touch join into passages.

Texts that are equal as a whole are one text here; copies take the whole text as their passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import WORD, id_text, map_rows
from tidegauge.operators.joins import null_safe_join
from tidegauge.session import spool

LENGTH = 50
WINDOW = 16
GRAM = 8
#: Distinct words whose hashes a task remembers; beyond it the memory starts anew.
CACHE_SIZE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest
        value = self[word] = xxh64_intdigest(word, 7)
        return value


class TextHashes:
    """Hashes of a text's word windows, from prefix sums modulo 2^64."""

    def __init__(self, text: str, memory: _Hashes):
        if len(memory) > CACHE_SIZE:
            memory.clear()
        words = text.encode("utf-8").split()
        self.n = len(words)
        values = np.fromiter(map(memory.__getitem__, words), np.uint64, self.n)
        powers = np.full(self.n, _BASE)
        back = np.full(self.n, _INVERSE)
        if self.n:
            powers[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(values * np.multiply.accumulate(powers), dtype=np.uint64)]

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Mixed 64-bit hash of the ``length`` words from each start."""
        x = (self.sums[starts + length] - self.sums[starts]) * self.back[starts]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(29))

    def minimisers(self, length: int) -> np.ndarray:
        """For every start of ``length`` words, the kept suffix that stands for it."""
        starts = np.arange(max(0, self.n - length + 1))
        if not len(starts):
            return starts
        grams = self.of(np.arange(len(starts) + WINDOW - 1), GRAM)
        least = np.lib.stride_tricks.sliding_window_view(grams[::-1], WINDOW)[::-1].argmin(axis=1)
        return starts + WINDOW - 1 - least  # rightmost of equal ones


def kept_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``prefix, text_hash, at``: hash of the first words, hash of the text, word position."""
    schema = pa.schema([("prefix", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32())])

    def run(batches):
        memory = _Hashes()
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                out = []
                for text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    hashes = TextHashes(text, memory)
                    at = np.unique(hashes.minimisers(length))
                    out.append((hashes.of(at, length - WINDOW + 1).view(np.int64),
                                np.full(len(at), text_hash, np.int64), at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    texts = id_text(docs).select(F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, "prefix long, text_hash long, at int")


def _equal_neighbours(batches):
    """Of sorted rows, those whose prefix equals that of the row before or after, and the first and
    last of the partition, whose neighbours are elsewhere; repeated rows count once."""
    schema = pa.schema([("text_hash", pa.int64()), ("at", pa.int32())])
    held, before = None, True
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.r_[h, c] for h, c in zip(held, rows)]
        if not len(rows[0]):
            continue
        fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in rows], axis=0)]
        rows = [c[fresh] for c in rows]
        same = rows[0][1:] == rows[0][:-1]
        keep = np.r_[before, same]  # the first of the partition stays, whatever it is
        keep[:-1] |= same
        # the last row waits for its successor, and remembers whether its predecessor was equal
        out = [c[:-1][keep[:-1]] for c in rows[1:]]
        held, before = [c[-1:] for c in rows], keep[-1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[1:]], schema=schema)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``text_hash, starts``: word positions from which ``length`` words also occur in another text."""
    texts = id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    ids = spool(texts.select("text_hash", "doc_id"))
    kept = spool(kept_suffixes(docs, length))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["prefix", "text_hash", "at"]
    near = (kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .mapInArrow(_equal_neighbours, "text_hash long, at int"))
    places = near.groupBy("text_hash").agg(F.collect_set("at").alias("ats"))
    # one row stands for all copies of a text
    one = ids.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    wanted = places.join(one, "text_hash")
    wanted = null_safe_join(texts, wanted, ["doc_id", "text_hash"])

    def start():
        memory = _Hashes()

        def windows(text_hash, text, ats):
            hashes = TextHashes(text, memory)
            starts = np.flatnonzero(np.isin(hashes.minimisers(length), ats))
            return [(text_hash, starts.tolist(), hashes.of(starts, length).view(np.int64).tolist())]
        return windows
    found = spool(map_rows(wanted.select("text_hash", "text", "ats"),
                           "text_hash long, starts array<int>, hashes array<long>", start))
    rows = found.select("text_hash", F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("hashes").alias("hash"))))
    rows = rows.toDF("text_hash", "start", "hash")
    twice = (rows.groupBy("hash").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
             .where("a != b").select("hash"))
    return rows.join(twice, "hash", "left_semi").groupBy("text_hash").agg(
        F.sort_array(F.collect_set("start")).alias("starts"))


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, end`` (words, end exclusive): the passages of ``docs`` (``doc_id, text``) made
    of runs of ``length`` words that also occur in another row. Rows without one do not appear.

    Words are runs of characters other than ASCII white space, compared as they are. Texts of fewer
    words, null and empty ones have no passage. Equal texts of ``length`` words or more are one
    passage each, from the first word to the last; a passage that only one text holds, however
    often, is none. Repeated rows are copies of each other and stay repeated; null ids stay null;
    other columns are ignored. Texts and windows are compared by 64-bit hashes.
    """
    rows = spool(id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"),
                                      F.regexp_count("text", F.lit(WORD)).alias("n_words")))
    counts = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"))
    copies = counts.where(F.col("n") > 1).where(F.col("n_words") >= length).select(
        "text_hash", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"))).alias("passages"))

    def start():
        def join(text_hash, starts):
            at = np.array(starts)
            breaks = np.flatnonzero(np.diff(at) > length) + 1
            return [(text_hash, [{"start": int(p[0]), "end": int(p[-1]) + length} for p in np.split(at, breaks)])]
        return join
    single = counts.where("n = 1").select("text_hash")
    parts = map_rows(repeated_windows(docs, length).join(single, "text_hash", "left_semi"),
                     "text_hash long, passages array<struct<start:int,end:int>>", start)
    found = spool(copies.union(parts))
    return rows.join(found, "text_hash").select("doc_id", F.inline("passages"))
