"""Ranked search of many queries at once, with shared subexpressions.

Queries (items) share terms. Pairs of partial sums that stand together in most items are merged again
and again, so the items become sums over a graph in which a shared set of terms is one node. For a
batch of documents each node's accumulator is computed once, from its two parts, and an item's scores
are the sum of the few nodes it is left with.

Documents are tokenised once; what is written is each one's length and the counts of query terms.
Document frequencies and lengths are sums over all documents. The best documents of an item are kept
per task, then merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.session import spool

TOP = 50
#: Items that share one graph, and one pass over the documents.
ITEMS = 512
#: Terms, those of most items first, among which shared pairs are sought. Others enter items singly.
SHARED = 1024
#: Accumulators (documents times terms and nodes) held at a time.
CELLS = 1 << 22
#: Tasks' lists of one item that are merged first, and the scale of scores.
SALTS = 32
SCALE = 1_000_000_000

#: A-Z in lower case, other ASCII but digits and a-z as spaces; bytes of other characters stay.
_TERMS = bytes(i + 32 if 65 <= i <= 90 else i if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other than ASCII characters, A-Z in lower case."""
    return text.translate(_TERMS).split()


class Graph:
    """Items as sums: ``nodes[i]`` are the two symbols of symbol ``n_terms + i``, which stand for earlier
    ones; ``items`` are lists of symbols. Symbols below ``n_terms`` are terms."""

    def __init__(self, items: list[list[int]], n_terms: int, most: int = SHARED):
        held = Counter(t for item in items for t in item)
        shared = [t for t, n in sorted(held.items(), key=lambda x: (-x[1], x[0])) if n > 1][:most]
        place = {t: i for i, t in enumerate(shared)}
        has = np.zeros((len(items), max(1, 2 * len(shared))), bool)  # symbols by item; columns grow
        for i, item in enumerate(items):
            has[i, [place[t] for t in item if t in place]] = True
        symbols, self.nodes, self.n_terms = list(shared), [], n_terms
        together = has.T.astype(np.float32) @ has.astype(np.float32)
        np.fill_diagonal(together, 0)
        while shared:
            at = int(together.argmax())
            a, b = divmod(at, together.shape[1])
            if together[a, b] < 2:
                break
            if len(symbols) == has.shape[1]:
                has = np.pad(has, ((0, 0), (0, len(symbols))))
                together = np.pad(together, (0, len(symbols)))
            both, new = has[:, a] & has[:, b], len(symbols)
            has[both, a] = has[both, b] = False
            has[both, new] = True
            symbols.append(n_terms + len(self.nodes))
            self.nodes.append((symbols[a], symbols[b]))
            for c in (a, b, new):
                together[c] = together[:, c] = has[has[:, c]].sum(axis=0)
                together[c, c] = 0
        self.items = [[symbols[c] for c in np.flatnonzero(row)] + [t for t in item if t not in place]
                      for row, item in zip(has, items)]
        # nodes by level: those of a level need only earlier ones
        depth: dict[int, int] = {}
        for i, (a, b) in enumerate(self.nodes):
            depth[n_terms + i] = 1 + max(depth.get(a, 0), depth.get(b, 0))
        self.levels = []
        for level in range(1, max(depth.values(), default=0) + 1):
            own = [s for s, d in depth.items() if d == level]
            self.levels.append((np.array(own), *np.array([self.nodes[s - n_terms] for s in own]).T))

    def additions(self) -> int:
        """Per document, over all items."""
        return len(self.nodes) + sum(max(0, len(x) - 1) for x in self.items)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Items x documents from terms x documents."""
        sums = np.zeros((self.n_terms + len(self.nodes), parts.shape[1]), np.int64)
        sums[:self.n_terms] = parts
        for own, a, b in self.levels:
            sums[own] = sums[a] + sums[b]
        return np.stack([sums[item].sum(axis=0) if item else np.zeros(parts.shape[1], np.int64) for item in self.items])


def _best(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` best: highest score, then smallest id, null ids last."""
    if len(scores) > 4 * top:  # only those that reach the score of the last place
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], nulls[keep], -scores[keep]))[:top]]


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of documents with a term: their length, and the numbers (packed
    32 bits) and counts (packed 64 bits) of the terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        place = shared.value
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = terms(text)
                if found:
                    own = np.fromiter((place.get(w, -1) for w in found), np.int32, len(found))
                    ids, counts = np.unique(own[own >= 0], return_counts=True)
                    out.append((doc_id, len(found), ids.astype("<i4").tobytes(), counts.astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    # bytes are what is cut into terms; no text is decoded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def _statistics(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and the documents of each term of the vocabulary."""
    def run(batches):
        df, n, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            lengths, packed = batch.columns
            n, words = n + len(lengths), words + int(lengths.to_numpy().sum())
            df += np.bincount(np.frombuffer(b"".join(packed.to_pylist()), "<i4"), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[[-1, -2], held]), pa.array(np.r_[[n, words], df[held]])],
                                         ["term", "n"])
    rows = counted.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    found = dict(map(tuple, rows))  # one row per term of the vocabulary
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(t, 0) for t in range(n_terms)], np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _scored(counted: DataFrame, graph: Graph, weights: np.ndarray, n_docs: int, words: int, top: int) -> DataFrame:
    """``item, doc_id, score``: of each task the ``top`` best documents of each item."""
    shared = counted.sparkSession.sparkContext.broadcast((graph, weights))
    rows = max(16, CELLS // max(1, len(weights) + len(graph.nodes)))

    def run(batches):
        graph, weights = shared.value
        none = np.empty(0, np.int64)
        held = [(none, none, none.astype(bool))] * len(graph.items)
        least = np.zeros(len(held), np.int64)  # a score has to be above, once a list is full not below
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, lengths, packed, counts = batch.slice(at, rows).columns
                packed = [np.frombuffer(x, "<i4") for x in packed.to_pylist()]
                owner = np.repeat(np.arange(len(packed)), list(map(len, packed)))
                term, tf = np.concatenate(packed), np.frombuffer(b"".join(counts.to_pylist()), "<i8")
                m = 50 + (50 * lengths.to_numpy() * n_docs) // words
                parts = np.zeros((len(weights), len(packed)), np.int64)
                parts[term, owner] = weights[term] * (SCALE * tf // (1000 * tf + 20 * m[owner]))
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                own = ids.fill_null(0).to_numpy()
                scores = graph.scores(parts)
                for i in np.flatnonzero((scores >= np.maximum(least, 1)[:, None]).any(axis=1)):
                    new = np.flatnonzero(scores[i] >= max(1, least[i]))
                    both = [np.r_[a, b] for a, b in zip(held[i], (scores[i, new], own[new], nulls[new]))]
                    kept = _best(*both, top)
                    held[i] = tuple(x[kept] for x in both)
                    if len(kept) == top:
                        least[i] = held[i][0][-1]
        if any(len(x[0]) for x in held):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(held)), [len(x[0]) for x in held])),
                pa.array(np.concatenate([x[1] for x in held]), mask=np.concatenate([x[2] for x in held])),
                pa.array(np.concatenate([x[0] for x in held]))], ["item", "doc_id", "score"])
    return counted.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` (``item_id, text``) the ``top`` rows
    of ``docs`` (``doc_id, text``) with the highest score above 0, equal scores by ascending ``doc_id``.

    The score is a sum over the item's distinct terms of ``w * ((1000000000 tf) div (1000 tf + 20 m))``
    in integers, where ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 50 + (50 n N) div L``.
    Null texts have no term; a null ``doc_id`` comes last among equals; repeated rows, of either table,
    count and rank each by itself; other columns are ignored. Empty tables give an empty one. Items are
    the query set: they are read in blocks of ``block``, each with one pass over all documents.
    """
    spark = docs.sparkSession
    queries = items.select(F.col("item_id").cast("long").alias("item_id"),
                           F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    order = Window.partitionBy("block").orderBy("item_id", "text")
    number = F.coalesce(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-queries.count() // block)))), F.lit(0))
    queries = spool(queries.withColumn("block", number).withColumn("item", F.row_number().over(order).cast("long") - 1))
    ranked = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for (b,) in queries.select("block").distinct().orderBy("block").collect():  # one row per block
        own = queries.where(F.col("block") == b)
        told = [set(terms(bytes(r.text))) for r in own.orderBy("item").select("text").collect()]  # a block's items
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*told)))}
        if not vocabulary:
            continue
        counted = spool(_counted(docs, vocabulary))
        n_docs, words, df = _statistics(counted, len(vocabulary))
        if not n_docs:
            continue
        graph = Graph([sorted(vocabulary[t] for t in x) for x in told], len(vocabulary))
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        found = _scored(counted, graph, weights, n_docs, words, top)
        by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # a task hands on ``top`` rows per item; salted first, so that no task gets all of an item
        salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
        first = salted.withColumn("_place", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*by)))
        last = first.where(F.col("_place") <= top).withColumn(
            "rank", F.row_number().over(Window.partitionBy("item").orderBy(*by)))
        ranked = ranked.union(last.where(F.col("rank") <= top).join(own.select("item", "item_id"), "item")
                              .select("item_id", "rank", "doc_id", "score"))
    return ranked
