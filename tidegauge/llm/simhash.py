"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected classes.

Two 64-bit fingerprints that differ in at most 3 bits agree on one of four 16-bit blocks, and of the
48 bits left on one of four 12-bit blocks: 16 keys of 28 bits. Equal texts and texts with equal
fingerprints are one row before any key is made, so groups of copies cost nothing here.

Keys with many different fingerprints are rare but possible. Up to ``BUCKET`` of them are compared
block-wise in one task and leave a spanning forest, never all their pairs. Fingerprints of larger
buckets are linked by an exact way without comparisons: any two within distance 3 have a middle
within 1 of one and 2 of the other, and the rows that meet at one middle are at most 2081.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.common import id_text, map_rows, quoted
from tidegauge.llm.graph import connected_components
from tidegauge.session import spool

BITS = 64
#: Fixed by the block layout: 4 blocks prove a distance of at most 3.
DISTANCE = 3
#: Seed of the shingle hash.
SEED = 42
#: Fingerprints of one key that one task compares (4096^2 byte-sized steps); more go the other way.
BUCKET = 4096
#: Shingle hashes summed at a time.
SUM_ROWS = 1 << 16


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles, as an unsigned integer; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    k = min(shingle, len(words))
    ones, n = np.zeros(BITS, np.int64), len(words) - k + 1
    for at in range(0, n, SUM_ROWS):
        part = words[at:at + SUM_ROWS + k - 1]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(s), seed)
                              for s in zip(*(part[i:] for i in range(k)))), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) per row of ``docs``."""
    def start():
        return lambda doc_id, text: [(doc_id, int(np.uint64(fingerprint(text, shingle)).view(np.int64)))]
    return map_rows(id_text(docs), "doc_id long, fp long", start)


def block_keys(fp) -> list:
    """The 16 keys of a fingerprint column: table number and 28 bits."""
    keys = []
    for a in range(4):
        turned = fp if a == 0 else F.shiftrightunsigned(fp, 16 * a).bitwiseOR(F.shiftleft(fp, 64 - 16 * a))
        rest = F.shiftrightunsigned(turned, 16)
        for b in range(4):
            sub = F.shiftrightunsigned(rest, 12 * b).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(F.lit(4 * a + b).cast("long"), 28)
                        .bitwiseOR(F.shiftleft(turned.bitwiseAND(F.lit(0xFFFF)), 12)).bitwiseOR(sub))
    return keys


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) that connect what is within DISTANCE among ``fps`` (distinct)."""
    bits = fps.view(np.uint64)
    label = np.full(len(fps), -1)
    for i in range(len(fps)):
        if label[i] >= 0:
            continue
        label[i], front = i, [i]
        while front:
            j = front.pop()
            near = np.flatnonzero((np.bitwise_count(bits ^ bits[j]) <= DISTANCE) & (label < 0))
            label[near] = i
            front.extend(near.tolist())
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[member]], fps[member]


def _bucket_edges(batches):
    """Rows come sorted by key, a key complete in its partition and at most BUCKET rows long."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def edges(keys, fps):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        pair = starts[sizes == 2]
        near = np.bitwise_count(fps[pair].view(np.uint64) ^ fps[pair + 1].view(np.uint64)) <= DISTANCE
        out = [(fps[pair[near]], fps[pair[near] + 1])]
        out += [_forest(fps[s:s + n]) for s, n in zip(starts[sizes > 2], sizes[sizes > 2])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    for batch in batches:
        keys = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield edges(keys[:cut], fps[:cut])
        held_k, held_f = keys[cut:], fps[cut:]
    if len(held_k):
        yield edges(held_k, held_f)


def _ball_edges(fps: DataFrame) -> DataFrame:
    """Links among ``fps`` without comparing them: the smallest one within 1 of a middle is linked
    to all within 2 of it."""
    masks = [1 << i for i in range(BITS)]
    one = [0] + masks
    two = [masks[i] | masks[j] for i in range(BITS) for j in range(i)]
    signed = np.array(one + two, np.uint64).view(np.int64).tolist()

    def start():
        return lambda fp: [(fp ^ m, fp, i < len(one)) for i, m in enumerate(signed)]
    middles = map_rows(fps.select("b"), "middle long, b long, close boolean", start)
    w = Window.partitionBy("middle")
    return (middles.withColumn("a", F.min(F.when(F.col("close"), F.col("b"))).over(w))
            .where("a IS NOT NULL AND a != b").select("a", "b").distinct())


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp``: their components are those of all links
    of at most DISTANCE differing bits (an edge may stand for a chain of links)."""
    fp = F.col("fp")
    keyed = fps.select(fp, F.explode(F.array(*block_keys(fp))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = spool(keyed.join(sizes, "key"))
    small = (shared.where(F.col("n") <= bucket).select("key", "fp")
             .repartition("key").sortWithinPartitions("key", "fp")
             .mapInArrow(_bucket_edges, "a long, b long"))
    large = _ball_edges(shared.where(F.col("n") > bucket).select(fp.alias("b")).distinct())
    return small.union(large).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component`` per row of ``docs`` (``doc_id, text``).

    Texts are lower-cased (A-Z) and cut into ``shingle``-word shingles, repeats included; a text of
    fewer words is one shingle; null, empty and blank texts have fingerprint zero and link like any
    other. ``component`` is the smallest ``doc_id`` reachable over links of at most 3 bits, itself
    included. Repeated rows stay repeated; a null ``doc_id`` stays null, counts as larger than any
    other, and its component is null where its class has no id at all. Other columns are ignored, an
    empty table gives an empty one.
    """
    rows = spool(fingerprints(docs, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    labels = connected_components(links(nodes.select("fp"), bucket))
    placed = (nodes.join(labels, nodes["fp"] == labels["node"], "left")
              .select("fp", "rep", F.coalesce("label", "fp").alias("class")))
    placed = spool(placed)
    first = placed.groupBy("class").agg(F.min("rep").alias("component"))
    classes = placed.join(first, "class").select("fp", "component")
    return rows.join(classes, "fp").select("doc_id", "fp", "component")


#: Bits of the wide fingerprint, in 64-bit words. Two shingle sets with Jaccard J have a cosine of
#: about 2J/(1+J), and differ in acos(cosine)/pi of the bits: 15 % at 0.8.
WIDE = 4
#: Texts are linked from this Jaccard similarity of their shingle sets, computed exactly.
SIMILARITY = 0.8
#: Standard deviations above the expected distance up to which two fingerprints are candidates.
MARGIN = 3.0
#: Bits of a block, and blocks: fixed, so that a pair is found or not whatever else the table holds. By
#: the binomial model 98 of 100 pairs of just the wanted similarity share one and lie within the cut.
BLOCK_BITS, BLOCKS = 16, 111
#: Shingles, summed over texts, of one part of a group of candidates; a task compares two parts.
PART_SHINGLES = 1 << 21


def differing_share(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; empty for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle, len(words))
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(
        *(words[i:] for i in range(k)))), np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of ``64 * WIDE`` bits of a set of shingle hashes; zero bytes for the empty set."""
    ones, n = np.zeros(64 * WIDE, np.int64), len(shingles)
    more = np.arange(WIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, SUM_ROWS >> 4):
        # further words of bits by a 64-bit mixer
        x = shingles[at:at + (SUM_ROWS >> 4), None] + more
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(x), -1), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def _blocks() -> np.ndarray:
    """Bit numbers of each block, blocks x bits; bits may be in several blocks."""
    rng = np.random.RandomState(4)
    return np.stack([rng.choice(64 * WIDE, BLOCK_BITS, replace=False) for _ in range(BLOCKS)])


def _fixed(column) -> np.ndarray:
    """Rows x WIDE words of a binary column whose values all have the same length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)


def _wide_forest(x: np.ndarray, most: int):
    """Positions (root, member) of a spanning forest of the rows of ``x`` within ``most`` bits."""
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if label[i] >= 0:
            continue
        label[i], front = i, [i]
        while front:
            rest = np.flatnonzero(label < 0)
            near = rest[np.bitwise_count(x[rest] ^ x[front.pop()]).sum(axis=1) <= most]
            label[near] = i
            front.extend(near.tolist())
    member = np.flatnonzero(label != np.arange(len(x)))
    return label[member], member


#: Up to so many fingerprints of a block are compared pair by pair, all blocks of a batch at once.
FEW = 16


def _block_edges(most: int, bucket: int | None):
    """Function for ``mapInArrow`` over rows ``key, fp`` sorted by key: edges ``a, b``, and of blocks
    of more than ``bucket`` rows the rows themselves as ``key, a`` (b null)."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def put(keys, a, b):
        as_bytes = lambda x: pa.array(list(map(bytes, x)) if len(x) else [], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), as_bytes(a), pa.nulls(len(a), pa.binary()) if b is None else as_bytes(b)], schema=schema)

    def edges(keys, x):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        few = np.repeat(sizes <= FEW, sizes)
        left, right = [], []
        for by in range(1, min(FEW, int(sizes.max()))):
            i = np.flatnonzero((keys[by:] == keys[:-by]) & few[by:])
            i = i[np.bitwise_count(x[i] ^ x[i + by]).sum(axis=1) <= most]
            left.append(i)
            right.append(i + by)
        for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
            a, b = _wide_forest(x[s:s + n], most)
            left.append(a + s)
            right.append(b + s)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            yield put(keys[a], x[a], x[b])

    def run(batches):
        keys, x, passing = np.empty(0, np.int64), np.empty((0, WIDE), np.uint64), None
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            x = np.concatenate([x, _fixed(batch.column(1))])
            if passing is not None:
                n = int(np.searchsorted(keys, passing, "right"))
                yield put(keys[:n], x[:n], None)
                keys, x = keys[n:], x[n:]
            if not len(keys):
                continue
            passing = None
            cut = int(np.searchsorted(keys, keys[-1]))
            ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1
            sizes = np.diff(np.r_[0, ends])
            large = np.repeat(sizes > bucket, sizes) if bucket else np.zeros(len(keys), bool)
            if large[-1]:  # the last block goes on, and is too large already
                passing, cut = keys[-1], len(keys)
            done = large[:cut]
            if done.any():
                yield put(keys[:cut][done], x[:cut][done], None)
            if not done.all():
                yield from edges(keys[:cut][~done], x[:cut][~done])
            keys, x = keys[cut:], x[cut:]
        if len(keys):
            yield from edges(keys, x)
    return run


def _exact_forest(sets: list[np.ndarray], similarity: float):
    """Positions (root, member) of a spanning forest of the sets (sorted, distinct values) whose
    Jaccard similarity is at least ``similarity``."""
    place = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in place])
    ends = np.r_[0, np.cumsum(sizes)]
    values, codes = np.unique(np.concatenate([sets[i] for i in place]), return_inverse=True)
    own, label = np.zeros(len(values), bool), np.full(len(sets), -1)
    for i in range(len(sets)):
        if label[i] >= 0:
            continue
        label[i], front = i, [i]
        while front:
            j = front.pop()
            # only sets of about the same size can be similar enough
            lo = np.searchsorted(sizes, math.floor(similarity * sizes[j]))
            hi = np.searchsorted(sizes, math.ceil(sizes[j] / similarity), "right")
            if not (label[lo:hi] < 0).any():
                continue
            own[codes[ends[j]:ends[j + 1]]] = True
            sums = np.r_[0, np.cumsum(own[codes[ends[lo]:ends[hi]]])]
            own[codes[ends[j]:ends[j + 1]]] = False
            both = np.diff(sums[ends[lo:hi + 1] - ends[lo]])
            alike = both / np.maximum(1, sizes[j] + sizes[lo:hi] - both) >= similarity
            near = lo + np.flatnonzero(alike & (label[lo:hi] < 0))
            label[near] = i
            front.extend(near.tolist())
    member = np.flatnonzero(label != np.arange(len(sets)))
    return place[label[member]], place[member]


def _set_edges(similarity: float):
    """Function for ``mapInArrow`` over rows ``key, set, shingles`` sorted by key, a key complete in
    its partition: edges ``a, b`` between sets of a key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(nodes, shingles):
        root, member = _exact_forest([np.frombuffer(x, np.uint64) for x in shingles], similarity)
        return np.array(nodes, np.int64)[[root, member]]

    def run(batches):
        key, nodes, shingles = None, [], []
        for batch in batches:
            found = []
            for k, node, x in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(nodes) > 1:
                        found.append(edges(nodes, shingles))
                    key, nodes, shingles = k, [], []
                nodes.append(node)
                shingles.append(x)
            if found:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), schema=schema)
        if len(nodes) > 1:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, edges(nodes, shingles))), schema=schema)
    return run


def _candidate_groups(fps: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """``node, label`` of the distinct ``fp`` that are connected by candidate pairs: those that share
    a block and differ in at most the share of bits that belongs to ``similarity``, plus MARGIN."""
    share = differing_share(similarity)
    most = math.floor(64 * WIDE * share + MARGIN * math.sqrt(64 * WIDE * share * (1 - share)))
    blocks = _blocks()
    keyed_schema = pa.schema([("key", pa.int64()), ("fp", pa.binary())])

    def keys(batches):
        place = np.int64(1) << np.arange(blocks.shape[1], dtype=np.int64)
        table = np.arange(len(blocks), dtype=np.int64) << np.int64(blocks.shape[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                fps = batch.column(0).slice(at, 128)
                bits = np.unpackbits(_fixed(fps).view(np.uint8), axis=1).astype(np.int64)
                found = (bits[:, blocks] * place).sum(axis=2) + table
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ravel()), fps.take(pa.array(np.repeat(np.arange(len(fps)), len(blocks))))],
                    schema=keyed_schema)

    def compared(rows: DataFrame, limit: int | None) -> DataFrame:
        return (rows.repartition("key").sortWithinPartitions("key", "fp")
                .mapInArrow(_block_edges(most, limit), "key long, a binary, b binary"))
    found = spool(compared(fps.mapInArrow(keys, "key long, fp binary"), bucket))
    # blocks too large for one task: every two of their parts meet in a task of their own
    rest = found.where("b IS NULL").select("key", F.col("a").alias("fp"))
    parts = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("parts"))
    large = compared(_paired_parts(rest.join(parts, "key"), "key", "fp").select("key", "fp"), None)
    return connected_components(
        found.where("b IS NOT NULL").unionByName(large)
        .select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct())


def _paired_parts(rows: DataFrame, key: str, item: str) -> DataFrame:
    """``rows`` dealt by ``item`` to as many ``parts`` of their ``key`` as the column says; ``key``
    becomes one of each two parts that a row belongs to."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64(
        F.col(key), F.least("_part", j), F.greatest("_part", j)))
    return rows.withColumn(key, F.explode(pairs)).drop("_part", "parts")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY,
                      bucket: int = BUCKET) -> DataFrame:
    """``doc_id, text_hash, cluster, component`` per row of ``docs`` (``doc_id, text``): near-duplicates
    by the similarity of their shingle sets rather than by 3 bits.

    Texts of similarity 0.8 differ in some 15 % of the bits, which no split into a few blocks can
    find. So fingerprints have 256 bits and many more blocks, and a wide cut on their distance; what
    they connect are only candidates. All texts of such a group are compared by their shingle sets,
    and those of a Jaccard similarity of at least ``similarity`` are linked. No pair below is a link;
    a pair above can be missed where no block or distance brings it into one group (some 2 in 100
    at just the similarity, fewer above), alone as in company of others. Nulls, copies and ids as in :func:`near_duplicates`.
    """
    from xxhash import xxh64_intdigest

    def start():
        def one(doc_id, text, text_hash):
            found = shingle_set(text, shingle)
            node = xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)
            return [(doc_id, text_hash, wide_fingerprint(found), node, len(found))]
        return one
    texts = id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = spool(map_rows(texts, "doc_id long, text_hash long, fp binary, node long, n long", start))
    place = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id")
    sets = spool(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("doc_id").alias("rep"),
                                          F.min(F.struct(place, F.col("text_hash").alias("_hash"))).alias("one")))
    groups = _candidate_groups(sets.select("fp").distinct(), similarity, bucket)
    point = F.xxhash64("fp").alias("point")
    sets = spool(sets.withColumn("point", point).join(groups.withColumnRenamed("node", "point"), "point", "left")
                 .select(F.coalesce("label", "point").alias("key"), "node", "n", "rep", "one"))
    # groups of several sets, large ones in parts
    parts = (sets.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).where("m > 1")
             .select("key", F.greatest(F.ceil(F.col("m") / bucket), F.ceil(F.col("n") / PART_SHINGLES))
                     .cast("int").alias("parts")))
    wanted = sets.join(parts, "key").select("key", "node", "parts", "one.*")
    sources = (texts.select(place, "text", F.col("text_hash").alias("_hash")).join(wanted, ["_id", "_hash"])
               .groupBy("node", "key", "parts").agg(F.min("text").alias("text")))

    def shingled():
        return lambda node, key, parts, text: [(node, key, parts, shingle_set(text, shingle).tobytes())]
    dealt = _paired_parts(map_rows(sources, "node long, key long, parts int, shingles binary", shingled), "key", "node")
    edges = (dealt.select("key", "node", "shingles").repartition("key").sortWithinPartitions("key", "node")
             .mapInArrow(_set_edges(similarity), "a long, b long").distinct())
    labels = connected_components(edges).withColumnRenamed("label", "_class")
    placed = spool(sets.join(labels, "node", "left").select("node", "rep", F.coalesce("_class", "node").alias("cluster")))
    first = placed.groupBy("cluster").agg(F.min("rep").alias("component"))
    return rows.join(placed.join(first, "cluster").select("node", "cluster", "component"), "node").select(
        "doc_id", "text_hash", "cluster", "component")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each class one row stays, with the smallest
    ``doc_id`` (null last), of equal ids the smallest text hash; all columns as they were."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_tg_id")
    found = similar_documents(docs, shingle, similarity)
    kept = found.groupBy("cluster").agg(F.min(F.struct(place, F.col("text_hash").alias("_tg_hash"))).alias("w")).select("w.*")
    rows = docs.select("*", place, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tg_hash"))
    rows = rows.join(kept, ["_tg_id", "_tg_hash"], "left_semi")
    # the same row may be there more than once; of rows that differ elsewhere the first as JSON stays
    columns = quoted(docs.columns)
    w = Window.partitionBy("_tg_id", "_tg_hash").orderBy(F.to_json(F.struct(*columns)))
    return rows.withColumn("_tg_row", F.row_number().over(w)).where("_tg_row = 1").select(*columns)
