"""Toxicity, fill-in-the-middle and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidegauge.llm import infill, ranked, toxicity

# ---------------------------------------------------------------- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top):
    """Counter of the rows that every item has by scoring every document for it."""
    split = [(i, Counter(plain_terms(t))) for i, t in docs]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    n_docs, words = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = Counter()
    for item_id, text in items:
        found = []
        for doc_id, c, n in split:
            m = 50 + (50 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0:
                found.append((-s, doc_id is None, doc_id or 0, doc_id))
        for rank, (s, _, _, doc_id) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1):
            out[item_id, rank, doc_id, -s] += 1
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows],
                                 "item_id long, text string, rank string, block string")


@pytest.mark.parametrize("block", [512, 4])
def test_ranked_search(spark, docs_of, block):
    rng = random.Random(21)
    vocabulary = ["the", "of", "and", "Ünit", "日本", "x9"] + [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(rng.choice(vocabulary[:6] if rng.random() < 0.4 else vocabulary) for _ in range(n))
    docs = [(i, t) for i, t in enumerate(ODD)]
    docs += [(100 + i, text(rng.randint(1, 80)).replace(" ", rng.choice([" ", "-", "\n", "THE "]))) for i in range(150)]
    docs += [docs[-1], (None, "the w1 w2"), (None, "the w1 w2"), (3, "the w1 w2"), (2, "the w1 w2")]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "!?"), (53, "unknown"), (1, "the w1"), (1, "the w1"), (None, "w2 W2 w2"), (54, "w1 " * 500)]
    got = ranked.search(docs_of(docs), items_of(spark, items), top=7, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items, 7)


def test_ranked_search_of_nothing(spark, docs_of):
    some, none = docs_of(["a b"]), docs_of([], 0)
    assert ranked.search(some, items_of(spark, [])).count() == 0
    assert ranked.search(none, items_of(spark, [(1, "a")])).count() == 0
    assert ranked.search(docs_of(["", None, "!"]), items_of(spark, [(1, "a")])).count() == 0


def test_graph_shares_sums_and_keeps_them():
    rng = random.Random(22)
    items = [sorted({t for t in range(40) if rng.random() < 1 / (1 + t / 6)}) for _ in range(60)] + [[], [3], [3]]
    graph = ranked.Graph(items, 40)
    parts = np.random.RandomState(1).randint(0, 10 ** 12, (40, 17))
    assert (graph.scores(parts) == [parts[item].sum(axis=0) if item else np.zeros(17) for item in items]).all()
    assert graph.additions() < 0.6 * sum(max(0, len(x) - 1) for x in items)
    # terms beyond those considered for sharing enter singly
    assert (ranked.Graph(items, 40, most=5).scores(parts) == graph.scores(parts)).all()


# ---------------------------------------------------------------- fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs_of):
    rng = random.Random(23)
    pieces = ["\n", "\r\n", " ", "<P", "<S", "S>", "$1", "\\", "日本😀", "word ", "\x85", "<", ">", "\t"]
    texts = list(ODD) + ["\n", "\n\n", "a\n", "\na", "a <P> b\nc", "<M>", "<S>", "line\n" * 20_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (5, "x\ny\nz"), (5, "x\ny\nz")]
    found = infill.transform(docs_of(rows)).withColumn("back", infill.restored())
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found.collect())
    assert got == Counter((i, *plain_infill(i, t), t or "") for i, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert infill.transform(docs_of([], 0)).count() == 0


def test_fill_in_middle_rates(docs_of):
    docs = docs_of([f"a\nb {i}\n" for i in range(400)])
    forms = Counter(r.form for r in infill.transform(docs, cut=70, suffix_first=0).collect())
    assert 220 < forms["psm"] < 340 and forms["spm"] == 0


# ---------------------------------------------------------------- toxicity

BAD = ["idiot", "moronical", "scumbag", "worthless"]


def labelled(n, seed, stem=""):
    """(text, toxic) rows: every fifth text has some bad words among syllables."""
    rng = random.Random(seed)
    syllables = ["the", "an", "tion", "er", "in", "re", "ou", "wh", "st", "able"]
    rows = []
    for i in range(n):
        ws = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        if i % 5 == 0:
            for _ in range(max(3, len(ws) // 25)):
                ws[rng.randrange(len(ws))] = rng.choice(BAD).capitalize()
        rows.append((" ".join(ws), int(i % 5 == 0)))
    return rows


@pytest.fixture(scope="module")
def toxic_case(spark, docs_of):
    rows = labelled(1500, 24)
    docs = docs_of([(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, toxicity.train(docs, labels)


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_of_texts_not_learned_from(toxic_case, docs_of):
    rows, docs, labels, model = toxic_case
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    own = [i for i in range(len(rows)) if is_held_out(i)]
    assert np.mean([got[i].predicted == rows[i][1] for i in own]) > 0.97
    assert all(0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3) for i in got)
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    assert held == set(own)


def test_toxicity_scores_each_window_by_its_lengths(toxic_case, docs_of):
    """Scores do not depend on batches or on what a task remembers: each text alone gives the same."""
    rows, _, _, model = toxic_case
    texts = list(ODD) + [rows[i][0] for i in range(12)]
    plain = {i: float(model.scorer().score([toxicity.windows(t or "")])[0]) for i, t in enumerate(texts)}
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(texts), model).collect()}
    assert got == plain
    assert plain[0] == plain[1] == plain[2] < 0.3  # null, empty and blank texts


def test_windows_and_code():
    import zstandard
    keys = toxicity.windows("Idiot, an IDIOT-like é1\x00x")
    raw = [k.tobytes() for k in keys]
    assert [r.split(b" ")[1] for r in raw] == [b"idiot", b"an", b"idiot", b"like", "é1".encode(), b"x"]
    assert raw[0] == b" idiot an idiot "
    codes = toxicity.coded(keys, 8)
    assert all(len(c) == 28 for c in codes) and codes[0][:24] == codes[2][:24] and codes[0][24:] != codes[2][24:]
    assert len(toxicity.windows("")) == len(toxicity.windows(" .,!\n")) == 0
    # the length function is what zstandard gives with that dictionary
    data = toxicity._dictionary(codes * 50, 4096)
    compress = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(data),
                                        write_content_size=False, write_dict_id=False, write_checksum=False)
    assert [toxicity._length(data)(c) for c in codes] == [len(compress.compress(c)) for c in codes]


def test_toxicity_learns_nothing_from_other_rows(spark, toxic_case, docs_of):
    """Held-out labels, contradicting ones and null ids change nothing; copies of a row neither."""
    rows, docs, labels, model = toxic_case
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    more = spark.createDataFrame([(None, 1, 1), (9999, 1, 0), (9999, 1, 1), (3, 1, None)], turned.schema)
    again = toxicity.train(docs.union(docs.where("doc_id < 50")), turned.union(more))
    assert again.toxic == model.toxic and again.ordinary == model.ordinary
    assert again.thresholds == model.thresholds and (again.weights == model.weights).all()


def test_toxicity_without_a_model(spark, docs_of):
    docs = docs_of([(1, "idiot"), (None, None), (1, "idiot")])
    for labels in ([], [(1, 1, 1)], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (3, 1, 0)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = toxicity.train(docs, frame)
        assert sorted((r.doc_id or 0, r.score, r.predicted) for r in toxicity.score(docs, model).collect()) == [
            (0, 0.0, 0), (1, 0.0, 0), (1, 0.0, 0)]
    assert toxicity.score(docs_of([], 0), None).count() == 0
