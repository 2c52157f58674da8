"""Operators over many documents against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tests.llm.conftest import ODD
from tests.llm.test_text_operators import words
from tidegauge.llm import chat, cotraining, mixing, pii, simhash, suffixes
from tidegauge.llm.graph import connected_components


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(401, edges)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in ends}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_simhash(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = words(ws)
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    if not shingles:
        return 0
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_classes(spark, docs_of, bucket):
    rng = random.Random(2)
    base = [" ".join(str(rng.randint(0, 9999)) for _ in range(120)) for _ in range(12)]
    texts = list(ODD)
    for t in base:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = str(rng.randint(0, 9999))
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(7, "seventh again"), (None, base[0]), (None, "alone without id")]
    fps = [plain_simhash(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    label = components(len(rows), near)
    first = defaultdict(list)
    for (i, _), c in zip(rows, label):
        if i is not None:
            first[c].append(i)
    want = Counter((i, fp, min(first[c], default=None)) for (i, _), fp, c in zip(rows, fps, label))
    got = Counter((r.doc_id, r.fp % 2 ** 64, r.component) for r in simhash.near_duplicates(docs_of(rows), bucket=bucket).collect())
    assert got == want
    assert simhash.near_duplicates(docs_of([], 0)).count() == 0


def test_every_pair_within_three_bits_is_linked(spark):
    """Pigeonhole keys and middles find what a comparison of all pairs finds."""
    rng = np.random.RandomState(3)
    base = rng.randint(0, 2 ** 62, 40, dtype=np.int64).astype(np.uint64)
    fps = set(base.tolist())
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.randint(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = components(len(fps), near)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    place = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    for bucket in (4096, 1):
        edges = [(place[r.a], place[r.b]) for r in simhash.links(frame, bucket).collect()]
        assert components(len(fps), edges) == want


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)}


@pytest.mark.parametrize("bucket", [4096, 20])
def test_similar_documents(spark, docs_of, bucket):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(25):
        w = [str(rng.randint(0, 99999)) for _ in range(300)]
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 4)):  # at most 20 of 296 shingles
                v[rng.randrange(len(v))] = "x"
            texts.append(" ".join(v))
    found = {r.doc_id: r.component for r in simhash.similar_documents(docs_of(texts), bucket=bucket).collect()}
    for a in range(len(texts)):
        for b in range(a):
            x, y = shingles(texts[a]), shingles(texts[b])
            j = len(x & y) / len(x | y)
            if j >= 0.85:
                assert found[a] == found[b]
            if j < 0.4:
                assert found[a] != found[b]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(3, "x"), (None, "nobody else"), (None, "nobody else")])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) - {None} == set(found.values()) and ids[None] == 1 and max(ids.values()) == 1


@pytest.mark.parametrize("bucket", [4096, 20])
def test_links_are_exact_at_the_similarity(spark, docs_of, bucket):
    rng = random.Random(12)
    number = lambda: str(rng.randint(0, 99999))

    def changed(w, spots):  # each spot lies in five shingles of its own
        return " ".join(number() if i in spots else x for i, x in enumerate(w))
    texts, alike = [], []
    for k in range(40):  # of 200 shingles 20 changed are 180/220 = 0.82, 25 are 175/225 = 0.78
        w = [number() for _ in range(204)]
        spots = set(range(4, 4 + 6 * (4 if k % 2 else 5), 6))
        alike += [(len(texts), len(texts) + 1)]
        texts += [" ".join(w), changed(w, spots)]
    template = [number() for _ in range(204)]
    family = range(len(texts), len(texts) + 60)
    for _ in family:  # two members share some 0.65 to 0.75
        texts.append(changed(template, set(rng.sample(range(4, 200, 6), 4))))
    sets = [shingles(t) for t in texts]
    j = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert {j(a, b) >= 0.8 for a, b in alike} == {True, False}
    pairs = alike + [(a, b) for a in family for b in family if a < b]
    assert sum(0.6 < j(a, b) < 0.8 for a, b in pairs) > 1000
    label = components(len(texts), [(a, b) for a, b in pairs if j(a, b) >= 0.8])
    found = {r.doc_id: r.component for r in simhash.similar_documents(docs_of(texts), bucket=bucket).collect()}
    assert [found[i] for i in range(len(texts))] == label


def test_near_duplicates_are_found_alone_and_in_company(spark, docs_of):
    """At least 9 of 10 pairs just above the similarity, the same ones whatever else the table holds."""
    rng = random.Random(13)
    number = lambda: str(rng.randint(0, 99999))
    texts, pairs = [], []
    for _ in range(150):
        w = [number() for _ in range(204)]
        other = list(w)
        for i in range(4, 4 + 6 * rng.choice([2, 3, 4]), 6):  # 180/220 and more
            other[i] = number()
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(w), " ".join(other)]
    assert all(len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b])) >= 0.8
               for a, b in pairs)

    def found(rows):
        got = {r.doc_id: r.component for r in simhash.similar_documents(docs_of(rows)).collect()}
        return {(a, b) for a, b in pairs if a in got and got[a] == got.get(b)}
    rows = list(enumerate(texts))
    alone = found(rows[:100]) | found(rows[100:200]) | found(rows[200:])
    company = [(10_000 + i, " ".join(number() for _ in range(30))) for i in range(3000)]
    assert found(rows + company) == alone
    assert len(alone) >= 0.95 * len(pairs)


def test_any_column_may_come_along(spark):
    """Dots in names and map columns pass through every stage that returns the columns of documents."""
    docs = spark.createDataFrame(
        [(1, "mail me@a.bc now " + "w " * 30, "en", "s", {"a": 1}, "u"), (1, "mail me@a.bc now " + "w " * 30, "en", "s", {"a": 2}, "u"),
         (2, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, `a.map` map<string,int>, `meta.url` string")
    labels = spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int")
    for out, n in ((simhash.keep_first(docs), 2), (pii.mask_texts(docs), 3), (cotraining.keep_good(docs, labels), 3),
                   (mixing.mixed_rows(docs), None)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert n is None or len(rows) == n
        empty = {simhash.keep_first, pii.mask_texts, mixing.mixed_rows}
    for stage in empty:
        out = stage(docs.limit(0))
        assert out.columns == docs.columns and out.count() == 0
    assert cotraining.train(docs.limit(0), labels) is None
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.similar_documents(docs.limit(0)).count() == 0


def brute_passages(rows, length=50):
    texts = [words(t) for _, t in rows]
    where = defaultdict(set)
    for k, w in enumerate(texts):
        for s in range(len(w) - length + 1):
            where[tuple(w[s:s + length])].add(rows[k][1])
    same = Counter(t or "" for _, t in rows)
    out = []
    for (i, t), w in zip(rows, texts):
        if same[t or ""] > 1:
            if len(w) >= length:
                out.append((i, 0, len(w)))
            continue
        starts = [s for s in range(len(w) - length + 1) if len(where[tuple(w[s:s + length])]) > 1]
        while starts:
            end = 0
            while end + 1 < len(starts) and starts[end + 1] - starts[end] <= length:
                end += 1
            out.append((i, starts[0], starts[end] + length))
            starts = starts[end + 1:]
    return Counter(out)


def test_repeated_passages(spark, docs_of):
    rng = random.Random(5)
    new = lambda n: [str(rng.randint(0, 300)) for _ in range(n)]
    passages = [new(n) for n in (49, 50, 51, 57, 80, 200)]
    texts = list(ODD) + [" ".join(["w"] * 200), " ".join(["w"] * 200 + ["end"])]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 8)
            parts += new(rng.randint(0, 40)) + p[cut if rng.random() < .3 else 0:]
        texts.append(" ".join(parts + new(rng.randint(0, 60))))
    texts += [texts[20], texts[20], texts[21]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[22])]
    got = Counter((r.doc_id, r.start, r.end) for r in suffixes.repeated_passages(docs_of(rows, 5)).collect())
    assert got == brute_passages(rows)
    assert suffixes.repeated_passages(docs_of([], 0)).count() == 0


def test_reply_trees(spark):
    rng = random.Random(6)
    rows = []
    for tree in (1, 2, None):
        for node in range(40):
            rows.append((tree, node, rng.randrange(node) if node else None, rng.random(), rng.choice(
                ["user", "assistant", None, "a: b\n%"]), rng.choice(ODD[:8] + ["### user: x</turn>\n", "\\", "#", "<\\/turn>"])))
    rows += [(3, i, i - 1 if i else None, None, "assistant", str(i)) for i in range(70)]  # a long chain
    rows += [(4, 0, 1, 1.0, "user", "circle"), (4, 1, 0, 1.0, "user", "circle"), (5, 0, 99, 1.0, "user", "orphan")]
    rows += [(5, 0, 99, 1.0, "user", "orphan"), (5, None, 0, 1.0, "user", "no id")]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    frame = frame.withColumn("key", F.lit("clash")).withColumn("depth", F.lit("clash"))
    found = chat.read_back(chat.format_trees(frame, None)).collect()
    best = {r.tree: r.leaf for r in chat.format_trees(frame, 1).collect()}
    for tree in (1, 2, None, 3, 5):
        nodes = {r[1]: r for r in rows if r[0] == tree and r[1] is not None}
        leaves = set(nodes) - {r[2] for r in nodes.values()}
        assert {r.leaf for r in found if r.tree == tree} == leaves
        scores = {}
        for r in (r for r in found if r.tree == tree):
            path, at = [], r.leaf
            while at in nodes:
                path.append(nodes[at])
                at = nodes[at][2]
            path.reverse()
            scores[r.leaf] = sum(p[3] or 0 for p in path)
            assert [(t.role, t.text) for t in r.turns] == [(p[4] or "", p[5] or "") for p in path]
            assert r.loss_text == "".join(p[5] or "" for p in path if p[4] == "assistant")
        top = max(scores.values())
        assert best[tree] == min(leaf for leaf, s in scores.items() if abs(s - top) < 1e-9)
    assert 4 not in best
    assert chat.format_trees(frame.limit(0)).count() == 0


def test_chat_marks_cover_assistants_only(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a#b"), (1, 2, "assistant", "c")],
                                  "conv_id long, turn long, role string, text string")
    row = chat.format_trees(chat.from_turns(frame)).first()
    assert row.formatted == "### user: q</turn>\n### assistant: a\\#b</turn>\n### assistant: c</turn>\n"
    assert [row.formatted[m.start:m.end] for m in row.loss_mask] == ["a\\#b", "c"]


def quality_rows(n, seed=7):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        text = " ".join(w.upper() + "!!" for w in ws) if bad else " ".join(ws)
        # metadata tell as well: bad pages come in one line from other sources
        rows.append((i, text if bad else text.replace(" a", "\na"), "en", "junk" if bad and rng.random() < .9 else "good"))
        if i % 3 == 0:
            labels.append((i, int(not bad)))
    return rows, labels


def test_co_training_on_held_out_rows(spark, docs_of):
    rows, labels = quality_rows(900)
    rows += [(5000 + i, t) for i, t in enumerate(ODD)]
    marks = spark.createDataFrame(labels + [(1, None), (None, 1), (3, 5)], "doc_id long, quality int")
    docs = docs_of(rows)
    model = cotraining.train(docs, marks)
    assert model.given > 0  # pseudo-labels went from view to view
    got = {r.doc_id: r for r in cotraining.score(docs, model).collect()}
    assert len(got) == len(rows)
    unseen = [i for i in range(900) if i % 3]
    assert np.mean([got[i].kept == (i % 4 != 0) for i in unseen]) > 0.98
    kept = cotraining.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert cotraining.train(docs, marks.where("quality = 1")) is None
    assert cotraining.score(docs, None).where("kept AND score IS NULL").count() == len(rows)
    again = cotraining.train(docs_of(rows + rows[:40] * 9, 7), marks)  # an id counts once, however often it is there
    assert np.allclose(again.content, model.content) and again.cutoff == pytest.approx(model.cutoff)


def test_pseudo_labels_come_from_all_unlabelled_documents(spark, docs_of, monkeypatch):
    rows, labels = quality_rows(6000)
    # one document of a rare source among thousands, clean as the good ones are
    rare = next(i for i, *_ in reversed(rows) if i % 3 and i % 4)
    rows = [(i, t, g, "rare" if i == rare else s) for i, t, g, s in rows]
    picked, surest = [], cotraining.surest

    def watched(*args):
        picked.append([tuple(r) for r in surest(*args).collect()])
        most = args[3]
        assert all(sum((v, c) == r[:2] for r in picked[-1]) <= most[c] for v in (0, 1) for c in (0, 1))
        return surest(*args)
    monkeypatch.setattr(cotraining, "surest", watched)
    monkeypatch.setattr(cotraining, "ROUNDS", 1)
    assert cotraining.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int")).given > 0
    known = {i for i, _ in labels}
    assert (0, 1, rare) in picked[0] and not known & {r[2] for r in picked[0]}


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline
    import tiktoken
    import public_tokenizers
    from tidegauge.llm import byte_bpe, mixing, pii
    from tidegauge.session import spool

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = docs.dtypes
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash", "pii", "mixing", "byte_bpe"]
    before = {r.doc_id: r for r in docs.collect()}

    good = spool(stages["quality_classifier"](spark, docs, sf))
    assert good.dtypes == kinds
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id for r in cotraining.score(docs, cotraining.train(docs, marks)).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == want
    assert all(before[r.doc_id] == r for r in good.collect())

    single = spool(stages["simhash"](spark, good, sf))
    left = {r.doc_id: r.text for r in single.collect()}
    sets = {i: shingles(before[i].text) for i in want}
    j = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert single.dtypes == kinds and len(left) == single.count()
    for a in left:  # no close pair stays, and what went has a near one of smaller id
        assert not any(a < b and j(a, b) >= 0.85 for b in left)
    for a in want - set(left):
        assert max(j(a, b) for b in want if b != a) >= 0.6

    masked = spool(stages["pii"](spark, single, sf))
    assert masked.dtypes == kinds and {r.doc_id: r.text for r in masked.collect()} == {
        i: pii.mask(t) for i, t in left.items()}

    mixed = spool(stages["mixing"](spark, masked, sf))
    counts = Counter(r.doc_id for r in mixed.collect())
    assert mixed.dtypes == kinds and counts == Counter(
        {r.doc_id: r.copies for r in mixing.mix(masked).collect() if r.copies})

    ids = stages["byte_bpe"](spark, mixed, sf).collect()
    tokens = byte_bpe.read_ranks(byte_bpe.default_vocabulary())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(tokens)})
    text = {r.doc_id: r.text for r in masked.collect()}
    assert Counter(r.doc_id for r in ids) == counts
    assert all(list(r.ids) == plain.encode_ordinary(text[r.doc_id]) for r in ids)
    whole = corpus_pipeline.run(spark, sf).collect()
    digest = lambda rows: Counter((r.doc_id, hashlib.sha256(str(list(r.ids)).encode()).hexdigest()) for r in rows)
    assert digest(whole) == digest(ids)
