"""Operators on single texts against brute force and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from math import comb

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.conftest import ODD
from tidegauge.llm import byte_bpe, fingerprint, language, mixing, pii, rules
from pyspark.sql import functions as F


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe_matches_the_public_encoder(spark, docs_of):
    tokens = byte_bpe.read_ranks(byte_bpe.default_vocabulary())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(tokens)})
    texts = ODD + ["'s 'S I'll  \t\tx", "٠١ Ⅷ ½", "é é", "▁▁ x▁", "<|endoftext|>", "a\r\n\r\n  b c"]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["a", "the", " ", "\n", "é", "😀", "12", "'ll", "#", "\x85", "\x1c", "ß"])
                      for _ in range(rng.randint(1, 60))) for _ in range(200)]
    docs = docs_of(texts)
    encoded = byte_bpe.encode(docs)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: r.text for r in byte_bpe.decode(encoded).collect()}
    digest = {r.doc_id: r for r in byte_bpe.encode_digests(docs).collect()}
    for i, t in enumerate(texts):
        expected = other.encode_ordinary(t or "")
        assert ids[i] == expected and back[i] == (t or "")
        assert digest[i].n_tokens == len(expected)
        assert digest[i].ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_whole_vocabulary():
    tokens = byte_bpe.read_ranks(byte_bpe.default_vocabulary())
    codec = byte_bpe.Codec(byte_bpe.serialise_model(tokens), tokens)
    for rank, token in enumerate(tokens):
        mapped = token.decode("latin-1").translate(codec.table)
        assert codec.processor.encode(mapped, out_type=int) == [rank + 1]


BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(d) for d in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in BASE_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255
                    or kind == "card" and not (13 <= len(digits) <= 19 and plain_luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            found.append((kind, *m.span()))
    return found


def test_pii_base_spans_match_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@x.y", "1", "23", "255", "4", "256", ".", " ", "-", "+", "(", ")", "_", "é", "\n",
             "4915864153225946", "+1 (317) 555-7008", "1.2.3.4", "me@a.bc"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == base_spans(text), text
        assert not any(a < d and c < b for k, a, b, _ in pii.find(text) if k not in pii.BASE for _, c, d in base_spans(text))


def test_pii_further_kinds_need_proof_or_context(spark, docs_of):
    assert [s[0] for s in pii.find("to DE89 3704 0044 0532 0130 00 now")] == ["iban"]
    assert pii.find("to DE88 3704 0044 0532 0130 00 now") == []
    # what follows an account number is no part of it
    for text, end in (("GB82 WEST 1234 5698 7654 32 I paid", 27), ("DE89 3704 0044 0532 0130 00 12 EUR", 27),
                      ("DE89370400440532013000 NEXT", 22), ("GB82WEST12345698765432, GB82WEST12345698765432", 22)):
        assert pii.find(text)[0][:3] == ("iban", 0, end)
    assert pii.find("DE89370400440532013000X") == pii.find("ZZ89370400440532013000") == pii.find("DE89") == []
    assert pii.find("call (555) 123-4567 x")[0][:3] == ("local_phone", 5, 19)
    assert pii.find("call 555) 123-4567 x") == []
    assert pii.find("see 123-45-6789") == [] and [s[0] for s in pii.find("SSN 123-45-6789")] == ["national_id"]
    assert [s[0] for s in pii.find("call +1 317-555-7008")] == ["phone"]
    scores = [pii.find(t)[0][3] for t in ("x 4915864153225946", "card 4915864153225946")]
    assert scores[0] < scores[1]
    docs = docs_of(ODD + ["mail me@a.bc now", "me@a.bc"])
    rows = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    assert len(rows) == docs.count()
    assert rows[len(ODD)].spans == "email:5:12" and rows[len(ODD)].n_email == 1
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.mask_texts(docs)
    assert masked.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert texts[len(ODD)] == ("mail [EMAIL] now", 16) and texts[0] == (None, None)
    assert not any(pii.find(t or "") for t, _ in texts.values())
    assert pii.spans(docs_of([], 0)).count() == 0


def brute_stats(text):
    ws = words(text)
    grams = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rule_statistics(spark, docs_of):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "\x85"]) for _ in range(rng.randint(0, 300)))
                   for _ in range(200)]
    rows = {r.doc_id: r for r in rules.stats(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(t), repr(t)[:80]


def test_exact_binomial_and_cutoffs():
    for k, n, p in [(0, 100, .05), (2, 200, .05), (7, 300, .05), (4, 1000, .01)]:
        assert rules.binomial_tail(k, n, p) == pytest.approx(
            sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    size = len(rules.GRID) + 1
    good, bad = np.zeros(size), np.zeros(size)
    good[1], bad[30] = 2000, 50
    cutoff = rules.choose_cutoff(good, bad, 0.01, 0.01)
    assert cutoff == rules.GRID[29]  # gentlest that rejects every bad row
    good[1] = 20  # too few rows to prove anything
    assert rules.choose_cutoff(good, bad, 0.01, 0.01) == float("inf")


def test_rules_keep_the_promise(spark, docs_of):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        ws = ["".join(rng.choice("abcdefgh") for _ in range(4)) + ("###" if bad else "") for _ in range(40)]
        texts.append((i, " ".join(ws), "en" if i % 3 else None))
        labels.append((i, 0 if bad else 1))
    texts += [(5000 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(labels + [(1, None), (None, 1), (7, 7)], "doc_id long, quality int")
    rows = rules.apply_rules(docs_of(texts), frame).collect()
    assert len(rows) == len(texts)
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] == (i % 5 != 0) for i in range(1500) if i % 3)
    assert not any(r.kept for r in rows if r.base_failed)
    # null and "" are strata of their own: each has its cutoffs, and the correction counts both
    empty = docs_of([(i, t, "" if lang else None) for i, t, lang in ((*r, None)[:3] for r in texts)])
    found = rules.stats(empty, "lang").join(frame.where("quality IN (0, 1)"), "doc_id")
    cuts = rules.fit_cutoffs(found, "lang").collect()
    assert {r.stratum for r in cuts} == {None, ""} and len(cuts) == 2 * len(rules.signals())
    apart = rules.apply_rules(empty, frame).collect()
    assert {r.doc_id: r.kept for r in apart if r.doc_id < 1500 and r.doc_id % 3} == {
        i: kept[i] for i in range(1500) if i % 3}
    none = rules.apply_rules(docs_of(texts), frame.limit(0)).where("NOT kept AND NOT base_failed").count()
    assert none == 0 and rules.apply_rules(docs_of([], 0), frame).count() == 0


def test_language_on_held_out_rows(spark, docs_of):
    kinds = {"aa": ["kra", "tok", "mi"], "bb": ["sel", "u", "pon"], "cc": ["çé", "ñu", "lo"]}
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(kinds))
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(12)), lang))
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    docs = docs_of(rows)
    model = language.train(docs)
    assert model[0] == sorted(kinds)
    found = {r.doc_id: r for r in language.predict(docs, model).withColumn("held", language.held_out()).collect()}
    assert len(found) == len(rows)
    for i, text, lang in rows:
        r = found[i]
        assert r.held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        if lang:
            assert r.lang_pred == lang
        elif not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und" and r.score == 0
    # neither languages of held-out rows nor other columns matter
    changed = docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert (language.train(changed)[1] == model[1]).all()
    again = language.train(docs_of(rows + rows[:30] * 9, 7))  # an id counts once, however often it is there
    assert (again[1] == model[1]).all()
    # characters that regular expressions count as words, but that are no letters
    odd = language.predict(docs_of(["½", "²³", "Ⅷ", "①", "ª", "ⅷ!", "é"]), model).collect()
    assert [r.lang_pred == "und" for r in sorted(odd, key=lambda r: r.doc_id)] == [True, True, True, True, False, True, False]
    assert language.predict(docs_of([], 0), model).count() == 0
    few = language.train(docs_of(rows), most=2)
    assert len(few[0]) == 2 and set(few[0]) < set(kinds)
    nothing = language.train(docs.where("lang = 'zz'"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def brute_choice(text, gram=4, window=8):
    """Winnowing by definition on the same token hashes."""
    hashes = [brute_choice.hash[t] for t in re.findall(fingerprint.TOKEN, text)]
    width, grams = 1, hashes
    while width < gram:
        if len(grams) > width:
            grams = [((a << width) & (2 ** 64 - 1)) ^ b for a, b in zip(grams, grams[width:])]
        width *= 2
    grams = [g >> 32 for g in grams]
    picked = []
    for s in range(max(1, len(grams) - window + 1) if grams else 0):
        part = list(enumerate(grams[s:s + window], s))
        if len(part) < window and len(grams) >= window:
            continue
        least = min(h for _, h in part)
        at = max(i for i, h in part if h == least)
        if (least, at) not in picked:
            picked.append((least, at))
    return ",".join(f"{h:x}:{i}" for h, i in picked)


def test_winnowing_against_its_definition(spark, docs_of):
    rng = random.Random(6)
    texts = ["", "one"] + [" ".join(rng.choice(["a", "bb", "c", "dd", "e" * 40]) for _ in range(rng.randint(1, 60)))
                           for _ in range(60)]
    tokens = sorted({t for x in texts for t in re.findall(fingerprint.TOKEN, x)})
    frame = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.xxhash64("t").alias("h"))
    brute_choice.hash = {r.t: r.h % 2 ** 64 for r in frame.collect()}
    docs = docs_of(texts)
    got = {r.doc_id: r.s for r in fingerprint.fingerprints(docs).select(
        "doc_id", fingerprint.as_string(F.col("choice")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_choice(t), t


def test_winnowing_of_texts_without_blanks(spark, docs_of):
    rng = random.Random(8)
    plain = ["".join(chr(rng.randint(low, high)) for _ in range(600)) for low, high in ((0x4E00, 0x9000), (48, 122))]
    docs = docs_of([x for t in plain for x in (t, t[:5] + "x" + t[5:], t[250:350])])
    found = {r.doc_id: set(r.h) for r in fingerprint.fingerprints(docs).select(
        "doc_id", fingerprint.hashes(F.col("choice")).alias("h")).collect()}
    for i in (0, 3):
        whole, edited, part = found[i], found[i + 1], found[i + 2]
        assert len(whole & edited) / len(whole | edited) > 0.9
        assert len(part & whole) / len(part) > 0.8  # a passage at another offset


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_fingerprints_of_edited_texts(spark, docs_of, buckets):
    rng = random.Random(7)
    texts = [(3 * i, t) for i, t in enumerate(ODD)] + [
        (1000 + i, " ".join(str(rng.randint(0, 10 ** 6)) for _ in range(100))) for i in range(30)] + [(1000, "same id")]
    rows = sorted(((i, t or "") for i, t in texts))
    found = sorted(fingerprint.compare(docs_of(texts), buckets).collect(), key=lambda r: (r.doc_id, r.edited[:9], r.n_chars))
    expected = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        expected.append((i, len(t), t[:len(t) - half] + nxt[:half]))
    assert sorted((r.doc_id, r.n_chars, r.edited) for r in found) == sorted(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    long = [r for r in found if r.doc_id > 1000]
    assert all(0.15 < r.near_edited < 0.6 and r.near_next < 0.05 for r in long)
    assert fingerprint.compare(docs_of([], 0), buckets).count() == 0
    single = fingerprint.compare(docs_of([(None, "abcd")])).collect()
    assert [(r.doc_id, r.edited) for r in single] == [(None, "abab")]


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * w[s]
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing_meets_targets(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), None, rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(800)]
    rows += [(1000 + i, t, None, "odd") for i, t in enumerate(ODD)] + [rows[5], rows[5]]
    found = mixing.mix(docs_of(rows)).collect()
    again = mixing.mix(docs_of(rows, 7)).collect()
    key = lambda r: (r.doc_id, r.size, r.copies)
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 2
    for s, t in brute_targets(sizes).items():
        assert {round(r.target, 6) for r in found if r.source == s} == {round(t, 6)}
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    mixed = mixing.mixed_rows(docs_of(rows))
    assert mixed.columns == docs_of(rows).columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(
        {i: n for i, n in ((r.doc_id, sum(x.copies for x in found if x.doc_id == r.doc_id)) for r in found) if n})
    assert mixing.mix(docs_of([], 0)).count() == 0
    assert mixing.mix(docs_of(["", None])).agg(F.sum("copies")).first()[0] == 0


def test_better_documents_come_first(spark, docs_of):
    rows = [(i, ("good " if i % 4 else "poor ") * 10, None, "s") for i in range(4000)]
    weight = F.when(F.col("text").startswith("good"), 1.0).otherwise(0.25)
    few = {r.doc_id: r.copies for r in mixing.mix(docs_of(rows), weight=weight, total=0.5).collect()}
    assert abs(sum(few.values()) - 2000) <= 1
    # with exponential keys the taken are those with u ** (1 / w) above one level: 0.6 ... of weight 1
    good = sum(few[i] for i in few if i % 4) / 3000
    poor = sum(few[i] for i in few if not i % 4) / 1000
    level = next(x / 1e4 for x in range(10_000, 0, -1) if 3 * (1 - x / 1e4) + 1 - (x / 1e4) ** 0.25 >= 2)
    assert good == pytest.approx(1 - level, abs=0.03) and poor == pytest.approx(1 - level ** 0.25, abs=0.04)


def test_no_cell_of_the_mix_holds_many_documents(spark, docs_of):
    """Texts without blanks have tiny weights; their keys spread over as many cells as others do."""
    from unittest.mock import patch
    rows = [(i, "x" * 3000 if i % 2 else "w " * 600, None, "s") for i in range(3000)]
    written, spool = [], mixing.spool

    def watched(df):
        out = spool(df)
        if "cell" in out.columns:
            written.append(out.groupBy("cell").count().agg(F.max("count")).first()[0])
        return out
    with patch.object(mixing, "spool", watched):
        taken = mixing.mix(docs_of(rows), total=0.5)
        assert taken.where("copies > 0").count() > 0
    assert written and max(written) <= 3


def test_language_scores_are_those_of_the_kernel(spark):
    """The folded weights give what explicit kernels, landmarks, Nystroem map and ridge regression give."""
    rng = random.Random(15)
    kinds = {"aa": "krtoki", "bb": "selupn", "cc": "çéñulo"}
    sample = [(g, " ".join("".join(rng.choice(kinds[g]) for _ in range(4)) for _ in range(10)))
              for g in sorted(kinds) for _ in range(14)]
    languages, weights = language.fit([(g, np.packbits(language.presence(t)).tobytes()) for g, t in sample], 12, 1e-2)

    def grams(text):  # the places of the n-grams: as many as there are, but for a few that share one
        places = set(np.flatnonzero(language.presence(text)).tolist())
        plain = {text[i:i + n] for n in range(1, language.ORDER + 1) for i in range(len(text) - n + 1)}
        assert 0.97 * len(plain) <= len(places) <= len(plain)
        return places

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))
    texts = [grams(t) for _, t in sample]
    marks = [g for c in languages for g in [x for x, (lang, _) in zip(texts, sample) if lang == c][:4]]
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k)
    z = np.array([[kernel(a, b) for b in marks] for a in texts]) @ vectors / np.sqrt(values)
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for lang, _ in sample])
    share = 1 / 14
    ridge = np.linalg.solve(share * z.T @ z + 1e-2 * np.eye(len(marks)), share * z.T @ y)
    new = ["krat selu", "çéñu lolo", "uuu kkk"]
    want = np.array([[kernel(grams(t), b) for b in marks] for t in new]) @ vectors / np.sqrt(values) @ ridge
    got = [language.presence(t) @ weights / math.sqrt(language.presence(t).sum()) for t in new]
    assert np.allclose(got, want, atol=1e-3)
