"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

The four base kinds (email, ip, card, phone) are accepted by their pattern and check alone. Further
kinds (iban, national_id, local_phone) need a score of at least ``ACCEPT``: a confirmed checksum is
enough, a bare shape only together with a context word nearby. Every search is linear in the text:
number patterns run inside runs of number characters, addresses start from their ``@``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import id_text, map_rows, quoted

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("iban", "national_id", "local_phone")
#: Score from which a span of a further kind is taken.
ACCEPT = 0.7
#: Characters on each side in which context words count.
CONTEXT = 48

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: All ip, card and phone matches lie inside one such run and start with a digit or plus.
NUMBERS = re.compile(r"[0-9+][\x20().0-9+-]{5,}")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
NATIONAL_ID = re.compile(r"(?<![0-9.+-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9.+-])[0-9]{3}(?:[\x20.-]|\)\x20?)[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")

# Characters of an account number, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
IBAN = {n: re.compile(rf"[A-Z0-9](?:\x20?[A-Z0-9]){{{n - 1}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}

# Score of the bare shape, and words that raise it when they stand nearby.
START_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.8,
               "national_id": 0.4, "local_phone": 0.4}
CONTEXT_SCORE = 0.35
CONTEXT_WORDS = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telephone", "telefono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "national", "identity"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telephone", "telefono"),
}
CONTEXT_PATTERN = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(w) + r")(?![^\W_])", re.IGNORECASE)
                   for k, w in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    """Luhn checksum of a string of ASCII digits."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 mod-97 check of an account number without blanks."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in text.split(".")))


def _emails(text: str):
    start = 0
    while (at := text.find("@", start)) >= 0:
        left = at
        while left > start and text[left - 1] in LOCAL:
            left -= 1
        domain = DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            yield "email", left, domain.end()
        start = domain.end() if domain else at + 1


def _numbers(text: str):
    for run in NUMBERS.finditer(text):
        at, end = run.span()
        for m in IP.finditer(text, at, end):
            if _octets(m.group()):
                yield "ip", *m.span()
        for m in CARD.finditer(text, at, end):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
        for m in PHONE.finditer(text, at, end):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                yield "phone", *m.span()
        for m in NATIONAL_ID.finditer(text, at, end):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield "national_id", *m.span()
        for m in LOCAL_PHONE.finditer(text, at, end):
            a, b = m.span()
            if text[a + 3] != ")":
                yield "local_phone", a, b
            elif text[a - 1:a] == "(":
                yield "local_phone", a - 1, b


def _ibans(text: str):
    """An account number is as long as its country's are, whatever follows it."""
    done = 0
    for start in IBAN_START.finditer(text):
        m = IBAN[IBAN_LENGTHS[start[1]]].match(text, start.start()) if start[1] in IBAN_LENGTHS else None
        if m and m.start() >= done and mod97(m.group().replace(" ", "")):
            done = m.end()
            yield "iban", *m.span()


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans ``(kind, start, end, score)`` in code points, end exclusive, ordered by kind and start.

    Spans of further kinds that touch a base span are dropped; base spans may overlap each other.
    """
    found = []
    for kind, a, b in (*_emails(text), *_numbers(text), *_ibans(text)):
        score = START_SCORE[kind]
        # whole words only: context is cut at white space, not within a word
        if CONTEXT_PATTERN[kind].search(text, max(0, a - CONTEXT), a) or CONTEXT_PATTERN[kind].search(
                text, b, min(len(text), b + CONTEXT)):
            score = min(1.0, score + CONTEXT_SCORE)
        if kind in BASE or score >= ACCEPT:
            found.append((kind, a, b, score))
    base = sorted((a, b) for kind, a, b, _ in found if kind in BASE)
    starts, ends = [a for a, _ in base], list(accumulate((b for _, b in base), max))

    def free(a: int, b: int) -> bool:  # no base span that starts before b ends after a
        before = bisect_left(starts, b)
        return not before or ends[before - 1] <= a
    kept = [s for s in found if s[0] in BASE or free(s[1], s[2])]
    return sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1]))


def mask(text: str) -> str:
    """``text`` with each group of overlapping spans replaced by ``[KIND]`` of its first span."""
    out, at = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` per row of ``docs`` (``doc_id, text``).

    A null text counts as empty and has no spans; repeated rows and null ids stay; other columns
    are ignored; no text is cut; an empty table gives an empty one.
    """
    def start():
        return lambda doc_id, text: [(doc_id, [dict(zip(("kind", "start", "end", "score"), s))
                                               for s in find(text)])]
    return map_rows(id_text(docs), f"doc_id long, spans {SPANS}", start)


def span_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of the base spans and all spans as a string."""
    def start():
        def one(doc_id, text):
            found = find(text)
            words = [f"{k}:{a}:{b}" for k, a, b, _ in found]
            n_base = sum(s[0] in BASE for s in found)
            counts = [sum(s[0] == k for s in found) for k in BASE]
            digest = hashlib.sha256(",".join(words[:n_base]).encode()).hexdigest()
            return [(doc_id, *counts, digest, ",".join(words))]
        return one
    return map_rows(id_text(docs), "doc_id long, n_email long, n_ip long, n_card long, "
                                   "n_phone long, base_sha256 string, spans string", start)


def mask_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null, ``n_chars`` (where
    it exists) becomes the new length, all other columns and the order of columns stay."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else mask(t))

    out = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(docs.columns))
