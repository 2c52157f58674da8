"""Quality rules with cutoffs whose false rejections are bounded on labelled rows.

Each rule compares one signal with a cutoff of a fixed grid. A cutoff is allowed in a stratum when
the exact (Clopper-Pearson) upper bound of the share of good documents that it rejects is at most
``risk`` divided by the number of rules, at a confidence corrected for all rules and strata
(Bonferroni); along the grid, from the gentlest cutoff on, testing stops at the first failure
(fixed sequence), which needs no further correction. Of the allowed cutoffs the one with most bad
documents rejected, less a price for each good one, is taken, the gentlest of equal ones. With probability ``1 - delta``, then, all rules together
reject at most ``risk`` of the good documents of every stratum. A stratum with too few labels to
prove anything keeps its documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import id_text, map_rows
from tidegauge.operators.joins import null_safe_join
from tidegauge.session import spool

#: Largest share of good documents of a stratum that the rules may reject, and the chance to fail.
RISK = 0.05
DELTA = 0.05
#: Of the allowed cutoffs the best by bad rows rejected, less so many for each good one.
GOOD_COST = 10
#: Cutoffs of every rule, gentlest last.
GRID = tuple(i / 50 for i in range(50))
#: Fixed values of the base rule.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
         "n_upper", "n_marks", "n_distinct")


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur at least twice; exact, no hashing."""
    if len(ids) <= window:
        return 0
    ranks = ids
    step, width = 1, 1
    while width < window:
        step = min(width, window - width)
        pairs = ranks[:len(ranks) - step].astype(np.int64) * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        width += step
    again = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_stats(text: str) -> tuple[int, ...]:
    """Counts in the order of ``STATS``; lines count when they hold a word."""
    words = text.encode("utf-8").split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(ids), len(lines), upper,
            text.count("!") + text.count("?"), len(number))


def stats(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the columns ``more`` and the counts ``STATS`` per row of ``docs``."""
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more]

    def start():
        return lambda doc_id, text, *rest: [(doc_id, *rest, *text_stats(text))]
    schema = ", ".join(["doc_id long", *kept, *(f"{s} long" for s in STATS)])
    return map_rows(id_text(docs, *more), schema, start)


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def signals() -> dict[str, Column]:
    """Rule name to signal: each a share, larger is worse."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "upper": _share("n_upper", "word_chars"),
        "marks": F.least(_share("n_marks", "n_words"), F.lit(1.0)),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k) for k below the mean, summed from its largest term down; else 1."""
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = math.exp(log + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > total * 1e-17:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total, i = total + term, i - 1
    return min(total, 1.0)


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> float:
    """Cutoff of ``GRID`` from counts of good and bad rows by number of grid values below their
    signal; infinite where none is allowed or none is worth its good rows."""
    n = int(good.sum())
    best, most = math.inf, 0
    for g in range(len(GRID) - 1, -1, -1):
        if binomial_tail(int(good[g + 1:].sum()), n, risk) > delta:
            break
        gain = int(bad[g + 1:].sum()) - GOOD_COST * int(good[g + 1:].sum())
        if gain > most:
            best, most = GRID[g], gain
    return best


def fit_cutoffs(rows: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, cutoff, n_good`` from all labelled rows (``quality`` 1 good, 0 bad)."""
    names = list(signals())
    n_strata = max(1, rows.select(stratum).distinct().count())  # null is one of its own
    grid = F.lit(list(GRID))
    below = [F.struct(F.lit(r).alias("rule"), F.size(F.filter(grid, s.__gt__)).alias("above"))
             for r, s in signals().items()]
    counts = (rows.select(F.col(stratum).alias("stratum"), "quality", F.inline(F.array(*below)))
              .groupBy("stratum", "rule", "above", "quality").agg(F.count(F.lit(1)).alias("n")))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:  # at most rules x grid x 2 rows per stratum
        out = []
        for rule in names:
            part = frame[frame["rule"] == rule]
            tally = [np.bincount(p["above"], p["n"], len(GRID) + 1) if len(p) else np.zeros(len(GRID) + 1)
                     for p in (part[part["quality"] == 1], part[part["quality"] == 0])]
            out.append((frame["stratum"].iloc[0], rule,
                        choose_cutoff(*tally, risk / len(names), delta / (len(names) * n_strata)),
                        int(tally[0].sum())))
        return pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "n_good"])
    return counts.groupBy("stratum").applyInPandas(
        choose, "stratum string, rule string, cutoff double, n_good long")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK,
                delta: float = DELTA) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept`` and ``rejected_by`` per row of ``docs``.

    ``labels`` holds ``doc_id, quality``; rows with a null in either are no labels, several labels
    of a document count one each. A null text has no words and fails the base rule. Null strata are
    a stratum; one without labels has no rules. Repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty one. Documents that fail the base rule take no part in the choice of cutoffs.
    """
    found = spool(stats(docs.withColumn(stratum, F.col(stratum).cast("string")), stratum))
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    cutoffs = fit_cutoffs(found.where(~base_failed()).join(marked, "doc_id"), stratum, risk, delta)
    # one row per stratum; Spark measures it before it chooses a join
    limits = cutoffs.groupBy(F.col("stratum").alias(stratum)).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    rejected = F.filter(F.array(*(F.when(s > F.col("_cutoffs")[r], F.lit(r)) for r, s in signals().items())),
                        lambda x: x.isNotNull())
    out = (null_safe_join(found, limits, [stratum], "left")
           .withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected))
    return out.select("doc_id", *STATS, "base_failed",
                      (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
