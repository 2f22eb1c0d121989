"""Quality rules whose cutoffs are chosen by risk control. DataFrame functions only.

Words are ``[^\\x20\\x09-\\x0D]+``. The base rule fails texts of few words or of many repeated ones.
Besides it each signal (a count per hundred words or lines) has a grid of cutoffs, from loose to
tight. Labelled clean documents are the holdout: for each stratum, signal and cutoff, k of n are
rejected. A cutoff is certified if P(Binomial(n, a) <= k) <= d, the exact one-sided bound on a false
rejection rate above a. Over all signals of a stratum the rates add up to ``max_rejection`` at most
(a is its share for each signal), with probability 1 - ``failure`` for all strata together: d is
``failure`` divided by strata and signals (Bonferroni), and within a grid the cutoffs are tested in
fixed order until the first that is not certified, which needs no further correction. The tightest
certified cutoff is used; without one the signal rejects nothing in that stratum.

Cases: null text counts as empty and fails the base rule; a null stratum is a stratum of its own;
a document labelled more than once counts once, as clean if any label says so; labels for unknown
documents don't count; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Signal: counted, of what, cutoffs per hundred from loose to tight.
SIGNALS = {
    "symbols": ("n_symbols", "n_words", (200, 150, 100, 80, 60, 50, 40, 30, 20, 15, 10)),
    "shouts": ("n_shouts", "n_words", (100, 80, 60, 50, 40, 30, 20, 15, 10)),
    "dup_lines": ("n_dup_lines", "n_lines", (90, 80, 70, 60, 50, 40, 30)),
    "repeats": ("n_repeat_words", "n_words", (28, 25, 20, 15, 10, 5)),
}
MAX_REJECTION = 0.02
FAILURE = 0.05


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts of the base rule, the extra signals and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(WHITE))
    count_of = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    df = docs.select(*keep, text.alias("_t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+")).alias("_w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_l"))
    n = F.size("_w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.slice("_w", i, WINDOW)
    df = df.select("*", F.transform(starts, lambda i: F.xxhash64(window(i))).alias("_h"))
    # Equal windows have equal hashes: only where hashes repeat are the windows themselves compared.
    again = F.size("_h") > F.size(F.array_distinct("_h"))
    df = df.select("*", F.when(again, F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(window(i), " ").alias("s"), i.alias("i"))))).alias("_s"))
    same = lambda a, k: F.coalesce(F.get("_s", k)["s"] == a["s"], F.lit(False))
    twice = F.array_sort(F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate(twice, start, lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")), lambda acc: acc["total"])
    df = df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        count_of("!").alias("n_shouts"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def exceeds(signal: str, cutoff: int | Column) -> Column:
    of, total, _ = SIGNALS[signal]
    return 100 * F.col(of) > cutoff * F.col(total)


def certified(n: int, k: int, rate: float, level: float) -> bool:
    """Whether k of n rules out a rate above ``rate``: P(Binomial(n, rate) <= k) <= level."""
    if k > rate * n:
        return False
    term = n * math.log1p(-rate)
    logs = [term]
    step = math.log(rate) - math.log1p(-rate)
    for i in range(k):
        term += math.log(n - i) - math.log(i + 1) + step
        logs.append(term)
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(level)


def choose_cutoffs(counts: DataFrame, labels: DataFrame, max_rejection: float = MAX_REJECTION, failure: float = FAILURE) -> dict[str, dict[str | None, int]]:
    """Certified cutoff of each signal and stratum, from counts with ``doc_id`` and ``stratum``."""
    clean = labels.filter("quality = 1").select("doc_id").distinct()
    tests = [(s, c) for s, (_, _, grid) in SIGNALS.items() for c in grid]
    rejected = [F.count_if(exceeds(s, c)).alias(f"{s}_{c}") for s, c in tests]
    held = counts.join(clean, "doc_id", "left_semi").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *rejected)
    strata = max(1, counts.agg(F.count_distinct(F.coalesce(F.col("stratum"), F.lit("\0")))).first()[0])
    rate, level = max_rejection / len(SIGNALS), failure / len(SIGNALS) / strata
    least = math.ceil(math.log(level) / math.log1p(-rate))  # fewer can certify nothing
    out: dict[str, dict[str | None, int]] = {s: {} for s in SIGNALS}
    for row in held.filter(F.col("n") >= least).collect():  # at most one row for each ``least`` labels
        for s, (_, _, grid) in SIGNALS.items():
            for c in grid:
                if not certified(row["n"], row[f"{s}_{c}"], rate, level):
                    break
                out[s][row["stratum"]] = c
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_rejection: float = MAX_REJECTION, failure: float = FAILURE) -> DataFrame:
    """Counts, ``base_failed``, ``rejected_by`` (signals) and ``kept`` for each document.

    ``docs`` needs ``doc_id``, ``text`` and the stratum's column; ``labels`` has ``doc_id``, ``quality``.
    """
    docs = docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum"))
    counts = staged(word_counts(docs, ["doc_id", "stratum"]), "counts")
    chosen = choose_cutoffs(counts, labels, max_rejection, failure)
    strata = sorted({x for by in chosen.values() for x in by}, key=lambda x: (x is not None, x))
    # One row a certified stratum; Spark broadcasts them if they are few.
    table = docs.sparkSession.createDataFrame([(x, *(chosen[s].get(x) for s in SIGNALS)) for x in strata], "_stratum string, " + ", ".join(f"_{s} int" for s in SIGNALS))
    judged = counts.join(table, counts["stratum"].eqNullSafe(table["_stratum"]), "left")
    rejected = F.array_compact(F.array(*(F.when(exceeds(s, F.col(f"_{s}")), s) for s in SIGNALS)))
    return judged.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop(*table.columns)
