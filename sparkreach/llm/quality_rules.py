"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules: fewer than 50 words, or over half the words in repeated three-word windows. The method adds cutoffs on
ratios (RULES) for each stratum (language) from labelled holdouts. The rules' grids of cutoffs go together: at level j
every rule has its j-th cutoff, so what is rejected at one level is rejected at all lower ones too, by any rule. Of the
n good documents of a stratum k are rejected at a level, and the level is safe if the exact binomial tail
P(X <= k | n, max_risk) is at most error / strata: then a false-rejection rate above `max_risk`, of all rules together,
is ruled out (Clopper-Pearson). Levels are tested from the highest on and the first that isn't safe ends it; in such a
fixed sequence each test may have the full error of its stratum, so only strata need a correction (Bonferroni's). The
lowest safe level is used; with none, a stratum's documents are rejected by the base rules alone.

A stratum with too few good labels for even a level that rejects none of them is pooled with the others of that kind;
the guarantee is then on their pool. Languages without a good label get no cutoff.

Texts are scanned once, without a shuffle: windows, lines and words are arrays within a row. What follows works on a
written table of counts. Cutoffs are a row per stratum; they are broadcast, their count is checked first.

Cases: null and empty texts have no words and fail; null languages are a stratum of their own; a document labelled more
than once counts as good only if all its labels say so; rows of equal ids are judged each by its text, and a label of
the id holds for all of them; texts are read whole, at any length; no labels: only base rules reject; an empty table
gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLANK = r"\x20\x09-\x0D"
# rule: ratio of counts, and its grid of cutoffs (lowest, step); fixed before any data are seen
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.02, 0.04),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.10, 0.10),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.10, 0.05),
    "loners": ("n_loners / greatest(n_words, 1)", 0.05, 0.05),
}
LEVELS = 8
MAX_STRATA = 10_000  # of which cutoffs are broadcast; beyond, they are joined


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each row's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(f"[^{BLANK}]+"), F.lit(0))).withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{BLANK}]")))
    rows = rows.withColumn("n", F.size("w"))
    # windows as strings: a blank cannot be part of a word
    zipped = F.slice(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.col("n")).alias("b"), F.slice("w", F.lit(3), F.col("n")).alias("c")), F.lit(1), F.greatest(F.col("n") - 2, F.lit(0)))
    rows = rows.withColumn("g", F.transform(zipped, lambda x: F.concat_ws(" ", x["a"], x["b"], x["c"])))

    pairs = F.sort_array(F.transform(F.col("g"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def covered(s):
        """Words in windows that stand beside an equal one in the sorted array s of (window, place)."""
        before = lambda e, k: F.when(k > 0, F.try_element_at(s, F.greatest(k, F.lit(1)))["x"] == e["x"])
        after = lambda e, k: F.try_element_at(s, k + 2)["x"] == e["x"]
        same = F.filter(s, lambda e, k: F.coalesce(before(e, k), F.lit(False)) | F.coalesce(after(e, k), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    # transform over an array of one binds the sorted array, so that it is made once a row
    repeated = F.when(F.size(F.array_distinct("g")) == F.size("g"), 0).otherwise(F.element_at(F.transform(F.array(pairs), covered), 1))
    return rows.select(
        "doc_id",
        "lang",
        F.col("n").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        repeated.cast("bigint").alias("n_repeat_words"),
        F.size("l").cast("bigint").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.regexp_count("t", F.lit(rf"(?<=[{BLANK}])[^\p{{L}}\p{{N}}{BLANK}](?=[{BLANK}])")).cast("bigint").alias("n_loners"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def binomial_tail(k, n, p: float):
    """P(X <= k) of n trials with chance p, exact: terms by their recurrence, summed in logarithms."""
    odds, first = math.log(p) - math.log1p(-p), math.log1p(-p)
    start = F.struct((n * first).alias("term"), (n * first).alias("sum"))

    def step(a, j):
        term = a["term"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, step, lambda a: a["sum"]))


def level(low: float, step: float, ratio: str):
    """The last cutoff that the ratio reaches; below all of them -1."""
    return F.greatest(F.lit(-1), F.least(F.floor((F.expr(ratio) - low) / step), F.lit(LEVELS - 1))).cast("int")


def worst():
    return F.greatest(*(level(low, step, x) for x, low, step in RULES.values()))


def cutoffs(counted: DataFrame, labels: DataFrame, max_risk: float, error: float) -> DataFrame:
    """lang, pooled, at (the level), n, k, tail of the languages that have a safe level.

    With risk r, error e and t strata a level that rejects no good document needs log(t / e) / -log(1 - r) of them.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    held = counted.where(~F.col("base_failed")).join(good, "doc_id").groupBy("lang", worst().alias("b")).agg(F.count("*").alias("m"))
    held = written(held, "held")  # ten rows a language at most
    sizes = held.groupBy("lang").agg(F.sum("m").alias("n"))
    strata = sizes.count() + 1  # the pool may be one more
    enough = math.log(strata / error) / -math.log1p(-max_risk)
    sizes = sizes.select(F.col("lang").alias("own"), (F.col("n") < enough).alias("pooled"))
    sizes = sizes.withColumn("stratum", F.when(F.col("pooled"), "pool").otherwise(F.coalesce(F.concat(F.lit("="), "own"), F.lit("null"))))
    bins = held.join(sizes, F.col("lang").eqNullSafe(F.col("own"))).groupBy("stratum").agg(F.collect_list(F.struct("b", "m")).alias("bins"), F.sum("m").alias("n"))
    grid = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("at")).withColumn("k", F.expr("aggregate(filter(bins, x -> x.b >= at), 0L, (a, x) -> a + x.m)"))
    grid = grid.withColumn("tail", F.when(F.col("k") > F.col("n") * max_risk, 1.0).otherwise(binomial_tail(F.col("k"), F.col("n"), max_risk)))
    # k falls as levels rise, and so does the tail: the safe levels are those from the lowest safe one on
    safe = grid.where(F.col("tail") <= error / strata).groupBy("stratum").agg(F.min(F.struct("at", "n", "k", "tail")).alias("best"))
    return sizes.join(safe, "stratum").select(F.col("own").alias("lang"), "pooled", "best.*")


def judge(docs: DataFrame, labels: DataFrame, max_risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """counts of each row with kept and failed (names of the rules at or above their cutoff)."""
    counted = written(counts(docs), "counts")
    safe = written(cutoffs(counted, labels, max_risk, error).select(F.col("lang").alias("stratum"), "at"), "cutoffs")
    found = counted.join(F.broadcast(safe) if safe.count() <= MAX_STRATA else safe, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    failed = F.array_compact(F.array(*(F.when(level(low, step, x) >= F.col("at"), F.lit(name)) for name, (x, low, step) in RULES.items())))
    return found.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("stratum", "at")


def report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    return judge(docs, labels, **kw).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))
