"""Quality rules whose cutoffs come from labelled documents with a bound on false rejection."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, cut, documents, fresh, mix, named, prepare

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_marks", "n_worded_lines"]
#: Shares that a rule bounds from above: name and SQL over the counts.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_worded_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: From the mildest rule set to the strictest: the share of good documents below a rule's cutoff, and how far the cutoff is then moved
#: towards 1, where it would reject nothing. The ladder was laid down before any labels were looked at with it.
LEVELS = ((1.0, 0.5), (1.0, 0.25), (1.0, 0.1), (1.0, 0.05), (1.0, 0.02), (1.0, 0.0), (0.999, 0.0), (0.995, 0.0), (0.99, 0.0))
_DROP_SYMBOLS, _DROP_MARKS = {ord(c): None for c in "#*$%&|<>"}, {ord(c): None for c in "!?|"}


def count_features(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """COUNTS and EXTRA of a whole text; zeros for null."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = len(text) - len(text.translate(_DROP_SYMBOLS))
    marks = len(text) - len(text.translate(_DROP_MARKS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeats = len(ws), 0
    if n > 3:
        h = hashes.of(ws)
        g = mix(mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:])
        _, back, times = np.unique(g, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, upper, marks, len(lines)


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` and ``EXTRA``; other columns stay, those named as the new ones are replaced."""
    prepare(docs.sparkSession)
    names = [*COUNTS, *EXTRA]

    @F.pandas_udf("struct<" + ",".join(f"{n}:long" for n in names) + ">")
    def count(text: pd.Series) -> pd.DataFrame:
        h = WordHashes()
        return pd.DataFrame([count_features(t, h) for t in text], columns=names, dtype="int64")

    rest, got = [c for c in docs.columns if c not in names], fresh(docs, "_counts")
    kept = [named(c) for c in rest]
    return docs.select(*kept, count("text").alias(got)).select(*kept, *(F.col(got)[n].alias(n) for n in names))


def upper_bound(rejected: int, n: int, wrong: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a share, from ``rejected`` of ``n``; fails with probability ``wrong`` at most."""
    if n == 0 or rejected >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(rejected + 1)]
    lo, hi = rejected / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p >= 1:
            break
        tail = math.fsum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(logs))
        lo, hi = (p, hi) if tail > wrong else (lo, p)
    return hi


def choose_cutoffs(rows: DataFrame, risk: float = 0.01, wrong: float = 0.05) -> dict[str, dict[str, float]]:
    """Cutoffs for each stratum, from rows of (stratum, good, fit, one column for each rule).

    On the ``fit`` half, a level's cutoffs are that quantile of each share among good documents, moved towards 1 (``LEVELS``). On the other half, a level
    passes while the exact upper bound of the share of good documents that its rules reject together is at most ``risk``. Levels are
    tried from the mildest on and the first failure ends it, so the levels need no correction; strata share ``wrong`` equally (Bonferroni). Of
    the levels that pass, the mildest one that rejects the most poor documents of the fit half is taken. A stratum where none passes has no rules.

    Quantiles and counts are aggregates over all rows; the driver sees the numbers of each stratum and level. For the quantiles, shares are
    rounded up to 1e-5, so that a stratum's state has 100,001 values a rule at most.
    """
    up = lambda r: F.ceil(F.col(r) * 100_000) / 100_000
    levels = F.array(*(F.lit(q) for q, _ in LEVELS))
    moved = F.array(*(F.lit(m) for _, m in LEVELS))
    edges = rows.where("fit AND good").groupBy("stratum").agg(*(F.percentile(up(r), levels).alias(f"_{r}") for r in RULES))
    edges = edges.select("stratum", *(F.zip_with(f"_{r}", moved, lambda q, m: q + (1 - q) * m).alias(f"_{r}") for r in RULES))
    reject = [F.greatest(*(F.col(r) > F.col(f"_{r}")[k] for r in RULES)) for k in range(len(LEVELS))]
    held, poor = ~F.col("fit") & F.col("good"), F.col("fit") & ~F.col("good")
    counts = [F.count_if(which & x).alias(f"{name}{k}") for name, which in (("h", held), ("p", poor)) for k, x in enumerate(reject)]
    first = [F.first(f"_{r}", True).alias(f"_{r}") for r in RULES]
    found = rows.join(F.broadcast(edges), "stratum", "left").groupBy("stratum").agg(F.count_if(held).alias("n"), *first, *counts).collect()  # a row for each stratum
    out: dict[str, dict[str, float]] = {}
    for f in sorted(found, key=lambda f: f["stratum"]):
        passed = passing([f[f"h{k}"] for k in range(len(LEVELS))], f["n"], risk, wrong / len(found)) if f["_symbols"] is not None else 0
        if passed:
            best = max(range(passed), key=lambda k: (f[f"p{k}"], -k))
            out[f["stratum"]] = {r: f[f"_{r}"][best] for r in RULES}
    return out


def passing(rejected: list[int], n: int, risk: float, wrong: float) -> int:
    """How many levels pass, from the mildest on: with ``rejected`` of ``n`` held-out good documents, the exact upper bound is ``risk`` at most."""
    for k, r in enumerate(rejected):
        # more than that share rejected: the bound is larger still
        if r > risk * n or upper_bound(r, n, wrong) > risk:
            return k
    return len(rejected)


def labelled_rows(features: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """Shares of all labelled documents that pass the base rules."""
    chosen = labels.dropna(subset=["doc_id", "quality"]).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"))
    # what the base rules reject needs no cutoffs; copies of an id count once
    place = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    own = features.where(~F.expr(BASE_FAILED)).select(F.col("doc_id").cast("long").alias("_id"), F.struct(place, *(F.expr(x).alias(n) for n, x in RULES.items())).alias("_s"))
    own = own.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_s").alias("_s"))
    joined = own.join(chosen, "_id")
    return joined.select("_s.*", (F.col("_q") >= 1).alias("good"), (F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(2)) == 0).alias("fit"))


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.01, wrong: float = 0.05) -> DataFrame:
    """``docs`` (without the text) with counts, ``base_failed``, ``rejected_by`` (sorted names of rules) and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows. The rules' cutoffs hold for a
    stratum; with probability 1 - ``wrong`` no stratum's rules reject more than ``risk`` of its good documents (see ``choose_cutoffs``;
    all labelled rows count; the cutoffs' ladder was fixed beforehand). A stratum without labels enough for the bound has no rules. Null text has no words.
    Null strata form one stratum; ids may be null or repeat; other columns stay.
    """
    features = cut(with_features(docs).drop("text"), "quality")
    cutoffs = choose_cutoffs(cut(labelled_rows(features, labels, stratum), "labelled"), risk, wrong)
    # a row for each stratum that has rules; each needs hundreds of labelled documents, so they are few
    table = docs.sparkSession.createDataFrame([(k, *(c[r] for r in RULES)) for k, c in cutoffs.items()], "_stratum string, " + ", ".join(f"_{r} double" for r in RULES))
    rest = [c for c in features.columns if c not in ("base_failed", "rejected_by", "kept")]
    kept = features.select(F.struct(*map(named, rest)).alias("r"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("s")).join(F.broadcast(table), F.col("s") == F.col("_stratum"), "left")
    kept = kept.select("r.*", F.array_sort(F.array_compact(F.array(*(F.when(F.expr(re.sub(r"\bn_|\bword_", lambda m: "r." + m[0], x)) > F.col(f"_{n}"), F.lit(n)) for n, x in RULES.items())))).alias("rejected_by"))
    return kept.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality(documents(spark, sf_dir).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "rejected_by")


__all__ = ["choose_cutoffs", "count_features", "op6_quality_rules", "quality", "upper_bound"]
