"""Cutoffs of op6_quality_rules use every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from framelark.llm import quality


def test_rare_stratum_has_rules_and_cutoffs_are_quantiles(spark):
    n, rare = 60_000, 1_200  # among any 20,000 labels some 400 are rare and 180 of those good and held out; the bound needs 367
    place = F.when(F.col("id") < rare, "rare").otherwise("common")
    bad = F.col("id") % 10 == 9
    symbols = F.when(bad, 900).otherwise(F.col("id") % 7)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), place.alias("lang"), F.lit(100).alias("n_words"), F.lit(1000).alias("word_chars"), symbols.alias("n_symbols"), *(F.lit(0).alias(c) for c in ("n_dup_lines", "n_repeat_words", "n_upper", "n_marks")), F.lit(10).alias("n_worded_lines"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (~bad).cast("int").alias("quality"))
    rows = quality.labelled_rows(docs, labels, "lang").cache()
    assert rows.count() == n
    got = quality.choose_cutoffs(rows)
    assert set(got) == {"rare", "common"}
    good = rows.where("fit AND good AND stratum = 'rare'").toPandas()
    level, moved = quality.LEVELS[0]
    edge = float(np.quantile(good["symbols"], level))
    assert abs(got["rare"]["symbols"] - (edge + (1 - edge) * moved)) < 2e-5
    rows.unpersist()
