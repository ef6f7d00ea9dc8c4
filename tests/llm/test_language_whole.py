"""Copies and texts without a letter don't thin out what op9_language_id learns from."""

from pyspark.sql import functions as F

from framelark.llm import language


def test_copies_do_not_dilute_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "KernelRidge", lambda x, y: seen.extend(y))
    own = spark.range(300).select(F.concat(F.lit("text of number "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    copies = spark.range(20_000).select(F.lit("the same again").alias("text"), F.lit("aa").alias("lang"))
    marks = spark.range(10_000).select(F.col("id").cast("string").alias("text"), F.lit("aa").alias("lang"))
    language.fit_language(own.unionByName(copies).unionByName(marks), rows_each=800)
    assert len(seen) == 301
