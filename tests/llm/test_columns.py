"""Extra columns of any name stay as they were."""

import pytest

from framelark.llm import decontaminate, language, lines, pii, quality, toxicity

NAMES = ["_key", "_own", "_lost", "_bitmap", "_k", "_f", "_n", "_judged", "_guess", "_counts", "_none", "a", "b", "h", "row", "all", "more", "x.y", "p.q.r"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, "some words in a line of text\nand more of them " + "x " * d, *NAMES) for d in range(5)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.mark.parametrize("name", ["lines", "decontaminate", "language", "toxicity", "quality", "pii"])
def test_other_columns_stay(spark, docs, name):
    bench = spark.createDataFrame([(1, "some words in a line of text and more of them")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = {
        "lines": lambda: lines.drop_repeated_lines(docs),
        "decontaminate": lambda: decontaminate.decontaminate(docs, bench),
        "language": lambda: language.identify(docs, None),
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "quality": lambda: quality.quality(docs, labels, stratum="a"),
        "pii": lambda: pii.personal_data(docs),
    }[name]().collect()
    assert len(out) == 5 and all([r[n] for n in NAMES] == NAMES for r in out)
