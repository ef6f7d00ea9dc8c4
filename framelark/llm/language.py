"""Language identification with string kernels and Nyström landmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, fresh, named, prepare

SIZE = 8192
ORDERS = (1, 2, 3)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Which of ``SIZE`` hashed n-grams (1 to 3 code points, lower case, white space as one space) a whole text has."""
    c = np.frombuffer(" ".join(f" {text} ".lower().split()).join("  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    have, h = np.zeros(SIZE, bool), np.zeros(len(c), np.uint32)
    for n in ORDERS:
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        have[(h * np.uint32(0x9E3779B1)) >> np.uint32(19)] = True
    return have


def unit(rows: list[np.ndarray]) -> np.ndarray:
    """Presence vectors as rows of length 1, so that their products are normalised blended-spectrum kernels."""
    x = np.stack(rows).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class KernelRidge:
    """One-versus-rest ridge regression on the Nyström features of a presence kernel."""

    def __init__(self, x: np.ndarray, y: list[str], landmarks_each: int = 48, penalty: float = 0.1):
        self.languages = sorted(set(y))
        at: dict[str, list[int]] = {k: [] for k in self.languages}
        for i, v in enumerate(y):
            at[v].append(i)
        marks = x[[i for k in self.languages for i in at[k][:landmarks_each]]]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = (x @ marks.T).astype(np.float64) @ root
        features = np.hstack([features, np.ones((len(x), 1))])
        target = np.array([[1.0 if v == k else -1.0 for k in self.languages] for v in y])
        share = np.array([len(y) / len(self.languages) / len(at[v]) for v in y])  # each language counts alike
        w = np.linalg.solve((features * share[:, None]).T @ features + penalty * np.eye(features.shape[1]), (features * share[:, None]).T @ target)
        self.marks, self.weights, self.bias = np.ascontiguousarray(marks.T), (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.marks @ self.weights + self.bias

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        s = self.scores(x)
        e = np.exp(4 * (s - s.max(1, keepdims=True)))
        return [self.languages[i] for i in s.argmax(1)], np.clip(e.max(1) / e.sum(1), 0, 1)


def fit_language(labelled: DataFrame, rows_each: int = 800) -> KernelRidge | None:
    """Fit on about ``rows_each`` different texts of each language at most (text, lang), chosen by a hash of the text.

    Null languages and texts without a letter are left out. The number of languages is taken to be small (it is that of the labels, not of the documents).
    """
    prepare(labelled.sparkSession)
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("text", "lang")
    # copies of a text are drawn together, so they count once
    counts = {r["lang"]: r["count"] for r in usable.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().collect()}
    if not counts:
        return None
    rate = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, rows_each / n))))
    draw = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.where(draw < rate[F.col("lang")])

    @F.pandas_udf("binary")
    def bits(text: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in text], dtype=object)

    # copies of a text share its hash: one row of each is enough
    rows = chosen.dropDuplicates(["text", "lang"]).select("lang", bits("text").alias("b"), F.xxhash64("text").alias("h")).where("b IS NOT NULL").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"]))
    if not rows:
        return None
    return KernelRidge(unit([np.unpackbits(np.frombuffer(r["b"], np.uint8)) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: KernelRidge | None, batch: int = 128) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Rows are judged by themselves; other columns stay,
    those named as the new ones are replaced.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # landmarks: languages x 48 x SIZE floats

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def guess(text: pd.Series) -> pd.DataFrame:
        names, scores = ["und"] * len(text), np.zeros(len(text))
        at = [i for i, t in enumerate(text) if has_letter(t)] if shared.value else []
        for k in range(0, len(at), batch):
            part = at[k : k + batch]
            got, s = shared.value.predict(unit([presence(text.iloc[i]) for i in part]))
            for i, g in zip(part, got, strict=True):
                names[i] = g
            scores[part] = s
        return pd.DataFrame({"lang_pred": names, "score": scores})

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    got = fresh(docs, "_guess")
    kept = [named(c) for c in rest]
    return docs.select(*kept, guess("text").alias(got)).select(*kept, f"{got}.lang_pred", f"{got}.score")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = fit_language(docs.where(~F.col("held_out")).select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


__all__ = ["KernelRidge", "fit_language", "identify", "op9_language_id", "presence"]
