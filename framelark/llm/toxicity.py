"""Toxicity by a chain of linear classifiers over the presence of words."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, clean, documents, fresh, named, prepare, words

FOLDS = 5


def word_ids(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a whole text's words, without punctuation at their ends."""
    return np.unique(hashes.of(words(text)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton's method; the last one is the free intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class WordModel:
    """One link of the chain: words with a significant association, and the probabilities of the links before.

    It is fitted on rows of word numbers; ``name`` then gives it the words' hashes.
    """

    def __init__(self, most: int = 300, wrong: float = 0.01):
        self.most, self.wrong = most, wrong

    def select(self, rows: list[np.ndarray], y: np.ndarray, n_words: int) -> None:
        """Words whose presence depends on the label: likelihood ratio beyond chance after correction for the number of words tried."""
        count = lambda v: np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, k in zip(rows, y, strict=True) if k == v)]), minlength=n_words)
        with_word = np.stack([count(0), count(1)], 1).astype(float)
        self.column, n = np.full(n_words, -1), np.array([len(y) - y.sum(), y.sum()], float)
        tried = np.flatnonzero(with_word.sum(1) >= 5)
        if not len(tried) or n.min() == 0:
            return
        cells = np.stack([with_word[tried], n - with_word[tried]])
        expected = cells.sum(2, keepdims=True) * n / n.sum()
        g = 2 * (cells * np.log(np.maximum(cells, 1e-9) / np.maximum(expected, 1e-9))).sum((0, 2))
        order = np.argsort(-g, kind="stable")[: self.most]
        order = order[g[order] > 2 * math.log(len(tried) / self.wrong)]
        self.column[tried[order]] = np.arange(len(order))

    def numbered(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), self.column.max(initial=-1) + 1))
        for i, r in enumerate(rows):
            c = self.column[r]
            x[i, c[c >= 0]] = 1
        return np.hstack([x, earlier])

    def fit(self, rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, n_words: int) -> WordModel:
        self.select(rows, y, n_words)
        self.weights = fit_linear(self.numbered(rows, earlier), y)
        return self

    def name(self, ids: np.ndarray) -> WordModel:
        """Keep the hashes of the selected words (``ids`` has those of all numbers, ascending)."""
        chosen = np.flatnonzero(self.column >= 0)
        self.vocabulary, self.place = ids[chosen], self.column[chosen]
        del self.column
        return self

    def predict(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(self.vocabulary)))
        for i, r in enumerate(rows):
            x[i, self.place[np.isin(self.vocabulary, r, assume_unique=True)]] = 1
        return apply_linear(np.hstack([x, earlier]), self.weights)


class Chain:
    """A model for each category, in order. Each sees the words and what the earlier ones said.

    While training, what the earlier ones said comes from models that were not fitted on the row (``FOLDS`` folds),
    so a later link learns how far an earlier one can be trusted.
    """

    def __init__(self, categories: list[str]):
        self.categories, self.links = categories, []

    def fit(self, words_of: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> Chain:
        ids, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *words_of]), return_inverse=True)
        rows, earlier = np.split(flat, np.cumsum([len(r) for r in words_of])[:-1]), np.zeros((len(words_of), 0))
        for k in range(len(self.categories)):
            y, out = labels[:, k].astype(float), np.zeros(len(rows))
            for f in range(FOLDS):
                own, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(own) and len(held):
                    part = WordModel().fit([rows[i] for i in own], earlier[own], y[own], len(ids))
                    out[held] = apply_linear(part.numbered([rows[i] for i in held], earlier[held]), part.weights)
            self.links.append(WordModel().fit(rows, earlier, y, len(ids)).name(ids))
            earlier = np.hstack([earlier, out[:, None]])
        return self

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        said = np.zeros((len(rows), 0))
        for link in self.links:
            said = np.hstack([said, link.predict(rows, said)[:, None]])
        return said


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 8000) -> Chain | None:
    """Fit a chain on at most ``max_rows`` labelled documents, those with the smallest hashes of their id.

    ``labels`` has doc_id and one 0/1 column for each category; rows with a null are left out, repeated ids count as 1 where any says
    1. The sample is bounded, so its ids may be broadcast and its words gathered. None if nothing is labelled.
    """
    chosen = labels.dropna(subset=["doc_id", *categories]).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("int")).alias(f"_y{k}") for k, c in enumerate(categories)))
    chosen = chosen.orderBy(F.xxhash64(F.lit(8), "doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")

    @F.pandas_udf("binary")
    def ids_of(text: pd.Series) -> pd.Series:
        h = WordHashes(clean=clean)
        return pd.Series([word_ids(t, h).tobytes() for t in text], dtype=object)

    columns = [f"_y{k}" for k in range(len(categories))]
    # repeated ids may have several texts: one row of each, so that the bound holds
    rows = texts.groupBy("doc_id", *columns).agg(F.min("text").alias("text")).select("doc_id", *columns, ids_of("text").alias("ids")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    fold = np.array([(r["doc_id"] * 2654435761 >> 7) % FOLDS for r in rows])
    return Chain(categories).fit([np.frombuffer(r["ids"], np.uint64) for r in rows], np.array([[r[c] for c in columns] for r in rows]), fold)


def score(docs: DataFrame, chain: Chain | None, threshold: float = 0.2) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``toxic``: the last category's probability reaches ``threshold``.

    The whole text counts. Null, empty or wordless text is never toxic and has probability 0, as has any text where nothing was
    labelled. Rows are judged by themselves, so ids may be null or repeated; all other columns stay, those named as the new ones are replaced.
    """
    spark = prepare(docs.sparkSession)
    names = [f"p_{c}" for c in (chain.categories if chain else ["toxic"])]
    kind = "struct<" + ",".join(f"{n}:double" for n in names) + ">"
    model = spark.sparkContext.broadcast(chain)  # a few hundred words a category

    @F.pandas_udf(kind)
    def judge(text: pd.Series) -> pd.DataFrame:
        h = WordHashes(clean=clean)
        rows = [word_ids(t, h) for t in text]
        p = model.value.predict(rows) if model.value and rows else np.zeros((len(rows), len(names)))
        p[[not len(r) for r in rows]] = 0
        return pd.DataFrame(p, columns=names)

    rest = [c for c in docs.columns if c not in (*names, "toxic")]
    got = fresh(docs, "_judged")
    kept = [named(c) for c in rest]
    judged = docs.select(*kept, judge("text").alias(got))
    return judged.select(*kept, *(F.col(got)[n].alias(n) for n in names), (F.col(got)[names[-1]] >= threshold).alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train a chain (low quality, then toxicity) on ``labels`` (doc_id, quality, toxic) and score ``docs``; see ``train`` and ``score``."""
    both = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return score(docs, train(docs, both, ["low_quality", "toxic"]))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "p_low_quality", "p_toxic", "toxic", (~F.col("toxic")).alias("kept"))


__all__ = ["Chain", "WordModel", "op8_toxicity", "score", "toxicity", "train"]
