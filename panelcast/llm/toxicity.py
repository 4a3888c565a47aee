"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each has a logistic model over
the presence of its most telling words and over the probabilities of the categories
before it. While the chain is fitted those probabilities are out-of-fold ones: each
row gets them from a model that has not seen its fold. The models are fitted by
Newton steps whose gradient and curvature each partition sums for its rows.

Defined cases: null and empty texts have no words and get the probability of such
texts; rows without id or label teach nothing; of several labels of an id the
greatest counts; a category with no labels, or with one class only, gets the share
of label 1 (0 without labels) everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common, linear
from panelcast.llm.decontam import words

#: Telling words of each category at most, the fewest labelled texts that hold one,
#: and the least z score.
WORDS, LEAST_TEXTS, LEAST_Z = 192, 3, 3.0
FOLDS = 3
STEPS = 8
RIDGE = 0.1
#: Labelled rows that the fit uses at most; beyond, a hash of the id chooses.
MAX_LABELLED = 200_000


@dataclass
class Link:
    """One model of the chain: its words, and weights for them, for the earlier
    probabilities and for a constant; or a fixed probability."""

    words: list[str]
    weights: np.ndarray
    base: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts and the bounds of each text's; of a single text beyond a
    batch the distinct ones, gathered part by part."""
    if not common.is_long(texts):
        return words(texts)
    flat = pc.unique(pa.chunked_array([pc.unique(words(part)[0]) for part in common.parts(texts)]))
    return flat, np.array([0, len(flat)])


def presence(flat: pa.Array, bounds: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Which words of ``vocabulary`` each text holds: a row of 0 and 1 for each."""
    n = len(bounds) - 1
    out = np.zeros((n, len(vocabulary)))
    if len(flat) and vocabulary:
        codes = pc.fill_null(pc.index_in(flat, pa.array(vocabulary, flat.type)), -1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        known = codes >= 0
        out[owner[known], codes[known]] = 1
    return out


def _word_lists(labelled: DataFrame) -> DataFrame:
    """A written table: the distinct words of each labelled text instead of the text."""
    others = [c for c in labelled.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch):
                flat, bounds = distinct_words(common.strings(part.column("text")))
                lists = [sorted(set(flat[int(a) : int(b)].to_pylist())) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(lists, pa.list_(pa.string()))], names=[*others, "words"])

    schema = labelled.select(*others).withColumn("words", F.array().cast("array<string>")).schema
    return common.staged(common.map_arrow(labelled, run, schema), "toxicity-words")


def word_counts(labelled: DataFrame, categories: Sequence[str]) -> DataFrame:
    """A written table (word, texts_<c>, hits_<c>): in how many labelled texts of each
    category a word occurs, and in how many of label 1. One aggregation for all
    categories; words of fewer than LEAST_TEXTS texts are left out."""
    rows = labelled.select(F.explode("words").alias("word"), *(F.when(F.col(c).isin(0, 1), F.col(c)).cast("long").alias(c) for c in categories))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(x for c in categories for x in (F.count(c).alias(f"texts_{c}"), F.coalesce(F.sum(c), F.lit(0)).alias(f"hits_{c}"))))
    return common.staged(counts.filter(F.col("n") >= LEAST_TEXTS), "toxicity-counts")


def telling_words(counts: DataFrame, category: str, n: int, ones: int, most: int = WORDS) -> list[str]:
    """The words whose share of texts differs most between the two classes, by the
    z score of two shares, which must be at least LEAST_Z; ``n`` texts are labelled,
    ``ones`` of them 1."""
    texts, hits = F.col(f"texts_{category}"), F.col(f"hits_{category}")
    share = texts / F.lit(float(n))
    gap = hits / F.lit(float(ones)) - (texts - hits) / F.lit(float(n - ones))
    z = F.abs(gap) / F.sqrt(share * (1 - share) * F.lit(1 / ones + 1 / (n - ones)) + F.lit(1e-12))
    rows = counts.filter(texts >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(most).collect()
    return [r["word"] for r in rows]


def _inputs(x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.column_stack([x, earlier, np.ones(len(x))])


def _out_of_fold(chain: list[tuple[Link, np.ndarray]], flat: pa.Array, bounds: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """For each text the probabilities of the fitted categories, each from the model
    that left the text's fold out."""
    out = np.zeros((len(fold), len(chain)))
    for i, (link, held_out) in enumerate(chain):
        out[:, i] = sigmoid((_inputs(presence(flat, bounds, link.words), out[:, :i]) * held_out[fold]).sum(1)) if len(held_out) else link.base
    return out


def _fit_link(labelled: DataFrame, counts: DataFrame, category: str, chain: list[tuple[Link, np.ndarray]]) -> tuple[Link, np.ndarray]:
    """A category's model, and the weights of the models that leave out one fold each.
    ``chain`` holds the same of the earlier categories."""
    known = labelled.filter(F.col(category).isin(0, 1))
    n, ones = known.agg(F.count(category), F.coalesce(F.sum(category), F.lit(0))).first()
    if not 0 < ones < n:
        return Link([], np.zeros(0), ones / n if n else 0.0), np.zeros((0, 0))
    vocabulary = telling_words(counts, category, n, ones)
    width = len(vocabulary) + len(chain) + 1
    weights = np.zeros((FOLDS + 1, width))

    def newton(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("words")
        flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in (category, "fold"))
        x = _inputs(presence(flat, bounds, vocabulary), _out_of_fold(chain, flat, bounds, fold))
        out = np.zeros((FOLDS + 1, width, width + 1))
        for f in range(FOLDS + 1):  # fold f is left out; the last model sees all
            own, target = x[fold != f], y[fold != f]
            p = sigmoid(own @ weights[f])
            out[f, :, :-1] = (own * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ own
            out[f, :, -1] = own.T @ (target - p)
        return out

    for _ in range(STEPS):
        sums = linear.summed(known.select("words", F.col(category).cast("double").alias(category), "fold"), newton, (FOLDS + 1, width, width + 1))
        steps = np.array([np.linalg.solve(s[:, :-1] + RIDGE * np.eye(width), s[:, -1] - RIDGE * w) for s, w in zip(sums, weights, strict=True)])
        weights = weights + steps
        if np.abs(steps).max() < 1e-3:
            break
    return Link(vocabulary, weights[-1], ones / n), weights[:-1]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = MAX_LABELLED) -> list[Link]:
    """The chain over ``categories``: names, in order, and 0/1 columns of ``labels``."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("int").alias(f"y_{k}") for k, c in categories.items())).filter("doc_id IS NOT NULL")
    taught = taught.groupBy("doc_id").agg(*(F.max(f"y_{k}").alias(f"y_{k}") for k in categories))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    # The labels that are used are bounded by max_labelled, so they may be broadcast,
    # and no text is shuffled.
    labelled = texts.join(F.broadcast(linear.bounded(taught, max_labelled)), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    labelled = _word_lists(labelled)
    names = [f"y_{k}" for k in categories]
    counts, chain = word_counts(labelled, names), []
    for name in names:
        chain.append(_fit_link(labelled, counts, name, chain))
    return [link for link, _ in chain]


def toxicity_scores(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Every row of ``docs (doc_id, text)``: doc_id and a probability p_<name> for each
    category of the chain. Scoring is one narrow stage over whole texts."""
    links, names = fit_chain(docs, labels, categories, max_labelled), list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch):
                flat, bounds = distinct_words(common.strings(part.column("text")))
                found = np.zeros((part.num_rows, len(links)))
                for i, link in enumerate(links):
                    found[:, i] = sigmoid(_inputs(presence(flat, bounds, link.words), found[:, :i]) @ link.weights) if len(link.weights) else link.base
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[:, i].copy()) for i in range(len(links)))], names=["doc_id", *(f"p_{k}" for k in names)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return common.map_arrow(rows, run, "doc_id long, " + ", ".join(f"p_{k} double" for k in names))
