"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model also sees the earlier categories' log-odds. It is trained
on out-of-fold predictions of those, so that it meets them as unsure as they will be on unseen text. Features are words
and word beginnings, chosen by their log-odds among the labelled rows; models are fitted on a bounded sample of these,
and every document is then scored where it lies, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Labelled rows fitted on, features kept for each category, rows that must hold a feature, folds, ridge, rounds of
#: gradient descent.
SAMPLE, FEATURES, LEAST_ROWS, FOLDS, RIDGE, STEPS = 8_000, 300, 5, 5, 3e-4, 100
#: Features are hashed to so many numbers.
HASHES = 1 << 22
#: Word beginnings used as features, by length.
PREFIXES = (4, 5)
#: Words that a task remembers the features of before it starts anew.
REMEMBERED = 300_000
THRESHOLD = 0.4

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """A word's features as hashes: itself and its beginnings."""
    names = [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]
    return [xxhash.xxh64_intdigest(x) & HASHES - 1 for x in names]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Weights of one category over the chosen features, the earlier categories' log-odds, and a constant."""

    category: str
    weights: np.ndarray
    earlier: np.ndarray
    constant: float


@dataclass
class Chain:
    index: dict[int, int]
    models: list[Model]

    def log_odds(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(rows, categories) of rows given as (feature indices, values)."""
        out = np.zeros((len(found), len(self.models)))
        for k, m in enumerate(self.models):
            base = np.array([m.weights[i] @ v if len(i) else 0.0 for i, v in found])
            out[:, k] = np.clip(base + out[:, :k] @ m.earlier + m.constant, -30, 30)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, width: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on a sparse part (row, column, value), a dense part and a constant; rows in ``use``.

    Accelerated gradient descent with diagonal scaling; a category without both classes gets a constant only.
    """
    target, weight = y.astype(float), use.astype(float)
    total, positive = weight.sum(), (weight * target).sum()
    if total == 0 or positive == 0 or positive == total:
        rate = (positive + 0.05) / (total + 0.1 + 0.9 * (positive == 0))
        return np.zeros(width), np.zeros(dense.shape[1]), math.log(rate / (1 - rate))
    weight = weight * np.where(target > 0, 0.5 * total / positive, 0.5 * total / (total - positive)) / total
    x = np.zeros(width + dense.shape[1] + 1)
    z, last, momentum = x.copy(), x.copy(), 1.0

    def spread(coef: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=vals * coef[cols], minlength=n) + dense @ coef[width:-1] + coef[-1]

    def gather(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(cols, weights=vals * r[rows], minlength=width), dense.T @ r, [r.sum()]])

    reach = np.bincount(rows, weights=np.abs(vals), minlength=n) + np.abs(dense).sum(axis=1) + 1
    scale = 0.25 * np.concatenate([np.bincount(cols, weights=np.abs(vals) * (weight * reach)[rows], minlength=width), np.abs(dense).T @ (weight * reach), [(weight * reach).sum()]]) + RIDGE
    ridge = np.full(len(x), RIDGE)
    ridge[-1] = 0.0
    for _ in range(STEPS):
        grad = gather(weight * (sigmoid(spread(z)) - target)) + ridge * z
        x = z - grad / scale
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        z = x + (momentum - 1) / after * (x - last)
        last, momentum = x, after
    return x[:width], x[width:-1], float(x[-1])


def chosen_features(sample: DataFrame, categories: list[str]) -> list[int]:
    """FEATURES of each category, by smoothed log-odds and support, of those that LEAST_ROWS or more entries hold.

    Counted in Spark from (categories..., features); ties go to the smaller hash, and no more than the chosen ones come
    to the driver.
    """
    flags = [F.sum(c).alias(c) for c in categories]
    total = sample.agg(F.count(F.lit(1)).alias("n"), *flags).first()
    counts = sample.select(*categories, F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *flags)
    counts = materialize(counts.where(F.col("n") >= LEAST_ROWS), "toxicity-counts")
    best = None
    for c in categories:
        yes = total[c] or 0
        a, b = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5
        odds = F.log(a / (yes + 1)) - F.log(b / (total["n"] - yes + 1))
        top = counts.select("feature", (F.abs(odds) / F.sqrt(1 / a + 1 / b)).alias("strength")).orderBy(F.desc("strength"), "feature").limit(FEATURES)
        best = top if best is None else best.union(top)
    return sorted({r.feature for r in best.collect()})


def fit_chain(owner: np.ndarray, features: np.ndarray, names: list[int], labels: np.ndarray, categories: list[str], folds: np.ndarray) -> Chain:
    """One model a category, in order.

    ``owner`` and ``features`` are one entry for each of the features ``names`` of each different word of each sampled
    row.
    """
    n, names = len(labels), np.array(names, np.int64)
    number = np.searchsorted(names, features)
    pairs, times = np.unique(owner.astype(np.int64) * HASHES + number, return_counts=True)
    rows, cols, vals = pairs // HASHES, pairs % HASHES, np.log1p(times.astype(float))
    width, models = len(names), []
    earlier = np.zeros((n, 0))
    for k, category in enumerate(categories):
        fit = lambda use: fit_linear(rows, cols, vals, n, width, earlier, labels[:, k], use)  # noqa: E731, B023
        odds = np.zeros(n)
        if k + 1 < len(categories):
            for fold in range(FOLDS):
                w, e, c = fit(folds != fold)
                own = np.bincount(rows, weights=vals * w[cols], minlength=n) + earlier @ e + c
                odds = np.where(folds == fold, np.clip(own, -30, 30), odds)
        w, e, c = fit(np.ones(n, bool))
        models.append(Model(category, w, e, c))
        earlier = np.column_stack([earlier, odds])
    return Chain(dict(zip(names.tolist(), range(width))), models)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled documents with their categories as 0/1, by the hash of doc_id, ordered by it.

    A document with several label rows has a category if any of them has; null counts as 0; several documents with one
    id are taken as they come.
    """
    flags = [F.max(F.coalesce(F.expr(e).cast("int"), F.lit(0))).alias(c) for c, e in categories.items()]
    each = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(*flags)
    count = max(1, each.count())
    cut = int(min(1.0, size / count) * (1 << 31))
    few = each.where(F.shiftrightunsigned(F.xxhash64("label_id"), 33) < cut).limit(2 * size)
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text")
    return texts.join(F.broadcast(few), "label_id")


#: What the labels say, as a chain: poor prose, toxic, toxic in otherwise sound prose.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_sound": "toxic = 1 AND quality = 1"}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES) -> Chain:
    """A chain fitted on a sample of at most about SAMPLE labelled rows.

    Features are counted and chosen in Spark; the driver gets the sampled rows' chosen features, which are bounded by
    FEATURES a category whatever the length of the texts.
    """
    names = list(categories)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                held = [sorted(f for w in words_of(t) for f in features_of(w)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(held, pa.list_(pa.int32()))], ["label_id", *names, "features"])

    kinds = ", ".join(f"{c} int" for c in names)
    schema = f"label_id long, {kinds}, features array<int>"
    with scratch():
        sample = materialize(labelled_sample(docs, labels, categories).mapInArrow(words, schema), "toxicity-sample")
        chosen = chosen_features(sample, names)
        wanted = np.array(chosen, np.int32)

        def only_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = [x[np.isin(x, wanted)] for x in (np.array(v, np.int32) for v in b.column(b.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(held, pa.list_(pa.int32()))], ["label_id", *names, "features"])

        got = sample.mapInArrow(only_chosen, schema).toArrow()
    ids = got.column("label_id").to_numpy()
    held = got.column("features").combine_chunks()
    folds = ids * 2654435761 % (1 << 32) % FOLDS
    lengths = held.value_lengths().to_numpy(zero_copy_only=False) if len(held) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    features = held.flatten().to_numpy(zero_copy_only=False) if len(held) else np.zeros(0, np.int32)
    labels = np.column_stack([got.column(c).to_numpy() for c in names]).astype(np.int64).reshape(-1, len(names))
    return fit_chain(owner, features, chosen, labels, names, folds)


def score(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with a column <prefix><category> for each category; null or empty text is scored by the constants alone.

    Repeated rows get equal scores, other columns stay, an empty table gives no rows; texts are read whole.
    """
    names = [m.category for m in chain.models]
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        index = chain.index

        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = out = tuple(k for f in features_of(word) if (k := index.get(f)) is not None)
                return out

        known = Known()

        def found(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            got: dict[int, int] = {}
            for word in words_of(text):
                for k in known[word]:
                    got[k] = got.get(k, 0) + 1
            keys = np.array(sorted(got), dtype=np.int64)
            return keys, np.log1p(np.array([got[k] for k in keys.tolist()], dtype=float))

        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                p = sigmoid(chain.log_odds([found(t) for t in part.column(part.num_columns - 1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(p[:, c]) for c in range(len(names))]], [*out_names[:-1], *out_names_p])

    own = [f.name for f in docs.schema.fields]
    out_names, out_names_p = [*[f"c{k}" for k in range(len(own))], "text"], [f"p{k}" for k in range(len(names))]
    schema = ", ".join([*[f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)], *[f"{p} double" for p in out_names_p]])
    done = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)], F.col("text").alias("text_scored")).mapInArrow(run, schema)
    return done.toDF(*own, *[f"{prefix}{c}" for c in names])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: doc_id, p_low_quality, p_toxic, p_toxic_sound, toxic (p_toxic of at least THRESHOLD).

    One row for each input row: null and empty texts are scored by the constants, repeated rows alike, other columns are
    ignored, no labels give constants only, and an empty table gives no rows.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the chain finds toxic; same columns, whatever their names."""
    prefix = "p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    scored = score(docs, train(docs, labels), prefix)
    return scored.where(F.col(f"{prefix}toxic") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
