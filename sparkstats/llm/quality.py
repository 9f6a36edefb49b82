"""Quality classifier by co-training of two views.

The text view sees a document's words (with their first four and last three
bytes) and the shape of its text; the metadata view sees source, language and
length. Both are logistic regressions on signs of low quality: features whose
log odds speak against a document, in units of those odds. In each round both views
score every document outside the labelled sample, on Spark; the documents that a view is
confident about join the other view's counts of features by class, from which its
signs and their log odds are taken anew. The weight of a sign in units of its odds comes from
labelled rows; signs that none of these has get the mean weight of the others. On labelled
rows that neither view trains on, both are calibrated, and the calibrated log odds of
the views, less the prior that both contain, score every document.

The labelled rows are a bounded sample: at most ``LABELLED`` labelled documents, by
least hash of the id, and one row of each (the one of least hash); other labels are not
looked at. Features are counted per task and added up by Spark; the driver gets the counts of
features that at least ``LEAST_COUNT`` documents have, ``SPACE`` for each view at most, and
the signs, not the texts or all features, of the sample. The exchange and the scores
cover all documents.

Labels: a document is good if its quality is 1 and it is not toxic, bad if its
quality is 0 or it is toxic, and unlabelled otherwise; several labels of an id
count as the worst of them.

Defined cases: a null, empty or blank text has the one feature ``empty``; null
metadata are a value of their own; with no labelled document, or only one class
of them, every document scores that class's share (1 without labels); ties and
repeated rows score alike; labels without an id or a document are ignored; an
empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import carrying, shuffled, stored, text_of

LABELLED = 6000
HELD_OUT = 5             # every fifth labelled document calibrates
SPACE = 1 << 18          # hashed features of a view
LEAST_COUNT = 8          # documents that must have a feature
LEAST_ODDS = 1.0         # log odds against a document that a sign must have
CONFIDENT = 0.995

CAPITALS = bytes(range(65, 91))
MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def _share(name: bytes, x: float) -> bytes:
    return b"#%s%d" % (name, min(9, int(10 * x)))


def text_features(text: bytes) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.array([crc32(b"#empty") % SPACE], np.int32)
    known, n = set(words), len(text)
    found = [*known, *{w[:4] + b"^" for w in known}, *{b"$" + w[-3:] for w in known},
             _share(b"distinct", len(known) / len(words)), _share(b"bars", 2.5 * words.count(b"|") / len(words)),
             _share(b"capitals", (n - len(text.translate(None, CAPITALS))) / n),
             _share(b"marks", 3 * (n - len(text.translate(None, MARKS))) / n)]
    return np.fromiter(map(crc32, found), np.int64, len(found)).astype(np.int32) % SPACE


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    size = "?" if n_chars is None or n_chars != n_chars else int(max(0.0, n_chars)).bit_length()
    found = (f"source={source}", f"lang={lang}", f"size={size}", f"lang={lang},size={size}")
    return np.fromiter((crc32(x.encode()) for x in found), np.int64, 4).astype(np.int32) % SPACE


def _odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


@dataclass
class View:
    """Weights of signs against a document, and the calibration of their sum."""
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows])

    def logit(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift

    def calibrate(self, rows: list[np.ndarray], good: np.ndarray) -> None:
        """Logistic regression of the label on the raw sum, by Newton steps with a weak prior."""
        x = np.column_stack([self.raw(rows), np.ones(len(rows))])
        at = np.array([1.0, _odds((good.sum() + 1) / (len(good) + 2))])
        centre = at.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            gradient = x.T @ (good - p) - 0.01 * (at - centre)
            curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
            at = at + np.clip(np.linalg.solve(curve, gradient), -2, 2)
        self.slope, self.shift = max(float(at[0]), 0.0), float(at[1])


@dataclass
class Counts:
    """Of one view: documents by class (bad, good) and, by class, those that have each feature."""
    docs: np.ndarray
    features: np.ndarray

    def odds(self) -> np.ndarray:
        """Log odds of the signs, each class with half the weight; 0 for what is no sign."""
        half = self.docs.sum() / 2
        bad, good = (np.log(f * (half / n) + 1) - np.log(half) for f, n in zip(self.features, self.docs))
        out = good - bad
        out[(self.features.sum(0) < LEAST_COUNT) | (out > -LEAST_ODDS)] = 0
        return out


def fit_view(rows: list[np.ndarray], good: np.ndarray, odds: np.ndarray, rounds: int = 60, step: float = 0.05) -> np.ndarray:
    """Weights (none positive) of a class-balanced logistic regression on the signs. rows: their signs."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    signs, idx = np.unique(np.concatenate(rows) if len(row) else np.zeros(0, np.int32), return_inverse=True)
    if not len(signs):
        return np.zeros(SPACE)
    weight = np.where(good == 1, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    value, n = odds[signs][idx], len(signs)
    u, b, m, v, mb, vb = np.zeros(n), 0.0, np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam, with weights kept at or above zero
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=u[idx] * value, minlength=len(rows)) + b, -30, 30)))
        miss = (p - good) * weight / weight.sum()
        g, gb = np.bincount(idx, weights=miss[row] * value, minlength=n), miss.sum()
        m, mb, v, vb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb, 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        near, far = 1 - 0.9 ** t, 1 - 0.99 ** t
        u = np.maximum(u - step * (m / near) / (np.sqrt(v / far) + 1e-7), 0)
        b -= step * (mb / near) / (np.sqrt(vb / far) + 1e-7)
    every = np.full(SPACE, u.mean())
    every[signs] = u
    return every * odds


# --- passes ---------------------------------------------------------------------

Chosen = Callable[[pd.DataFrame, list, list], list]  # of a batch: per view, each row's class or -1


def _features(b: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.unique(text_features(x)) for x in b["body"]], [np.unique(meta_features(*x)) for x in zip(b["source"], b["lang"], b["n_chars"])]


def _counting(rows: DataFrame, chosen: Chosen) -> DataFrame:
    """``view, feature, bad, good``: documents that have each feature, and all documents as feature -1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2, SPACE + 1), np.int64)
        for b in batches:
            views = _features(b)
            for k, label in enumerate(chosen(b, *views)):
                for c in (0, 1):
                    mine = np.flatnonzero(np.asarray(label) == c)
                    if len(mine):
                        total[k, c, :-1] += np.bincount(np.concatenate([views[k][i] for i in mine]), minlength=SPACE)
                        total[k, c, -1] += len(mine)
        for k in (0, 1):
            at = np.flatnonzero(total[k].any(axis=0))
            yield pd.DataFrame({"view": k, "feature": np.where(at == SPACE, -1, at), "bad": total[k, 0, at], "good": total[k, 1, at]})

    return rows.mapInPandas(run, "view int, feature int, bad long, good long")


def _collected(counts: DataFrame) -> list[Counts]:
    found = (counts.groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
             .filter((F.col("feature") < 0) | (F.col("bad") + F.col("good") >= LEAST_COUNT)).toArrow())
    view, at, bad, good = (found.column(c).to_numpy() for c in ("view", "feature", "bad", "good"))
    out = []
    for k in (0, 1):
        features, docs = np.zeros((2, SPACE)), np.ones(2)
        mine, all_docs = (view == k) & (at >= 0), (view == k) & (at < 0)
        features[:, at[mine]] = bad[mine], good[mine]
        if all_docs.any():
            docs = np.maximum([bad[all_docs][0], good[all_docs][0]], 1).astype(float)
        out.append(Counts(docs, features))
    return out


def _sample_signs(sample: DataFrame, odds: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Per view the signs of each sampled row, in order of the ids."""
    used = [o != 0 for o in odds]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            views = _features(b)
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {name: [f[u[f]] for f in fs] for name, fs, u in zip(("text", "meta"), views, used)})

    got = sample.mapInPandas(run, "doc_id long, text array<int>, meta array<int>").toArrow().sort_by("doc_id")
    return [[np.asarray(x, np.int32) for x in got.column(c).to_pylist()] for c in ("text", "meta")]


def _confident(views: list[View]) -> Chosen:
    """What each view is sure of, as a label for the other one."""
    def choose(b: pd.DataFrame, text: list, meta: list) -> list:
        out = []
        for view, rows in zip(views, (text, meta)):
            p = 1 / (1 + np.exp(-np.clip(view.logit(rows), -30, 30)))
            out.append(np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1)))
        return out[::-1]
    return choose


def _good() -> Column:
    return (F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0.0)
            .when((F.col("quality") == 1) & F.coalesce(F.col("toxic") == 0, F.lit(True)), 1.0))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled sample, stored: ``doc_id, good`` and what features are made of."""
    marked = (labels.filter(F.col("doc_id").isNotNull()).select("doc_id", _good().alias("good"))
              .groupBy("doc_id").agg(F.min("good").alias("good")).filter("good IS NOT NULL"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().join(shuffled(marked), "doc_id")
    chosen = stored(ids.select("doc_id", "good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "labelled-sample")
    # at most LABELLED rows are broadcast; of an id's rows the one of least hash stays, so
    # that no id weighs more than another
    held = docs.select(*_inputs(), "doc_id").join(F.broadcast(chosen), "doc_id")
    held = held.withColumn("_place", F.struct(F.xxhash64("body"), "source", "lang", "n_chars"))
    rows = held.groupBy("doc_id").agg(F.min_by(F.struct("good", "body", "source", "lang", "n_chars"), "_place").alias("r"))
    return stored(rows.select("doc_id", "r.*"), "labelled-rows")


def _inputs() -> list[Column]:
    return [text_of().cast("binary").alias("body"), F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 2) -> tuple[list[View], float]:
    sample = training_rows(docs, labels)
    known = sample.select("doc_id", "good").toArrow().sort_by("doc_id")  # LABELLED rows at most
    ids, good = known.column("doc_id").to_numpy(), known.column("good").to_numpy()
    if not len(good) or good.min() == good.max():
        return [View(np.zeros(SPACE)), View(np.zeros(SPACE))], -_odds(good.mean() if len(good) else 1.0)
    held = np.zeros(len(good), bool)
    for label in (0.0, 1.0):  # both classes train and calibrate, if there are two rows of them
        held[np.flatnonzero(good == label)[HELD_OUT - 1::HELD_OUT]] = True
    train = ~held
    if not 0 < good[held].sum() < held.sum():
        train, held = np.ones(len(good), bool), np.ones(len(good), bool)  # too few to hold any out
    training = set(ids[train].tolist())

    def labelled(b: pd.DataFrame, text: list, meta: list) -> list:
        own = np.where(b["doc_id"].isin(training), b["good"], -1)
        return [own, own]

    counted = stored(_counting(sample, labelled), "labelled-counts")
    others = docs.select(*_inputs(), F.col("doc_id").cast("long").alias("doc_id")).join(
        F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    total, views = counted, []
    for turn in range(rounds + 1):
        odds = [c.odds() for c in _collected(total)]
        signs = _sample_signs(sample, odds)
        views = []
        for k in (0, 1):
            view = View(fit_view([signs[k][i] for i in np.flatnonzero(train)], good[train], odds[k]))
            view.calibrate([signs[k][i] for i in np.flatnonzero(held)], good[held])
            views.append(view)
        if turn < rounds:
            total = counted.unionByName(stored(_counting(others, _confident(views)), "lent-counts"))
    return views, _odds(float(good[held].mean()))


@carrying("doc_id", "text", "source", "lang", "n_chars")
def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, the probability that a document is good."""
    (text, meta), prior = fit(docs, labels)

    @F.pandas_udf(DoubleType())
    def score(body: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        logits = (text.logit([text_features(x) for x in body])
                  + meta.logit([meta_features(*x) for x in zip(source, lang, n_chars)]) - prior)
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return docs.withColumn("score", score(*_inputs()))
