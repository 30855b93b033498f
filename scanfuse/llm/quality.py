"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfuse.llm.common import fresh, staged, table

#: Shape features of a text: the shares of each ASCII mark and of character and word classes.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
N_FEATURES = len(MARKS) + 13


def features(text: str) -> np.ndarray:
    """Of the whole text; zero for an empty one."""
    x = np.zeros(N_FEATURES)
    raw = text.encode("utf-8", "replace")
    if not raw:
        return x
    hist = np.zeros(256, dtype=np.int64)
    for k in range(0, len(raw), 1 << 20):
        hist += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - k), k), minlength=256)
    share = hist / len(raw)
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    repeats = sum(map(eq, words, words[1:]))
    m = len(MARKS)
    x[:m] = np.sqrt(share[MARKS])
    upper, lower, digit = share[65:91].sum(), share[97:123].sum(), share[48:58].sum()
    x[m:] = [
        upper, lower, np.sqrt(digit), share[128:].sum(), share[32], share[10], np.sqrt(share[MARKS].sum()),
        np.log1p(len(raw)) / 10, lengths.mean() / 10 if len(words) else 0.0, lengths.std() / 10 if len(words) else 0.0,
        len(set(words)) / n * np.log1p(n) / 10, np.sqrt(repeats / n), upper / max(upper + lower, 1e-9),
    ]
    return x


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _features(texts: pa.Array) -> pa.Array:
    x = np.array([features(t.as_py() or "") for t in texts], dtype=np.float32).reshape(-1, N_FEATURES)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_design(x, self.mean, self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.stack(lists.to_numpy()).astype(np.float64) if len(lists) else np.zeros((0, N_FEATURES))


def _totals(df: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums part(x, positive) over all rows: partial sums inside tasks, then an aggregate by position; the driver gets one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                now = part(_matrix(pdf["x"]), pdf["positive"].to_numpy(dtype=bool))
                total = now if total is None else total + now
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    rows = df.select("x", "positive").mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(rows, key=lambda r: r["at"])])


@dataclass(frozen=True)
class Risk:
    """Both parts of the risk at one point, without the ridge: value, slope and curvature of `trusted` and of `unbiased`."""

    trusted: tuple[float, np.ndarray, np.ndarray]
    unbiased: tuple[float, np.ndarray, np.ndarray]

    @property
    def negatives(self) -> float:
        """The unbiased estimate of the negatives' risk, which the clipped risk cuts at zero."""
        return self.unbiased[0] - self.trusted[0]

    def mixed(self, share: float) -> tuple[float, np.ndarray, np.ndarray]:
        return tuple(share * a + (1 - share) * b for a, b in zip(self.trusted, self.unbiased))  # type: ignore[return-value]


def fit(train: DataFrame, prior: float, ridge: float = 1e-2, steps: int = 12, halvings: int = 16) -> Model | None:
    """Fits a linear score to train (x, positive). All rows are the unlabelled web text, the positive ones the trusted sample.

    Minimises the non-negative risk pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)]) for the logistic loss, plus a ridge. That is the
    larger of two convex functions, pi * E_P[loss(+)] (`trusted`) and the unbiased risk, and its minimum that of a mixture of both: of the
    unbiased risk alone where the estimated risk of the negatives is not below zero there, else of the mixture at which that estimate
    is zero, whose share is found by halving; or of `trusted` alone. Each mixture is minimised by Newton steps over all rows. None if there is no positive row.
    """
    first = _totals(train, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(first) or first[1] == 0:
        return None
    n, n_pos = first[:2]
    d = (len(first) - 2) // 2
    mean = first[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(first[2 + d :] / n - mean**2, 0)) + 1e-3
    penalty = ridge * np.r_[np.ones(d), 0.0]

    def risk(w: np.ndarray) -> Risk:
        def part(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            a = _design(x, mean, scale)
            z = a @ w
            s = _sigmoid(z)
            bend = s * (1 - s)
            one, zp, sp = a[p], z[p], s[p]
            unlabelled = [[np.logaddexp(0, z).sum()], s @ a, ((a * bend[:, None]).T @ a).ravel()]
            positive = [[np.logaddexp(0, -zp).sum()], (sp - 1) @ one, ((one * bend[p][:, None]).T @ one).ravel(), one.sum(0)]
            return np.concatenate(unlabelled + positive)

        t = _totals(train, part)
        m = d + 1
        u, q = t[: 1 + m + m * m] / n, prior * t[1 + m + m * m :] / n_pos
        trusted = q[0], q[1 : 1 + m], q[1 + m : 1 + m + m * m].reshape(m, m)
        pull = q[1 + m + m * m :]  # pi * E_P of the features: loss(+) - loss(-) is minus the score
        return Risk(trusted, (u[0] - pull @ w, u[1 : 1 + m] - pull, u[1 + m :].reshape(m, m)))

    origin = np.zeros(d + 1)
    start = risk(origin)

    def minimum(share: float) -> tuple[np.ndarray, Risk]:
        """Of the mixture with `share` of `trusted`. It starts at the origin: where another share's minimum is far away, curvature says nothing."""
        w, now = origin, start
        for _ in range(steps if not share else 3 * steps):
            value, slope, bend = now.mixed(share)
            value, slope, bend = value + 0.5 * penalty @ w**2, slope + penalty * w, bend + np.diag(penalty + 1e-9)
            step = np.linalg.solve(bend, slope)
            size = 1.0
            while size > 1e-4:
                new = risk(w - size * step)
                gain = value - new.mixed(share)[0] - 0.5 * penalty @ (w - size * step) ** 2
                if gain >= -1e-12:
                    break
                size /= 2
            else:
                break
            w, now = w - size * step, new
            if gain < (1e-6 if share else 1e-5):
                break
        return w, now

    w, now = minimum(0.0)
    low, high = 0.0, 1.0
    for _ in range(halvings if now.negatives < -1e-6 else 0):
        share = (low + high) / 2
        w, now = minimum(share)
        if abs(now.negatives) <= 1e-4:
            break
        low, high = (share, high) if now.negatives < 0 else (low, share)
    return Model(mean, scale, w, prior)


def class_prior(positive: int, labelled: int) -> float:
    """The share of positives among labelled documents, as the lower end of its interval of two standard errors (Wilson's, so between 0 and 1).

    An overstated prior takes more from the unlabelled risk than the negatives have, so the estimate errs to the low side.
    """
    share, z2 = positive / labelled, 4.0
    spread = np.sqrt(z2 * (share * (1 - share) / labelled + z2 / (4 * labelled * labelled)))
    return float((share + z2 / (2 * labelled) - spread) / (1 + z2 / labelled))


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("label"))


def _fold() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def _fitted(seen: DataFrame, labels: DataFrame) -> Model | None:
    """The model of seen (doc_id, x, held_out; a written table) and the labels outside the held-out fold."""
    train = staged(seen.where("NOT held_out").join(_known(labels), "doc_id", "left").select("x", F.coalesce("label", F.lit(False)).alias("positive"), F.col("label").isNotNull().alias("labelled")), "train")
    n, pos = train.agg(F.sum(F.col("labelled").cast("long")), F.sum(F.col("positive").cast("long"))).first()
    return fit(train, class_prior(pos, n)) if pos else None


def _scorer(model: Model | None) -> Callable[[str], Column]:
    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(x)) if model else np.full(len(x), 0.5))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores every document for quality.

    docs: doc_id, text; labels: doc_id, quality; other columns are not read. Null text counts as empty and is scored like any other.
    Repeated rows are scored alike. Labels are learnt only from documents whose crc32(doc_id as text) mod 5 is not 0; a document with
    conflicting labels counts as its smallest; null labels are ignored. The positives are trusted; labels of 0 serve only to estimate the
    class prior, by the share of positives among learnt labels (see class_prior). Without any positive label every score is the prior 0.5.
    The unlabelled set is every document outside the held-out fold. Returns doc_id, held_out, score, predicted.
    """
    seen = staged(docs.select("doc_id", _features("text").alias("x"), _fold().alias("held_out")), "features")
    scored = seen.select("doc_id", "held_out", _scorer(_fitted(seen, labels))("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier accepts, with all their columns; each row is judged by its own text, whether or not rows share a doc_id or have none."""
    x = fresh(docs, "features")
    rows = staged(docs.withColumn(x, _features("text")), "features", dictionary=False)
    model = _fitted(rows.select("doc_id", F.col(x).alias("x"), _fold().alias("held_out")), labels)
    return rows.where(_scorer(model)(x) >= threshold).select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
