"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of every whole text (shares of character classes, word and line shapes; no labels, lang,
source or doc_id) are written once. Class counts, means and covariances are exact moments of the
labelled training rows, at most ``FIT_ROWS`` of them by a hash of the doc_id, summed by Spark to a few
hundred numbers; only those reach the driver. Each
class covariance is shrunk towards the pooled one and that towards its diagonal, so it can always be
factored. The Cholesky factors are cached in the model; a score is the logistic of the difference of
two Mahalanobis log-densities plus the log prior odds, tempered to keep scores graded.

Defined results: null and empty texts have all-zero statistics and are scored like any other; rows
without a label, or with a label other than 0 or 1, do not train; several labels of one document,
and repeated rows of one, all count; equal scores are equal decisions; texts of any length are measured
whole; other columns are ignored, whatever their names; without training rows of both classes the score is the smoothed share of label 1; a null
doc_id is never held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm.common import table, text_of, written

#: Shares of the pooled covariance in a class covariance, and of the diagonal in the pooled one.
SHRINK_CLASS, SHRINK_DIAGONAL = 0.5, 0.05
#: Log-density differences are divided by this before the logistic: words are not independent draws.
TEMPERATURE = 4.0
THRESHOLD = 0.3
FOLDS = 5
#: Labels that train, at most: a fixed size of sample, so that fitting costs the same however many labels there are.
FIT_ROWS = 50_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PROSE = np.zeros(256, bool)
_PROSE[list(b".,;:'\"?-()")] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _PROSE | _TAIL)

WIDTH = 14


def statistics(raw: bytes) -> np.ndarray:
    """Transformed statistics of one text (UTF-8)."""
    out = np.zeros(WIDTH)
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars, n = len(raw) - counts[_TAIL].sum(), len(words)
    letters = max(1, counts[_LETTER].sum())
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x]
    out[:] = (
        np.log1p(n),
        np.log(sizes.mean()),
        np.log1p(sizes.std()),
        np.sqrt(counts[_UPPER].sum() / letters),
        np.sqrt(counts[_DIGIT].sum() / chars),
        np.sqrt(counts[_PROSE].sum() / chars),
        np.sqrt(counts[_SYMBOL].sum() / chars),
        np.sqrt(counts[124] / n),
        np.sqrt(counts[33] / n),
        np.sqrt(len(set(words)) / n),
        np.log(n / max(1, len(lines))),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.sqrt(counts[46] / n),
        np.sqrt((sizes <= 3).mean()),
    )
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t.as_buffer().to_pybytes()) for t in batch["text"]]).reshape(-1, WIDTH)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every document, written once."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return written(rows.mapInArrow(_measure, f"doc_id {kind}, x array<double>"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    """Two Gaussians by mean, inverse Cholesky factor and log-determinant, or a constant score."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None
    odds: float = 0.0
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        density = [-0.5 * ((((x - m) @ f.T) ** 2).sum(1) + d) for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        z = (density[1] - density[0] + self.odds) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    for batch in batches:
        x, y = np.array(batch["x"].tolist()).reshape(-1, WIDTH), batch["label"].to_numpy()
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
    yield pd.DataFrame({"label": np.repeat([0, 1], sums.shape[1]), "i": np.tile(np.arange(sums.shape[1]), 2), "v": sums.ravel()})


def training_labels(labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(of, label): the labels that train, outside the held-out fold, bounded by ``fit_rows``."""
    known = labels.select(F.col("doc_id").alias("of"), F.col(label_col).cast("int").alias("label"))
    return known.where(F.col("label").isin(0, 1) & ~held_out(F.col("of"))).orderBy(F.xxhash64("of"), "of", "label").limit(fit_rows)


def fit(rows: DataFrame, known: DataFrame) -> Model:
    """The model of ``rows`` (of :func:`measured`) and the labels ``known`` (of :func:`training_labels`)."""
    train = rows.join(F.broadcast(known), rows["doc_id"] == known["of"]).select("x", "label")
    sums = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    for c, i, v in train.mapInPandas(_moments, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v")).collect():
        sums[c, i] = v
    n = sums[:, 0]
    if n.min() < 2:
        return Model(constant=float((n[1] + 1) / (n.sum() + 2)))
    means = sums[:, 1 : 1 + WIDTH] / n[:, None]
    covs = [sums[c, 1 + WIDTH :].reshape(WIDTH, WIDTH) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    pooled = (1 - SHRINK_DIAGONAL) * pooled + SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(WIDTH)
    lower = [np.linalg.cholesky((1 - SHRINK_CLASS) * s + SHRINK_CLASS * pooled) for s in covs]
    return Model(
        means, np.array([np.linalg.inv(low) for low in lower]), np.array([2 * np.log(np.diag(low)).sum() for low in lower]), float(np.log(n[1] / n[0]))
    )


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for ``rows`` of :func:`measured`."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, without those scored below ``threshold``."""
    known = written(training_labels(labels))
    # only the rows that train are measured for the fit; their ids are few enough to broadcast
    mine = docs.join(F.broadcast(known.select(F.col("of").alias("__tg_of")).distinct()), F.col(f"`{id_col}`") == F.col("__tg_of"), "left_semi")
    model = fit(measured(mine, id_col, text_col), known)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t.encode()) for t in texts]).reshape(-1, WIDTH)))

    return docs.where(score(text_of(text_col)) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(table(spark, sf_dir, "documents"))
    scores = scored(rows, fit(rows, training_labels(table(spark, sf_dir, "labels"))))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
