"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

The presence of an n-gram in a text is a feature; its scale is the log ratio of how often it is
present in toxic and in other labelled texts; a logistic regression learns the weights of the scaled
features. Features whose ratio may be chance are left out, so a long clean text gathers no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.arrowtext import sliced, text_bytes
from keystrata.llm.ngrams import hashed
from keystrata.llm.tables import sum_tables
from keystrata.runtime import ship_package

SIZES = (3, 4, 5, 6)
BITS = 20
#: Bounds of what the classifier is fitted on: labelled texts of a class, those of the lowest hashes of
#: their ids, and n-grams, those whose ratio is the surest.
MAX_TEXTS_PER_CLASS = 5000
MAX_FEATURES = 100_000
#: Of an n-gram's likelihood-ratio test against chance (chi-squared of one degree), at every number of texts.
LEAST_G = 10.83
LEAST_RATIO = 1.0
#: Bytes of text whose n-grams a worker holds at a time, some 60 bytes of memory for each.
SLICE = 1 << 18


@dataclass
class Model:
    weights: np.ndarray  # float32 by hashed n-gram, the log-count ratio multiplied in
    bias: float


def _presence(batch: pa.RecordBatch, column: int, wanted: np.ndarray | None) -> np.ndarray:
    """Different (row << BITS | n-gram) of a batch, of wanted n-grams only. A batch is a slice of about
    SLICE bytes or one longer text, whose n-grams are marked in a table window by window."""
    data, offsets = text_bytes(batch.column(column))
    if batch.num_rows == 1 and len(data) > SLICE:
        seen = np.zeros(1 << BITS, bool)
        for at in range(0, len(data), SLICE):
            part = data[at : at + SLICE + max(SIZES) - 1]
            for _, gram in hashed(part, np.array([0, len(part)]), SIZES, BITS):
                seen[gram] = True
        return np.flatnonzero(seen if wanted is None else seen & wanted)
    found = []
    for text, gram in hashed(data, offsets, SIZES, BITS):
        if wanted is not None:
            keep = wanted[gram]
            text, gram = text[keep], gram[keep]
        found.append(text.astype(np.int64) << BITS | gram)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _surprise(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """G of each n-gram's presence in so many of the toxic and of the clean texts; a count of 0 is evidence as any other."""
    share = (toxic + clean) / (n_toxic + n_clean)
    g = np.zeros(len(toxic))
    for counts, n in ((toxic, n_toxic), (clean, n_clean)):
        for seen, expected in ((counts, n * share), (n - counts, n * (1 - share))):
            some = seen > 0
            g[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return g


def _logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, n_columns: int, l2: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse entries, by Adam on all rows."""
    theta, m, v = np.zeros(n_columns + 1), np.zeros(n_columns + 1), np.zeros(n_columns + 1)
    theta[-1] = np.log((weight * y).sum() / (weight * (1 - y)).sum())
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(rows, values * theta[columns], len(y)) + theta[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.append(np.bincount(columns, values * error[rows], n_columns) + l2 * theta[:-1], error.sum()) / total
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: F.Column | None = None) -> Model:
    """Learn from the labelled rows whose id meets `usable`. Labels other than 0 and 1 are no labels; an
    id labelled more than once counts by its highest label. With labels of one class or none, the
    model scores every text by the share of toxic labels, smoothed."""
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.where(F.col(label_col).isin(0, 1))
    known = known.where(usable) if usable is not None else known
    known = known.select(F.col(id_col), F.col(label_col).alias("y")).groupBy(id_col).agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    size = 1 << BITS
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    constant = Model(np.zeros(size, np.float32), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not n1 or not n0:
        return constant
    # At most MAX_TEXTS_PER_CLASS ids a class: their number is the proven bound of this broadcast.
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(MAX_TEXTS_PER_CLASS)
        chosen = part if chosen is None else chosen.union(part)
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, F.col("y").cast("int").alias("y"))

    def fill(table: np.ndarray, batches: Iterator[pa.RecordBatch]) -> None:
        for batch in sliced(batches, text_col, SLICE):
            y = np.asarray(batch.column(1)).astype(np.int64)
            entries = _presence(batch, 0, None)
            table[: 2 * size] += np.bincount(y[entries >> BITS] * size + (entries & (size - 1)), minlength=2 * size)
            table[2 * size : 2 * size + 2] += np.bincount(y, minlength=2)

    table = sum_tables(sample, fill, 2 * size + 2)
    n0s, n1s = table[2 * size :].tolist()
    if not n0s or not n1s:
        return constant
    p, q = table[size : 2 * size] + 0.5, table[:size] + 0.5
    ratio = np.log(p / (n1s + 1.0)) - np.log(q / (n0s + 1.0))
    surprise = _surprise(table[size : 2 * size], table[:size], n1s, n0s)
    candidates = np.flatnonzero((surprise >= LEAST_G) & (np.abs(ratio) >= LEAST_RATIO))
    candidates = candidates[np.argsort(-surprise[candidates], kind="stable")[:MAX_FEATURES]]
    if not len(candidates):
        return constant
    place = np.full(size, -1, np.int32)
    place[candidates] = np.arange(len(candidates))
    shared = spark.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in sliced(batches, text_col, SLICE):
            entries = _presence(batch, 0, at >= 0)
            rows = np.bincount(entries >> BITS, minlength=batch.num_rows)
            offsets = np.concatenate(([0], np.cumsum(rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[entries & (size - 1)]))], names=["y", "features"])

    # Bounded by MAX_TEXTS_PER_CLASS texts of each class and MAX_FEATURES.
    got = sample.mapInArrow(features, "y int, features array<int>").toArrow().combine_chunks()
    y = np.asarray(got.column("y").combine_chunks() if isinstance(got.column("y"), pa.ChunkedArray) else got.column("y")).astype(np.float64)
    lists = got.column("features").combine_chunks() if isinstance(got.column("features"), pa.ChunkedArray) else got.column("features")
    columns = np.asarray(lists.flatten()).astype(np.int64)
    rows = np.repeat(np.arange(len(y)), np.asarray(lists.value_lengths()))
    order = np.lexsort((columns, rows))  # rows come in any order; sums differ by rounding only
    rows, columns = rows[order], columns[order]
    weight = np.where(y > 0, n1 / n1s, n0 / n0s)
    weight /= weight.mean()
    scale = ratio[candidates]
    w, bias = _logistic(rows, columns, scale[columns], y, weight, len(candidates))
    weights = np.zeros(size, np.float32)
    weights[candidates] = (w * scale).astype(np.float32)
    return Model(weights, bias)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with one more column: the probability (0 to 1) that a text is toxic.

    Every text is read whole, a null one as empty: it has the score of a text without evidence. Other
    columns stay as they are (a column named `into` is replaced). The model is 4 MB, whatever the input.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != into]
    frame = docs.select(*kept)
    i = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wanted = m.weights != 0
        for batch in sliced(batches, text_col, SLICE):
            entries = _presence(batch, i, wanted)
            z = np.bincount(entries >> BITS, m.weights[entries & ((1 << BITS) - 1)], batch.num_rows) + m.bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], schema=batch.schema.append(pa.field(into, pa.float64())))

    from pyspark.sql.types import DoubleType, StructField, StructType

    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField(into, DoubleType())]))
