"""Language identification in two steps: the language family first, then one-versus-one linear support
vector machines within the family.

Features are relative frequencies of hashed character n-grams of the whole text. All machines are
linear, so a text's margins are means of n-gram weights, and a batch of texts takes a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.arrowtext import sliced, text_bytes
from keystrata.llm.ngrams import hashed
from keystrata.runtime import ship_package

SIZES = (1, 2, 3)
BITS = 12
#: Bound of what is learnt from: texts of a language, those of the lowest hashes of their ids.
MAX_TEXTS_PER_LANGUAGE = 500
#: Bound of the number of languages that can be learnt; more are refused, as none may be left out.
MAX_LANGUAGES = 200
UNKNOWN = "und"
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"),
    "uralic": ("fi", "hu", "et"),
}


def family_of(language: str) -> str:
    """The family of a language code; a language in no family is one of its own."""
    return next((f for f, members in FAMILIES.items() if language in members), language)


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]  # by family
    pairs: list[tuple[str, str]]  # of families or of languages: a positive margin means the first
    weights: np.ndarray  # n-grams x pairs
    bias: np.ndarray


def _frequencies(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Relative n-gram frequencies: rows x 2^BITS."""
    data, offsets = text_bytes(batch.column(column))
    counts = np.zeros((batch.num_rows, 1 << BITS), np.float32)
    for text, gram in hashed(data, offsets, SIZES, BITS):
        key = text.astype(np.int64) << BITS | gram
        counts += np.bincount(key, minlength=counts.size).reshape(counts.shape)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias for labels -1 and 1: hinge loss with L2, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    square = (x * x).sum(axis=1)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    bound = np.where(y > 0, c / (y > 0).mean(), c / (y < 0).mean())  # classes weigh alike
    order = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: F.Column | None = None) -> Model:
    """Learn from the rows with a text and a language that meet `usable`. Every language is learnt: more
    than MAX_LANGUAGES of them are a ValueError."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    languages = sorted(r[0] for r in rows.select(lang_col).distinct().orderBy(lang_col).limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values; merge rare ones or leave their rows out by `usable`")
    ids = None
    for lang in languages:
        part = rows.where(F.col(lang_col) == lang).select(id_col, F.lit(lang).alias("l")).orderBy(F.xxhash64(id_col), id_col).limit(MAX_TEXTS_PER_LANGUAGE)
        ids = part if ids is None else ids.union(part)
    families = sorted({family_of(x) for x in languages})
    by_family = {f: [x for x in languages if family_of(x) == f] for f in families}
    if ids is None:
        return Model([], {}, [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    # At most MAX_TEXTS_PER_LANGUAGE ids for each of MAX_LANGUAGES: the proven bound of this broadcast.
    sample = rows.select(id_col, text_col, F.col(lang_col).alias("l")).join(F.broadcast(ids.dropDuplicates()), [id_col, "l"]).select("l", text_col)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, 1 << 20):
            x = _frequencies(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["l", "x"])

    got = sorted((r["l"], bytes(r["x"])) for r in sample.mapInArrow(vectors, "l string, x binary").collect())
    lang = np.array([g[0] for g in got])
    x = np.frombuffer(b"".join(g[1] for g in got), np.float32).reshape(len(got), 1 << BITS)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-4
    x = (x - mean) / spread / np.sqrt(x.shape[1])
    fam = np.array([family_of(v) for v in lang])
    pairs, w, b = [], [], []
    for names, of in [(families, fam), *((by_family[f], lang) for f in families)]:
        for one, two in combinations(names, 2):
            rows_of = (of == one) | (of == two)
            weight, bias = linear_svm(x[rows_of], np.where(of[rows_of] == one, 1.0, -1.0))
            weight = weight / spread / np.sqrt(x.shape[1])
            pairs.append((one, two))
            w.append(weight)
            b.append(bias - float(weight @ mean))
    return Model(families, by_family, pairs, np.array(w, np.float32).T.reshape(1 << BITS, len(pairs)), np.array(b))


def _vote(names: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the winner, confidence) of one-versus-one machines: most votes, then the largest sum of margins."""
    if len(names) == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
    for (one, two), m in margins.items():
        i, j = names.index(one), names.index(two)
        votes[:, i] += m > 0
        votes[:, j] += m <= 0
        sums[:, i] += np.tanh(m)
        sums[:, j] -= np.tanh(m)
    winner = np.argmax(votes + sums / (2 * len(names)), axis=1)
    worst = np.full(n, np.inf)
    for (one, two), m in margins.items():
        i, j = names.index(one), names.index(two)
        worst = np.where(winner == i, np.minimum(worst, m), np.where(winner == j, np.minimum(worst, -m), worst))
    return winner, 1 / (1 + np.exp(-np.clip(2 * worst, -30, 30)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with a predicted language and a score (0 to 1, the product of both steps' confidences).

    A text that is null or has no letter is `und` with score 0, as is every text if nothing was learnt.
    Only the text is looked at, and all of it. Other columns stay (those named in `into` are replaced).
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in into]
    frame = docs.select(*kept)
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, text_col):
            n = batch.num_rows
            data, offsets = text_bytes(batch.column(place))
            sums, total = np.zeros((n, len(m.pairs))), np.zeros(n)
            for text, gram in hashed(data, offsets, SIZES, BITS):
                total += np.bincount(text, minlength=n)
                for k in range(len(m.pairs)):
                    sums[:, k] += np.bincount(text, m.weights[gram, k], n)
            margins = sums / np.maximum(total, 1)[:, None] + m.bias
            of = {p: margins[:, k] for k, p in enumerate(m.pairs)}
            pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if m.families:
                family, sure = _vote(m.families, {p: v for p, v in of.items() if p[0] in m.families and p[1] in m.families}, n)
                for i, f in enumerate(m.families):
                    names = m.languages[f]
                    lang, sure2 = _vote(names, {p: v for p, v in of.items() if p[0] in names and p[1] in names}, n)
                    here = family == i
                    pred[here] = np.array(names, object)[lang[here]]
                    score[here] = (sure * sure2)[here]
                # A byte of A-Z or a-z is a letter; other texts are looked at by character.
                plain = np.bincount(np.searchsorted(offsets, np.flatnonzero(_ASCII_LETTER[data]), side="right") - 1, minlength=n)
                for i in np.flatnonzero(plain == 0).tolist():
                    if not any(map(str.isalpha, batch.column(place)[i].as_py() or "")):
                        pred[i], score[i] = UNKNOWN, 0.0
            fields = [pa.field(into[0], pa.string()), pa.field(into[1], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], schema=pa.schema([*batch.schema, *fields]))

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField(into[0], StringType()), StructField(into[1], DoubleType())]))


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = True
_ASCII_LETTER[97:123] = True
