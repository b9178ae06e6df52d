"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are computed once for all rows and written to the shared folder.  Cosines of
random projections approximate a Gaussian kernel on them; each partition of the training rows sums
its share of the normal equations, the driver adds a fixed number of such shares and solves them.
Pool-adjacent-violators over a bounded number of bins turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, materialize, public_id, tidy
from .kernels import ALNUM, chunks, words

FEATURES = 256
RIDGE = 1e-2
#: Labelled rows to fit on, about; more are thinned by a hash of their id.
MOST_ROWS = 100_000
#: Partitions of the training rows: so many shares of the normal equations go to the driver.
SHARES = 12
BINS = 1024
FOLDS = 5

_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_HIGH = np.arange(256) >= 128
_COMMON = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"?()-"])
_NOT_LF = np.arange(256) != 10
_MARK = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH | _COMMON)
NAMES = [
    "bytes", "words", "lines", "word_bytes", "lower", "upper", "digit", "space", "high", "common_marks", "other_marks", "end_marks", "upper_words", "alnum_starts",
    "distinct_words", "distinct_lines", "longest_word", "line_words", "word_bytes_deviation", "short_words",
]


def _distinct(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each document has."""
    if not len(keys):
        return np.zeros(n)
    both = np.unique((keys >> np.uint64(20)) | (doc.astype(np.uint64) << np.uint64(44)))
    return np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)


def statistics_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of ``NAMES`` for each chunk of documents."""
    for (row, data, offsets), w, lines in zip(chunks(column), words(column), words(column, table=_NOT_LF), strict=True):
        n = len(offsets) - 1
        size = np.diff(offsets).astype(float)

        def share(table: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(table[data])))
            return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

        doc, count = w.doc(), np.diff(w.first).astype(float)
        many = np.maximum(count, 1)
        length = (w.end - w.start).astype(float)
        per = lambda x: np.bincount(doc, weights=x, minlength=n)
        mean = per(length) / many
        last, first = w.data[w.end - 1] if len(w.end) else w.data[:0], w.data[w.start] if len(w.start) else w.data[:0]
        second = w.data[np.minimum(w.start + 1, len(w.data) - 1)] if len(w.start) else w.data[:0]
        deviation = np.sqrt(np.maximum(per(length**2) / many - mean**2, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, doc, length)
        line_doc, line_count = lines.doc(), np.diff(lines.first).astype(float)
        yield np.column_stack(
            [
                np.log1p(size), np.log1p(count), np.log1p(line_count), np.log1p(mean), *(share(t) for t in (_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _COMMON, _MARK)),
                per(_MARK[last]) / many, per(_UPPER[first] & _UPPER[second]) / many, per(ALNUM[first]) / many,
                _distinct(w.hashes(), doc, n) / many, _distinct(lines.hashes(), line_doc, n) / np.maximum(line_count, 1), np.log1p(longest), np.log1p(count / np.maximum(line_count, 1)), np.log1p(deviation), per(length <= 3) / many,
            ]
        )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and x, the statistics of every row's whole text; they depend on the text alone."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [r for block in statistics_of(batch[1]) for r in block.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(x, pa.list_(pa.float32()))], names=["_id", "x"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(tidy(compute), "_id long, x array<float>")


class Model:
    """Standardised statistics, random Fourier features, weights and the calibration's corners."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d = len(NAMES)
        self.mean, self.scale = np.zeros(d), np.ones(d)
        self.directions = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.corners = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack((np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phase), np.ones(len(z))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.corners), 0, 1)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(float)


def _summed(rows: DataFrame, share) -> np.ndarray | None:
    """Sum over partitions of ``share(x, y)``, an array of fixed size, as each partition sums it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = share(_matrix(batch), batch.column("y").to_numpy().astype(float))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["total"])

    shares = [np.array(r.total) for r in rows.mapInArrow(tidy(add), "total array<double>").collect()]
    return np.sum(shares, axis=0) if shares else None


def isotonic(at: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in rising order: corners of a non-decreasing curve."""
    blocks: list[list[float]] = []
    for x, p, n in zip(at, positive, count, strict=True):
        blocks.append([x * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.round((raw + 0.5) / 2 * BINS), 0, BINS).astype(np.int64)


def fit(train: DataFrame) -> Model:
    """train: x and y (0 or 1), fold (0-3); rows of fold 0 calibrate, the others give the weights.

    Without rows the model says 0.5; with one class only it says that class's share.
    """
    model = Model()
    train = train.repartition(SHARES)
    moments = _summed(train, lambda x, y: np.concatenate(([len(y), y.sum()], x.sum(0), (x**2).sum(0))))
    if moments is None:
        return model
    d, n = len(NAMES), moments[0]
    prior = moments[1] / n
    model.corners = (np.array([0.0]), np.array([prior]))
    model.mean = moments[2 : 2 + d] / n
    variance = moments[2 + d :] / n - model.mean**2
    model.scale = np.where(variance > 1e-9, np.sqrt(np.maximum(variance, 1e-9)), 1.0)

    def equations(x, y):
        z = model.features(x)
        return np.column_stack((z.T @ z, z.T @ y))

    total = _summed(train.where("fold <> 0"), equations)
    if total is None or prior in (0.0, 1.0):
        return model
    total = total.reshape(FEATURES + 1, FEATURES + 2)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * n / 1000 * np.eye(FEATURES + 1), total[:, -1])

    def bins(x, y):
        b = _bin(model.raw(x))
        return np.column_stack((np.bincount(b, y, BINS + 1), np.bincount(b, minlength=BINS + 1)))

    counted = _summed(train.where("fold = 0"), bins)
    if counted is None:
        counted = _summed(train, bins)
    positive, count = counted.reshape(BINS + 1, 2).T
    used = count > 0
    model.corners = isotonic(np.arange(BINS + 1)[used] * 2 / BINS - 0.5, positive[used], count[used])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Only labels of ids whose ``crc32(id as text) mod 5`` isn't 0 are learnt from.  A label other
    than 0 or 1 or a null counts as none, of an id's several labels the largest counts.  A null or
    empty text has the statistics of an empty one and is scored like any; a null id stays null (and
    isn't held out); repeated rows have equal scores; an empty table gives no rows.
    """
    remainder = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(FOLDS))
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.where(remainder(F.col("_id")) != 0)
    n = known.count()
    if n > MOST_ROWS:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * MOST_ROWS / n)))
    train = stats.join(known, "_id").select("x", "y", (remainder(F.col("_id")) - 1).alias("fold"))
    model = stats.sparkSession.sparkContext.broadcast(fit(materialize(train, "training")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(model.value.score(_matrix(batch)))], names=["_id", "score"])

    out = stats.mapInArrow(tidy(score), "_id long, score double")
    return out.select(
        public_id(),
        F.coalesce(remainder(public_id("i")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
