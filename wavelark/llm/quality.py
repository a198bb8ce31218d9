"""Quality classifier: regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics. Each class has a
mean and a covariance, shrunk towards the pooled covariance and then towards a
multiple of the identity; its Cholesky factor is computed once. A score is the
logistic of the difference of the classes' log densities (Mahalanobis distance
and log determinant) plus their log prior odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_training, rows_of, staged, utf8

#: Labelled rows that the model is fitted on at most, chosen by their id's
#: hash. It bounds what reaches the driver; scoring has no bound.
FIT_ROWS = 20_000
CUT = 0.3
#: Of a short text the shares say little: as many bytes and words of a plain
#: text are added to what is counted.
PRIOR_BYTES, PRIOR_WORDS = 240, 40
NAMES = ("words", "word_length", "upper", "digits", "stops", "symbols", "bars", "shouts", "distinct", "pairs", "top", "short", "plain", "line_repeats", "line_words", "other")

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:?"
_SHOUTS = b"!"
_BARS = b"|\t<>{}[]"
_SPACES = b" \t\n\r\v\f"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _LETTERS + _DIGITS + _STOPS + _SHOUTS + _BARS)


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of one text; of a null as of an empty one."""
    t = text or b""
    words = t.split()
    n, size = len(words), len(t.translate(None, _SPACES)) + PRIOR_BYTES

    def share(kind: bytes) -> float:
        return (len(t) - len(t.translate(None, kind))) / size

    low = [w.lower().strip(b".,;:?!") for w in words]
    counts = Counter(low)
    pairs = (len(set(zip(low, low[1:], strict=False))) + PRIOR_WORDS) / (max(0, n - 1) + PRIOR_WORDS)
    counted = n + PRIOR_WORDS
    lines = [x for x in t.split(b"\n") if x.strip()]
    upper = share(_UPPER)
    spread = np.log1p(n)
    return np.array(
        [
            spread,
            np.log1p(size / counted),
            np.sqrt(upper),
            np.sqrt(share(_DIGITS)),
            np.sqrt(share(_STOPS)),
            np.sqrt(share(_SYMBOLS)),
            np.sqrt(share(_BARS)),
            np.sqrt(share(_SHOUTS)),
            np.log((len(counts) + PRIOR_WORDS) / counted) / max(1.0, spread),
            pairs,
            np.sqrt(max(counts.values(), default=0) / counted),
            (sum(len(w) <= 3 for w in low) + PRIOR_WORDS / 2) / counted,
            (sum(w.isalpha() or max(w, default=0) > 127 for w in low) + PRIOR_WORDS) / counted,
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))),
            share(bytes(range(0, 9)) + b"\x7f"),
        ]
    )


@dataclass
class Discriminant:
    """Fitted parameters; factors are the lower Cholesky factors, whiteners
    their inverses, computed once for all that is scored."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_prior: float

    def __post_init__(self):
        self.whiteners = [np.linalg.inv(f) for f in self.factors]
        self.log_sizes = [np.log(np.diag(f)).sum() for f in self.factors]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.3, ridge: float = 0.05) -> Discriminant | None:
        """None where a class has no rows."""
        if len(y) == 0 or len(set(y.tolist())) < 2:
            return None
        centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = (x - centre) / scale
        groups = [z[y == k] for k in (0, 1)]
        means = [g.mean(0) for g in groups]
        own = [(g - m).T @ (g - m) / len(g) for g, m in zip(groups, means, strict=True)]
        whole = sum(len(g) * c for g, c in zip(groups, own, strict=True)) / len(z)
        factors = []
        for g, c in zip(groups, own, strict=True):
            share = max(pooled, min(1.0, x.shape[1] / len(g)))
            c = (1 - share) * c + share * whole
            c = (1 - ridge) * c + ridge * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
            factors.append(np.linalg.cholesky(c))
        return Discriminant(centre, scale, means, factors, float(np.log(len(groups[1]) / len(groups[0]))))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log_density = [-0.5 * (((z - m) @ w.T) ** 2).sum(1) - size for m, w, size in zip(self.means, self.whiteners, self.log_sizes, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + self.log_prior, -500, 500)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            x = pa.array([statistics(t) for t in utf8(b.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def _few(known: DataFrame) -> DataFrame:
    """FIT_ROWS of the rows (id, ...) at most. A cut of the hash leaves about as
    many before they are ordered, so that a task sends its share only."""
    n = known.count()
    if n > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / n))
    return known.orderBy(F.xxhash64("id"), *known.columns).limit(FIT_ROWS)


def fit(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Discriminant | None:
    """Learns from the labelled training rows (id, x), FIT_ROWS at most."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_id).alias("id")).agg(F.max(label_col).alias("y"))
    known = rows.where(is_training(F.col("id"), 5, 0)).join(marks, "id")
    chosen = _few(known.select("id", "x", "y")).select("x", "y").collect()
    x = np.array([r.x for r in chosen], float).reshape(len(chosen), len(NAMES))
    return Discriminant.fit(x, np.array([r.y for r in chosen], int))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Per row: id, held_out, score (higher: label 1 likelier), predicted.

    Labels are learnt from ids whose crc32 as text isn't divisible by 5 only;
    held_out marks the others (null for a row without an id). Labels other
    than 0 and 1 are skipped; an id labelled twice has the larger label. Null
    and empty texts are scored as texts without words. Without labels of
    both classes every score is 1. Repeated rows stay rows.
    """
    rows = staged(features(docs, id_col, text_col), "features")
    model = fit(rows, labels, label_id, label_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(NAMES))
            score = np.ones(b.num_rows) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(work, f"id {kind}, score double")
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of docs that classify would predict as 1, unchanged.

    Statistics are computed in the pass that filters; only the rows that the
    model is fitted on are read before.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_id).alias("id")).agg(F.max(label_col).alias("y"))
    known = docs.select(F.col(id_col).alias("id")).where(is_training(F.col("id"), 5, 0)).join(marks.select("id"), "id").distinct()
    chosen = _few(known)
    few = docs.join(F.broadcast(chosen.withColumnRenamed("id", id_col)), id_col, "left_semi")  # FIT_ROWS ids at most
    model = fit(features(few, id_col, text_col), labels, label_id, label_col)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            if model is None or not b.num_rows:
                yield b
            else:
                x = np.array([statistics(t) for t in utf8(b.column(at))]).reshape(b.num_rows, len(NAMES))
                yield b.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(work, docs.schema)
