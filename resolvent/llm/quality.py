"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text is read once, for its statistics.  They are standardised by mean and deviation over all documents
and mapped to random Fourier features, whose inner products approximate a Gaussian kernel.  Partitions sum
their parts of the normal equations; the solved ridge scores are calibrated by an isotonic fit on a fold of
the training rows that the equations have not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, hash_spans, padded, pieces, runs, sums, utf8
from ._labels import fold, isotonic, training_labels
from ._spark import durable, tune

#: Random features, kernel width in deviations, ridge per row, labelled rows of each class at most, calibration bins.
FEATURES, WIDTH, RIDGE, MOST_LABELS, BINS = 192, 4.0, 1e-4, 100_000, 2000
NAMES = ["log_bytes", "log_words", "word_len", "upper", "digit", "mark", "symbol", "bar", "bang", "line", "capital", "beyond_ascii", "distinct", "stop", "long", "top"]

_SPACE, _ALPHA, _UPPER, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(6))
_SPACE[[*range(0x09, 0x0E), 0x20]] = True
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_MARK[[ord(c) for c in ".,;:?'\"-()"]] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"]] = True


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[documents, len(NAMES)] statistics of texts; all 0 for an empty text."""
    n = np.diff(off).astype(np.float64)
    by = lambda flags: sums(flags, off)
    starts, ends, _, first = runs((~_SPACE[buf]).astype(np.uint8), off)
    words = np.diff(first).astype(np.float64)
    size = ends - starts
    letters = by(_ALPHA[buf]).astype(np.float64)
    h = hash_spans(padded(LOWER[buf]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), np.diff(first))
    key = (doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    times = np.diff(np.append(begins, len(key)))
    owner = (key[begins] >> np.uint64(44)).astype(np.int64)
    distinct = np.bincount(owner, minlength=len(n))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, owner, times)
    w, c, a = np.maximum(words, 1), np.maximum(n, 1), np.maximum(letters, 1)
    per = lambda x: sums(x, first)
    return np.column_stack([
        np.log1p(n), np.log1p(words), by(~_SPACE[buf]) / w, by(_UPPER[buf]) / a, by(_DIGIT[buf]) / c, by(_MARK[buf]) / w, by(_SYMBOL[buf]) / w,
        by(buf == 0x7C) / w, by(buf == 0x21) / w, by(buf == 0x0A) / w, per(_UPPER[buf[starts]]) / w if len(starts) else words, by(buf >= 0x80) / c,
        distinct / w, per(size <= 3) / w, per(size >= 12) / w, top / w,
    ]).astype(np.float64)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, f array<double>)``."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(1))
            for i, j in pieces(off):
                f = statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(NAMES)), pa.array(f.reshape(-1)))], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, f array<double>")


class Fourier:
    """Random features of standardised statistics: a linear part, cosines and a constant."""

    def __init__(self, mean, deviation, features: int = FEATURES, width: float = WIDTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = np.asarray(mean), np.where(np.asarray(deviation) > 1e-9, deviation, 1.0)
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.deviation, -6, 6)
        return np.column_stack([np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b)), x, np.ones(len(x))])


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    column = b.column(k)
    return np.asarray(column.flatten()).reshape(len(column), -1)


def normal_equations(rows: DataFrame, phi: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """``rows(f, y, w)`` -> weighted sums of the features' products with each other and with y."""
    d = len(phi.b) + len(phi.mean) + 1

    def run(batches):
        total = np.zeros((d, d + 1))
        for b in batches:
            z, y, w = phi(_matrix(b, 0)), np.asarray(b.column(1)), np.asarray(b.column(2))
            total += (z * w[:, None]).T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * (d + 1)), pa.array(total.reshape(-1)))], ["i", "v"])

    parts = rows.mapInArrow(run, "i long, v array<double>")
    summed = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(d + 1)]).alias("v")).collect()  # d rows of d + 1 numbers
    out = np.zeros((d, d + 1))
    for r in summed:
        out[r["i"]] = r["v"]
    return out[:, :d], out[:, d]


def ridge_solution(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights of the ridge regression; the last feature is the constant, so its entry is the rows' weight."""
    return np.linalg.solve(a + np.eye(len(a)) * RIDGE * max(1.0, a[-1, -1]), b)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, column: str = "quality", threshold: float = 0.5, most: int = MOST_LABELS) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``labels(doc_id, quality)`` -> ``(doc_id, held_out, score, predicted)``, one row per
    row of ``docs``.

    Only labels whose fold is not ``held`` are learnt, at most ``most`` of each class.  Null and empty texts have
    statistics of 0 and are scored like any other.  With no labels, or of one class only, every score is the share of
    label 1 (0.5 without labels).  Repeated rows are scored each; other columns are ignored.
    """
    tune(docs.sparkSession)
    base = durable(document_statistics(docs))
    k = len(NAMES)
    moments = base.agg(*[g(F.col("f")[i]) for i in range(k) for g in (F.avg, F.stddev_pop)]).first()
    chosen, weight = training_labels(labels, column, modulus, held, most)
    out = base.withColumn("held_out", fold(F.col("doc_id"), modulus) == held)
    if len(weight) < 2:
        score = F.lit(float(next(iter(weight))) if weight else 0.5)
        return out.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    phi = Fourier([moments[2 * i] or 0.0 for i in range(k)], [moments[2 * i + 1] or 0.0 for i in range(k)])
    w = F.when(F.col("y") == 1, F.lit(weight[1])).otherwise(F.lit(weight[0]))
    train = durable(base.join(chosen, "doc_id").select("doc_id", "f", F.col("y").cast("double").alias("y"), w.cast("double").alias("w")))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0  # a quarter calibrates
    a, b = normal_equations(train.where(~apart).select("f", "y", "w").repartition(16), phi)
    beta = ridge_solution(a, b)

    def ridge(f: np.ndarray) -> np.ndarray:
        return np.clip(phi(f) @ beta, -0.5, 1.5)

    def bins(batches):
        for x in batches:
            s = np.floor((ridge(_matrix(x, 0)) + 0.5) / 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), x.column(1), x.column(2)], ["s", "y", "w"])

    seen = train.where(apart).select("f", "y", "w").mapInArrow(bins, "s long, y double, w double").groupBy("s").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y")).collect()  # at most BINS + 1 rows
    if seen:
        at = np.array([(r["s"] + 0.5) * 2 / BINS - 0.5 for r in seen])
        mass = np.array([r["w"] for r in seen])
        knots, values = isotonic(at, np.array([r["y"] for r in seen]) / mass, mass)
    else:
        knots, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def score(batches):
        for x in batches:
            r = ridge(_matrix(x, 1))
            # The calibrated value, with the ridge score to rank within steps.
            s = 0.999 * np.clip(np.interp(r, knots, values), 0, 1) + 0.001 * (r + 0.5) / 2
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array(np.round(s, 6))], ["doc_id", "held_out", "score"])

    scored = out.select("doc_id", "f", "held_out").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
