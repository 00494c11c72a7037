"""Quality rules: counting rules and a hashed n-gram classifier.

Each text gets counts (words, word characters, symbols, repeated lines,
words in repeated three-word windows) and a probability of being good text.
The probability is a logistic regression over hashed word unigrams and
hashed four-byte character n-grams, both as relative frequencies, fitted on
labelled rows and calibrated on a held-out part of them (Platt scaling).
Texts are scored in Arrow batches against a fixed threshold.

Training uses a bounded sample: ``SAMPLE_PER_CLASS`` labelled rows of each
class, chosen by a hash of the id. Counts and scores cover every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import kernel as K
from tasklane.llm.common import arrow_map, table

SAMPLE_PER_CLASS = 2000
WORD_DIM = 1 << 14
CHAR_DIM = 1 << 14
CHAR_N = 4
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SCALE = 1 << 16

# Symbol characters of the counting rule (fixed by the rule).
_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Model:
    """Fixed-point weights (so a sum doesn't depend on its order), bias, and
    the calibration ``p = 1 / (1 + exp(-(slope * score + shift)))``."""
    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float
    shift: float


def _features(buf, off, starts, ends, ptr):
    """Feature ids of each word and of each character window, and the ranges
    of each row in both."""
    words = (K.span_hashes(buf, starts, ends) >> np.uint64(64 - 14)
             ).astype(np.int64) & (WORD_DIM - 1)
    n = max(0, len(buf) - CHAR_N + 1)
    code = np.zeros(n, np.uint32)
    for k in range(CHAR_N):
        code = (code << np.uint32(8)) | buf[k:k + n]
    chars = ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)
             ).astype(np.int64) & (CHAR_DIM - 1)
    stop = np.maximum(off[1:] - CHAR_N + 1, off[:-1])
    start = np.minimum(off[:-1], n)
    return words, chars, (ptr[:-1], ptr[1:]), (start, np.minimum(stop, n))


def _sample_batches(batches, schema):
    for batch in K.byte_slices(batches, "text"):
        buf, off = K.flat(batch.column("text"))
        starts, ends, ptr = K.word_spans(buf, off)
        words, chars, w, c = _features(buf, off, starts, ends, ptr)
        ids, values = [], []
        for i in range(batch.num_rows):
            own = []
            for x, (a, b), base, dim in ((words, w, 0, WORD_DIM),
                                         (chars, c, WORD_DIM, CHAR_DIM)):
                count = np.bincount(x[a[i]:b[i]], minlength=dim)
                at = np.flatnonzero(count)
                own.append((at + base, count[at] / max(1, b[i] - a[i])))
            ids.append(np.concatenate([a for a, _ in own]).astype(np.int32))
            values.append(np.concatenate([v for _, v in own])
                          .astype(np.float32))
        yield K.with_columns(batch, ["doc_id", "quality"], {
            "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
            "values": pa.array([x.tobytes() for x in values], pa.binary()),
        }, schema)


_SAMPLE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("quality", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("values", T.BinaryType())])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class _Sparse:
    """Feature values of some rows, by row and by feature."""

    def __init__(self, rows: list[tuple], scale: np.ndarray):
        size = np.array([len(r[1]) for r in rows])
        self.n = len(rows)
        self.ids = np.concatenate([r[1] for r in rows])
        self.x = np.concatenate([r[2] for r in rows])
        self.x /= scale.astype(np.float32)[self.ids]
        self.some = np.flatnonzero(size)
        self.first = (np.cumsum(size) - size)[self.some]
        order = np.argsort(self.ids, kind="stable")
        self.by = self.x[order]
        self.by_row = np.repeat(np.arange(self.n, dtype=np.int32),
                                size)[order]
        ids = self.ids[order]
        self.edge = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        self.used = ids[self.edge].astype(np.intp)

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        out[self.some] = np.add.reduceat(
            self.x * w.astype(np.float32)[self.ids], self.first)
        return out

    def gradient(self, err: np.ndarray) -> np.ndarray:
        """For the features in ``used``."""
        return np.add.reduceat(self.by * err.astype(np.float32)[self.by_row],
                               self.edge).astype(np.float64)


def _descend(rows: list[tuple], scale: np.ndarray, w: np.ndarray, b: float,
             steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam from given weights, both classes counting alike, until
    the loss stands still."""
    y = np.array([r[0] for r in rows], np.float64)
    of = _Sparse(rows, scale)
    weight = np.zeros(len(y))
    for k in (0, 1):
        weight[y == k] = 1 / max(1, (y == k).sum())
    u = w[of.used]
    m, v = np.zeros((2, len(u) + 1))
    before = np.inf
    for step in range(1, steps + 1):
        w[of.used] = u
        p = _sigmoid(of.scores(w) + b)
        if step % 10 == 0:
            loss = -(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-300)
                     ).sum()
            if before - loss < 1e-3 * before:
                break
            before = loss
        err = (p - y) * weight
        g = np.append(of.gradient(err) + 1e-5 * u, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (
            np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        u, b = u - move[:-1], b - move[-1]
    w[of.used] = u
    return w, float(b)


def _fit(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float,
         steps: int = 250, more: int = 60) -> Model:
    """Weights of three rows of four are calibrated on the others, with good
    rows counting as ``share`` of all, which they are in the whole label
    table; then all rows take part in some more steps."""
    dim = WORD_DIM + CHAR_DIM
    # Rare features stay small: each is scaled by its root mean square.
    rms = np.zeros(dim)
    for _, ids, values in rows:
        rms[ids] += values.astype(np.float64) ** 2
    rms = (np.sqrt(rms / len(rows)) + 1e-4) * 30.0
    held = [r for i, r in enumerate(rows) if i % 4 == 3]
    seen = [r for i, r in enumerate(rows) if i % 4 != 3]
    w, b = _descend(seen, rms, np.zeros(dim), 0.0, steps)
    slope, shift = (1.0, 0.0)
    if held:
        slope, shift = _platt(_Sparse(held, rms).scores(w) + b, np.array(
            [r[0] for r in held], np.float64), share)
    w, b = _descend(rows, rms, w, b, more)
    fixed = np.round(w / rms * SCALE).astype(np.int64)
    return Model(fixed[:WORD_DIM], fixed[WORD_DIM:], b, slope, shift)


def _platt(score: np.ndarray, y: np.ndarray, share: float
           ) -> tuple[float, float]:
    """Newton's method on the two calibration parameters, with the smoothed
    targets that keep them finite when the classes separate."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(y == 1, share / good, (1 - share) / bad)
    x = np.stack([score, np.ones_like(score)], 1)
    p = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(x @ p)
        g = x.T @ ((q - target) * weight) + 1e-6 * p
        h = (x * (q * (1 - q) * weight)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def train(documents: DataFrame, labels: DataFrame,
          per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on ``per_class`` labelled rows of each class, the first by a hash
    of ``doc_id`` among those that ``documents`` holds. A document with
    several label rows counts as bad if any says so; null labels are ignored.
    ``None`` if no row of a class is among the documents."""
    marked = (labels.where("doc_id is not null and quality in (0, 1)")
              .groupBy("doc_id").agg(F.min("quality").cast("int")
                                     .alias("quality"))
              .join(documents.select("doc_id").distinct(), "doc_id",
                    "left_semi"))
    counts = {r.quality: r["count"]
              for r in marked.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    picks = None
    for k in (0, 1):
        part = (marked.where(F.col("quality") == k)
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
        picks = part if picks is None else picks.unionByName(part)
    picks = documents.sparkSession.createDataFrame(picks.collect(),
                                                   picks.schema)
    # Of a repeated id one row: that of the least hash of its text.
    sample = (documents.select("doc_id", "text")
              .join(F.broadcast(picks), "doc_id").groupBy("doc_id")
              .agg(F.min("quality").alias("quality"), F.min_by(
                  "text", F.xxhash64("text")).alias("text")))
    rows = arrow_map(sample, _sample_batches, _SAMPLE).collect()
    rows.sort(key=lambda r: r.doc_id)
    rows = [(r.quality, np.frombuffer(r.ids, np.int32),
             np.frombuffer(r["values"], np.float32)) for r in rows]
    return _fit(rows, counts[1] / (counts[0] + counts[1]))


def measures(buf: np.ndarray, off: np.ndarray, starts, ends, ptr
             ) -> dict[str, np.ndarray]:
    """The counting rules over one buffer, a value for each row."""
    n = len(off) - 1
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": np.diff(ptr),
           "word_chars": K.sums(lead & ~K.SPACE[buf], off[:-1], off[1:]),
           "n_symbols": K.sums(_SYMBOL[buf], off[:-1], off[1:])}
    cut = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([off[:-1], cut + 1]))
    begin = begin[begin < len(buf)]
    row = np.searchsorted(off, begin, side="right") - 1
    stop = np.append(begin[1:], len(buf))
    stop = np.where((stop > 0) & (buf[stop - 1] == 10) & (stop > begin),
                    stop - 1, stop) if len(begin) else stop
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, row = begin[full], stop[full], row[full]
    key = K.mix(K.span_hashes(buf, begin, stop)
                ^ K.mix(row.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(key, return_index=True)
    out["n_dup_lines"] = (np.bincount(row, minlength=n)
                          - np.bincount(row[at], minlength=n))
    words = K.span_hashes(buf, starts, ends)
    at = K.windows(ptr, 3)
    rows = K.rows_of(ptr)
    key = K.mix(K.gram_hashes(words, 3)[at]
                ^ K.mix(rows[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    at = at[order[same[1:] | same[:-1]]]
    hit = np.zeros(len(words) + 2, bool)
    for k in range(3):
        hit[at + k] = True
    out["n_repeat_words"] = K.sums(hit[:len(words)], ptr[:-1], ptr[1:])
    return out


def _score_batches(model: Model | None, keep: list[str], min_words: int,
                   max_repeat: int, threshold: float):
    def run(batches, schema):
        for batch in K.byte_slices(batches, "text"):
            buf, off = K.flat(batch.column("text"))
            starts, ends, ptr = K.word_spans(buf, off)
            out = measures(buf, off, starts, ends, ptr)
            failed = ((out["n_words"] < min_words)
                      | (100 * out["n_repeat_words"]
                         > max_repeat * out["n_words"]))
            p = np.full(batch.num_rows, 1.0)
            if model is not None:
                words, chars, w, c = _features(buf, off, starts, ends, ptr)
                score = np.full(batch.num_rows, model.bias)
                for x, (a, b), weight in ((words, w, model.word),
                                          (chars, c, model.char)):
                    score += K.sums(weight[x], a, b) / SCALE / np.maximum(
                        1, b - a)
                p = _sigmoid(model.slope * score + model.shift)
            new = {k: pa.array(out[k].astype(np.int64)) for k in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines",
                "n_repeat_words")}
            new |= {"p_good": pa.array(p), "base_failed": pa.array(failed),
                    "kept": pa.array(~failed & (p >= threshold))}
            yield K.with_columns(batch, keep, new, schema)
    return run


_RESULT = [("n_words", T.LongType()), ("word_chars", T.LongType()),
           ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
           ("n_repeat_words", T.LongType()), ("p_good", T.DoubleType()),
           ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]


def quality_rules(documents: DataFrame, model: Model | None,
                  keep: list[str] | None = None, min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``documents``: the columns in ``keep``
    (default ``doc_id``), the counts, ``p_good``, ``base_failed``, ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows
    are judged row by row. Without a model ``p_good`` is 1 and the base rules
    decide. Other columns, whatever their names, are not read; an empty table
    gives an empty result. No shuffle."""
    keep = ["doc_id"] if keep is None else keep
    fields = [f for c in keep for f in documents.schema if f.name == c]
    schema = T.StructType(fields + [T.StructField(*x) for x in _RESULT])
    need = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(documents.select(*need), _score_batches(
        model, keep, min_words, max_repeat_percent, threshold), schema)


def quality_filter(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns."""
    names = documents.columns
    plain = documents.toDF(*[c if c == "text" else f"_c{i}"
                             for i, c in enumerate(names)])
    judged = quality_rules(plain, model, plain.columns)
    return judged.where("kept").select(*plain.columns).toDF(*names)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    documents = table(spark, sf_dir, "documents")
    return quality_rules(documents,
                         train(documents, table(spark, sf_dir, "labels")))
