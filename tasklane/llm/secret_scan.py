"""Secret scans: fixed patterns and character Markov models.

The patterns find assigned credentials, access keys and long hex strings. The
method adds what they miss: two first-order Markov models over characters
score every other long token; its log-likelihood ratio, in total and per
character, must exceed fixed thresholds. The model of random strings is
trained from labelled strings of several alphabets and the values that the
patterns label as secrets, the model of ordinary identifiers from labelled
names in the usual styles and the table's own identifiers (runs of letters,
digits, ``_`` and ``-``, mostly letters, that no pattern touches). The labelled
samples are made by rule and bounded (``PER_ALPHABET``, ``NAMES``; see
``identifiers``); the table's counts cover all rows.

Training counts character pairs over the whole table in one pass; what leaves
a task is one count per class and pair of characters. The second pass scans.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklane.llm import identifiers
from tasklane.llm import kernel as K
from tasklane.llm.common import arrow_map, table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
MIN_RUN = 16            # shortest token that the models score
MIN_IDENTIFIER = 8      # shortest run that trains the ordinary model
LETTER_SHARE = 0.75     # least part of letters in such a run
PER_ALPHABET = 1000     # labelled random strings of each alphabet
NAMES = 20_000          # labelled ordinary names
HALF_TRUST = 16         # ordinary pairs of the table, about one identifier's,
                        # at which the ratios count half
HALF_WEIGHT = 1000      # a table's pairs after a character that weigh as
                        # much, at most, as the labelled sample's
MIN_TOTAL = 10.0        # thresholds on the log-likelihood ratio, in nats
MIN_MEAN = 0.8
MIN_MEAN_LETTERS = 1.25 # without a digit: names of other languages reach 1
MIN_LETTERS = 4         # fewer are a number or a date

_CHARS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
          b"0123456789+/_=-")
_CODE = np.full(256, -1, np.int16)
_CODE[list(_CHARS)] = np.arange(len(_CHARS))
SIZE = len(_CHARS) + 1          # one more for the border of a token
_ALPHA = np.zeros(256, bool)
_ALPHA[list(_CHARS[:52])] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(_CHARS[:26])] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(_CHARS[52:62])] = True
_NAME = _ALPHA | _DIGIT
_NAME[list(b"_-")] = True


def _runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray,
                                                        np.ndarray]:
    """Byte spans of the runs of marked bytes, cut at row borders."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    first[off[:-1][full]] = inside[off[:-1][full]]
    last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, kind, start of the value)`` of the patterns' matches,
    leftmost and non-overlapping in each kind; failing ones are dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2))
                  for m in ASSIGN.finditer(text)
                  if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start())
                  for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m.start())
              for m in HEX.finditer(text)]
    return found


def _pairs(data: bytes) -> np.ndarray:
    """Codes of the character pairs of one token, borders included."""
    code = _CODE[np.frombuffer(data, np.uint8)].astype(np.int64)
    code = np.concatenate([[SIZE - 1], code[code >= 0], [SIZE - 1]])
    return code[:-1] * SIZE + code[1:]


def _suspects(buf, off) -> np.ndarray:
    """Rows that may hold a match: those with a long token, or with a
    keyword (its first bytes, in either case, cheaply looked for)."""
    starts, ends = _runs(_CODE[buf] >= 0, off)
    long = starts[ends - starts >= MIN_RUN]
    rows = np.zeros(len(off) - 1, bool)
    rows[np.searchsorted(off, long, side="right") - 1] = True
    sign = np.flatnonzero((buf == ord(":")) | (buf == ord("=")))
    if len(sign):
        data = buf.tobytes().lower()
        for word in WORDS:
            raw, at = word.encode(), data.find(word.encode())
            while at >= 0:
                rows[np.searchsorted(off, at, side="right") - 1] = True
                # on to the next row: one hit marks it
                nxt = off[np.searchsorted(off, at, side="right")]
                at = data.find(raw, nxt)
    return np.flatnonzero(rows)


def _count_batches(batches, schema):
    counts = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in K.byte_slices(batches, "text"):
        buf, off = K.flat(batch.column("text"))
        if not len(buf):
            continue
        data = buf.tobytes()
        words = _NAME[buf]
        for i in _suspects(buf, off).tolist():
            raw = data[off[i]:off[i + 1]]
            text = raw.decode()
            seen = set()
            for start, end, _, value in base_spans(text):
                a = off[i] + len(text[:start].encode())
                b = a + len(text[start:end].encode())
                words[a:b] = False
                own = text[value:end].encode()
                if (value, end) not in seen:
                    seen.add((value, end))
                    np.add.at(counts[1], _pairs(own), 1)
        starts, ends = _runs(words, off)
        keep = (ends - starts >= MIN_IDENTIFIER) & (
            K.sums(_ALPHA[buf], starts, ends)
            >= LETTER_SHARE * (ends - starts))
        starts, ends = starts[keep], ends[keep]
        code = _CODE[buf].astype(np.int64)
        inner = np.zeros(len(buf) + 1, np.int64)
        np.add.at(inner, starts + 1, 1)
        np.add.at(inner, ends, -1)
        at = np.flatnonzero(np.cumsum(inner[:-1]) > 0)
        counts[0] += np.bincount(code[at - 1] * SIZE + code[at],
                                 minlength=SIZE * SIZE)
        counts[0] += np.bincount((SIZE - 1) * SIZE + code[starts],
                                 minlength=SIZE * SIZE)
        counts[0] += np.bincount(code[ends - 1] * SIZE + SIZE - 1,
                                 minlength=SIZE * SIZE)
    kind, pair = np.nonzero(counts)
    if len(kind):
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)),
             pa.array(counts[kind, pair])], schema=schema)


_COUNTS = T.StructType([T.StructField("kind", T.IntegerType()),
                        T.StructField("pair", T.IntegerType()),
                        T.StructField("n", T.LongType())])


def _model(counts: np.ndarray, sample: list[str]) -> np.ndarray:
    """Log probability of the next character: the labelled sample's and the
    table's, each smoothed by one count; after a character that the table
    shows often both weigh the same, after a rare one the sample decides."""
    own = np.ones(SIZE * SIZE)
    for name in sample:
        np.add.at(own, _pairs(name.encode()), 1)
    both = []
    for c in (own, counts + 1.0):
        c = c.reshape(SIZE, SIZE)
        both.append(c / c.sum(axis=1, keepdims=True))
    seen = counts.reshape(SIZE, SIZE).sum(axis=1, keepdims=True)
    weight = 0.5 * seen / (seen + HALF_WEIGHT)
    return np.log((1 - weight) * both[0] + weight * both[1]).ravel()


def train(documents: DataFrame, per_alphabet: int = PER_ALPHABET,
          names: int = NAMES) -> np.ndarray:
    """Log-likelihood ratio of each character pair, random against ordinary.
    At most ``2 * SIZE**2`` sums reach the driver. The ratios grow smoothly
    with the ordinary pairs that the table shows, by ``n / (n + HALF_TRUST)``:
    without any (an empty one, say) all are 0 and only the patterns run; from
    a few identifiers on they hardly change, whatever the table's size."""
    sums = arrow_map(documents.select("text"), _count_batches, _COUNTS)
    counts = np.zeros((2, SIZE * SIZE))
    for r in sums.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r.kind, r.pair] += r.n
    strings, ordinary = identifiers.samples(per_alphabet, names)
    trust = counts[0].sum() / (counts[0].sum() + HALF_TRUST)
    return trust * (_model(counts[1], strings) - _model(counts[0], ordinary))


def _added(text: str, base, ratio, min_total, min_mean):
    """Spans of the method: long tokens of letters with digits, or with a
    capital after their first character besides small letters, that no
    pattern matched and that the models call random."""
    raw = text.encode("utf-32-le")
    points = np.frombuffer(raw, "<u4")
    small = np.where(points < 128, points, 0).astype(np.uint8)
    inside = _CODE[small] >= 0
    for start, end, _, _ in base:
        inside[start:end] = False
    starts, ends = _runs(inside, np.array([0, len(points)]))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a < MIN_RUN:
            continue
        own = small[a:b]
        upper = _UPPER[own]
        small_letters = (_ALPHA[own] & ~upper).any()
        digits = _DIGIT[own].any()
        if _ALPHA[own].sum() < MIN_LETTERS or not (
                digits or small_letters and upper[1:].any()):
            continue
        score = ratio[_pairs(own.tobytes())].sum()
        mean = min_mean if digits else max(min_mean, MIN_MEAN_LETTERS)
        if score >= min_total and score >= mean * (b - a + 1):
            yield a, b, "markov", a


def _scan_batches(keep, ratio, min_total, min_mean):
    order = {k: i for i, k in enumerate(KINDS)}

    def joined(spans):
        spans = sorted(spans, key=lambda s: (s[0], order[s[2]]))
        return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches, schema):
        for batch in K.byte_slices(batches, "text"):
            buf, off = K.flat(batch.column("text"))
            data, n = buf.tobytes(), batch.num_rows
            count = np.zeros((len(KINDS), n), np.int64)
            digest, spans = [empty] * n, [""] * n
            for i in (_suspects(buf, off).tolist() if len(buf) else ()):
                text = data[off[i]:off[i + 1]].decode()
                base = base_spans(text)
                more = [] if ratio is None else list(
                    _added(text, base, ratio, min_total, min_mean))
                for _, _, kind, _ in base + more:
                    count[order[kind], i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(base + more)
            new = {f"n_{k}": pa.array(c)
                   for k, c in zip(KINDS, count, strict=True)}
            yield K.with_columns(batch, keep, new | {
                "base_sha256": pa.array(digest, pa.string()),
                "spans": pa.array(spans, pa.string())}, schema)
    return run


def secret_scan(documents: DataFrame, ratio: np.ndarray | None,
                keep: list[str] | None = None, min_total: float = MIN_TOTAL,
                min_mean: float = MIN_MEAN) -> DataFrame:
    """One row for each row of ``documents``: the columns in ``keep``
    (default ``doc_id``), a count of each kind of span, the digest of the
    patterns' spans and all spans as ``kind:start:end``, by start, then kind.

    Null and empty texts have no spans (the digest is that of nothing);
    repeated rows are scanned row by row; only ``text`` and ``keep`` are
    read; an empty table gives no rows. Without models (``ratio`` None) only
    the patterns run. No shuffle."""
    keep = ["doc_id"] if keep is None else keep
    fields = [f for c in keep for f in documents.schema if f.name == c]
    fields += [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base_sha256", T.StringType()),
               T.StructField("spans", T.StringType())]
    need = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(documents.select(*need), _scan_batches(
        keep, ratio, min_total, min_mean), T.StructType(fields))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, with models trained on the same table."""
    documents = table(spark, sf_dir, "documents")
    return secret_scan(documents, train(documents))
