"""Quality rules: counted rules and a calibrated n-gram classifier against a fixed threshold.

The rules count words, symbols, repeated lines and repeated three-word windows of the whole text. The verdict on what
passes them comes from a logistic regression over hashed n-grams: single words, pairs of words and
five-byte windows, each family averaged over the text. It learns from a bounded sample of labelled
rows (`PER_CLASS` of each quality, texts of at most `LONGEST` characters, no held-out row);
four fifths train the weights, one fifth fits the calibration (Platt), weighted back to the labels'
own share of good rows. The model is two megabytes and goes to the tasks, which score Arrow batches.
A text stays if its probability reaches `THRESHOLD`.

Nulls and odd input: a null text has no words and fails the rules; where one of the two qualities has no
usable label, the rules alone decide; rows that repeat an id are judged each for itself; an empty
table gives an empty result; other columns are carried by `accepted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import labelled_sample, share_of_good, table, texts

BITS = 18  # hashed features of each family
FAMILIES = 3
PER_CLASS = 1500
LONGEST = 50_000
STEPS = 40
THRESHOLD = 0.3

_SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, probability double, kept boolean"
)


def _word_ids(tokens: list[bytes]):
    """numpy: equal words get equal small integers."""
    import numpy as np

    ids: dict[bytes, int] = {}
    return np.fromiter([ids.setdefault(t, len(ids)) for t in tokens], np.int64, len(tokens)), len(ids)


def _repeated(ids, distinct: int) -> int:
    """Words that lie in a three-word window found twice or more."""
    import numpy as np

    n = len(ids)
    if n < 4:
        return 0
    pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * distinct + ids[2:]  # below n * n
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def counts(text: str, raw: bytes, tokens: list[bytes], ids, distinct: int) -> tuple[int, ...]:
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return (
        len(tokens),
        len(text) - spaces,
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        _repeated(ids, distinct),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def features(raw: bytes, tokens: list[bytes]):
    """numpy: the hashed feature indices of each family."""
    import numpy as np

    top, odd = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    line = np.frombuffer(b" ".join(tokens), np.uint8)
    n = len(tokens)
    if not n:
        return [np.empty(0, np.int64)] * FAMILIES
    # a word's hash: its bytes as digits of a number in an odd base, modulo 2^64
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x100000001B3, np.uint64))
    offset = np.arange(len(line)) - np.repeat(starts, np.append(lengths[:-1] + 1, lengths[-1]))
    digits = (line.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(offset, len(powers) - 1)]
    word = np.add.reduceat(digits, starts)
    if n > 1:  # the blank behind a word counts with it; take it off
        word[:-1] -= np.uint64(33) * powers[lengths[:-1]]
    pair = word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:]
    out = [word * odd >> top, pair * odd >> top]
    wide = line.astype(np.uint64)
    m = len(wide) - 4
    if m > 0:
        five = wide[:m].copy()
        for k in range(1, 5):
            five = (five << np.uint64(8)) | wide[k : m + k]
        out.append(five * odd >> top)
    else:
        out.append(np.empty(0, np.uint64))
    return [x.astype(np.int64) + (k << BITS) for k, x in enumerate(out)]


def train(sample: list[tuple[str, int]], share_good: float):
    """(weights, slope, intercept) from (text, quality); None where a quality is missing."""
    import numpy as np

    if len({q for _, q in sample}) < 2:
        return None
    rows, cols, vals = [], [], []
    for k, (text, _) in enumerate(sample):
        raw = text.encode()
        for family in features(raw, raw.split()):
            if len(family):
                u, c = np.unique(family, return_counts=True)
                rows.append(np.full(len(u), k, np.int32))
                cols.append(u.astype(np.int32))
                vals.append((c / len(family)).astype(np.float32))
    rows, cols, vals = map(np.concatenate, (rows, cols, vals))
    y = np.array([q for _, q in sample], float)
    fit = np.arange(len(sample)) % 5 != 0
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit[:] = True
    size = FAMILIES << BITS
    w, bias, m, v = np.zeros(size), 0.0, np.zeros(size), np.zeros(size)
    mb = vb = 0.0
    for step in range(1, STEPS + 1):  # Adam on the whole sample
        z = np.bincount(rows, vals * w[cols], len(sample)) + bias
        err = np.where(fit, 1 / (1 + np.exp(-z)) - y, 0) / fit.sum()
        g = np.bincount(cols, vals * err[rows], size)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.98 * vb + 0.02 * gb * gb
        rate = 2.0 * np.sqrt(1 - 0.98**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-7)
        bias -= 0.1 * rate * mb / (np.sqrt(vb) + 1e-7)
    z = np.bincount(rows, vals * w[cols], len(sample)) + bias
    check = ~fit if not fit.all() else fit
    zc, yc = z[check], y[check]
    weight = np.where(yc == 1, share_good / max(yc.mean(), 1e-9), (1 - share_good) / max(1 - yc.mean(), 1e-9))
    scale = max(np.abs(zc).mean(), 1e-9)
    a, b = 1.0 / scale, 0.0
    for _ in range(200):  # Newton steps on the two calibration numbers, held back by a small prior
        p = 1 / (1 + np.exp(-np.clip(a * zc + b, -30, 30)))
        r, h = weight * (p - yc), weight * p * (1 - p) + 1e-6
        g = np.array([(r * zc).sum() / scale + 0.01 * (a * scale - 1), r.sum() + 0.01 * b])
        hess = np.array([[(h * zc * zc).sum() / scale**2 + 0.01, (h * zc).sum() / scale], [(h * zc).sum() / scale, h.sum() + 0.01]])
        d = np.linalg.solve(hess, g)
        d *= min(1.0, 1.0 / max(np.abs(d).max(), 1e-9))
        a, b = a - d[0] / scale, b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return w.astype(np.float32), float(a), float(b + a * bias)


def probability(model, raw: bytes, tokens: list[bytes]) -> float:
    import math

    weights, slope, intercept = model
    z = sum(float(weights[f].mean()) for f in features(raw, tokens) if len(f))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * z + intercept))))


def judge(text: str, model, threshold: float) -> tuple:
    raw = text.encode()
    tokens = raw.split()
    found = counts(text, raw, tokens, *_word_ids(tokens))
    failed = base_failed(found[0], found[4])
    p = probability(model, raw, tokens) if model else None
    return (*found, failed, p, not failed and (p is None or p >= threshold))


def fitted(docs: DataFrame, labels: DataFrame):
    """The model, from a bounded sample of the labelled rows of `docs`."""
    share = share_of_good(labels)
    sample = labelled_sample(docs, labels, PER_CLASS, LONGEST)
    return train(sample, share) if sample else None


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, probability and verdict for every row: the columns of SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t, shared.value, threshold) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                ["doc_id", *COUNTS, "base_failed", "probability", "kept"],
            )

    return texts(docs).mapInArrow(score, SCHEMA)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay, with their own columns, judged in one pass over them."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = [judge(t or "", shared.value, threshold)[-1] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
