"""Quality classifier: a byte-level convolutional network, in numpy.

Each byte of the text becomes 24 numbers: a learned embedding of 8, and whether it equals the byte
2, 3, ... 17 places before it. Learned filters, 16 bytes wide, slide over the whole text in steps of 8. Their
answers are max-pooled over chunks of 1024 bytes that overlap by half; the chunks' maximum and
mean, joined by learned weights, give one probability. Every byte of every text lies in a chunk.

Training uses a bounded sample of labelled rows (`PER_CLASS` of each quality, texts of at most `LONGEST`
characters, no held-out row), balanced, in mini-batches with Adam; the probability is shifted back to
the labels' own share of good rows. Gradients flow only through the maxima. Scoring holds one slice of
a text at a time, so memory does not follow the longest one.

Nulls and odd input: a null or empty text is scored as one empty chunk; where one of the two
qualities has no usable label every score is the share of good labels (1 without any); rows that repeat an id are
scored each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import held_out, labelled_sample, share_of_good, table

EMBEDDING, LAGS, FILTERS = 8, range(2, 18), 32
STEP, HALF = 8, 512  # a filter is two steps wide, a chunk two halves
CHANNELS = EMBEDDING + len(LAGS)
PER_CLASS = 800
LONGEST = 20_000
EPOCHS = 5
THRESHOLD = 0.7
SLICE = 1 << 20  # bytes seen at a time, a multiple of HALF


def _padded(raw: bytes, before: bytes = b""):
    """numpy: the bytes, padded with zeros to whole halves, behind 17 bytes of what came before."""
    import numpy as np

    length = max(1, -(-len(raw) // HALF)) * HALF
    back = max(LAGS)
    out = np.zeros(back + length + STEP, np.uint8)
    if before:
        out[back - len(before) : back] = np.frombuffer(before, np.uint8)
    out[back : back + len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _inputs(padded, embedding):
    """numpy: (steps + 1, STEP * CHANNELS) of one padded slice."""
    import numpy as np

    back = max(LAGS)
    own = padded[back:]
    x = np.empty((len(own), CHANNELS), np.float32)
    x[:, :EMBEDDING] = embedding[own]
    live = own != 0
    for k, lag in enumerate(LAGS):
        x[:, EMBEDDING + k] = (own == padded[back - lag : len(padded) - lag]) & live
    return x.reshape(-1, STEP * CHANNELS)


def _halves(x, model):
    """numpy: every filter's largest answer in each half, and where it is."""
    z = x[:-1] @ model["w0"]
    z += x[1:] @ model["w1"]
    z = z.reshape(-1, HALF // STEP, FILTERS)
    return z


def _pool(h):
    """numpy: maximum and mean over the chunks (pairs of neighbouring halves) of one text."""
    import numpy as np

    chunks = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])


def logit(raw: bytes, model) -> float:
    import numpy as np

    halves = []
    for at in range(0, max(len(raw), 1), SLICE):
        # the last filter of a slice looks one step into the next
        part = _padded(raw[at : at + SLICE], raw[max(0, at - max(LAGS)) : at])
        ahead = raw[at + SLICE : at + SLICE + STEP]
        if ahead:
            part[-STEP : len(part) - STEP + len(ahead)] = np.frombuffer(ahead, np.uint8)
        halves.append(_halves(_inputs(part, model["embedding"]), model).max(axis=1))
    h = np.maximum(np.concatenate(halves) + model["bias"], 0)
    return float(_pool(h) @ model["out"] + model["shift"][0])


def train(sample: list[tuple[str, int]], share_good: float):
    """The network from (text, quality); None where a quality is missing."""
    import math

    import numpy as np

    if len({q for _, q in sample}) < 2:
        return None
    rng = np.random.default_rng(7)
    model = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        "w0": rng.normal(0, 0.08, (STEP * CHANNELS, FILTERS)).astype(np.float32),
        "w1": rng.normal(0, 0.08, (STEP * CHANNELS, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "shift": np.zeros(1, np.float32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    texts = [_padded(t.encode()) for t, _ in sample]
    labels = np.array([q for _, q in sample], np.float32)
    order, step = np.arange(len(sample)), 0
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            grads = {k: np.zeros_like(v) for k, v in model.items()}
            for i in some:
                _backward(texts[i], labels[i], model, grads, len(some))
            step += 1
            rate = 0.004 * (1 - 0.8 * epoch / EPOCHS)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    seen = labels.mean()
    share = min(max(share_good, 0.01), 0.99)
    model["shift"] += np.float32(math.log(share / (1 - share)) - math.log(seen / (1 - seen)))
    return model


def _backward(padded, label, model, grads, n: int) -> None:
    """Add one text's gradients; only the maxima pass any on."""
    import numpy as np

    x = _inputs(padded, model["embedding"])
    z = _halves(x, model)
    where = z.argmax(axis=1)
    h = np.maximum(z.max(axis=1) + model["bias"], 0)
    pooled = _pool(h)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model["out"] + model["shift"][0], -30, 30)))
    d = np.float32((p - label) / n)
    grads["out"] += d * pooled
    grads["shift"] += d
    down = d * model["out"]
    dh = np.zeros_like(h)
    filters = np.arange(FILTERS)
    dh[h.argmax(axis=0), filters] += down[:FILTERS]
    if len(h) > 1:
        right = h[1:] > h[:-1]
        each = np.broadcast_to(down[FILTERS:] / (len(h) - 1), right.shape)
        dh[1:] += each * right
        dh[:-1] += each * ~right
    else:
        dh += down[FILTERS:]
    dh *= h > 0
    grads["bias"] += dh.sum(axis=0)
    half, filt = np.nonzero(dh)
    if not len(half):
        return
    value = dh[half, filt]
    rows = half * (HALF // STEP) + where[half, filt]
    spread = np.zeros((len(rows), FILTERS), np.float32)
    spread[np.arange(len(rows)), filt] = value
    own = padded[max(LAGS) :].reshape(-1, STEP)
    for name, at in (("w0", rows), ("w1", rows + 1)):
        grads[name] += x[at].T @ spread
        dx = (value[:, None] * model[name].T[filt]).reshape(-1, STEP, CHANNELS)[:, :, :EMBEDDING]
        np.add.at(grads["embedding"], own[at].ravel(), dx.reshape(-1, EMBEDDING))


def score(text: str, model, share_good: float) -> float:
    import math

    if model is None:
        return share_good
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit(text.encode(), model)))))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    good = share_of_good(labels)
    share = 1.0 if good is None else float(good)
    sample = labelled_sample(docs, labels, PER_CLASS, LONGEST)
    shared = docs.sparkSession.sparkContext.broadcast(train(sample, share) if sample else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(t or "", shared.value, share) for t in batch.column(2).to_pylist()]
            values = pa.array(found, pa.float64())
            chosen = pa.array([int(x >= THRESHOLD) for x in found], pa.int32())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), values, chosen],
                ["doc_id", "held_out", "score", "predicted"],
            )

    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return thin.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
