"""Hard negatives by Hilbert-ordered blocks, zone maps and interval bounds.

Components are scaled and floored to integers, so scores are exact inner products. The rows are put in the order of a
Hilbert curve (two bits for each of the `CURVE` widest dimensions, cut at the quartiles of a normal distribution) by a range
sort and stored as Parquet rows of `BLOCK` vectors each. Beside its vectors a block holds its zone map: the least and the
greatest value of every dimension, and of its labels.

Two searches follow, both over windows [low, high] of scores. The first has one window for each anchor, from the score
of its last positive within its own block upwards, and finds the positives; the second has one for each positive and
finds the negatives. Anchors travel in groups of `GROUP` that are neighbours on the curve. For a group and a zone
map, interval arithmetic bounds the scores of each anchor with every row of the block from both sides; the group reads the block only if
some window meets the bounds and the labels allow a partner. What is read is scored exactly; each task keeps the best
of each window, so what it emits grows with anchors and not with pairs. Nothing is dropped by the bounds: results are exact.

Size: anchors meet zone maps in slots of `ZONES` blocks, and the blocks they must read by an equi-join; no task
holds more than one block, one group, one slot of zone maps and `HELD` windows at a time. On data without structure the bounds exclude little and every
anchor group reads every block: the work is then anchors x rows / (BLOCK x GROUP) joins.

Nulls and odd input: rows with a null id, label, vector or component, or a component that is not finite, take no part.
Rows that are equal throughout count once; rows that share an id but differ count each, and no row is partner of its own
id. Equal scores go by the smaller id. Vectors of different length: missing components count as zero. Scaled components beyond 2^62
count as 2^62, scores beyond 64 bits as 2^63 - 1 or its negative; a label is a whole number. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.storage import written

BLOCK = 512  # rows of a block
GROUP = 64  # anchors that travel together
ZONES = 256  # zone maps looked at together
CURVE = 64  # dimensions the curve runs through, at most
HELD = 50_000  # windows whose best rows a task holds before it emits them
MOST = 2**63 - 1

BLOCKS = (
    "block long, rows int, dims int, width int, ids binary, labels binary, anchors binary, vectors binary, "
    "low binary, high binary, first_label long, last_label long"
)
GROUPS = "group long, blocks binary, places binary, ids binary, labels binary, dims int, width int, vectors binary, windows int, lows binary, highs binary"


# ---- numpy helpers -------------------------------------------------------------------------------


def narrowed(matrix):
    """(width, bytes): whole numbers in the narrowest of 2, 4 or 8 bytes."""
    import numpy as np

    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, matrix.astype(f"<i{width}").tobytes()


def widened(raw: bytes, width: int, dims: int):
    import numpy as np

    if not dims:
        return np.zeros((0, 0), np.int64)
    return np.frombuffer(raw, f"<i{width}").reshape(-1, dims).astype(np.int64)


def longs(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, "<i8")


def padded(vectors):
    """Vectors of any lengths as one matrix; missing components are zero."""
    import numpy as np

    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _largest(matrix) -> int:
    return max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))


def products(a, b):
    """All inner products of the rows of two whole-number matrices, exact, at most 64 bits."""
    import numpy as np

    d = min(a.shape[1], b.shape[1])
    if not d:
        return np.zeros((len(a), len(b)), np.int64)
    a, b = a[:, :d], b[:, :d]
    bound = d * _largest(a) * _largest(b)
    if bound < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound <= MOST:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def bounds(anchors, low, high):
    """Least and greatest inner product of each anchor with any point of each box; None if beyond what doubles hold."""
    import numpy as np

    d = min(anchors.shape[1], low.shape[1])
    if d * _largest(anchors) * max(_largest(low), _largest(high)) >= 2**52:
        return None
    up, down = np.maximum(anchors[:, :d], 0), np.minimum(anchors[:, :d], 0)
    low, high = low[:, :d], high[:, :d]
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def hilbert(cells, bits: int = 2):
    """The place of each row of `cells` (whole numbers below 2^bits) on a Hilbert curve, as big-endian bytes.

    Bit planes from the highest to the lowest: each plane exchanges or mirrors what is below it, and a Gray code over
    the dimensions gives the digits of the place.
    """
    import numpy as np

    x = cells.astype(np.int64).T.copy()  # one row per dimension
    n = len(x)
    if not n:
        return [b""] * len(cells)
    for plane in range(bits - 1, 0, -1):
        bit, below = 1 << plane, (1 << plane) - 1
        for k in range(n):
            mirror = (x[k] & bit) != 0
            swap = np.where(mirror, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(mirror, below, swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= turn
    digits = np.stack([(x[k] >> plane) & 1 for plane in range(bits - 1, -1, -1) for k in range(n)], axis=1)
    return [row.tobytes() for row in np.packbits(digits.astype(np.uint8), axis=1)]


# ---- blocks --------------------------------------------------------------------------------------


def scaled(vectors: DataFrame, anchor: Column, vector: str, scale: int) -> DataFrame:
    """(vec_id, label, anchor, vector): rows that take part, their components as floored longs in bytes."""
    infinite = float("inf")
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            held = batch.column(3)
            flat = held.flatten().to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(flat * scale), -(2.0**62), 2.0**62).astype("<i8")
            ends = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
            raw = [whole[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([*batch.columns[:3], pa.array(raw, pa.binary())], ["vec_id", "label", "anchor", "vector"])

    return usable.mapInArrow(run, "vec_id long, label long, anchor boolean, vector binary")


def moments(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(dimension, mean, deviation) over all rows: one line per dimension of the longest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x = padded([longs(v) for v in batch.column(0).to_pylist()]).astype(float)
            n, d = x.shape
            columns = [np.arange(d), np.full(d, n), x.sum(axis=0), (x * x).sum(axis=0)]
            yield pa.record_batch([pa.array(c) for c in columns], ["dim", "n", "s", "q"])

    sums = rows.select("vector").mapInArrow(run, "dim long, n long, s double, q double").groupBy("dim")
    found = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    return sorted((r.dim, r.s / r.n, max(r.q / r.n - (r.s / r.n) ** 2, 0.0) ** 0.5) for r in found)


def placed(rows: DataFrame) -> DataFrame:
    """`rows` with `place`, their place on the curve. It decides where rows are stored, never what is found."""
    widest = sorted(moments(rows), key=lambda m: (-m[2], m[0]))[:CURVE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x = padded([longs(v) for v in batch.column(3).to_pylist()])
            cells = np.zeros((len(x), len(widest)), np.int64)
            for k, (dim, mean, deviation) in enumerate(widest):
                at = x[:, dim].astype(float) if dim < x.shape[1] else np.zeros(len(x))
                cells[:, k] = sum((at > mean + c * deviation).astype(np.int64) for c in (-0.6745, 0.0, 0.6745))
            yield pa.record_batch([*batch.columns, pa.array(hilbert(cells), pa.binary())], [*batch.schema.names, "place"])

    return rows.mapInArrow(run, "vec_id long, label long, anchor boolean, vector binary, place binary")


def stored(rows: DataFrame) -> DataFrame:
    """The blocks, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, number, held, last = TaskContext.get().partitionId(), 0, [], None
        names = [f.split()[0] for f in BLOCKS.split(", ")]

        def close():
            ids, labels, anchors, vectors = zip(*held)
            x = padded([longs(v) for v in vectors])
            width, raw = narrowed(x)
            row = [
                (part << 32) + number, len(ids), x.shape[1], width, np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(),
                np.array(anchors, np.uint8).tobytes(), raw, x.min(axis=0).astype("<i8").tobytes(), x.max(axis=0).astype("<i8").tobytes(),
                min(labels), max(labels),
            ]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if row == last:
                    continue  # equal rows are neighbours and count once
                last = row
                held.append(row)
                if len(held) == BLOCK:
                    yield close()
                    number, held = number + 1, []
        if held:
            yield close()

    order = ["place", "vec_id", "label", "vector"]
    ordered = placed(rows).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return written(ordered.select("vec_id", "label", "anchor", "vector").mapInArrow(run, BLOCKS), "vector-blocks")


def anchors_of(blocks: DataFrame, positives: int) -> DataFrame:
    """(block, place, vec_id, label, vector, lows, highs): the anchors, each with the window for its positives.

    The window starts at the score of the last positive within the anchor's own block, where there are enough of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                places = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
                x = widened(r["vectors"], r["width"], r["dims"]) if r["dims"] else np.zeros((r["rows"], 0), np.int64)
                ids, labels = longs(r["ids"]), longs(r["labels"])
                scores = products(x[places], x)
                for k, p in enumerate(places.tolist()):
                    same = np.sort(scores[k][(labels == labels[p]) & (ids != ids[p])])
                    low = int(same[-positives]) if len(same) >= positives else -MOST - 1
                    out.append((r["block"], p, int(ids[p]), int(labels[p]), x[p].astype("<i8").tobytes(), [low], [MOST]))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = ["block", "place", "vec_id", "label", "vector", "lows", "highs"]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)

    schema = "block long, place int, vec_id long, label long, vector binary, lows array<long>, highs array<long>"
    return blocks.select("block", "rows", "dims", "width", "ids", "labels", "anchors", "vectors").mapInArrow(run, schema)


# ---- searches ------------------------------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in the order of the curve, `GROUP` of them to a row."""
    import numpy as np
    from pyspark import TaskContext

    part, number, held = TaskContext.get().partitionId(), 0, []
    names = [f.split()[0] for f in GROUPS.split(", ")]
    kinds = [pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def close():
        blocks, places, ids, labels, vectors, lows, highs = zip(*held)
        x = padded([longs(v) for v in vectors])
        width, raw = narrowed(x)
        most = max(map(len, lows))
        low, high = np.full((len(ids), most), MOST, "<i8"), np.full((len(ids), most), -MOST, "<i8")  # empty where there is none
        for k, (a, b) in enumerate(zip(lows, highs)):
            low[k, : len(a)], high[k, : len(b)] = a, b
        whole = lambda c: np.array(c, "<i8").tobytes()
        row = [(part << 32) + number, whole(blocks), whole(places), whole(ids), whole(labels), x.shape[1], width, raw, most, low.tobytes(), high.tobytes()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            held.append(row)
            if len(held) == GROUP:
                yield close()
                number, held = number + 1, []
    if held:
        yield close()


def _unpacked(r: dict):
    """ids, labels, vectors, lows, highs of a group."""
    import numpy as np

    ids = longs(r["a_ids"])
    x = widened(r["a_vectors"], r["a_width"], r["a_dims"]) if r["a_dims"] else np.zeros((len(ids), 0), np.int64)
    shape = (len(ids), r["windows"])
    return ids, longs(r["a_labels"]), x, longs(r["lows"]).reshape(shape), longs(r["highs"]).reshape(shape)


def _needed(same: bool):
    """Which blocks of a slot a group must read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                _, labels, x, lows, highs = _unpacked(r)
                zones = r["zones"]
                found = bounds(x, padded([longs(z["low"]) for z in zones]), padded([longs(z["high"]) for z in zones]))
                first = np.array([z["first_label"] for z in zones])
                last = np.array([z["last_label"] for z in zones])
                own = labels[:, None]
                reads = (first <= own) & (own <= last) if same else ~((first == own) & (last == own))
                if found is not None:
                    least, greatest = found
                    meets = np.zeros(reads.shape, bool)
                    for w in range(lows.shape[1]):
                        low, high = lows[:, w, None], highs[:, w, None]
                        meets |= (low <= high) & (greatest >= low) & (least <= high)
                    reads &= meets
                blocks = [zones[z]["block"] for z in np.flatnonzero(reads.any(axis=0))]
                yield pa.record_batch(
                    [pa.array([r["group"]] * len(blocks), pa.int64()), pa.array(blocks, pa.int64())], ["group", "block"]
                )

    return run


def _scored(same: bool, keep: int):
    """Scores of a group with a block; the best `keep` rows of each window, over all that the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        best: dict[tuple, list[tuple[int, int]]] = {}

        def emitted():
            rows = [(*key, -s, i) for key, some in best.items() for s, i in sorted(some)[:keep]]
            best.clear()
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            names = ["a_block", "a_place", "w", "score", "vec_id"]
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                a_ids, a_labels, a, lows, highs = _unpacked(r)
                a_blocks, a_places = longs(r["blocks"]), longs(r["places"])
                ids, labels = longs(r["ids"]), longs(r["labels"])
                x = widened(r["vectors"], r["width"], r["dims"]) if r["dims"] else np.zeros((len(ids), 0), np.int64)
                scores = products(a, x)
                partner = ((a_labels[:, None] == labels) == same) & (a_ids[:, None] != ids)
                for w in range(lows.shape[1]):
                    inside = partner & (scores >= lows[:, w, None]) & (scores <= highs[:, w, None])
                    for j in np.flatnonzero(inside.any(axis=1)).tolist():
                        at = np.flatnonzero(inside[j])
                        at = at[np.lexsort((ids[at], -scores[j, at]))[:keep]] if len(at) > keep else at
                        some = best.setdefault((int(a_blocks[j]), int(a_places[j]), w), [])
                        some += zip((-scores[j, at]).tolist(), ids[at].tolist())
                        if len(some) > 8 * keep:
                            some.sort()
                            del some[keep:]
                if len(best) > HELD:
                    yield emitted()
        if best:
            yield emitted()

    return run


def search(blocks: DataFrame, anchors: DataFrame, keep: int, same: bool) -> DataFrame:
    """(a_block, a_place, w, rank, vec_id, score): the best `keep` rows in each window of each anchor.

    `same` chooses partners of the anchor's own label or of any other. `blocks` is a written table.
    """
    payload = anchors.select("block", "place", "vec_id", "label", "vector", "lows", "highs")
    groups = written(
        payload.repartitionByRange("block", "place").sortWithinPartitions("block", "place").mapInArrow(_grouped, GROUPS),
        "anchor-groups",
    ).select(
        "group", "blocks", "places", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("dims").alias("a_dims"),
        F.col("width").alias("a_width"), F.col("vectors").alias("a_vectors"), "windows", "lows", "highs",
    )
    slots = max(1, -(-blocks.count() // ZONES))
    zones = (
        blocks.select(
            F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"), F.struct("block", "low", "high", "first_label", "last_label").alias("zone")
        )
        .groupBy("slot")
        .agg(F.collect_list("zone").alias("zones"))
    )
    met = groups.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).join(zones, "slot")
    pairs = written(met.mapInArrow(_needed(same), "group long, block long"), "block-reads")
    read = pairs.join(groups, "group").join(blocks.select("block", "ids", "labels", "dims", "width", "vectors"), "block")
    best = read.mapInArrow(_scored(same, keep), "a_block long, a_place int, w int, score long, vec_id long")
    order = Window.partitionBy("a_block", "a_place", "w").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _share(score: str, percent: int, rounded: str) -> Column:
    """score * percent / 100, rounded, exact, at most 64 bits."""
    exact = F.expr(f"{rounded}(CAST({score} AS DECIMAL(19, 0)) * {int(percent)} / 100)")
    return F.coalesce(exact.try_cast("long"), F.when(exact > 0, F.lit(MOST)).otherwise(F.lit(-MOST - 1)))


def mined(
    vectors: DataFrame, anchor: Column, vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, label and the vector; `anchor` says which rows are anchors. For each anchor and each of its
    best `positives` rows of the same label: the best `negatives` rows of other labels whose score is
    between `low` and `high` per cent of the positive's.
    """
    rows = written(scaled(vectors, anchor, vector, scale), "scaled-vectors")
    blocks = stored(rows)
    anchors = written(anchors_of(blocks, positives), "anchors")
    found = written(search(blocks, anchors, positives, same=True), "positives")

    side = F.struct("rank", _share("score", low, "ceil").alias("low"), _share("score", high, "floor").alias("high"))
    windows = (
        found.groupBy("a_block", "a_place")
        .agg(F.sort_array(F.collect_list(side)).alias("all"))  # `positives` of them
        .select(
            F.col("a_block").alias("block"), F.col("a_place").alias("place"), F.col("all.low").alias("lows"), F.col("all.high").alias("highs")
        )
    )
    chasing = anchors.drop("lows", "highs").join(windows, ["block", "place"])
    hard = search(blocks, chasing, negatives, same=False)
    of_anchor = anchors.select(F.col("block").alias("a_block"), F.col("place").alias("a_place"), F.col("vec_id").alias("anchor_id"))
    of_positive = found.select(
        "a_block", "a_place", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        hard.join(of_positive, ["a_block", "a_place", "w"])
        .join(of_anchor, ["a_block", "a_place"])
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def query(spark, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mined(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
