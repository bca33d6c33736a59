"""Near-duplicates by SimHash fingerprints, found with pivot distance tables.

Fingerprints: 64 bits, each set where over half of the text's four-word shingles have it set in
their XXH64. Fingerprints link at `reach` = 4 or fewer differing bits.

Finding the links. Each distinct fingerprint gets a table of Hamming distances to fixed reference
fingerprints (pivots). By the triangle inequality two linked fingerprints differ by at most `reach`
in each coordinate, so a pair with a larger difference is discarded unseen. Over all 64 bits the
coordinates of unrelated texts crowd around 32, so pairs are looked for in narrower tables first: the
bits are cut into 5 blocks, and the rest of the bits, without one block, again into 5 parts. Four differing bits leave at
least one block untouched and one part of the rest, so in at least one of the 25 masks (block + part, 23
bits) *all* coordinates of a linked pair agree. A mask's coordinates are therefore a key for an
ordinary shuffle. Inside a key the table over all bits discards pairs by their largest coordinate difference, and
survivors are verified bit by bit.

Size of groups. Equal fingerprints are one row before anything else happens. Under a key, fingerprints
are visited breadth first, each compared only with those not reached yet, and what leaves is one link for each that is reached:
a group of near copies costs links in proportion to its members, not its pairs. Keys are 23 bits
wide, so unrelated fingerprints under one key are n / 8 million. Components are contracted over all links.

Nulls and odd input: a null or empty text has fingerprint zero, linked like any other; rows that repeat an
id are kept; component_id is the smallest id that is not null; an empty table gives an empty result; other columns are
carried by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import table, texts
from barloom.llm.graph import components
from barloom.storage import written

PIVOTS = 24
REACH = 4


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of one text (UTF-8)."""
    import numpy as np
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    n = len(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(line, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(line[s:e], seed) for s, e in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())],
        np.uint64,
        n - words + 1,
    )
    # bit counts in slices, so that a very long text does not unpack at once
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        found = [fingerprint(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks() -> list[int]:
    """25 masks such that any 4 of the 64 bits miss at least one of them."""
    bits = list(range(64))
    cut = lambda of: [of[len(of) * k // 5 : len(of) * (k + 1) // 5] for k in range(5)]
    out = []
    for block in cut(bits):
        for part in cut([b for b in bits if b not in block]):
            out.append(sum(1 << b for b in block + part))
    return out


def _references(n: int = PIVOTS) -> list[int]:
    """The pivots: the first n hashes of a fixed seed."""
    import xxhash

    return [xxhash.xxh64_intdigest(b"pivot %d" % k, 0) for k in range(n)]


def _coordinates(fps, mask: int | None = None):
    """numpy: the distance of each fingerprint to each pivot, over the bits of a mask."""
    import numpy as np

    mask = np.uint64(mask if mask is not None else 2**64 - 1)
    return np.stack([np.bitwise_count((fps ^ np.uint64(p)) & mask) for p in _references()], axis=1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per fingerprint and mask: the mask's coordinates folded into a key."""
    import numpy as np

    fold = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(PIVOTS)], np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for no, mask in enumerate(_masks()):
            key = (_coordinates(fps, mask).astype(np.uint64) * fold).sum(axis=1, dtype=np.uint64)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(no)
            yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])


def linked(fps, reach: int = REACH) -> list[tuple[int, int]]:
    """Links that connect what is within reach among `fps` (distinct, numpy uint64); no more than needed.

    Breadth first over those not reached yet, with the pivot table in the order of its first coordinate.
    """
    import numpy as np

    table = _coordinates(fps).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    out, rest = [], np.ones(len(fps), bool)
    for root in range(len(fps)):
        if not rest[root]:
            continue
        rest[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            low = np.searchsorted(table[:, 0], table[at, 0] - reach, "left")
            high = np.searchsorted(table[:, 0], table[at, 0] + reach, "right")
            near = low + np.flatnonzero(rest[low:high])
            for some in (slice(1, 4), slice(4, None)):  # most pairs fall to the first coordinates
                if len(near):
                    gap = np.abs(table[near, some] - table[at, some]).max(axis=1)
                    near = near[gap <= reach]
            near = near[np.bitwise_count(fps[near] ^ fps[at]) <= reach]
            rest[near] = False
            queue += near.tolist()
            out += [(int(fps[at]), int(fps[k])) for k in near]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links under each key; rows arrive sorted by key."""
    import numpy as np

    kept_key, kept = None, np.empty(0, np.uint64)
    out: list[tuple[int, int]] = []

    def flush():
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        last = len(starts) - 1
        # groups of one need no look, except at the rim of a batch
        for k in range(last + 1) if last < 2 else [0, *(1 + np.flatnonzero((ends - starts)[1:last] > 1)), last]:
            s, e = int(starts[k]), int(ends[k])
            if k == 0 and keys[s] == kept_key:
                group = np.concatenate((kept, fps[s:e]))
            else:
                if len(kept) > 1:
                    out += linked(kept)
                group = fps[s:e]
            kept_key, kept = keys[s], np.empty(0, np.uint64)
            if k == last:
                kept = group
            elif len(group) > 1:
                out += linked(group)
        if out:
            yield flush()
    if len(kept) > 1:
        out += linked(kept)
    if out:
        yield flush()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints within reach of one another, enough of them to connect all that are."""
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    return (
        keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()
    )


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    found = written(fingerprints(docs), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-nodes")
    pairs = links(nodes)
    roots = components(pairs).withColumnRenamed("node", "fp")
    named = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = named.join(lowest, "root").select("fp", "component_id")
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (the smallest id), with the columns it came with."""
    ids = classes(docs.select("doc_id", "text"))
    stay = ids.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi")


def query(spark, folder: str) -> DataFrame:
    found = classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
