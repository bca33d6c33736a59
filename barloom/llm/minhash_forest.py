"""Near-duplicates by an LSH forest over MinHash signatures.

A document's set are its distinct word shingles; two documents link where their sets have a Jaccard similarity of
`percent` / 100 or more. A signature holds `TREES` x `DEEPEST` minima, 16 bits of each. Tree t is the sorted order of all
documents by their minima t * DEEPEST, t * DEEPEST + 1, ...: documents with a long common prefix are neighbours there.

1. *Longest common prefix.* All trees are range-sorted at once. Each document takes the neighbour with which it
   shares the longest prefix, at least `LEAST` minima: in a sparse region that is a short one, in a dense region a deep
   one, so each region gets the depth it needs, and a row gives one candidate whatever the size of its region. Over all trees a document keeps the candidate
   with the deepest prefixes. Beside it stand the hubs of its regions (rows with equal prefixes of length `LEAST`), the documents
   with the fewest elements of their own. The `FIRST` most alike are confirmed and contracted to components, which unites nearly
   all that belongs together.
2. *The rest.* In every region that still holds more than one component, documents
   of different components are candidates, all of them: in rounds each takes its most similar open ones first, and what a
   round has united is no candidate any more, until none is open. The rim of a large component is compared with its members in
   parts, inside tasks. Regions of more than `SIDE` rows are cut into parts, and
   each pair of parts is looked at by itself, so no group is gathered in a task.

Candidates pass a filter of sizes and, in step 2, of the elements that occur in no other set of such regions (both exact),
and one of signatures (`SLACK` deviations below the threshold), then both whole sets are compared as strings. A link is missed only if its documents share no prefix in any tree: at the threshold of
0.85 (1 - 0.85^5)^32, some 1 in 10^8, less above it; links inside a group of several are found by any path between them.

Copies: rows with the same sequence of words are one node, so copies cost nothing beyond their grouping.

Nulls and odd input: a null or empty text or one of white space has an empty set and links with nothing, not even its
like; rows that repeat an id are one document for links (what links with either links with both) and are all
returned; a row without an id takes the component of its copies, or null; an empty table gives an empty result; very long texts are hashed in slices;
equal similarities go by the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import table, texts
from barloom.llm.graph import components
from barloom.storage import written

TREES = 32
LEAST = 5  # minima that candidates share in some tree
DEEPEST = 8
HASHES = TREES * DEEPEST
SLACK = 6.5
SIDE = 512  # rows of a region that are compared with one another at once
LARGE = 64  # open members from which a component is compared as one first
FIRST = 4  # candidates of a document that are verified in the first round; 64 times as many in each further one

SIGNED = "doc_id long, n_shingles long, digest binary, signature binary"


# ---- sets and signatures -------------------------------------------------------------------------


def shingles(text: bytes, words: int) -> set[bytes]:
    """The set of one text (UTF-8)."""
    tokens = text.lower().split()
    if len(tokens) < words:
        return {b" ".join(tokens)} if tokens else set()
    line = b" ".join(tokens)
    starts, at = [], 0
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    ends = [s - 1 for s in starts[words:]] + [len(line)]
    return {line[s:e] for s, e in zip(starts, ends)}


def _factors():
    """numpy: the odd multipliers of the hash family, from a fixed seed."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(b"minimum %d" % k, 0) | 1 for k in range(HASHES)], np.uint64)


def signature(elements: set[bytes], factors) -> bytes:
    """16 bits of each of the `HASHES` minima over the set, big-endian."""
    import numpy as np
    import xxhash

    x = np.fromiter(map(xxhash.xxh64_intdigest, elements), np.uint64, len(elements))
    x ^= x >> np.uint64(31)
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(x), 512):  # slices that stay in the cache
        np.minimum(low, (x[at : at + 512, None] * factors).min(axis=0), out=low)
    return ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def signed(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: the size of its set, a digest of its words, its signature (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        factors = _factors()
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for raw in batch.column(1).to_pylist():
                found = shingles(raw, words)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest() if found else None)
                signatures.append(signature(found, factors) if found else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


# ---- candidates ----------------------------------------------------------------------------------

FOREST = "key binary, node long, n long, root long"


def forest(nodes: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """One row per node and tree: the tree's number and the node's first `depth` minima there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, TREES, 2 * DEEPEST)
            for t in range(TREES):
                keys = np.empty((n, 1 + 2 * depth), np.uint8)
                keys[:, 0], keys[:, 1:] = t, raw[:, t, : 2 * depth]
                buffers = [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * keys.shape[1]).tobytes()), pa.py_buffer(keys.tobytes())]
                key = pa.Array.from_buffers(pa.binary(), n, buffers)
                yield pa.record_batch([key, batch.column(0), batch.column(1), batch.column(3)], ["key", "node", "n", "root"])

    return nodes.select("node", "n", "signature", "root").mapInArrow(run, FOREST)


def _neighbours(percent: int):
    """Rows in the order of the trees: each row's neighbour with the longest common prefix, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        wide = 1 + 2 * DEEPEST
        keys, node, size = np.empty((0, wide), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)

        def pairs(keys, node, size, left: int, right: int):
            """Candidates of the rows left..right-1; the others are there as their neighbours."""
            same = keys[1:] == keys[:-1]
            deep = np.cumprod(np.concatenate((same[:, :1], same[:, 1::2] & same[:, 2::2]), axis=1), axis=1).sum(axis=1) - 1
            fits = 100 * np.minimum(size[1:], size[:-1]) >= percent * np.maximum(size[1:], size[:-1])
            deep = np.where(fits & (node[1:] != node[:-1]), deep, 0)
            before, after = np.concatenate(([0], deep)), np.concatenate((deep, [0]))
            at = np.flatnonzero(np.maximum(before, after) >= LEAST)
            at = at[(at >= left) & (at < right)]
            other = np.where(before[at] >= after[at], at - 1, at + 1)
            columns = [node[at], node[other], np.maximum(before, after)[at].astype(np.int64)]
            return pa.record_batch([pa.array(c) for c in columns], ["node", "other", "depth"])

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, wide)
            keys = np.concatenate((keys, raw))
            node = np.concatenate((node, batch.column(1).to_numpy()))
            size = np.concatenate((size, batch.column(2).to_numpy()))
            yield pairs(keys, node, size, 0 if first else 1, len(node) - 1)  # the last row waits for its next
            keys, node, size, first = keys[-2:], node[-2:], size[-2:], len(node) == 1
        if len(node):
            yield pairs(keys, node, size, 0 if first else len(node) - 1, len(node))

    return run


def nearest(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: for each node the neighbour with the deepest common prefixes over all trees."""
    ordered = forest(nodes).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    met = ordered.select("key", "node", "n").mapInArrow(_neighbours(percent), "node long, other long, depth long")
    votes = met.groupBy("node", "other").agg(F.sum("depth").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("other")).alias("b"))).alias("best"))
    other = -F.col("best.b")
    return best.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def elements(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, element): the hashed sets of `nodes`. Equal hashes of different elements only loosen a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for node, raw in zip(*[c.to_pylist() for c in batch.columns]):
                found = shingles(raw, words)
                x = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).view(np.int64)
                for at in range(0, len(x), 1 << 16):
                    part = x[at : at + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(part), node, np.int64)), pa.array(part)], ["node", "element"])

    of = texts(docs).join(nodes.select(F.col("node").alias("doc_id")), "doc_id").distinct()  # repeated rows are one set
    return of.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "node long, element long")


def lone_elements(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, own): how many elements of a node's set occur in no other of `nodes`."""
    met = elements(docs, nodes, words).groupBy("element").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("node"))
    return met.where("sets = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _across(percent: int):
    """Candidates between different components inside one part of a region, or between two; rows arrive sorted by `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def pairs(rows):
            node, size, most, root, part = (np.array(c) for c in zip(*rows))
            left, right = part <= 0, part >= 0  # 0: both sides are the same part
            out = []
            for k in np.flatnonzero(left).tolist():
                shared = np.minimum(most[k], most)  # what both sets can have in common at most
                at = np.flatnonzero(right & (root != root[k]) & (100 * shared >= percent * (size[k] + size - shared)))
                out.append(np.stack((np.minimum(node[k], node[at]), np.maximum(node[k], node[at]))))
            found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((2, 0), np.int64)
            return pa.record_batch([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

        key, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for region, i, j, *row in zip(*columns):
                if (region, i, j) != key:
                    if len(held) > 1:
                        yield pairs(held)
                    key, held = (region, i, j), []
                held.append(row)
        if len(held) > 1:
            yield pairs(held)

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """(key, parts): the regions that hold more than one component."""
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    return found.where("r0 <> r1").select("key", F.ceil(F.col("size") / SIDE).cast("int").alias("parts"))


def open_rows(nodes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(key, node, n, most, root): the rows of regions with several components that can link with anything there.

    Of a set, the elements that no other set in such regions has are in no intersection, so `most` elements are what it can
    share. That excludes most documents which come close to a group without belonging to it.
    """
    rows = forest(nodes, LEAST)
    left = written(rows.join(_mixed(rows).select("key"), "key"), "forest-regions")
    lone = lone_elements(docs, written(left.select("node").distinct(), "open-nodes"), words)
    return bounded(left, nodes, lone, percent)


def bounded(rows: DataFrame, nodes: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """`rows` with `most`, the elements a set can share at most: all but its `own`. Without those that cannot link."""
    # of an id with several texts, none counts as its own
    several = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    counted = written(own.join(several, "node", "left_anti"), "own-elements")
    most = rows.join(counted, "node", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    return written(most.where(100 * F.col("most") >= percent * F.col("n")), "open-rows")


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: each row with the hub of its region, the set there with the smallest share of lone elements.

    Whatever links in a group of edited copies mostly links with the least edited one.
    """
    hub = rows.groupBy("key").agg(F.min(F.struct((1 - F.col("most") / F.col("n")).alias("share"), "node", "n", "most", "root")).alias("h"))
    shared = F.least("most", "h.most")
    met = rows.join(hub, "key").where(
        (F.col("root") != F.col("h.root")) & (100 * shared >= percent * (F.col("n") + F.col("h.n") - shared))
    )
    return met.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()


def remaining(
    rows: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, words: int
) -> tuple[DataFrame, DataFrame]:
    """What is left between different components, by the roots of now: (links with large components, candidates (a, b) of others).

    Two exact bounds. An element that only one component has is in no intersection with others. And what a set can share
    with a member of a large component is at most what it shares with the union of that component: a document at
    the rim of a large group is compared with the group as one before it meets its members.
    """
    moved = rows.drop("root", "most").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    moved = written(moved.join(_mixed(moved).select("key"), "key"), "open-rows")
    of = written(moved.select("node", "root").distinct(), "open-nodes")
    met = written(elements(docs, of, words).join(of, "node"), "open-elements")
    held = written(met.select("element", "root").distinct(), "component-elements")
    only = held.groupBy("element").agg(F.count(F.lit(1)).alias("components")).where("components = 1").select("element")
    left = bounded(moved, nodes, met.join(only, "element").groupBy("node").agg(F.count(F.lit(1)).alias("own")), percent)

    large = written(of.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= LARGE).select("root"), "large-components")
    unions = held.join(large, "root").select("element", F.col("root").alias("other"))
    shared = met.join(unions, "element").where("root <> other").groupBy("node", "other").agg(F.count(F.lit(1)).alias("shared"))
    near = left.select("node", "n", "most").distinct().join(shared, "node").where(100 * F.least("shared", "most") >= percent * F.col("n"))
    near = written(near.select("node", "other").distinct(), "rims")
    members = written(left.join(large, "root").select("node", F.col("root").alias("other")).distinct(), "members")
    rims = written(rim_links(near, members, docs, percent, words), "near-links")
    small = left.join(large, "root", "left_anti")
    return rims, open_pairs(small.join(_mixed(small), "key"), percent).distinct()


def _linked_rims(percent: int, words: int):
    """Rows (other, i, j, side, node, text), sorted: the rim of a component first, then members; one link for each that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rim = None, {}
        for batch in batches:
            out = []
            for other, i, j, side, node, raw in zip(*[c.to_pylist() for c in batch.columns]):
                if (other, i, j) != key:
                    key, rim = (other, i, j), {}
                found = shingles(raw, words)
                if side == 0:
                    rim[node, raw] = found
                    continue
                hit = []
                for at, some in rim.items():
                    low, high = sorted((len(found), len(some)))
                    if 100 * low >= percent * high:
                        shared = len(found & some)
                        if 100 * shared >= percent * (low + high - shared):
                            hit.append(at)
                            out.append((min(at[0], node), max(at[0], node)))
                for at in hit:
                    del rim[at]
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def rim_links(near: DataFrame, members: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b): for each (node, other) of `near` links with members of the component `other`, where there are any.

    Both sides are cut in parts of some `SIDE` / 4 sets, and each pair of parts compares whole sets in one task. What
    leaves a part is one link for each node of the rim, not one row for each comparison.
    """
    parts = lambda df, name: df.groupBy("other").agg(F.ceil(F.count(F.lit(1)) * 4 / SIDE).cast("int").alias(name))
    sizes = parts(near, "rims").join(parts(members, "inner"), "other")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    columns = ["other", "i", "j", "side", "node"]
    rim = near.join(sizes, "other").withColumns({"i": part("rims"), "side": F.lit(0)}).withColumn("j", each("inner")).select(*columns)
    inner = members.join(sizes, "other").withColumns({"j": part("inner"), "side": F.lit(1)}).withColumn("i", each("rims")).select(*columns)
    of = texts(docs).join(rim.unionByName(inner).withColumnRenamed("node", "doc_id"), "doc_id")
    rows = of.select("other", "i", "j", "side", F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartition("other", "i", "j").sortWithinPartitions("other", "i", "j", "side")
    return ordered.mapInArrow(_linked_rims(percent, words), "a long, b long").distinct()


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): all candidates of different roots that share a region; `rows` with the `parts` of their region."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k.cast("int")))
    # every pair of parts (i <= j) gets the rows of both, marked by their side
    dealt = rows.withColumn("own", own).withColumn("k", each).select(
        "key",
        F.least("own", "k").alias("i"),
        F.greatest("own", "k").alias("j"),
        "node",
        "n",
        "most",
        "root",
        F.signum(F.col("own") - F.col("k")).cast("long").alias("part"),
    )
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(_across(percent), "a long, b long").distinct()


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, alike): the pairs whose signatures do not speak against a link, and how many minima agree."""
    share = percent / 100
    floor = HASHES * share - SLACK * (HASHES * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            n = batch.num_rows
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(n, -1) for k in (2, 3))
            alike = (one == two).sum(axis=1) if n else np.empty(0, np.int64)
            at = np.flatnonzero(alike >= floor)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(alike[at].astype(np.int64))], ["a", "b", "alike"])

    of = nodes.select("node", "signature")
    sides = (
        pairs.join(of.withColumnsRenamed({"node": "a", "signature": "sa"}), "a")
        .join(of.withColumnsRenamed({"node": "b", "signature": "sb"}), "b")
        .select("a", "b", "sa", "sb")
    )
    # rows that share an id may bring several signatures
    return sides.mapInArrow(run, "a long, b long, alike long").groupBy("a", "b").agg(F.max("alike").alias("alike"))


def _confirmed(percent: int, words: int):
    """Both whole sets of each pair; rows (a, b, side, text) arrive sorted by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, kept = None, ([], []), {}

        def linked() -> bool:
            for x in sides[0]:
                for y in sides[1]:
                    shared = len(x & y)
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        return True
            return False

        for batch in batches:
            out = []
            for a, b, side, raw in zip(*[c.to_pylist() for c in batch.columns]):
                if (a, b) != key:
                    if key and linked():
                        out.append(key)
                    kept = kept if key and key[0] == a else {}
                    key, sides = (a, b), ([], [])
                if side == 0:  # pairs of one document follow one another
                    found = kept.get(raw)
                    if found is None:
                        found = kept[raw] = shingles(raw, words)
                else:
                    found = shingles(raw, words)
                if found:
                    sides[side].append(found)
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        if key and linked():
            yield pa.record_batch([pa.array([key[0]]), pa.array([key[1]])], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts."""
    sides = F.array(*[F.struct(F.col(c).alias("doc_id"), F.lit(k).alias("side")) for k, c in enumerate("ab")])
    wanted = pairs.select("a", "b", F.explode(sides).alias("x")).select("a", "b", "x.doc_id", "x.side")
    both = texts(docs).join(wanted, "doc_id").select("a", "b", "side", F.col("text").cast("binary").alias("text"))
    ordered = both.repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return ordered.mapInArrow(_confirmed(percent, words), "a long, b long")


# ---- classes -------------------------------------------------------------------------------------


def classes(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select("doc_id", "text")
    found = written(signed(docs, words), "minhash")
    with_id = found.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    lowest = with_id.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("low"))
    nodes = written(
        lowest.select("digest", F.col("low.doc_id").alias("node"), F.col("low.n_shingles").alias("n"), F.col("low.signature").alias("signature")),
        "minhash-nodes",
    )
    plain = nodes.select("node", "n", "signature")

    alone = written(plain.withColumn("root", F.col("node")), "minhash-roots")
    rows = open_rows(alone, docs, percent, words)
    first = nearest(alone, percent).unionByName(hub_pairs(rows, percent)).distinct()
    first = written(_first_of(likely(first, plain, percent), FIRST), "candidates")
    # rows that share an id but not their words are one document
    shared = with_id.join(nodes.select("digest", "node"), "digest").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    links = confirmed(first, docs, percent, words).unionByName(shared.where("a <> b").select("a", "b"))
    links = written(links, "near-links")
    roots = written(components(links), "near-roots")

    def united(more: DataFrame) -> None:
        """Take new links in; most rounds bring none."""
        nonlocal links, roots
        if not more.isEmpty():
            links = written(links.unionByName(more), "near-links")
            roots = written(components(links), "near-roots")

    # what did not join a hub meets all others
    more, left = remaining(rows, roots, alone, docs, percent, words)
    waiting = written(likely(left, plain, percent), "open-pairs")
    each = FIRST
    while not waiting.isEmpty():
        chosen = written(_first_of(waiting, each), "chosen-pairs")
        united(written(more.unionByName(confirmed(chosen, docs, percent, words)), "near-links"))
        waiting = written(_still_open(waiting.join(chosen.select("a", "b"), ["a", "b"], "left_anti"), roots), "open-pairs")
        each, more = each * 64, more.limit(0)
    united(more)

    named = found.join(nodes.select("digest", "node"), "digest", "left").join(roots, "node", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.coalesce("root", "node"))
    return named.select("doc_id", "n_shingles", own.alias("component_id"))


def _first_of(waiting: DataFrame, each: int) -> DataFrame:
    """Of the open pairs, those among the `each` most similar of either of their documents."""
    order = lambda c, o: Window.partitionBy(c).orderBy(F.col("alike").desc(), o)
    ranked = waiting.withColumn("ra", F.row_number().over(order("a", "b"))).withColumn("rb", F.row_number().over(order("b", "a")))
    return ranked.where(F.least("ra", "rb") <= each).select("a", "b")


def _still_open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def query(spark, folder: str) -> DataFrame:
    found = classes(table(spark, folder, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
           lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s
  FROM words
), texts AS (
  SELECT s, min(doc_id) AS id, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), elements AS (SELECT id, n, unnest(s) AS e FROM texts),
pairs AS (
  SELECT x.id AS a, y.id AS b FROM elements x JOIN elements y ON x.e = y.e AND x.id < y.id
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT id AS node, id AS low FROM texts
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b
), lowest AS (SELECT node, min(low) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.root, d.doc_id) AS kept
FROM sets d LEFT JOIN texts t ON t.s = list_sort(d.s) LEFT JOIN lowest l ON l.node = t.id
"""
