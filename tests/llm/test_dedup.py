"""Exact, near and string deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, simhash, suffix_dedup
from tests.llm import fixtures


def exact_model(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    return sorted(
        (r[0], min(g), len(g), r[0] == min(g), hashlib.sha256(norm(r[1]).encode()).hexdigest())
        for r in rows
        for g in [groups[norm(r[1])]]
    )


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("extra", [False, True])
def test_exact(spark, extra):
    rows = fixtures.documents()
    found = exact_dedup.annotate(fixtures.frame(spark, rows, extra)).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == exact_model(rows)


def test_exact_compares_texts_when_digests_collide(spark):
    rows = fixtures.documents()
    weak = lambda c: F.length(c).cast("string")
    found = exact_dedup.annotate(fixtures.frame(spark, rows), digest=weak).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == exact_model(rows)


def test_exact_rows_keep_their_columns(spark):
    rows = fixtures.documents()
    docs = fixtures.frame(spark, rows)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(m[0] for m in exact_model(rows) if m[3])
    assert exact_dedup.annotate(fixtures.empty(spark)).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = fixtures.documents()
    expected = {(r[0], r[1]): slow_fingerprint(r[1]) for r in rows}
    ids, fps = [k[0] for k in expected], list(expected.values())
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                parent[root(a)] = root(b)
    lowest = defaultdict(lambda: 10**9)
    for k, i in enumerate(ids):
        lowest[root(k)] = min(lowest[root(k)], i)
    want = {i: (fps[k], lowest[root(k)]) for k, i in enumerate(ids)}
    docs = fixtures.frame(spark, rows, extra=True)
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in got} == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.collect()} == {c for _, c in want.values()}
    assert simhash.classes(fixtures.empty(spark)).count() == 0


def test_simhash_keeps_null_ids(spark):
    rows = [(None, "only here with no id at all", "en", "s", 1), (2, "another text entirely different from it", "en", "s", 1)]
    assert simhash.deduplicated(fixtures.frame(spark, rows)).count() == 2


def test_simhash_of_more_shingles_than_a_slice(spark):
    text = fixtures.prose(random.Random(8), 70_000)
    rows = [(1, text, "en", "s", 0), (2, text + " end", "en", "s", 0), (3, text, "en", "s", 0)]
    got = {r["doc_id"]: r["fp"] % 2**64 for r in simhash.fingerprints(fixtures.frame(spark, rows)).collect()}
    assert got == {r[0]: slow_fingerprint(r[1]) for r in rows}


def test_links_connect_all_within_reach():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base.copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, near]))
    want = {(int(x), int(y)) for x in fps for y in fps[np.bitwise_count(fps ^ x) <= 4] if x < y}
    masks = simhash._masks()
    for x, y in want:  # a linked pair shares all coordinates of at least one mask
        assert any((x ^ y) & m == 0 for m in masks)
    got = {tuple(sorted(p)) for p in simhash.linked(fps)}
    assert got <= want
    assert {v for p in got for v in p} == {v for p in want for v in p}


def repeats_model(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(b[s : s + 100])
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [200, 1])
def test_repeated_strings(spark, monkeypatch, hot):
    """hot = 1 sends almost every anchor down the path of very frequent ones."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 4_000 if hot > 1 else 3)
    monkeypatch.setattr(suffix_dedup, "FOLDED", 200_000 if hot > 1 else 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if hot > 1 else 7)
    rows = list({r[0]: r for r in fixtures.documents()}.values())  # an id names one document
    found = suffix_dedup.deduplicated(fixtures.frame(spark, rows, extra=True)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == repeats_model([(r[0], r[1] or "") for r in rows])


def test_repeated_strings_odd_input(spark):
    assert suffix_dedup.deduplicated(fixtures.empty(spark)).count() == 0
    text = "a passage of more than one hundred bytes " * 4
    rows = [(None, text, "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1)]
    found = suffix_dedup.deduplicated(fixtures.frame(spark, rows)).collect()
    removed = {r["doc_id"]: r["n_removed"] for r in found}
    # the null id comes first and only repeats itself; the others are whole copies of it
    assert len(found) == 3 and removed[4] == len(text) and removed[None] < len(text)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh "])
def test_suffix_order(alphabet):
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 700):
        raw = bytes(rng.choice(alphabet) for _ in range(n)) + bytes(400)
        order = suffix_dedup.order_suffixes(np.frombuffer(raw, np.uint8), 100)
        keys = [raw[k : k + 100] for k in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


def test_anchors_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(4)
    raw = fixtures.prose(rng, 3000).encode() + b"z" * 500
    whole = suffix_dedup._anchors([(0, len(raw), 0, raw)])[1].tolist()
    parts = [
        (k, k + 777, max(0, k - suffix_dedup.BEFORE), raw[max(0, k - suffix_dedup.BEFORE) : k + 777 + suffix_dedup.LENGTH])
        for k in range(0, len(raw), 777)
    ]
    pieces = [s for p in parts for s in suffix_dedup._anchors([p])[1].tolist()]
    assert set(whole) <= set(pieces)


@pytest.mark.parametrize("behind", [False, True])
@pytest.mark.parametrize("sizes", [[], [1], [2], [1, 1], [3], [1, 2], [2, 1], [0, 2], [1, 1, 1], [2, 2], [1, 1, 3], [4, 1]])
def test_agreement_keeps_every_row_of_a_partition(behind, sizes):
    text = b"left side" + b"a" * suffix_dedup.GRAM + b"right side"
    rows = [{"gram": 7, "at": 100 * k, "before": 9, "bytes": text, "reach": 0} for k in range(sum(sizes))]
    schema = pa.schema([("gram", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary()), ("reach", pa.int32())])
    batches, at = [], 0
    for n in sizes:
        batches.append(pa.RecordBatch.from_pylist(rows[at : at + n], schema))
        at += n
    got = [r for b in suffix_dedup._agreement(behind)(iter(batches)) for r in b.to_pylist()]
    assert [r["at"] for r in got] == [r["at"] for r in rows]
    whole = list(suffix_dedup._agreement(behind)(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    assert got == [r for b in whole for r in b.to_pylist()]
