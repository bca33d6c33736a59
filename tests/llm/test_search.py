"""Search, LSH forest and hard negatives against brute force, with the odd rows every operator must survive."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hard_negatives, maxscore, minhash_forest
from tests.llm import fixtures

UPPER = {c: c + 32 for c in range(65, 91)}

# ---- ranked search -------------------------------------------------------------------------------


def split(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def ranked(docs: list[tuple], items: list[tuple], k: int) -> set[tuple]:
    bags = [(i, Counter(split(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        found = []
        for i, b in bags:
            if not b:
                continue
            m = 50 + 50 * b.total() * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m))
                for t in set(split(text))
                if t in b
            )
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.fixture
def items():
    rows = fixtures.documents()
    some = [(k, " ".join((rows[k][1] or "").split()[:25])) for k in range(30)]
    return some + [(90, None), (91, ""), (92, "nowhere-else qqq"), (93, "the THE the, of"), (93, "harbour"), some[0], (None, "river lantern")]


@pytest.mark.parametrize("shard, batch, k", [(1 << 20, 256, 50), (400, 256, 5), (3000, 7, 3)])
def test_search_is_exhaustive_search(spark, monkeypatch, items, shard, batch, k):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "ITEMS", batch)
    rows = fixtures.documents()
    rows.append((None, "river lantern the", "en", None, 17))
    docs = fixtures.frame(spark, rows, extra=True)
    got = maxscore.search(docs, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked([(r[0], r[1]) for r in rows], items, k)


def test_search_in_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the")], "item_id long, text string")
    docs = fixtures.frame(spark, fixtures.documents())
    assert maxscore.search(fixtures.empty(spark), one).count() == 0
    assert maxscore.search(docs, none).count() == 0
    assert maxscore.search(docs.where("text = ''"), one).count() == 0


def test_pair_bounds_hold_and_are_tighter_than_single_ones():
    rng = np.random.default_rng(5)
    tighter = skipped = 0
    for _ in range(60):
        n, terms = 200, 8
        lists = [np.sort(rng.choice(n, rng.integers(1, 60), replace=False)) for _ in range(terms)]
        scores = [rng.integers(1, 1000, len(d)) ** 2 for d in lists]
        ends = np.concatenate(([0], np.cumsum([len(d) for d in lists])))
        docs, score = np.concatenate(lists), np.concatenate(scores)
        most = [int(s.max()) for s in scores]
        joint = {}
        for a, b in itertools.combinations(range(terms), 2):
            joint[a, b] = int(maxscore.intersection(lists[a], scores[a], lists[b], scores[b])[1].max(initial=0))
        order = sorted(range(terms), key=lambda t: (most[t], t))
        single = maxscore.prefix_bounds(order, most, {})
        pairs = maxscore.prefix_bounds(order, most, maxscore.matched(order, most, joint))
        whole = np.zeros((terms, n), np.int64)
        for t in range(terms):
            whole[t, lists[t]] = scores[t]
        for cut in range(terms + 1):
            true = whole[order[:cut]].sum(axis=0).max(initial=0) if cut else 0
            assert true <= pairs[cut] <= single[cut]
        tighter += pairs[-1] < single[-1]
        total = np.sort(whole.sum(axis=0))[::-1]
        for threshold in (0, int(total[9]), int(total[0]), int(total[0]) + 1):
            at, sums = maxscore.best_of(list(range(terms)), joint, ends, docs, score, most, n, threshold, 10)
            assert (sums == whole.sum(axis=0)[at]).all()
            want = [s for s in total[:10] if s >= max(threshold, 1)]
            assert np.sort(sums)[::-1][:10].tolist() == want
            skipped += len(at) < np.count_nonzero(whole.sum(axis=0))
    assert tighter > 50 and skipped > 100


# ---- LSH forest ----------------------------------------------------------------------------------


def classes_model(docs: list[tuple], words: int = 3, percent: int = 85) -> Counter:
    sets = []
    for i, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
        sets.append((i, {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    low = {i: i for i, s in sets if i is not None}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            low[y] = x
    return Counter((i, len(s), root(i)) for i, s in sets if i is not None)


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def near_copies() -> list[tuple]:
    """Groups around the threshold, a large one among them, besides the usual odd rows."""
    rng = random.Random(7)
    rows = [(r[0], r[1]) for r in fixtures.documents()]
    at = 1000
    for size, words, edits in ((90, 150, 6), (40, 60, 3), (30, 300, 9), (12, 12, 1), (25, 90, 5)):
        base = fixtures.prose(rng, words)
        for _ in range(size):
            rows.append((at, edited(rng, base, rng.randrange(edits + 1))))
            at += 1
    rows += [(at + k, t) for k, t in enumerate(["ONE Two", "one two", "one two ", "Ä b c", "ä b c", "a a a a a a", "a a a"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("side, first", [(512, 4), (8, 1)])
def test_forest_finds_the_components_of_all_links(spark, monkeypatch, side, first):
    monkeypatch.setattr(minhash_forest, "SIDE", side)
    monkeypatch.setattr(minhash_forest, "FIRST", first)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS component_id", "1 AS n", "2 AS node")
    got = Counter(map(tuple, minhash_forest.classes(docs.repartition(6)).collect()))
    assert got == classes_model(rows)


def test_forest_on_odd_ids_and_empty_tables(spark):
    a, b, c = (fixtures.prose(random.Random(k), 40) for k in range(3))
    rows = [(None, a), (7, a), (5, a), (5, b), (9, b), (9, b), (11, c), (None, c + " x"), (None, None), (13, None), (12, " ")]
    got = minhash_forest.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, r.component_id) for r in got)
    # 5 has two texts, so it links what links with either
    assert found == Counter([(None, 5), (7, 5), (5, 5), (5, 5), (9, 5), (9, 5), (11, 11), (None, None), (None, None), (13, 13), (12, 12)])
    assert minhash_forest.classes(fixtures.empty(spark)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    factors = minhash_forest._factors()
    for _ in range(10):
        base = [b"%d" % rng.randrange(10**9) for _ in range(400)]
        other = set(base[: rng.randrange(50, 400)]) | {b"%d" % rng.randrange(10**9) for _ in range(50)}
        one, two = set(base), other
        x, y = (np.frombuffer(minhash_forest.signature(s, factors), ">u2") for s in (one, two))
        true = len(one & two) / len(one | two)
        assert abs((x == y).mean() - true) < 5 * (0.25 / minhash_forest.HASHES) ** 0.5


# ---- hard negatives ------------------------------------------------------------------------------


def vectors(seed: int = 2) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 12))
    rows = []
    for k in range(700):
        label = int(rng.integers(5))
        rows.append((k, (centres[label] + rng.normal(scale=0.8, size=12)).astype(np.float32).tolist(), label))
    for k in range(700, 720):
        rows.append((k, rows[3][1], k % 5))  # ties
    rows += [rows[5], rows[5]]  # repeated
    rows += [(800, None, 1), (900, rows[1][1], None), (None, rows[1][1], 1), (901, [None] + rows[1][1][1:], 1)]
    rows += [(902, [float("nan")] * 12, 1), (1000, [float("inf")] * 12, 2), (1100, [], 2), (1101, rows[7][1][:5], 2), (1102, rows[7][1] * 2, 3)]
    rows += [(1200, [3e20] * 12, 1), (1201, [2e20] * 12, 1), (1202, [2.7e20] * 12, 2), (1203, [1e5] * 12, 1)]
    return rows


def mined_model(rows: list[tuple]) -> Counter:
    most = 2**63 - 1
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i, label, tuple(max(-(2**62), min(2**62, math.floor(256 * x))) for x in v)] = None
    kept = list(kept)
    score = lambda a, b: max(-most, min(most, sum(x * y for x, y in zip(a, b))))
    out = Counter()
    for i, label, v in kept:
        if i % 100:
            continue
        others = sorted((-score(v, w), j, other) for j, other, w in kept if j != i)
        for s, j, other in [o for o in others if o[2] == label][:5]:
            window = [o for o in others if o[2] != label and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            for rank, (t, n, _) in enumerate(window, 1):
                out[i, j, rank, n, -s, -t] += 1
    return out


@pytest.mark.parametrize("block, group, zones, held", [(512, 64, 256, 50_000), (16, 3, 4, 5)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, block, group, zones, held):
    for name, value in (("BLOCK", block), ("GROUP", group), ("ZONES", zones), ("HELD", held)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    df = df.selectExpr("*", "'x' AS block", "'x' AS score", "'x' AS vector", "1 AS rank")
    got = hard_negatives.mined(df, F.col("vec_id") % 100 == 0)
    exact = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, k) for i, v, k in rows]
    assert Counter(map(tuple, got.collect())) == mined_model(exact)
    assert hard_negatives.mined(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_interval_bounds_hold_and_exclude():
    rng = np.random.default_rng(1)
    for _ in range(50):
        points = rng.integers(-100, 100, (30, 6)) + rng.integers(-500, 500, 6)
        anchors = rng.integers(-300, 300, (10, 6))
        least, greatest = hard_negatives.bounds(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
        scores = anchors @ points.T
        assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= greatest[:, 0]).all()
    assert hard_negatives.bounds(anchors, np.full((1, 6), -(2**60)), np.full((1, 6), 2**60)) is None


def test_blocks_far_from_every_window_are_not_read(spark, monkeypatch):
    """Clustered vectors: the zone maps of other clusters exclude their blocks."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    rng = np.random.default_rng(4)
    centres = 4 * rng.choice([-1.0, 1.0], (16, 16))
    rows = [(k, (centres[k % 16] + rng.normal(scale=0.1, size=16)).tolist(), k % 2) for k in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    scaled = hard_negatives.scaled(df, F.col("vec_id") % 100 == 0, "embedding", 256)
    blocks = hard_negatives.stored(scaled)
    anchors = hard_negatives.anchors_of(blocks, 5)
    seen = []
    plain = hard_negatives.written
    monkeypatch.setattr(hard_negatives, "written", lambda df, label: seen.append((label, plain(df, label))) or seen[-1][1])
    hard_negatives.search(blocks, anchors, 5, same=True).count()
    tables = dict(seen)
    assert tables["block-reads"].count() < tables["anchor-groups"].count() * blocks.count() / 3


@pytest.mark.parametrize("dims, bits", [(2, 2), (2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_in_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    places = hard_negatives.hilbert(cells, bits)
    assert len(set(places)) == len(cells)
    along = cells[sorted(range(len(cells)), key=lambda k: places[k])]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()
