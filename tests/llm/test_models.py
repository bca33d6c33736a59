"""Classifiers: counts against brute force, held-out accuracy, odd input."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import quality_cnn, quality_rules
from barloom.llm.common import table
from tests.llm import fixtures

FOLDER = "/root/testdata/sf0.01"


def slow_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_rule_counts(spark):
    rows = fixtures.documents()
    got = quality_rules.judged(fixtures.frame(spark, rows, extra=True), fixtures.labels(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {r[0]: slow_counts(r[1] or "") for r in rows}
    for r in got:
        assert tuple(r[c] for c in quality_rules.COUNTS) == want[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_rule_counts_of_very_long_texts(spark):
    dice = __import__("random").Random(9)
    long = "\n".join(fixtures.prose(dice, dice.randrange(40)) for _ in range(8000)) + "\n# $ same\n# $ same" * 50
    rows = [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, "x" * 2_000_000, "en", "s", 0), (None, "a b c " * 300_000, "en", "s", 0)]
    got = quality_rules.judged(fixtures.frame(spark, rows, extra=True), fixtures.labels(spark, rows[2:3]).where("false")).collect()
    want = {r[0]: slow_counts(r[1]) for r in rows}
    assert len(got) == 4 and all(tuple(r[c] for c in quality_rules.COUNTS) == want[r["doc_id"]] for r in got)


def test_accepted_agrees_with_verdict(spark):
    rows = fixtures.documents()
    docs, labels = fixtures.frame(spark, rows, extra=True), fixtures.labels(spark, rows)
    kept = quality_rules.accepted(docs, labels)
    assert kept.columns == docs.columns
    verdict = [r["doc_id"] for r in quality_rules.judged(docs, labels).where("kept").collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(verdict)


@pytest.mark.parametrize("which", ["rules", "cnn"])
def test_without_labels_or_rows(spark, which):
    rows = fixtures.documents()
    none = fixtures.labels(spark, rows).where("false")
    if which == "rules":
        got = quality_rules.judged(fixtures.frame(spark, rows), none).collect()
        assert all(r["kept"] != r["base_failed"] for r in got)
        assert quality_rules.judged(fixtures.empty(spark), none).count() == 0
    else:
        got = quality_cnn.scored(fixtures.frame(spark, rows), none).collect()
        assert len(got) == len(rows) and all(r["score"] == 1 and r["predicted"] == 1 for r in got)
        assert quality_cnn.scored(fixtures.empty(spark), none).count() == 0


def test_held_out_accuracy_of_the_network(spark):
    found = quality_cnn.query(spark, FOLDER)
    held = found.where("held_out").join(table(spark, FOLDER, "labels"), "doc_id").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in held])
    assert len(held) > 50 and right >= 0.9


def test_held_out_accuracy_of_the_rules(spark):
    labels = table(spark, FOLDER, "labels")
    found = quality_rules.query(spark, FOLDER).join(labels, "doc_id").where("not base_failed")
    held = found.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    right = np.mean([(r["probability"] >= quality_rules.THRESHOLD) == (r["quality"] == 1) for r in held])
    assert right >= 0.9


def test_network_sees_the_whole_text_in_slices(monkeypatch):
    rng = np.random.default_rng(0)
    sample = [("good text of words " * 20, 1), ("### $$$ %%% " * 20, 0)] * 8
    model = quality_cnn.train(sample, 0.5)
    raw = bytes(rng.integers(32, 120, 6000, dtype=np.uint8))
    whole = quality_cnn.logit(raw, model)
    monkeypatch.setattr(quality_cnn, "SLICE", 1024)
    assert abs(quality_cnn.logit(raw, model) - whole) < 1e-3
    assert 0 <= quality_cnn.score("", model, 0.5) <= 1


@pytest.mark.parametrize("which", ["rules", "cnn"])
def test_held_out_labels_change_nothing(spark, monkeypatch, which):
    monkeypatch.setattr(quality_cnn, "EPOCHS", 1)
    rows = fixtures.documents()
    docs = fixtures.frame(spark, rows)
    labels = fixtures.labels(spark, rows)
    hidden = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    results = []
    for value in ("quality", "0", "1", "1 - quality", "NULL"):
        other = labels.selectExpr("doc_id", f"CASE WHEN {hidden} THEN {value} ELSE quality END AS quality", "toxic")
        found = quality_cnn.scored(docs, other) if which == "cnn" else quality_rules.judged(docs, other)
        score = "score" if which == "cnn" else "probability"
        results.append(sorted((r["doc_id"], r[score]) for r in found.collect()))
    assert labels.where(hidden).count() > 5
    assert all(r == results[0] for r in results)


def test_trained_scores_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "EPOCHS", 1)
    rows = fixtures.documents()
    long = fixtures.prose(__import__("random").Random(5), 180_000)
    assert len(long) > 1 << 20
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, long, "en", "s", 0), (9004, "\x00﻿😀", "en", "s", 0), (9004, "\x00﻿😀", "en", "s", 0)]
    got = quality_cnn.scored(fixtures.frame(spark, rows + odd, extra=True), fixtures.labels(spark, rows)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[9001] == by_id[9002]
    assert len({r["score"] for r in got if r["doc_id"] == 9004}) == 1
