"""Registered queries against SQL where there is any, and the pipeline against its parts."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import queries as llm
from tests.llm import fixtures
from tests.test_oracle import normal

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = llm.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(llm.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert normal(got.collect(), got.columns) == normal(cursor.fetchall(), columns)


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps the columns and works on what its predecessor kept; the last packs every id of the mix."""
    rows = fixtures.documents()
    (tmp_path / "sf").mkdir()
    fixtures.frame(spark, rows).write.parquet(str(tmp_path / "sf/documents.parquet"))
    fixtures.labels(spark, rows).write.parquet(str(tmp_path / "sf/labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "sf"))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    from tests.llm.test_dedup import exact_model
    from tests.llm.test_models import slow_counts
    from tests.llm.test_tokens import mix_model, reference

    for _, text in kept["quality_rules"]:
        n, *_, repeats = slow_counts(text or "")
        assert n >= 50 and 100 * repeats <= 50 * n
    exact = exact_model([(i, t) for i, t in kept["quality_rules"]])
    assert sorted(i for i, _ in kept["exact_dedup"]) == sorted(m[0] for m in exact if m[3])
    assert set(kept["simhash_near_dedup"]) <= set(kept["exact_dedup"])
    source = {r[0]: r[3] for r in rows}
    mix = mix_model([(i, t, None, source[i]) for i, t in {k: v for k, v in kept["simhash_near_dedup"]}.items()])
    words = sum(len(t.split()) for _, t in kept["mixing"])
    assert abs(words - sum(m[3] for m in mix.values())) <= max(len(t.split()) for _, t in kept["mixing"])
    encode = reference("byte_bpe_50k.json")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / "sf")).collect()
    assert sum(r["length"] for r in packed) == sum(len(encode(t)) + 1 for _, t in kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == len(packed)


def test_pipeline_of_empty_tables(spark, tmp_path):
    fixtures.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    fixtures.labels(spark, fixtures.documents()).where("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
