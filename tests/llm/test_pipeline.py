"""The stages on the smallest test data, each against a plain computation on its own input."""

from __future__ import annotations

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import test_near_duplicates, test_quality
from thicket.durable import new_folder, written

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], SF_DIR), new_folder(spark, keep=True)))
    return frames


def triples(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.select("doc_id", "text", "source").collect()]


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns(outputs):
    assert [f.columns for f in outputs[1:5]] == [outputs[0].columns] * 4


def test_quality_stage(outputs):
    kept = [r[0] for r in test_quality.brute_force(triples(outputs[0])) if r[-1]]
    assert ids(outputs[1]) == sorted(kept)
    removed = test_quality.lost_words(triples(outputs[0]))
    words = {r[0]: len(test_quality.WORD.findall(r[1])) for r in triples(outputs[1])}
    for (doc_id, text, _), lost in zip(triples(outputs[0]), removed):
        assert doc_id not in words or words[doc_id] == len(test_quality.WORD.findall(text)) - lost


def test_exact_stage(outputs):
    before, after = triples(outputs[1]), triples(outputs[2])
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert Counter(plain(t) for _, t, _ in after) == Counter({plain(t) for _, t, _ in before})
    assert {r[0] for r in after} <= {r[0] for r in before}


def test_near_stage(outputs):
    expected = test_near_duplicates.brute_force(triples(outputs[2]), 5)
    assert ids(outputs[3]) == sorted(i for i, (_, _, kept) in expected.items() if kept)


def test_mix_stage(outputs):
    before, after = triples(outputs[3]), Counter(triples(outputs[4]))
    assert set(after) <= set(before) and max(after.values()) <= 3
    assert len(after) < len(before) or max(after.values()) > 1


def test_last_stage_and_run(spark, outputs):
    assert ids(outputs[5]) == ids(outputs[4])
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, outputs[5].collect()))


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_queries_with_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = sorted((dict(zip(columns, r)) for r in result.fetchall()), key=str)
    got = [r.asDict() for r in frame.select(*columns).collect()]
    assert sorted(got, key=str) == expected and sorted(frame.columns) == sorted(columns)


def test_a_stage_removes_what_the_last_one_stored(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = written(corpus_pipeline.STAGES[1][1](spark, docs, SF_DIR), new_folder(spark, keep=True))
    root = spark._jvm.org.apache.hadoop.fs.Path(new_folder(spark)).getParent()
    filesystem = root.getFileSystem(spark._jsc.hadoopConfiguration())
    assert filesystem.exists(root)
    corpus_pipeline.STAGES[3][1](spark, kept, SF_DIR)
    assert not filesystem.exists(root) and kept.count() > 0
