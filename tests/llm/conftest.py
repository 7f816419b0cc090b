from __future__ import annotations

import pytest

DOCS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept boolean,"
    " component_id string, target string, host string, line string, n string, row int"
)


@pytest.fixture
def make_docs(spark):
    """Documents with columns whose names the operators use too, over several partitions."""

    def make(rows, parts: int = 3):
        filled = [(i, t, "en", s, None, "x", None, "y", "z", "h", "l", "n", 5) for i, t, s in rows]
        return spark.createDataFrame(filled, DOCS).repartition(parts)

    return make


@pytest.fixture
def small_partitions(spark):
    """Adaptive execution with thresholds that a few thousand rows of one key exceed."""
    skewed = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in skewed}
    for key, value in skewed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture
def odd_rows():
    """Nulls, empties, white space, repeats, a long text and texts of other scripts."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, None, "a"),
        (2, "", None),
        (3, " \t\n\x0b\x0c\r", "a"),
        (4, "one", "b"),
        (4, "one", "b"),
        (None, "no id here at all", "a"),
        (None, None, None),
        (5, long, "b"),
        (6, long + " end", "b"),
        (7, "Äöü 日本語     🎉 naïve", ""),
        (8, "one two\nthree four\none two\n", "a"),
    ]
