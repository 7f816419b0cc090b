"""Notes made from documents: only texts that take the next title are shuffled for it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thicket.sources import documents


@pytest.mark.parametrize("repeated", [False, True])
def test_next_titles(spark, repeated):
    ids = [*range(-60, 900), None] + [5, 6, 6, 8] * repeated
    rows = [(d, f"Word{i % 9} Two of {i}" if i % 4 else "-", f"src{i % 3}") for i, d in enumerate(ids) if d != 26]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    d = F.col("doc_id")
    title = documents._title(F.col("text"), d)
    joined = docs.withColumn("title", title).join(
        docs.select((d - 1).alias("doc_id"), title.alias("next_title")), "doc_id", "left"
    )
    expected = sorted(str(r["content"]) for r in joined.select(documents._content(d).alias("content")).collect())
    notes = documents.notes_from_documents(docs)
    assert sorted(str(r["content"]) for r in notes.collect()) == expected
    assert any("[[missing]]" in text for text in expected)
    # The join takes only the rows that need it, if no id repeats.
    assert ("Union" in notes._jdf.queryExecution().optimizedPlan().toString()) == (not repeated)
