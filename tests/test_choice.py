"""Links are chosen where the texts lie: only they are shuffled, whatever notes mention."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from thicket import Config
from thicket.operators.choice import _chosen
from thicket.operators.edges import suggest_links
from thicket.operators.targets import build_dictionary, link_targets

NAMES = ["Alpha Beta", "alpha beta", "Beta Gamma", "Gamma", "Çédille ſun", "a-b c.d", "🎉 Party", "ALPHA", "Delta alpha"]


def _given() -> dict[str, str]:
    rng = random.Random(5)
    words = [*NAMES, "alpha", "xBeta", "`Gamma`", "\n", "[[Gamma]]"]
    given = {f"{k}/{n}.md": "" for k, n in enumerate(NAMES)}
    return given | {f"n/{k}.md": " ".join(rng.choice(words) for _ in range(60)) for k in range(20)}


@pytest.mark.parametrize("settings", [{}, {"link_max_per_note": 2}, {"link_max_per_note": 0, "skip_already_linked": True}])
def test_the_three_ways_agree(spark, notes, settings):
    table, found = notes(_given()), []
    size = build_dictionary(link_targets(table, Config()), Config(), table).bytes
    # All titles with every task; their order alone; neither.
    for limit in (1 << 26, size - 1, 0):
        cfg = Config(broadcast_limit_bytes=limit, **settings)
        dictionary = build_dictionary(link_targets(table, cfg), cfg, table)
        assert (dictionary.is_small, dictionary.title_order() is not None) == (limit > size, limit > 0)
        planned = suggest_links(table, cfg)
        assert ("_chosen" in planned._jdf.queryExecution().optimizedPlan().toString()) == (limit > 0)
        found.append(sorted(map(tuple, planned.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 30


@pytest.mark.parametrize("slab", [1, 1 << 20])
def test_a_note_gives_its_links_not_its_mentions(spark, notes, slab):
    cfg, table = Config(link_max_per_note=2), notes(_given())
    dictionary = build_dictionary(link_targets(table, cfg), cfg, table)
    texts = pa.array(["Gamma " * 3000, "", "Delta alpha beta gamma, alpha beta " * 50, None])
    spans = pa.array([[{"start": 0, "end": 8}], [], [], []], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    names = pa.array([[], [], [], []], pa.list_(pa.int64()))
    found = _chosen(texts, spans, names, dictionary.title_filter(True), dictionary.title_order(), 2, 64, slab).to_pylist()
    assert [[(e["start"], e["key"]) for e in row] for row in found] == [
        [(12, "gamma")], [], [(0, "delta alpha"), (24, "alpha beta")], []
    ]
