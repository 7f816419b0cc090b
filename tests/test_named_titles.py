"""Where every task has the names of all targets, links are shown and written where the texts lie."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from thicket import Config
from thicket.functions.grams import TitleNames
from thicket.operators import edges, targets
from thicket.operators.choice import _edited
from thicket.operators.targets import build_dictionary, link_targets

NAMES = ["Alpha Beta", "alpha beta", "Gamma", "Çédille ſun", "İstanbul", "a-b c.d", "🎉 Party", "ALPHA", "Delta alpha"]


@pytest.fixture
def given(notes):
    rng = random.Random(7)
    words = [*NAMES, "alpha", "xBeta", "`Gamma`", "\n", "[[Gamma]]", "second name"]
    table = {f"{k}/{n}.md": "---\naliases: [second name, Gamma]\n---\n" for k, n in enumerate(NAMES)}
    return notes(table | {f"n/{k}.md": " ".join(rng.choice(words) for _ in range(40)) for k in range(20)} | {"none.md": None})


def _all(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"link_max_per_note": 0, "skip_already_linked": True, "respect_protection": True}])
def test_named_titles_change_no_result(given, monkeypatch, settings):
    cfg, found = Config(**settings), []
    for named in (True, False):
        if not named:
            monkeypatch.setattr(targets.Dictionary, "named_order", lambda self: (self.title_order(), None))
        shown = edges.suggest_links(given, cfg)
        accepted = shown.filter("start % 2 = 0").select("path", "target")
        found.append([
            _all(shown),
            _all(edges.apply_links(given, cfg)),
            _all(edges.apply_links(given, cfg, accepted)),
            _all(edges.linked_corpus(given, cfg)),
            _all(edges.linked_corpus(given, cfg, accepted)),
        ])
    assert found[0] == found[1] and all(len(rows) > 15 for rows in found[0])


def test_texts_are_not_shuffled(given, tmp_path):
    given.write.parquet(str(tmp_path / "n"))
    stored = given.sparkSession.read.parquet(str(tmp_path / "n"))
    written = edges.apply_links(stored, Config())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in written
    shown = edges.suggest_links(stored, Config())._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [i for i, line in enumerate(shown) if "Exchange" in line]
    helpers = [i for i, line in enumerate(shown) if "ArrowEvalPython" in line]
    # What stands lower runs earlier.
    assert len(shuffles) == 1 and helpers and shuffles[0] < min(helpers)


def test_a_text_that_only_shares_a_hash_is_passed_over(given):
    dictionary = build_dictionary(link_targets(given, Config()), Config(), given)
    order, names = dictionary.named_order()
    other = TitleNames(pa.array(["other"] * len(names.keys)), names.targets)
    texts = pa.array(["Delta alpha, gamma", None])
    spans = pa.array([[], []], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    none = pa.array([[], []], pa.list_(pa.int64()))
    links = [
        _edited(texts, spans, none, dictionary.title_filter(True), order, n, 3, 64, 8).to_pylist() for n in (names, other)
    ]
    assert [e["target"] for e in links[0][0]][:1] == ["Delta alpha"] and links[1] == [[], []]


def test_names_above_the_limit_stay_out(given):
    size = build_dictionary(link_targets(given, Config()), Config(), given)
    assert size.named_order()[1] is not None
    taken = size.name_bytes + 4 * (size.count + size.entries)
    order = size.count * 12 + size.entries * 16
    assert sum(len(n.as_py().encode()) for n in size.named_order()[1].targets) <= size.name_bytes
    for limit in (max(taken, order), min(taken, order) - 1):
        cfg = Config(broadcast_limit_bytes=limit)
        assert all(t is not None for t in build_dictionary(link_targets(given, cfg), cfg, given).named_order()) == (limit >= taken and limit >= order)
