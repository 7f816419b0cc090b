"""What a search holds at once follows neither the batch nor the sizes of titles."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from thicket import Config
from thicket.functions.grams import TitleFilter, _bits, _code_points, _hashes, _running_sums
from thicket.operators.choice import _edited, edited_texts
from thicket.operators.targets import build_dictionary, link_targets


def _peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _hash(text: str) -> int:
    return int(_hashes(_running_sums(_code_points(text)), np.array([0]), np.array([len(text)]))[0])


def _filter(titles: list[str]) -> TitleFilter:
    buckets, words = 1 << 10, 1 << 10
    leads = sorted({(_hash(t[:4]) & (buckets - 1), len(t)) for t in titles})
    masks = np.zeros(words, np.uint64)
    for t in titles:
        masks[_hash(t) & (words - 1)] |= _bits(np.array([_hash(t)], np.uint64))[0]
    counts = np.bincount([b for b, _ in leads], minlength=buckets)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return TitleFilter(4, max(map(len, titles)), offsets, np.array([n for _, n in leads], np.int32), masks, None, None)


def test_places_where_many_sizes_may_start():
    titles = ["aaaa" + "b" * n for n in range(60)]
    known, text = _filter(titles), "a" * 40_000 + "bbb " + "a" * 40_000 + "b" * 58
    which, place, start, end, _, joined = known.search([text, "xaaaab"])
    found = [(w, p, joined[s:e]) for w, p, s, e in zip(which.tolist(), place.tolist(), start.tolist(), end.tolist(), strict=True)]
    brute = [(w, p, t) for w, held in enumerate([text, "xaaaab"]) for p in range(len(held)) for t in titles if held.startswith(t, p)]
    assert [f for f in found if f[2] in titles] == brute and len(brute) == 80_057
    assert _peak(lambda: known.search(["a" * 80_000])) < 60_000_000


def test_links_of_a_batch_are_chosen_run_by_run(notes):
    names = ["Alpha beta", "beta gamma", "Gamma", "alphabet", "amma del"]
    table, cfg = notes({f"{n}.md": "" for n in names}), Config(link_whole_word=False)
    dictionary = build_dictionary(link_targets(table, cfg), cfg, table)
    tables = dictionary.named_order()
    helper = edited_texts(dictionary, tables, cfg.link_max_per_note).func
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batch(count: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        texts = [f"{k} " + "alphabeta gamma delta " * 900 if k % 9 else [None, ""][k % 2] for k in range(count)]
        spans = [[{"start": k, "end": k + 40}] if k % 3 else [] for k in range(count)]
        return pa.array(texts, pa.string()), pa.array(spans, kind), pa.array([[]] * count, pa.list_(pa.int64()))

    few, many = batch(8), batch(64)
    pieces = list(helper(iter([few, many])))
    whole = [_edited(*b, dictionary.title_filter(True), *tables, cfg.link_max_per_note, 1 << 17, 1 << 20) for b in (few, many)]
    assert pa.concat_arrays(pieces).to_pylist() == pa.concat_arrays(whole).to_pylist()
    assert len(pa.concat_arrays(pieces).flatten()) > 100

    def passed(columns: tuple[pa.Array, ...]) -> None:
        for _ in helper(iter([columns])):
            pass

    assert _peak(lambda: passed(many)) < 1.5 * _peak(lambda: passed(few))
