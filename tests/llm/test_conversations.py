from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache
from itertools import groupby

import pytest

from thicket.llm import conversations
from thicket.llm.conversations import Path, advance, block_summary, first_difference, joined_blocks, less, row_steps

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, block int, cost string, mark int"
ORDER = {"s": "", "u": "s", "a": "u"}


def spoiled(rows):
    """The damage of the contract, row by row."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv_id, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns) by recursion over rows, whole strings compared."""

    @lru_cache(maxsize=None)
    def best(i, shape, inserted):
        # shape: initials so far as "", "s", "u" (a pair is open) or "a" (a pair has closed)
        options = []
        if i == len(rows):
            if shape in ("", "a"):
                options.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            options.append(extend(best(i + 1, shape, 0), 2, "D", None))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                initial = role[:1]
                if initial == "s" and shape == "" or initial == "u" and shape != "u" or initial == "a" and shape == "u":
                    options.append(extend(best(i + 1, initial, 0), extra, "K", (role, text)))
                due = "assistant" if shape == "u" else "user"
                options.append(extend(best(i + 1, due[0], 0), 1 + extra, "R", (due, text)))
        if inserted < 3:
            due = "assistant" if shape == "u" else "user"
            options.append(extend(best(i, due[0], inserted + 1), 5, "I", (due, "")))
        return min((o for o in options if o), key=lambda o: o[:2], default=None)

    def extend(rest, cost, letter, turn):
        return rest and (rest[0] + cost, letter + rest[1], ((turn,) if turn else ()) + rest[2])

    return best(0, "", 0)


def brute_force(rows):
    out = {}
    damaged = spoiled(rows)
    for conv_id in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv_id]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(own)
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, kept = cheapest(own, faults) if len(own) < 60 else (None, None, ())
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def varied(seed, ids=120, least=1, most=12):
    random.seed(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Go!", "It ends. ", "no end\t", None, "日本。", "x" * 50_000 + "."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", None, "", "User"]
    rows = []
    for conv_id in [None, *range(ids)]:
        for turn in range(random.randint(least, most)):
            turn = None if random.random() < 0.05 else turn + 2 * (random.random() < 0.1)
            rows.append((conv_id, turn, random.choice(roles), random.choice(texts)))
    random.shuffle(rows)
    return rows


def as_dict(frame):
    rows = frame.collect()
    return {r["conv_id"]: tuple(r)[1:] for r in rows}, len(rows)


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 3), (3, 1)])
def test_repair_matches_brute_force(spark, seed, block):
    rows = varied(seed)
    wide = [(*r, "x", 7, "y", 9) for r in rows]
    table = spark.createDataFrame(wide, SCHEMA).repartition(5)
    found, n = as_dict(conversations.repair(conversations.damage(table), table, block_rows=block))
    expected = brute_force(rows)
    assert n == len(expected) and found == expected


def test_long_conversation_in_blocks_equals_one_block(spark):
    """A conversation with a third of all rows is solved in many blocks of many tasks."""
    rows = varied(5, ids=1, least=900, most=900) + varied(6, ids=200)
    table = spark.createDataFrame([(*r, "x", 7, "y", 9) for r in rows], SCHEMA)
    small, _ = as_dict(conversations.repair(conversations.damage(table), table, block_rows=16))
    large, _ = as_dict(conversations.repair(conversations.damage(table), table))
    assert small == large


def test_empty_table(spark):
    assert conversations.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    found, _ = as_dict(conversations.damaged_and_repaired(spark.createDataFrame([(1, turn, "user", "a.", "x", 1, "y", 1)], SCHEMA)))
    assert found == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def plain_best(kinds):
    """(cost, audit) by carrying whole strings."""
    best = {0: (0, "")}
    for table in [conversations.OPENING, *(row_steps(*k) for k in kinds)]:
        new = {}
        for before, (cost, audit) in best.items():
            for after, (more, letters) in table.get(before, {}).items():
                new[after] = min(new.get(after, (10**9, "")), (cost + more, audit + letters))
        best = new
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("modulus", [conversations._MODULUS, 3])
def test_audits_do_not_depend_on_hashes(monkeypatch, modulus):
    """With a modulus of 3 nearly all hashes collide; what they call alike is verified."""
    monkeypatch.setattr(conversations, "_MODULUS", modulus)
    random.seed(7)
    for _ in range(300):
        faults = ["", "", "", "blank", "duplicate", "truncated"]
        kinds = [(random.choice("suat"), random.choice(faults)) for _ in range(random.randint(1, 40))]
        rows = [(i, initial, fault) for i, (initial, fault) in enumerate(kinds)]
        cut = random.randint(1, len(rows))
        blocks = [block_summary(part, begins) for part, begins in ((rows[:cut], False), (rows[cut:], False)) if part]
        whole = joined_blocks([block_summary(rows, True)])
        assert joined_blocks(blocks) == whole
        assert (whole["cost"], whole["audit"]) == plain_best(kinds)


def test_shared_prefixes_and_comparison():
    root = conversations.ROOT
    a, b = root, root
    for letter in "KDKKRDKDDK":
        a, b = Path(a, letter), Path(b, letter)
    assert first_difference(a, b) is None and not less(a, b)
    x, y = Path(Path(a, "K"), "KI"), Path(Path(b, "K"), "KR")
    found = first_difference(x, y)
    assert found == (x, y) and x.parent is y.parent  # equal as verified, so shared now
    assert less(x, y) and not less(y, x)
    assert [node.size for node in x.up] == [11, 10, 8, 4]
    # One step's letters begin the other's: the letters that follow decide.
    p, q = Path(Path(a, "K"), "D"), Path(Path(a, "KI"), "D")
    assert less(p, q) and not less(q, p)
    paths = advance({0: (0, root)}, {0: {1: (2, "D"), 2: (0, "K")}})
    assert {s: (c, node.letters()) for s, (c, node) in paths.items()} == {1: (2, "D"), 2: (0, "K")}
    assert all(len(list(g)) == 1 for _, g in groupby(sorted(paths)))
