"""Repair the structure of conversations at least cost, with an audit of every edit.

A conversation should read: at most one system turn, then pairs of user and
assistant. Each row is kept, given another role or deleted, and empty turns may
be inserted; the cheapest edits are found by dynamic programming over four
states (nothing yet, after system, after user, after assistant). Its audit is one
initial an edit. Of audits that cost the same, the least in ASCII order wins.

Audits are never copied while they grow. A prefix is a node that adds a few
letters to its parent; prefixes that begin alike share their nodes. Each node
knows its ancestors 1, 2, 4, ... steps up and a rolling hash of its whole prefix,
so the first step at which two audits differ is found by halving. Equal hashes
are not trusted: the letters above the difference are compared up to the node
that both share, after which the two share it for good.

Scale: rows are put in order by range partitioning, so a conversation of any
length spreads over tasks. It is then solved in blocks of bounded size: a block
gives, for each state before it, the best edits to each state after it, and a
conversation is the chain of its blocks, joined by the same dynamic program with
a block as one step. Only the SHA-256 of a repaired conversation has to read its
rows one after another; they are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import attrgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from thicket.durable import stored
from thicket.llm.rows import SPACE

BLOCK_ROWS = 4096  # rows solved in one step of a long conversation
USER, ASSISTANT = "user", "assistant"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # fixed values: costs

# States: nothing yet, after system, after user, after assistant. What may follow:
NOTHING, SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
_NEXT = {
    (NOTHING, "s"): SYSTEM,
    (NOTHING, "u"): AFTER_USER,
    (SYSTEM, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_ASSISTANT,
    (AFTER_ASSISTANT, "u"): AFTER_USER,
}
_ACCEPTED = (NOTHING, AFTER_ASSISTANT)
_MODULUS = (1 << 64) - 59  # a prime

_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with faults put in by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its
    role to user. A null counts as one space, in the text, the role and the checksum.
    """
    space = F.lit(" ")
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    fault, text = F.col("fault"), F.col("text")
    damaged = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    return (
        conversations.select(
            "conv_id",
            "turn",
            F.coalesce("role", space).alias("role"),
            F.coalesce("text", space).alias("text"),
            (F.crc32(named.cast("binary")) % 20).alias("fault"),
        )
        .filter("fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(fault == 4, USER).otherwise(F.col("role")).alias("role"),
            damaged.alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def repair(rows: DataFrame, all_ids: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per ``conv_id``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored. Rows are taken by
    ``turn``, nulls first; rows of one turn by role, then text. Null ids are one
    conversation; a null role or text counts as one space. Roles that do not begin with
    s, u or a (an empty one, too) cannot be kept. ``gaps`` counts the turn numbers that
    are missing between the least and the largest, without nulls. A row's first fault
    counts: blank, duplicate (its role and text stand earlier in the conversation),
    truncated. ``illegal`` counts neighbours whose initials are not su, ua or au.
    ``repaired_sha256`` is that of the repaired ``role:text`` joined by line breaks.
    Ids of ``all_ids`` without rows have zeros, an empty audit and the hash of nothing. An
    empty table gives no rows.
    """
    placed = stored(_placed(rows, block_rows))
    audits = _audits(_solved_blocks(placed))
    kind = placed.schema["conv_id"].dataType.simpleString()
    nothing = [F.lit(None).cast("bigint").alias(c) for c in _TOTALS]
    # Of each conversation first its audit, then its rows in order.
    empty, unknown = F.lit(""), [F.lit(None).cast("bigint").alias(c) for c in _TOTALS]
    ids = (rows if all_ids is None else all_ids).select("conv_id").distinct()
    together = (
        ids.select("conv_id", F.lit(-2).cast("bigint").alias("place"), empty.alias("role"), empty.alias("text"), *unknown)
        .union(audits.select("conv_id", F.lit(-1).cast("bigint"), empty, "audit", *_TOTALS))
        .union(placed.select("conv_id", "place", "role", "text", *unknown))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place")
    )
    totals = ", ".join(f"{c} bigint" for c in _TOTALS)
    schema = f"conv_id {kind}, {totals}, audit string, repaired_sha256 string"
    return together.mapInArrow(_apply(_arrow(schema)), schema)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with one row for every ``conv_id`` of the table."""
    return repair(damage(conversations), conversations)


def _placed(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows with ``place``, their number in order, and ``block``, the run of rows it is in."""
    space = F.lit(" ")
    filled = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order = ["conv_id", "turn", "role"]
    # A prefix keeps the sampled range borders small; ties beyond it stay in one range.
    ranged = filled.repartitionByRange(*order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    place = F.monotonically_increasing_id()
    numbered = ranged.withColumn("place", place)
    # Partition and number within it: a block never spans two partitions.
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("block", F.col("place") - within % block_rows)


def _facts(role: Column, text: Column) -> list[Column]:
    trimmed = F.rtrim(text, F.lit(SPACE))
    return [
        F.left(role, F.lit(1)).alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut_off"),
        F.sha2(text, 256).alias("digest"),
    ]


def _solved_blocks(placed: DataFrame) -> DataFrame:
    """One row for each conversation of each block: its counts, and ``steps``: best edits by state before and after."""
    kind, turn_kind = (placed.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    facts = placed.select("conv_id", "place", "block", "turn", "role", *_facts(F.col("role"), F.col("text")))
    # The first row of each role and text; all others repeat it. Partial sums keep a hot one small.
    firsts = facts.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct("place", "block")).alias("m")
    ).select("m.place", "m.block")
    nothing = {"conv_id": kind, "turn": turn_kind, "initial": "string", "blank": "boolean", "cut_off": "boolean"}
    marks = firsts.select(
        *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), "place", "block", F.lit(True).alias("mark")
    )
    rows = facts.select(*nothing, "place", "block", F.lit(False).alias("mark"))
    dealt = marks.unionByName(rows).repartition("block").sortWithinPartitions("block", "place", F.desc("mark"))
    schema = (
        f"conv_id {kind}, block bigint, opened boolean, first_turn {turn_kind}, last_turn {turn_kind}, turns bigint,"
        " first_initial string, last_initial string, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
        " steps array<struct<before:int,after:int,cost:bigint,letters:string>>"
    )
    return dealt.mapInArrow(_solve(_arrow(schema)), schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


class _Row(NamedTuple):
    conv_id: object
    turn: object
    initial: str
    blank: bool
    cut_off: bool
    place: int
    block: int
    mark: bool


def _solve(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_summaries(_rows(batches, _Row)), schema)

    return run


def _summaries(rows: Iterator[_Row]) -> Iterator[dict]:
    for block, members in groupby(rows, attrgetter("block")):
        marked = -1
        conversations: list[tuple[object, list]] = []
        for row in members:
            if row.mark:
                marked = row.place
                continue
            if not conversations or conversations[-1][0] != row.conv_id:
                conversations.append((row.conv_id, []))
            fault = "truncated" if row.cut_off else ""
            fault = "blank" if row.blank else "duplicate" if row.place != marked else fault
            conversations[-1][1].append((row.turn, row.initial, fault))
        for at, (conv_id, turns) in enumerate(conversations):
            # Only the first conversation of a block can have begun before it.
            yield {"conv_id": conv_id, "block": block} | block_summary(turns, begins=at > 0)


def _rows(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator:
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in kind._fields]
        yield from map(kind._make, zip(*columns))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def block_summary(rows: list[tuple], begins: bool) -> dict:
    """Counts and best edits of consecutive rows (turn, initial, fault) of one conversation.

    ``begins``: the conversation surely begins here. Then only its start matters, and the
    edits hold what is inserted before its first row (``opened``).
    """
    turns = [turn for turn, _, _ in rows if turn is not None]
    faults = [fault for _, _, fault in rows]
    initials = [initial for _, initial, _ in rows]
    steps = []
    for before in [NOTHING] if begins else range(4):
        paths = {before: (0, ROOT)}
        if begins:
            paths = advance(paths, OPENING)
        for _, initial, fault in rows:
            paths = advance(paths, row_steps(initial, fault))
        for after, (cost, path) in paths.items():
            steps.append({"before": before, "after": after, "cost": cost, "letters": path.letters()})
    return {
        "opened": begins,
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "first_initial": initials[0],
        "last_initial": initials[-1],
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "steps": steps,
    }


def _audits(blocks: DataFrame) -> DataFrame:
    """``conv_id``, the counts and the best audit of each conversation, from its blocks in order."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    totals = ", ".join(f"{c} bigint" for c in _TOTALS)
    schema = f"conv_id {kind}, {totals}, audit string"
    return dealt.mapInArrow(_join(_arrow(schema)), schema)


def _join(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        joined = ({"conv_id": i} | joined_blocks(b) for i, b in groupby(rows, lambda row: row["conv_id"]))
        return _batches(joined, schema)

    return run


def joined_blocks(blocks: Iterable[dict]) -> dict:
    """Counts, cost and audit of a conversation from the summaries of its blocks in order."""
    totals = dict.fromkeys(_TOTALS, 0)
    first = last = last_initial = None
    turns = 0
    paths: dict[int, tuple[int, Path]] = {}
    for block in blocks:
        if not paths:
            paths = {NOTHING: (0, ROOT)}
            paths = paths if block["opened"] else advance(paths, OPENING)
        if block["first_turn"] is not None:
            first = block["first_turn"] if first is None else first
            turns += block["turns"] - (block["first_turn"] == last)
            last = block["last_turn"]
        if last_initial is not None:
            totals["illegal"] += last_initial + block["first_initial"] not in ("su", "ua", "au")
        last_initial = block["last_initial"]
        for count in ("blank", "duplicate", "truncated", "illegal"):
            totals[count] += block[count]
        table: dict[int, dict[int, tuple[int, str]]] = {}
        for step in block["steps"]:
            table.setdefault(step["before"], {})[step["after"]] = (step["cost"], step["letters"])
        paths = advance(paths, table)
    ended = {state: path for state, path in paths.items() if state in _ACCEPTED}
    totals["cost"], path = _best(list(ended.values()))
    totals["gaps"] = int(last - first + 1 - turns) if first is not None else 0
    return totals | {"audit": path.letters()}


def _inserted(reached: dict[int, tuple[int, str]], before: int) -> dict[int, dict[int, tuple[int, str]]]:
    """What is reached from ``before``, also by inserting turns afterwards."""
    best = dict(reached)
    open_ = list(reached)
    while open_:
        state = open_.pop()
        cost, letters = best[state]
        for role in "ua":
            after = _NEXT.get((state, role))
            if after is not None and (after not in best or (cost + INSERT, letters + "I") < best[after]):
                best[after] = (cost + INSERT, letters + "I")
                open_.append(after)
    return {before: best}


OPENING = _inserted({NOTHING: (0, "")}, NOTHING)  # what may be inserted before the first row
_ROW_STEPS: dict[tuple[str, str], dict[int, dict[int, tuple[int, str]]]] = {}


def row_steps(initial: str, fault: str) -> dict[int, dict[int, tuple[int, str]]]:
    """Per state before a row: the states after it, each with the least cost and its letters."""
    kind = (initial if initial in ("s", "u", "a") else "", fault)
    if kind not in _ROW_STEPS:
        table = {}
        for before in range(4):
            reached = {before: (DELETE, "D")}
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault == "truncated" else 0
                edits = [(KEEP + extra, "K", kind[0]), (REROLE + extra, "R", "u"), (REROLE + extra, "R", "a")]
                for cost, letter, role in edits:
                    after = _NEXT.get((before, role))
                    if after is not None:
                        reached[after] = min(reached.get(after, (cost, letter)), (cost, letter))
            table |= _inserted(reached, before)
        _ROW_STEPS[kind] = table
    return _ROW_STEPS[kind]


class Path:
    """A prefix of an audit: its parent's letters and ``added``."""

    __slots__ = ("parent", "added", "size", "hash", "up")

    def __init__(self, parent: Path | None, added: str):
        self.parent, self.added = parent, added
        if parent is None:
            self.size, self.hash, self.up = 0, 0, []
            return
        self.size = parent.size + len(added)
        shift = pow(256, len(added), _MODULUS)
        self.hash = (parent.hash * shift + int.from_bytes(added.encode(), "big")) % _MODULUS
        # up[k] is the ancestor 2^k steps above.
        self.up = [parent]
        while len(self.up) <= len(self.up[-1].up):
            self.up.append(self.up[-1].up[len(self.up) - 1])

    def letters(self, top: Path | None = None) -> str:
        """All letters, or those added below ``top``."""
        parts, node = [], self
        while node is not top and node.parent is not None:
            parts.append(node.added)
            node = node.parent
        return "".join(reversed(parts))


ROOT = Path(None, "")


def _alike(a: Path, b: Path) -> bool:
    return a is b or (a.size == b.size and a.hash == b.hash)


def first_difference(a: Path, b: Path) -> tuple[Path, Path] | None:
    """The ancestors of two paths of equally many steps where these first add other letters."""
    if not _alike(a, b):
        for k in reversed(range(len(a.up))):
            if k < len(a.up) and not _alike(a.up[k], b.up[k]):
                a, b = a.up[k], b.up[k]
        found = (a, b)
        same = (a.parent, b.parent)
    else:
        found, same = None, (a, b)
    # Verify what the hashes call alike, up to the node that both share.
    x, y = same
    while x is not y:
        if x.added != y.added:
            found = (x, y)
        x, y = x.parent, y.parent
    if found is not None and found[0].parent is not found[1].parent:
        found[1].parent = found[0].parent  # equal as verified: from now on shared
    return found


def less(a: Path, b: Path) -> bool:
    """Whether the letters of ``a`` come before those of ``b``; both have equally many steps."""
    found = first_difference(a, b)
    if found is None:
        return False
    x, y = found
    if x.added.startswith(y.added) or y.added.startswith(x.added):
        return a.letters(x.parent) < b.letters(y.parent)
    return x.added < y.added


def advance(
    paths: dict[int, tuple[int, Path]], table: dict[int, dict[int, tuple[int, str]]]
) -> dict[int, tuple[int, Path]]:
    """The best path to each state after a step, from the best ones before it."""
    cheapest: dict[int, int] = {}
    options: dict[int, list[tuple[Path, str]]] = {}
    for before, (spent, path) in paths.items():
        for after, (cost, letters) in table.get(before, {}).items():
            total = spent + cost
            if after not in cheapest or total < cheapest[after]:
                cheapest[after], options[after] = total, [(path, letters)]
            elif total == cheapest[after]:
                options[after].append((path, letters))
    return {
        after: _best([(cheapest[after], Path(path, letters)) for path, letters in found])
        for after, found in options.items()
    }


def _best(found: list[tuple[int, Path]]) -> tuple[int, Path]:
    best = found[0]
    for one in found[1:]:
        if one[0] < best[0] or (one[0] == best[0] and less(one[1], best[1])):
            best = one
    return best


class _Line(NamedTuple):
    conv_id: object
    place: int
    role: str
    text: str
    gaps: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int


def _apply(schema: pa.Schema):
    """Per conversation come its id, its audit if it has rows, then the rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = groupby(_rows(batches, _Line), attrgetter("conv_id"))
        return _batches(({"conv_id": i} | _repaired(own) for i, own in lines), schema)

    return run


def _repaired(lines: Iterator[_Line]) -> dict:
    totals, audit, turns = dict.fromkeys(_TOTALS, 0), "", None
    digest = hashlib.sha256()
    for line in lines:
        if line.place == -1:
            totals, audit = {c: getattr(line, c) for c in _TOTALS}, line.text
            turns = Turns(audit, digest)
        elif line.place >= 0:
            turns.row(line.role, line.text)
    return totals | {"audit": audit, "repaired_sha256": digest.hexdigest()}


class Turns:
    """Writes the repaired turns of a conversation into a digest, row by row."""

    def __init__(self, audit: str, digest):
        self.audit, self.at, self.digest = audit, 0, digest
        self.state, self.any = NOTHING, False
        self._insertions()

    def row(self, role: str, text: str) -> None:
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._write(role if edit == "K" else self._due(), text)
        self._insertions()

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(self._due(), "")

    def _due(self) -> str:
        return ASSISTANT if self.state == AFTER_USER else USER

    def _write(self, role: str, text: str) -> None:
        self.state = _NEXT[self.state, role[0]]
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True
