from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from thicket import Config
from thicket.functions.paths import base_name
from thicket.operators import mentions as mentions_module
from thicket.operators import targets as targets_module
from thicket.operators.edges import apply_links, suggest_links
from thicket.operators.mentions import find_mentions, title_sized_texts, titles_in_notes
from thicket.operators.targets import build_dictionary, link_targets
from thicket.plans import find_edges, reports

LOOSE = Config(link_min_title_length=1)


def targets_of(spark, pairs):
    """(match, path of the target note) in the order given."""
    rows = [
        (match, path.rsplit("/", 1)[-1].removesuffix(".md"), path, i, len(match))
        for i, (match, path) in enumerate(pairs)
    ]
    return spark.createDataFrame(
        rows, "match string, target string, path string, ord int, match_len int"
    )


def linked(spark, notes, content, pairs, cfg=Config(), path="me.md"):
    pairs = [(p, f"t/{p}.md") if isinstance(p, str) else p for p in pairs]
    changed = apply_links(notes({path: content}), cfg, targets=targets_of(spark, pairs))
    row = changed.first()
    return row["content"] if row else content


CASES = {
    "longest first": (
        "Machine Learning and learning", ["Machine Learning", "Learning"], Config(),
        "[[Machine Learning]] and [[Learning|learning]]",
    ),
    "covered": ("Machine Learning only", ["Machine Learning", "Learning"], Config(),
                "[[Machine Learning]] only"),
    "whole word": ("xLearning Learning2 _Learning Learning", ["Learning"], Config(),
                   "xLearning Learning2 _Learning [[Learning]]"),
    "part of word": ("xLearning", ["Learning"], Config(link_whole_word=False), "x[[Learning]]"),
    "already linked": ("see [[Learning]] and Learning", ["Learning"], Config(),
                       "see [[Learning]] and [[Learning]]"),
    "protected": ("`Learning` https://x/Learning [Learning](y) Learning", ["Learning"], Config(),
                  "`Learning` https://x/Learning [Learning](y) [[Learning]]"),
    "frontmatter": ("---\ntitle: Learning\n---\nbody", ["Learning"], Config(),
                    "---\ntitle: [[Learning]]\n---\nbody"),
    "repeats": ("foo foo foo foo", ["foo foo", "foo"], LOOSE, "[[foo foo]] [[foo]] foo"),
    "short skipped": (
        "AI then Artificial Intel", [("Artificial Intel", "AINote.md"), ("AI", "AINote.md")],
        LOOSE, "AI then [[AINote|Artificial Intel]]",
    ),
    "cap": ("Alpha Beta2x Gamma", ["Alpha", "Beta2x", "Gamma"], Config(link_max_per_note=1),
            "Alpha [[Beta2x]] Gamma"),
    "case": ("LEARNING", ["Learning"], Config(link_case_sensitive=True), "LEARNING"),
    "blocked advances": (
        "foo bar foo foo foo", [("foo bar foo", "P.md"), ("foo foo", "Q.md")], LOOSE,
        "[[P|foo bar foo]] foo foo",
    ),
    "duplicate names": ("Dup here", [("Dup", "a/Dup.md"), ("Dup", "b/Dup.md")], LOOSE,
                        "[[Dup]] here"),
    "shared alias": (
        "todo todo todo", [("todo", "B.md"), ("todo", "A.md"), ("todo", "C.md")], LOOSE,
        "[[A|todo]] [[B|todo]] [[C|todo]]",
    ),
    "punctuation ends": ("What? Yes. What?No What?", ["What?"], LOOSE,
                         "[[What?]] Yes. What?No What?"),
    "punctuation starts": ("x(a) (a)", ["(a)"], LOOSE, "x(a) [[(a)]]"),
    "beyond the basic plane": ("🎉 Party🎉 x", ["Party"], LOOSE, "🎉 [[Party]]🎉 x"),
    "folding": ("STRAẞE ſun ΟΔΟΣ", ["straße", "sun", "οδος"], LOOSE,
                "[[straße|STRAẞE]] [[sun|ſun]] [[οδος|ΟΔΟΣ]]"),
    "no folding of dotted i": ("İx ix", ["ix"], LOOSE, "İx [[ix]]"),
    "empty note": ("", ["Learning"], Config(), ""),
}


@pytest.mark.parametrize("name", CASES)
def test_golden_cases(spark, notes, name):
    content, pairs, cfg, expected = CASES[name]
    assert linked(spark, notes, content, pairs, cfg) == expected


def test_same_name_is_never_linked(spark, notes):
    assert linked(spark, notes, "Me too", [("Me", "other/Me.md")], LOOSE, "x/Me.md") == "Me too"


def test_dictionary(notes):
    given = notes(
        {"a/Long Title.md": "---\naliases: [' Alt one ', abc]\n---\n", "b/abc.md": "", "c/🎉🎉.md": ""}
    )
    rows = {(r["match"], r["target"], r["ord"], r["match_len"]) for r in link_targets(given, Config()).collect()}
    assert rows == {
        ("Long Title", "Long Title", 0, 10), ("Alt one", "Long Title", 1, 7), ("🎉🎉", "🎉🎉", 0, 4),
    }
    no_aliases = link_targets(given, Config(link_use_aliases=False))
    assert no_aliases.count() == 2


def test_no_titles_no_links(notes):
    given = notes({"a.md": "a b", "b.md": "a"})
    assert suggest_links(given, Config()).count() == 0
    assert apply_links(given, Config()).count() == 0


def test_report_and_accept(spark, notes):
    given = notes({"n.md": "First Topic\nand Other thing", "Topic.md": "", "Other.md": "see topic"})
    found = find_edges.scan(given, Config())
    assert [(r["path"], r["target"], r["line"], r["start"], r["end"]) for r in found.collect()] == [
        ("Other.md", "Topic", 1, 4, 9), ("n.md", "Topic", 1, 6, 11), ("n.md", "Other", 2, 16, 21),
    ]
    report = [(r["title"], r["detail"]) for r in reports.edge_report(found).collect()]
    assert report[0] == ("Other.md  →  [[Topic]]", "line 1: see **topic**")
    accepted = spark.createDataFrame(
        [("n.md", "Other"), ("n.md", "Other"), ("n.md", "Nowhere"), ("gone.md", "Topic")],
        "path string, target string",
    )
    result = find_edges.insert(given, Config(), accepted)
    assert [(r["path"], r["content"], r["n_applied"]) for r in result.changed.collect()] == [
        ("n.md", "First Topic\nand [[Other]] thing", 1)
    ]
    assert result.notes.count() == 3
    assert reports.apply_summary(result.changed).first().asDict() == {"applied": 1, "notes": 1}
    nothing = find_edges.insert(given, Config(), accepted.limit(0))
    assert reports.apply_summary(nothing.changed).first().asDict() == {"applied": 0, "notes": 0}


def brute_force(content, own, titles, cap, whole, exact):
    """What the greedy search does, one title and one match at a time."""
    taken = [
        m.span()
        for p in (r"```[\s\S]*?```", r"`[^`]*`", r"\[\[[^\]]*?\]\]", r"!?\[[^\]]*?\]\([^)]*?\)",
                  r"(?i:https?://\S+)")
        for m in re.finditer(p, content)
    ]
    chosen = {}
    for match, path in sorted(titles, key=lambda t: (-len(t[0]), t[1])):
        target = path.removesuffix(".md")
        if target in chosen or target == own or (cap and len(chosen) == cap):
            continue
        pattern = re.escape(match)
        if whole:
            pattern = rf"(?<!\w){pattern}(?!\w)"
        for hit in re.finditer(pattern, content, 0 if exact else re.I):
            if not any(hit.start() < e and hit.end() > s for s, e in taken):
                chosen[target] = hit.span()
                taken.append(hit.span())
                break
    return {(t, *span) for t, span in chosen.items()}


@pytest.mark.parametrize("limit", [64 << 20, 0], ids=["broadcast", "shuffle"])
@pytest.mark.parametrize(
    ("cap", "whole", "exact"),
    [(20, True, False), (0, True, False), (2, True, True), (1, False, False), (0, False, True)],
)
def test_against_brute_force(spark, notes, monkeypatch, cap, whole, exact, limit):
    """Random small texts over a small alphabet, in blocks so small that most
    titles cross a block border."""
    monkeypatch.setattr(mentions_module, "BLOCK_UNITS", 3)
    rng = random.Random(f"{cap}{whole}{exact}")
    words = ["ab", "a", "ba", "Ab", "b_", "a.b", "`", "[[", "]]", "aab", "é", "https://a", "(", "](", ")"]
    texts = {
        f"n{i}.md": "".join(
            rng.choice(words) + rng.choice([" ", " ", "", "\n", "-"]) for _ in range(rng.randint(0, 30))
        )
        for i in range(60)
    }
    matches = ["ab", "a", "ab ab", "a ab", "ab-ab", "ba a ab", "aab", "a.b", "É", "b", "aa"]
    titles = [(m, f"n{rng.randint(0, 8)}.md") for m in matches for _ in range(rng.randint(1, 3))]
    titles = sorted(set(titles))
    cfg = Config(
        link_min_title_length=1, link_max_per_note=cap, link_whole_word=whole,
        link_case_sensitive=exact, broadcast_limit_bytes=limit,
    )
    found = suggest_links(notes(texts), cfg, targets_of(spark, titles)).collect()
    got = {path: set() for path in texts}
    for row in found:
        got[row["path"]].add((row["target"], row["start"], row["end"]))
    expected = {
        path: brute_force(content, path.removesuffix(".md"), titles, cap, whole, exact)
        for path, content in texts.items()
    }
    assert sum(map(len, expected.values())) > 50
    assert got == expected


def test_written_links_can_be_taken_out_again(notes):
    rng = random.Random(5)
    names = ["Alpha", "Beta", "Alpha Beta", "Gamma ray"]
    texts = {f"d/{n}.md": " ".join(rng.choice(["alpha", "BETA", "gamma", "ray", "x"]) for _ in range(40)) for n in names}
    given = notes(texts)
    for row in apply_links(given, Config()).collect():
        restored = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", row["content"])
        assert restored == texts[row["path"]]
        assert row["content"].count("[[") == row["n_applied"] <= 20


def test_one_title_mentioned_everywhere_is_split(spark):
    """Above the broadcast limit the texts are shuffled by title. When every note
    has the same one, AQE's skew join must be able to split its partition."""
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
    try:
        path = F.concat(F.lit("n"), F.col("id"), F.lit(".md"))
        given = spark.range(3000).repartition(8).select(
            path.alias("path"), F.lit("about Hot Topic and more").alias("content")
        )
        cfg = Config(broadcast_limit_bytes=0)
        titles = targets_of(spark, [("Hot Topic", "Hot Topic.md"), ("Cold", "Cold.md")])
        found = find_mentions(given, build_dictionary(titles, cfg, given), cfg).repartition("path")
        assert found.count() == 3000
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_plan_has_no_pairwise_join_and_one_text_shuffle(spark, tmp_path, notes):
    notes({"a/Topic.md": "x", "b.md": "Topic"}).write.parquet(str(tmp_path / "n"))
    stored = spark.read.parquet(str(tmp_path / "n"))
    found = suggest_links(stored, Config())
    assert found.count() == 1
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    text_shuffles = [
        line for line in final.splitlines()
        if "Exchange hashpartitioning(path" in line and "Reused" not in line
    ]
    assert len(text_shuffles) == 1


@pytest.fixture(params=["1000", "5"])
def cut_before_shuffle(spark, request):
    """Spark cuts before the shuffle; or it does not, and rows are salted."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(name, request.param)
    yield request.param == "1000"
    spark.conf.unset(name)


def test_one_alias_of_many_notes(spark, notes, cut_before_shuffle):
    """Only as many of the notes behind one title are kept as a note can use."""
    given = {f"n{i:03}.md": "---\naliases: [todo it]\n---\n" for i in range(300)}
    given["me.md"] = "todo it, " * 30
    cfg = Config(link_use_aliases=True)
    plan = targets_module._first_of_each_key(
        spark.range(99).selectExpr(
            "string(id % 2) AS key", "string(id) AS target", "struct(string(id) AS path, 0 AS ord) AS first"
        ),
        cfg.link_max_per_note + 1,
    )._jdf.queryExecution().executedPlan().toString()
    assert ("WindowGroupLimit" in plan) == cut_before_shuffle
    assert cut_before_shuffle or "salt" in plan
    dictionary = build_dictionary(link_targets(notes(given), cfg), cfg, notes(given))
    sizes = {r["key"]: r["n"] for r in dictionary.titles.select("key", F.size("entries").alias("n")).collect()}
    assert sizes["todo it"] == 21 and sizes["n000"] == 1
    found = [r["target"] for r in find_edges.scan(notes(given), cfg).filter("path = 'me.md'").collect()]
    assert found == [f"n{i:03}" for i in range(20)]
    uncapped = find_edges.scan(notes(given), Config(link_max_per_note=0)).filter("path = 'me.md'")
    assert uncapped.count() == 30
    everyone = build_dictionary(link_targets(notes(given), cfg), Config(link_max_per_note=0), notes(given))
    assert everyone.titles.filter("key = 'todo it'").select(F.size("entries")).first()[0] >= 61


def test_minimum_length_of_given_targets(spark, notes):
    given = notes({"me.md": "ab and abcd"})
    found = suggest_links(given, Config(), targets_of(spark, [("ab", "x/ab.md"), ("abcd", "y/abcd.md")]))
    assert [r["target"] for r in found.collect()] == ["abcd"]


def test_options(notes):
    given = notes(
        {
            "Topic.md": "---\ntags: [keep]\n---\nOther",
            "Other.md": "---\nabout: Topic\n---\nTopic and Topic",
            "linked.md": "see [[a/Topic#part|it]] and Topic",
        }
    )

    def places(**options):
        found = suggest_links(given, Config(**options)).collect()
        return sorted((r["path"], r["target"], r["line"]) for r in found)

    usual = [("Other.md", "Topic", 2), ("Topic.md", "Other", 4), ("linked.md", "Topic", 1)]
    assert places() == usual
    assert places(skip_already_linked=True) == usual[:2]
    assert places(protect_frontmatter=True) == [("Other.md", "Topic", 4), *usual[1:]]
    assert places(respect_protection=True) == [usual[0], usual[2]]


def test_accepted_paths_are_normalised(spark, notes):
    given = notes({"a/one.md": "Topic", "Topic.md": "", "two.md": "Topic"})
    accepted = spark.createDataFrame([("/a//one.md", "Topic")], "path string, target string")
    changed = apply_links(given, Config(), accepted).collect()
    assert [(r["path"], r["content"]) for r in changed] == [("a/one.md", "[[Topic]]")]


def test_own_name_column(spark):
    assert spark.createDataFrame([("a/b.md",)], "p string").select(base_name(F.col("p"))).first()[0] == "b"


def test_insert_shuffles_the_text_once(spark, notes, tmp_path):
    notes({"a/Topic.md": "x", "b.md": "Topic", "c.md": "none"}).write.parquet(str(tmp_path / "n"))
    stored = spark.read.parquet(str(tmp_path / "n"))
    whole = find_edges.insert(stored, Config()).notes
    assert {r["path"]: r["content"] for r in whole.collect()} == {"a/Topic.md": "x", "b.md": "[[Topic]]", "c.md": "none"}
    final = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shuffles = [line for line in final.splitlines() if "Exchange hashpartitioning(path" in line and "Reused" not in line]
    assert len(shuffles) == 1


def test_entries_are_not_carried_by_mentions(spark, notes):
    """Grouping by note comes before titles' entries, in place or by one shuffle of narrow rows."""
    given = notes({"a.md": "Topic and Topic and Other", "Topic.md": "x", "Other.md": "topic"}).repartition("path")
    for limit in (64 << 20, 0):
        cfg = Config(broadcast_limit_bytes=limit)
        dictionary = build_dictionary(link_targets(given, cfg), cfg, given)
        found = titles_in_notes(given, dictionary, cfg)
        assert sorted((r["path"], r["width"], r["starts"]) for r in found.collect()) == [
            ("Other.md", 5, [0]), ("a.md", 5, [0, 10]), ("a.md", 5, [20]),
        ]
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        lines = plan.splitlines()
        grouped = max(i for i, line in enumerate(lines) if "ObjectHashAggregate" in line or "SortAggregate" in line)
        joined = min(i for i, line in enumerate(lines) if "Join" in line and "Inner" in line)
        assert joined < grouped  # the join with entries stands above the grouping
        assert not any("Exchange" in line and "entries" in line for line in lines)


def test_filter_of_whole_titles(spark, notes, monkeypatch):
    """Above the broadcast limit few texts that are no title go to the shuffle, and every title does."""
    rng = random.Random(11)
    names = [f"Alpha {rng.randrange(10**6):x} {rng.choice('abc')}" for _ in range(3000)]
    given = {f"{n}.md": "" for n in names}
    given["me.md"] = " ".join(rng.choice(names) if i % 4 == 0 else f"Alpha {i:x} b" for i in range(4000))
    cfg = Config(broadcast_limit_bytes=0)
    notes = notes(given)
    dictionary = build_dictionary(link_targets(notes, cfg), cfg, notes)
    sized = title_sized_texts(notes, dictionary, cfg)
    found = find_mentions(notes, dictionary, cfg).count()
    small = Config()
    unfiltered = title_sized_texts(notes, build_dictionary(link_targets(notes, small), small, notes), small)
    assert found == find_mentions(notes, build_dictionary(link_targets(notes, small), small, notes), small).count()
    assert found <= sized.count() < 1.05 * found < unfiltered.count()
    assert dictionary.filter_words() == 4096  # the least, as nothing may be broadcast beyond it
    assert replace(dictionary, count=10**6, cfg=small).filter_words() == 1 << 18
    assert replace(dictionary, count=10**12, cfg=small).filter_words() * 32 <= small.broadcast_limit_bytes
