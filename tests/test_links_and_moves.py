from __future__ import annotations

from pyspark.sql import functions as F

from thicket import Config
from thicket.operators.links import resolve_links, unresolved_links
from thicket.operators.moves import (
    TAKEN,
    apply_moves,
    plan_trash_moves,
    rewrite_inbound_links,
)
from thicket.operators.ranking import rank_in_group
from thicket.plans import declutter, reports

NOW = 1000


def edges(frame):
    return {(r["src"], r["dst"]): r["n"] for r in frame.collect()}


def test_resolve(notes, spark):
    given = notes(
        {
            "a/one.md": "[[two]] [[two#h|x]] ![[pic.png]] `[[three]]` [[gone]] [[#top]]",
            "a/two.md": "[[b/three]] [[sub/four]] [[b/three.md]]",
            "b/two.md": "[[one]]\n```\n[[two]]\n```",
            "b/three.md": "---\nlink: '[[one]]'\n---\n[[three]] [[two]]",
            "a/sub/four.md": "[[ two ]]",
            "two.md": "",
        }
    )
    files = given.select("path").union(spark.createDataFrame([("x/pic.png",)], "path string"))
    assert edges(resolve_links(given, files)) == {
        # An exact path wins, here a file in the root; then the same folder.
        ("a/one.md", "two.md"): 2,
        ("a/one.md", "x/pic.png"): 1,
        ("a/two.md", "b/three.md"): 2,
        ("a/two.md", "a/sub/four.md"): 1,
        ("b/two.md", "a/one.md"): 1,
        ("b/three.md", "b/three.md"): 1,
        ("b/three.md", "two.md"): 1,
        ("a/sub/four.md", "two.md"): 1,
    }
    lost = {(r["src"], r["target"]) for r in unresolved_links(given, files).collect()}
    assert lost == {("a/one.md", "gone")}


def test_ties(notes):
    given = notes(
        {"m/x.md": "", "bb/x.md": "", "aa/x.md": "", "m/n/src.md": "[[x]]", "m/src.md": "[[x]]"}
    )
    found = edges(resolve_links(given))
    assert found == {("m/n/src.md", "m/x.md"): 1, ("m/src.md", "m/x.md"): 1}
    without = given.filter("path <> 'm/x.md'")
    assert set(edges(resolve_links(without))) == {("m/n/src.md", "aa/x.md"), ("m/src.md", "aa/x.md")}


def test_a_popular_name_multiplies_nothing(notes):
    """Many files of one name and many links to it: one edge per link."""
    given = notes({f"d{i}/README.md": "[[README]] [[d1/README]]" for i in range(200)})
    found = resolve_links(given)
    assert found.agg(F.sum("n")).first()[0] == 400
    assert found.count() == 399  # in d1 both texts are the same link


def planned(spark, selected, existing, cfg=Config()):
    moves = plan_trash_moves(
        spark.createDataFrame([(p,) for p in selected], "path string"),
        spark.createDataFrame([(p,) for p in selected + existing], "path string"),
        cfg,
        NOW,
    )
    return moves, {r["path"]: r["new_path"] or r["error"] for r in moves.collect()}


def test_trash_moves(spark):
    assert planned(spark, ["a/x.md"], [])[1] == {"a/x.md": "_trash/x.md"}
    assert planned(spark, ["a/x.md"], ["_trash/x.md"])[1] == {"a/x.md": "_trash/x-1000.md"}
    three = planned(spark, ["c/x.md", "b/x.md", "a/x.md"], [])[1]
    assert three == {
        "a/x.md": "_trash/x.md", "b/x.md": "_trash/x-1000.md", "c/x.md": "_trash/x-1001.md",
    }
    assert planned(spark, ["a/x.md"], [], Config(trash_folder="/o//t/"))[1] == {"a/x.md": "o/t/x.md"}


def test_failed_moves_are_reported(spark):
    moves, paths = planned(
        spark, ["a/x.md", "b/y.md", "c/y-1000.md", "d/y.md"], ["_trash/x.md", "_trash/x-1000.md"]
    )
    assert paths == {
        "a/x.md": "a/x.md: " + TAKEN,
        "b/y.md": "_trash/y.md",
        "c/y-1000.md": "_trash/y-1000.md",
        "d/y.md": "d/y.md: " + TAKEN,
    }
    assert reports.move_summary(moves).first().asDict() == {"moved": 2, "failed": 2}
    assert reports.move_errors(moves).count() == 2


def test_nothing_selected(spark):
    moves, paths = planned(spark, [], ["a.md"])
    assert paths == {}
    assert reports.move_summary(moves).first().asDict() == {"moved": 0, "failed": 0}


def test_rank_spreads_one_group_over_partitions(spark):
    rows = spark.range(5000).select(
        F.lit("same").alias("name"), F.format_string("p%05d", F.col("id")).alias("path")
    )
    ranked = rank_in_group(rows.repartition(3), "name", [F.col("path")], "place")
    wrong = ranked.filter(F.col("place") != F.substring("path", 2, 5).cast("int") + 1)
    assert ranked.count() == 5000 and wrong.count() == 0


def test_inbound_links_follow_the_move(notes, spark):
    given = notes(
        {
            "a/x.md": "[[y]]",
            "b/x.md": "self [[x]]",
            "a/y.md": "",
            "s/by_name.md": "[[x]] ![[x#h]] `[[x]]` [[x|shown]]",
            "s/by_path.md": "---\nk: v\n---\nsee [[a/x|A]], [[b/x.md]] and [[y]]",
            "s/other.md": "[[y]]",
        }
    )
    selected = spark.createDataFrame([("a/x.md",), ("b/x.md",)], "path string")
    moves = plan_trash_moves(selected, given.select("path"), Config(), NOW)
    changed = {r["path"]: (r["content"], r["n_applied"]) for r in rewrite_inbound_links(given, moves).collect()}
    assert changed == {
        # [[x]] still reaches a/x.md, which is now _trash/x.md.
        "b/x.md": ("self [[_trash/x-1000]]", 1),
        "s/by_path.md": (
            "---\nk: v\n---\nsee [[_trash/x|A]], [[_trash/x-1000]] and [[y]]", 2,
        ),
    }
    before = {(r["src"], r["dst"]) for r in resolve_links(given).collect()}
    result = declutter.trash(given, selected, Config(), NOW)
    new = {r["path"]: r["new_path"] for r in result.moves.collect()}
    after = {(r["src"], r["dst"]) for r in resolve_links(result.notes).collect()}
    assert after == {(new.get(s, s), new.get(d, d)) for s, d in before}


def test_only_accepted_notes_move(notes, spark):
    given = notes({"a.md": "", "b.md": "", "c.md": "one two three four five"})
    flagged = declutter.scan(given, Config())
    accepted = spark.createDataFrame([("b.md",), ("c.md",)], "path string")
    result = declutter.trash(given, flagged, Config(), NOW, accepted)
    assert {r["path"] for r in result.notes.collect()} == {"a.md", "_trash/b.md", "c.md"}
    assert apply_moves(given, result.moves).count() == 3
