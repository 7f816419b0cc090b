from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from thicket import Config
from thicket.operators.clutter import (
    clutter_summary,
    flag_clutter,
    in_report_order,
    protected_notes,
)
from thicket.operators.links import orphans
from thicket.operators.metadata import with_metadata
from thicket.plans import declutter, reports

META_ONLY = "---\ntags: [x]\n---\n  \n"
FARM = "```\n" + "\n".join(f"https://e.co/{i}" for i in range(6)) + "\n```"
FIVE_URLS = " ".join(f"https://e.co/{i}" for i in range(5))


def test_long_block_lists(notes):
    """A list of any length is no recursion."""
    tags = "\n".join(f"- t{i}" for i in range(100_000))
    aliases = "\r\n".join(f"  - 'a{i}'" for i in range(100_000))
    found = with_metadata(
        notes(
            {
                "tags.md": f"---\ntags:\n{tags}\n---\nx",
                "aliases.md": f"---\r\naliases:  \r\n{aliases}\r\nother: 1\r\n- no\r\n---\r\nx",
                "short.md": "---\ntags:\n- one\nnot: a\n- list\naliases:\n  b: c\n- d\n---\n",
            }
        )
    ).select("path", F.size("fm_tags").alias("tags"), F.size("aliases").alias("aliases"), "fm_tags")
    rows = {r["path"]: r for r in found.collect()}
    assert rows["tags.md"]["tags"] == 100_000 and rows["tags.md"]["fm_tags"][-1] == "t99999"
    assert rows["aliases.md"]["aliases"] == 100_000
    assert rows["short.md"]["fm_tags"] == ["one"] and rows["short.md"]["aliases"] == 0


def reasons(frame):
    return {row["path"]: row["reasons"] for row in frame.collect()}


def test_rules(spark, notes):
    given = {
        "a/empty.md": META_ONLY,
        "a/zero.md": "",
        "a/nofm.md": "---\n---\n",
        "a/code.md": "`one two three four five six`",
        "a/viagra.md": "viagra",
        "a/accent.md": "éviagra one two three four",
        "a/farm.md": FARM,
        "a/urls.md": FIVE_URLS,
        "a/meta.md": "---\ntitle: viagra\n---\none two three four five",
        "a/fine.md": "one two three four five",
        "a/four.md": "one two three four",
    }
    assert reasons(flag_clutter(notes(given), Config())) == {
        "a/empty.md": ["empty"],
        "a/zero.md": ["empty"],
        "a/nofm.md": ["stub"],
        "a/code.md": ["stub"],
        "a/viagra.md": ["stub", "spam"],
        "a/accent.md": ["spam"],
        "a/farm.md": ["stub", "spam", "link-farm"],
        "a/urls.md": ["spam"],
        "a/four.md": ["stub"],
    }


def test_switches(notes):
    given = notes({"m.md": META_ONLY, "f.md": FARM})
    off = Config(flag_empty=False, flag_spam=False, flag_link_farms=False)
    assert reasons(flag_clutter(given, off)) == {"m.md": ["stub"], "f.md": ["stub"]}
    none = Config(flag_empty=False, stub_min_words=0, flag_spam=False, flag_link_farms=False)
    assert reasons(flag_clutter(given, none)) == {}
    bad = Config(flag_empty=False, flag_stubs=False, spam_patterns=("(", "tags"))
    assert reasons(flag_clutter(given, bad)) == {"f.md": ["link-farm"]}
    in_python = Config(flag_empty=False, flag_stubs=False, spam_patterns=(r"(e|co)+/5",))
    assert reasons(flag_clutter(given, in_python)) == {"f.md": ["spam", "link-farm"]}


def test_protection(notes):
    given = notes(
        {
            "_trash/a.md": "",
            "_trash": "",
            "_trash2/a.md": "",
            "Templates/a.md": "",
            "Templates2/a.md": "",
            "inline.md": "text #Keep",
            "code.md": "`#keep`",
            "list.md": "---\ntags: [keep, x]\n---\n",
            "block.md": "---\ntags:\n  - 'Keep'\n  - y\n---\n",
            "words.md": "---\ntags: a, #keep b\n---\n",
            "nested.md": "---\ntags: keep/x\n---\n",
            "number.md": "---\ntags: 2024\n---\n",
            "singular.md": "---\ntag: keep\n---\n",
        }
    )
    found = {r["path"] for r in protected_notes(given, Config()).collect()}
    assert found == {
        "_trash/a.md", "_trash", "Templates/a.md", "inline.md", "list.md", "block.md", "words.md",
    }
    # The '#' comes off before the trim, so a padded one never matches.
    padded = Config(protect_tags=(" #keep",), ignore_folders=(" Templates// ", ""))
    found = {r["path"] for r in protected_notes(given, padded).collect()}
    assert found == {"_trash/a.md", "_trash", "Templates/a.md"}
    unset = Config(protect_tags=(), ignore_folders=(), trash_folder="/old//bin/")
    assert protected_notes(given, unset).count() == 0


def test_supplied_metadata_wins(spark):
    given = spark.createDataFrame(
        [("a.md", "---\ntags: [x]\n---\n", ["Keep"])],
        "path string, content string, fm_tags array<string>",
    )
    assert protected_notes(given, Config()).count() == 1


@pytest.mark.parametrize(
    ("meta", "aliases"),
    [
        ("aliases: [One, 'Two, too', \"Three\"]", ["One", "Two, too", "Three"]),
        ("aliases:\n- One\n- Two words", ["One", "Two words"]),
        ("aliases: One, Two", ["One, Two"]),
        ("aliases: 2024", []),
        ("aliases: [2024]", ["2024"]),
        ("alias: One", []),
        ("title: x", []),
        ("aliases:", []),
    ],
)
def test_aliases(notes, meta, aliases):
    for newline in ("\n", "\r\n"):
        content = f"---\n{meta}\n---\nbody".replace("\n", newline)
        row = with_metadata(notes({"a.md": content})).first()
        assert row["aliases"] == aliases


def test_orphans_in_scan(spark, notes):
    given = notes({p: "one two three four five" for p in ("self.md", "out.md", "in.md", "no.md")})
    edges = spark.createDataFrame(
        [("self.md", "self.md"), ("out.md", "pic.png"), ("_trash/t.md", "in.md")],
        "src string, dst string",
    )
    cfg = Config(flag_orphans=True)
    assert reasons(flag_clutter(given, cfg, edges)) == {"no.md": ["orphan"]}
    assert [r["path"] for r in orphans(given.select("path"), edges).collect()] == ["no.md"]
    with pytest.raises(ValueError):
        flag_clutter(given, cfg)


def test_report_order_and_texts(notes):
    given = notes({f"{n}.md": "" for n in ("B", "a", "A", "_x", "é", "b")} | {"f.md": FARM})
    scanned = declutter.scan(given, Config())
    assert [r["path"][0] for r in scanned.collect()] == ["_", "a", "A", "b", "B", "é", "f"]
    report = {r["title"]: (r["detail"], r["checked"]) for r in reports.clutter_report(scanned).collect()}
    assert report["a.md"] == ("empty · 0 word(s)", True)
    assert report["f.md"] == ("stub, spam, link farm · 0 word(s)", True)
    assert reports.item_count(scanned).first()["items"] == 7
    totals = {r["reason"]: r["notes"] for r in clutter_summary(scanned).collect()}
    assert totals == {"empty": 6, "stub": 1, "spam": 1, "link-farm": 1}
    assert in_report_order(scanned).count() == 7


def test_text_is_measured_once_and_not_shuffled(spark, notes):
    """No filter is pushed below the measures, and the orphan join moves no text."""
    edges = spark.createDataFrame([("x", "y")], "src string, dst string")
    flagged = flag_clutter(notes({"a.md": ""}), Config(flag_orphans=True), edges)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("viagra") <= 2  # once in the plan, once in its initial copy
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert shuffles and not any("content" in line for line in shuffles)


def test_config_rules():
    stored = {"trashFolder": "  ", "stubMinWords": 3, "spamPatterns": ["x"], "other": 1}
    cfg = Config.from_settings(stored)
    assert (cfg.trash_folder, cfg.stub_min_words, cfg.spam_patterns) == ("_trash", 3, ("x",))
    assert cfg.protect_tags == ("keep",)
    assert Config(spam_patterns=" a \n\n b").spam_patterns == ("a", "b")
    assert Config.from_settings(None) == Config()
    for wrong in ({"link_min_title_length": 0}, {"stub_min_words": -1}, {"link_farm_min_urls": 0}):
        with pytest.raises(ValueError):
            Config(**wrong)


def test_flags_are_exclusive(notes):
    rows = flag_clutter(notes({"a.md": "", "b.md": "x", "c.md": FARM}), Config())
    assert rows.filter(
        F.array_contains("reasons", "empty") & F.array_contains("reasons", "stub")
    ).count() == 0
