from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from thicket.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(repeated),
    )


def brute_force(rows):
    """All the rules, with true documents counted for each line."""
    out = []
    for (doc_id, text, _), lost in zip(rows, lost_words(rows)):
        counts = naive_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        out.append((doc_id, *counts, failed, lost, not failed and counts[0] - lost >= 0.3 * counts[0]))
    return sorted(out, key=str)


def corpus():
    random.seed(6)
    line = lambda n: " ".join(f"w{random.randrange(5000)}" for _ in range(n))
    footer, licence = line(30), line(20)
    rows = []
    for i in range(60):
        body = [line(random.choice((3, 40, 60))) for _ in range(random.randrange(1, 4))]
        rows.append((i, "\n".join([*body, licence, footer.upper() if i % 2 else f"  {footer} "]), "a" if i % 3 else None))
    rows += [(100 + i, f"{licence}\n{footer}\n{line(8)}", "a") for i in range(10)]  # little else
    page = "\n".join(line(30) for _ in range(4))
    rows += [(200 + i, page, "a") for i in range(40)]  # copies are no boilerplate
    rows += [(300 + i, f"{page}\n{line(5)}", "a") for i in range(40)]  # neither are near copies
    rows += [(400, "x y z " * 40, "a"), (401, f"{licence} <#> | \x85 \xa0", "b")]
    return rows


def rows_of(frame):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return sorted((tuple(r[n] for n in [*names, "n_removed_words", "kept"]) for r in frame.collect()), key=str)


def test_matches_brute_force(make_docs):
    rows = corpus()
    found = rows_of(quality.line_quality(make_docs(rows, 4)))
    assert found == brute_force(rows)
    kept = {r[0] for r in found if r[-1]}
    assert {*range(200, 240), *range(300, 340)} <= kept  # copies stay
    assert not kept & {*range(100, 110), 400}


def test_odd_rows(make_docs, odd_rows):
    assert rows_of(quality.line_quality(make_docs(odd_rows))) == brute_force(odd_rows)
    assert quality.line_quality(make_docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_counts(seed):
    random.seed(seed)
    for _ in range(300):
        text = "".join(random.choice("aab  \n\n\t\x0b\x1c\x85#|é") for _ in range(random.randrange(60)))
        assert quality.counts(text)[:5] == naive_counts(text)


def test_kept_documents_lose_their_boilerplate(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    good = quality.good_documents(docs)
    found = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.columns == docs.columns and set(found) == {r[0] for r in brute_force(rows) if r[-1]}
    texts, removed = {i: t for i, t, _ in rows}, dict(zip((r[0] for r in rows), lost_words(rows)))
    for i, text in found.items():
        assert len(WORD.findall(texts[i])) - len(WORD.findall(text)) == removed[i]
        assert text == texts[i] or removed[i]
    assert any(removed[i] for i in found) and good.filter("n_chars IS NULL AND kept IS NULL").count() == len(found)


def test_verdict_does_not_depend_on_the_size_of_the_host(make_docs):
    """The same documents around one licence line, in a small and in a large host."""
    random.seed(3)
    word = lambda: f"w{random.randrange(10**9)}"
    licence = " ".join(word() for _ in range(80))
    around = [(i, licence + "\n" + " ".join(word() for _ in range(14)), "h") for i in range(12)]
    verdicts = []
    for size in (20, 4000):
        others = [(1000 + i, " ".join(word() for _ in range(60)), "h") for i in range(size)]
        found = quality.line_quality(make_docs([*around, *others])).filter("doc_id < 1000").collect()
        verdicts.append(sorted((r["doc_id"], r["n_removed_words"], r["kept"]) for r in found))
    assert verdicts[0] == verdicts[1] == [(i, 80, False) for i in range(12)]


def test_lines_can_be_cut(make_docs):
    rows = corpus()
    cut = quality.without_boilerplate(make_docs([*rows, (900, None, "a"), (901, "", "a")]))
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    footer = rows[0][1].split("\n")[-1].strip().lower()
    assert all(footer not in texts[i].lower() for i, _, host in rows[:60] if host == "a")
    assert texts[900] is None and texts[901] == "" and texts[200] == dict((r[0], r[1]) for r in rows)[200]


def lost_words(rows):
    """Removed words of each row: documents are counted one by one, near copies found by comparing line sets."""
    lines_of = []
    for _, text, _ in rows:
        lines_of.append([(len(WORD.findall(x)), x.strip().lower()) for x in (text or "").split("\n") if WORD.search(x)])
    documents = {(host, tuple(x for _, x in lines)): dict((x, n) for n, x in lines) for (*_, host), lines in zip(rows, lines_of)}
    times = Counter((host, x) for host, lines in documents for x in set(lines))
    frequent = {k for k, n in times.items() if n > quality.LINE_DOCS}
    counted, groups = Counter(), []
    for (host, _), sizes in documents.items():
        part = {x: n for x, n in sizes.items() if (host, x) in frequent}
        total = sum(part.values())
        near = None
        if total and 8 * (sum(sizes.values()) - total) <= total:
            for other in (g for h, g in groups if h == host):
                both = sum(n for x, n in part.items() if x in other)
                if 100 * both >= 80 * (total + sum(other.values()) - both):
                    near = other
            if near is None:
                groups.append((host, part))
        if near is None:
            counted.update((host, x) for x in part)
    bad = {k for k, n in counted.items() if n > quality.LINE_DOCS}
    return [sum(n for n, x in lines if (host, x) in bad) for (_, _, host), lines in zip(rows, lines_of)]


def test_documents_around_one_longest_line_count_each(make_docs):
    random.seed(7)
    line = lambda n: " ".join(f"w{random.randrange(5000)}" for _ in range(n))
    licence, template = line(60), [line(20) for _ in range(3)]
    page, other = [line(12) for _ in range(25)], [line(12) for _ in range(12)]
    rows = [(i, f"{licence}\n{line(10)}", "a") for i in range(60)]  # the licence is the longest line of all
    rows += [(100 + i, "\n".join([*template, line(10)]), "b") for i in range(60)]  # several lines in all
    for i in range(60):  # near copies, each with a line of its own in another place
        rows.append((200 + i, "\n".join([*page[: i % 25], line(12), *page[i % 25 + 1 :]]), "c"))
    rows += [(300 + i, "\n".join([licence, *other, line(8)]), "a") for i in range(40)]  # around the same licence
    rows += [(400 + i, f"{licence}\n{line(3)}", "a") for i in range(5)]
    random.shuffle(rows)
    found = {r["doc_id"]: r for r in quality.line_quality(make_docs(rows, 4)).collect()}
    assert {i: r["n_removed_words"] for i, r in found.items()} == dict(zip((r[0] for r in rows), lost_words(rows)))
    assert {i for i, r in found.items() if r["kept"]} == {*range(200, 260), *range(300, 340)}
    left = {r["doc_id"]: r["text"] for r in quality.without_boilerplate(make_docs(rows, 4)).collect()}
    assert all(len(left[i].split()) == 10 for i in [*range(60), *range(100, 160)])
