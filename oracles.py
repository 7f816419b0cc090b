"""DuckDB SQL for every registered query, over whole tables and whole texts.

Each query is written from the definitions, not from the Spark plans: mentions
come from word-unit windows, links are chosen by a recursive query that takes
one candidate per note and step.
"""

from __future__ import annotations

SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
FENCE = "```"
FARM = r"\n".join(f"https://ex.com/{i}" for i in range(1, 7))
NOW_MS = 1_700_000_000_000
# Stored settings of a user: among the patterns one is blank and two are invalid.
SETTINGS = {
    "stubMinWords": 40,
    "flagEmpty": False,
    "flagLinkFarms": False,
    "spamPatterns": " \\bthe\\s+of\\b \n\n  \n(the\n[z-a]\n^Thin\\b",
    "protectTags": "#X\n",
    "ignoreFolders": ["Templates/", " src3// "],
    "trashFolder": "/_trash/",
    "notASetting": 1,
}

# The notes: see thicket/sources/documents.py.
NOTES = rf"""
titled AS (
  SELECT doc_id AS d, text, source,
         coalesce(nullif(regexp_extract(text, '^[\p{{L}}\p{{N}}]+ [\p{{L}}\p{{N}}]+'), ''),
                  'note' || doc_id) AS title
  FROM documents),
notes AS (
  SELECT CASE WHEN a.d % 23 = 0 THEN '_trash' WHEN a.d % 29 = 0 THEN 'Templates'
              ELSE a.source END || '/' || a.d || '/' || a.title || '.md' AS path,
         CASE WHEN a.d % 11 = 0 THEN E'---\ntags: [x]\n---\n  \n'
              WHEN a.d % 13 = 0 THEN a.text || ' Free Money now'
              WHEN a.d % 17 = 0 THEN E'{FENCE}\n{FARM}\n{FENCE}'
              WHEN a.d % 38 = 19 THEN E'---\ntags:\n- keep\n- x\n---\n' || a.text
              WHEN a.d % 19 = 0 THEN E'---\ntags: [keep, x]\n---\n' || a.text
              WHEN a.d % 14 = 7 THEN E'---\naliases: ' || a.title || E' alt\n---\n' || a.text
              WHEN a.d % 7 = 0 THEN E'---\naliases: [' || a.title || E' alt]\n---\n' || a.text
              WHEN a.d % 5 = 0 THEN a.text || E'\nSee [[' || coalesce(b.title, 'missing') || ']] and [['
                                     || coalesce(b.title, 'missing') || ']], not [[nowhere ' || a.d || ']]'
              WHEN a.d % 3 = 0 THEN a.text || ' `https://ex.com/a` and https://ex.com/b [text](https://ex.com/c) #Topic/x'
              ELSE a.text END AS content
  FROM titled a LEFT JOIN titled b ON b.d = a.d + 1)"""

BODIES = rf"""
stripped AS (
  SELECT path, content,
         regexp_replace(content, '\A---\r?\n[\s\S]*?\r?\n---\r?\n?', '') AS text,
         regexp_extract(content, '\A---\r?\n[\s\S]*?\r?\n---\r?\n?') AS meta
  FROM notes),
bodies AS (
  SELECT path, regexp_replace(text, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g') AS body
  FROM stripped)"""

MEASURES = rf"""
cleaned AS (
  SELECT path, body,
         regexp_replace(regexp_replace(regexp_replace(
           body, '{FENCE}[\s\S]*?{FENCE}', ' ', 'g'), '`[^`]*`', ' ', 'g'),
           '[#>*_\-\[\]()!|]', ' ', 'g') AS prose
  FROM bodies),
measures AS (
  SELECT path, body,
         len(regexp_extract_all(prose, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''-]*'))::BIGINT AS words,
         len(regexp_extract_all(body, '(?i)https?://[^{SPACE}]+'))::BIGINT AS urls
  FROM cleaned)"""

META = rf"""
tag_lists AS (
  SELECT path,
         list_transform(list_filter(
           regexp_extract_all(
             regexp_replace(regexp_replace(text, '{FENCE}[\s\S]*?{FENCE}', ' ', 'g'),
                            '`[^`]*`', ' ', 'g'),
             '(?:\A|[{SPACE}])#([\p{{L}}\p{{N}}_/-]+)', 1),
           lambda t: regexp_matches(t, '[^0-9]')), lambda t: lower(t))
         || coalesce(list_transform(
              string_split(nullif(regexp_extract(meta, '(?m)^tags:[ \t]*\[([^\]]*)\]', 1), ''), ','),
              lambda t: lower(regexp_replace(trim(t), '\A#', ''))), [])
         || list_transform(
              regexp_extract_all(regexp_extract(meta, '(?m)^tags:\n((?:- .*\n)+)', 1), '- (.*)\n', 1),
              lambda t: lower(t)) AS tags,
         coalesce(list_transform(
              string_split(nullif(regexp_extract(meta, '(?m)^aliases:[ \t]*\[([^\]]*)\]', 1), ''), ','),
              lambda a: trim(a)),
              list_filter([regexp_extract(meta, '(?m)^aliases: ([^\[\n]*)$', 1)], lambda a: a <> '')) AS aliases
  FROM stripped),
protected AS (
  SELECT path FROM tag_lists
  WHERE path = '_trash' OR starts_with(path, '_trash/') OR starts_with(path, 'Templates/')
     OR starts_with(path, '.obsidian/') OR coalesce(list_contains(tags, 'keep'), false))"""

CLUTTER = rf"""
flagged AS (
  SELECT path, words, list_filter([
           CASE WHEN body = '' THEN 'empty' WHEN words < 5 THEN 'stub' END,
           CASE WHEN regexp_matches(body,
                  '(?i)\b(viagra|casino|crypto[{SPACE}]*giveaway|free[{SPACE}]*money)\b')
                OR regexp_matches(body, '(?i)(https?://[^{SPACE}]+[{SPACE}]*){{5,}}')
                THEN 'spam' END,
           CASE WHEN urls >= 5 AND urls >= words THEN 'link-farm' END],
         lambda r: r IS NOT NULL) AS reasons
  FROM measures WHERE path NOT IN (SELECT path FROM protected)),
clutter AS (SELECT * FROM flagged WHERE len(reasons) > 0)"""

MENTIONED = rf"""
tokens AS (
  SELECT path AS src, unnest(regexp_extract_all(
           text, '{FENCE}[\s\S]*?{FENCE}|`[^`]*`|!?\[\[[^\]]*?\]\]')) AS token
  FROM stripped),
link_texts AS (
  SELECT src, trim(regexp_extract(token, '\A!?\[\[([^\]|#]*)', 1)) AS target, count(*) AS n
  FROM tokens WHERE regexp_matches(token, '\A!?\[\[[^\]|#]*[^\]|# ]')
  GROUP BY ALL)"""


def resolved(name: str, links: str, files: str) -> str:
    """CTE ``name``: the rows of ``links`` (src, target, ...) with their dst."""
    return rf"""
{name}_at AS (
  SELECT k AS key, arg_min(path, (kind, length(path), path)) AS found FROM (
    SELECT path, 0 AS kind, path AS k FROM {files}
    UNION ALL SELECT path, 1, regexp_replace(path, '\.md\z', '') FROM {files})
  GROUP BY k),
{name}_named AS (
  SELECT k AS key, arg_min(path, (kind, length(path), path)) AS found FROM (
    SELECT path, 0 AS kind, regexp_extract(path, '[^/]*\z') AS k FROM {files}
    UNION ALL
    SELECT path, 1, regexp_replace(regexp_extract(path, '[^/]*\z'), '\.md\z', '') FROM {files}
    WHERE path LIKE '%.md')
  GROUP BY k),
{name} AS (
  SELECT l.*, coalesce(a.found, b.found, c.found) AS dst
  FROM {links} l
  LEFT JOIN {name}_at a ON a.key = l.target
  LEFT JOIN {name}_at b ON b.key = regexp_replace(l.src, '[^/]*\z', '') || l.target
  LEFT JOIN {name}_named c ON c.key = l.target AND NOT contains(l.target, '/'))"""


CUSTOM = rf"""
kept_out AS (
  SELECT path FROM tag_lists
  WHERE starts_with(path, '_trash/') OR starts_with(path, 'Templates/') OR starts_with(path, 'src3/')
     OR coalesce(list_contains(tags, 'x'), false)),
custom AS (
  SELECT path, words, list_filter([
           CASE WHEN words < 40 THEN 'stub' END,
           CASE WHEN regexp_matches(body, '(?i)\bthe[{SPACE}]+of\b') OR regexp_matches(body, '(?i)\AThin\b')
                THEN 'spam' END], lambda r: r IS NOT NULL) AS reasons
  FROM measures WHERE path NOT IN (SELECT path FROM kept_out))"""

GRAPH = (
    MENTIONED
    + ","
    + resolved("pointed", "link_texts", "notes")
    + """,
graph AS (SELECT src, dst, sum(n)::BIGINT AS n FROM pointed WHERE dst IS NOT NULL GROUP BY ALL),
lonely AS (
  SELECT path FROM notes
  WHERE NOT EXISTS (SELECT 1 FROM graph WHERE src = path)
    AND NOT EXISTS (SELECT 1 FROM graph WHERE dst = path))"""
)

TARGETS = r"""
targets AS (
  SELECT title AS match, title AS target, path, 0 AS ord, length(title)::INT AS match_len
  FROM (SELECT path, regexp_extract(path, '([^/]*)\.md\z', 1) AS title FROM notes)
  WHERE length(title) >= 4
  UNION ALL
  SELECT alias, regexp_extract(path, '([^/]*)\.md\z', 1), path, ord::INT, length(alias)::INT
  FROM (SELECT path, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS ord
        FROM tag_lists WHERE aliases IS NOT NULL)
  WHERE length(alias) >= 4)"""


def _spans(pattern: str) -> str:
    return rf"""
  SELECT path, string_split_regex(content, '{pattern}') AS gaps,
         regexp_extract_all(content, '{pattern}') AS hits FROM notes"""


RANGES = rf"""
cut AS ({" UNION ALL ".join(_spans(p) for p in (
    FENCE + r"[\s\S]*?" + FENCE,
    "`[^`]*`",
    r"\[\[[^\]]*?\]\]",
    r"!?\[[^\]]*?\]\([^)]*?\)",
    rf"(?i)https?://[^{SPACE}]+"))}),
pieces AS (
  SELECT path, row_number() OVER () AS id, gaps, hits FROM cut WHERE len(hits) > 0),
steps AS (
  SELECT path, id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap,
         generate_subscripts(hits, 1) AS i FROM pieces),
spans AS (
  SELECT path, (sum(length(gap) + length(hit)) OVER (
           PARTITION BY path, id ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS e,
         length(hit) AS w FROM steps),
ranges AS (SELECT path, e - w AS s, e FROM spans)"""

# Every text window of one to three word units, the sizes titles have here.
MENTIONS = r"""
split AS (
  SELECT path, regexp_extract_all(lower(content) || chr(10),
           '[\p{L}\p{N}_]*[^\p{L}\p{N}_]') AS units FROM notes),
unit_rows AS (
  SELECT path, unnest(units) AS u, generate_subscripts(units, 1) AS i FROM split),
windows AS (
  SELECT path, u AS g1, u || lead(u) OVER w AS g2,
         u || lead(u) OVER w || lead(u, 2) OVER w AS g3,
         (sum(length(u)) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING)
           - length(u))::BIGINT AS start
  FROM unit_rows WINDOW w AS (PARTITION BY path ORDER BY i)),
grams AS (
  SELECT path, start, left(g1, length(g1) - 1) AS key FROM windows
  UNION ALL SELECT path, start, left(g2, length(g2) - 1) FROM windows WHERE g2 IS NOT NULL
  UNION ALL SELECT path, start, left(g3, length(g3) - 1) FROM windows WHERE g3 IS NOT NULL),
mentions AS (
  SELECT g.path, g.key, g.start FROM grams g
  WHERE g.key IN (SELECT lower(match) FROM targets))"""


# Every place of a title in a text, whatever stands around it: between the pieces that it cuts.
SUBSTRINGS = r"""
keys AS (SELECT DISTINCT lower(match) AS key FROM targets),
parted AS (
  SELECT path, key, string_split(lower(content), key) AS parts
  FROM notes JOIN keys ON contains(lower(content), key)),
parts AS (SELECT path, key, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM parted),
mentions AS (
  SELECT path, key, (sum(length(part)) OVER w + (i - 1) * length(key))::BIGINT AS start FROM parts
  WINDOW w AS (PARTITION BY path, key ORDER BY i ROWS UNBOUNDED PRECEDING)
  QUALIFY i < n)"""


def planned(cap: int) -> str:
    """CTEs up to ``edits`` (path, s, e, target): the links to write."""
    below_cap = f"len(r.edits) < {cap} AND" if cap else ""
    return rf"""
title_places AS (
  SELECT path, key, length(key) AS width, list_reduce(
           list_transform(list(start ORDER BY start), lambda s: [s]),
           lambda kept, s: CASE WHEN s[1] >= kept[len(kept)] + length(key)
                           THEN list_concat(kept, s) ELSE kept END) AS starts
  FROM mentions GROUP BY path, key),
range_lists AS (SELECT path, list({{'s': s, 'e': e}}) AS kept FROM ranges GROUP BY path),
free AS (
  SELECT p.path, p.key, p.width, list_filter(p.starts, lambda s: len(list_filter(
           coalesce(k.kept, []), lambda r: s < r.e AND s + p.width > r.s)) = 0) AS places
  FROM title_places p LEFT JOIN range_lists k USING (path)),
choices AS (
  SELECT f.path, f.width, f.places, t.target, regexp_extract(f.path, '([^/]*)\.md\z', 1) AS own,
         row_number() OVER (PARTITION BY f.path ORDER BY t.match_len DESC, t.path, t.ord) AS k
  FROM free f JOIN (
    SELECT lower(match) AS key, target, match_len, path, ord FROM targets
    QUALIFY row_number() OVER (PARTITION BY lower(match), target ORDER BY path, ord) = 1
  ) t ON t.key = f.key),
walk AS (
  SELECT DISTINCT path, 0::BIGINT AS k,
         CAST([] AS STRUCT(s BIGINT, e BIGINT, target VARCHAR)[]) AS edits
  FROM choices
  UNION ALL
  SELECT path, k, CASE WHEN hit IS NULL THEN edits ELSE list_append(edits,
           {{'s': hit, 'e': hit + width, 'target': target}}) END
  FROM (
    SELECT r.path, c.k, r.edits, c.width, c.target,
           CASE WHEN {below_cap} c.target <> c.own
                 AND len(list_filter(r.edits, lambda e: e.target = c.target)) = 0
           THEN list_filter(c.places, lambda p: len(list_filter(
             r.edits, lambda e: p < e.e AND p + c.width > e.s)) = 0)[1] END AS hit
    FROM walk r JOIN choices c ON c.path = r.path AND c.k = r.k + 1)),
edits AS (
  SELECT path, unnest(edits, recursive := true) FROM (
    SELECT path, arg_max(edits, k) AS edits FROM walk GROUP BY path)),
suggestions AS (
  SELECT n.path, e.target, matched AS matched_text, e.s AS start, e.e AS "end",
         (1 + length(before) - length(replace(before, chr(10), '')))::BIGINT AS line,
         regexp_replace(
           CASE WHEN length(line_left) > 40 THEN '…' || right(line_left, 40) ELSE line_left END
           || '**' || matched || '**' ||
           CASE WHEN length(line_right) > 40 THEN left(line_right, 40) || '…' ELSE line_right END,
           '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g') AS context,
         CASE WHEN matched = e.target THEN '[[' || e.target || ']]'
              ELSE '[[' || e.target || '|' || matched || ']]' END AS replacement
  FROM edits e JOIN notes n USING (path),
  LATERAL (SELECT left(n.content, e.s) AS before,
                  substr(n.content, e.s + 1, e.e - e.s) AS matched) x,
  LATERAL (SELECT regexp_extract(x.before, '[^\n]*\z') AS line_left,
                  regexp_extract(substr(n.content, e.e + 1), '\A[^\n]*') AS line_right) y)"""


WRITTEN = r"""
placed AS (
  SELECT path, start, "end", replacement,
         coalesce(lag("end") OVER (PARTITION BY path ORDER BY start), 0) AS prev
  FROM chosen),
written AS (
  SELECT p.path, string_agg(substr(n.content, p.prev + 1, p.start - p.prev) || p.replacement,
                            '' ORDER BY p.start)
           || substr(any_value(n.content), max(p."end") + 1) AS content,
         count(*)::BIGINT AS n_applied
  FROM placed p JOIN notes n USING (path) GROUP BY p.path)"""

MOVES = rf"""
ranked AS (
  SELECT path, regexp_extract(path, '[^/]*\z') AS name,
         row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*\z')
                            ORDER BY icu_sort_key(path, 'root'), path) AS place
  FROM clutter),
stamped AS (
  SELECT path, '_trash/' || name AS plain,
         place - CASE WHEN '_trash/' || name IN (SELECT path FROM notes) THEN 1 ELSE 2 END AS stamp,
         regexp_replace(name, '\.md\z', '') AS base
  FROM ranked),
wanted AS (
  SELECT path, stamp >= 0 AS is_stamped, CASE WHEN stamp < 0 THEN plain
           ELSE '_trash/' || base || '-' || ({NOW_MS} + stamp) || '.md' END AS new_path
  FROM stamped),
moves AS (
  SELECT path, CASE WHEN fails THEN NULL ELSE new_path END AS new_path,
         CASE WHEN fails THEN 'error' ELSE 'moved' END AS status,
         CASE WHEN fails THEN path || ': Destination file already exists!' END AS error
  FROM (SELECT *, is_stamped AND (new_path IN (SELECT path FROM notes) OR new_path IN
          (SELECT new_path FROM wanted WHERE NOT is_stamped)) AS fails FROM wanted)),
done AS (SELECT path, new_path FROM moves WHERE status = 'moved')"""

RELINKED = (
    """
expected AS (
  SELECT p.src AS old_src, p.target, coalesce(s.new_path, p.src) AS src,
         coalesce(t.new_path, p.dst) AS new_dst
  FROM pointed p LEFT JOIN done s ON s.path = p.src LEFT JOIN done t ON t.path = p.dst
  WHERE p.dst IS NOT NULL),
files_after AS (
  SELECT coalesce(d.new_path, n.path) AS path FROM notes n LEFT JOIN done d ON d.path = n.path),"""
    + resolved("repointed", "expected", "files_after")
    + r""",
renames AS (
  SELECT old_src AS path, target, regexp_replace(new_dst, '\.md\z', '') AS new_target
  FROM repointed WHERE dst IS DISTINCT FROM new_dst),
relinked AS (
  SELECT n.path, sum((length(n.content) - length(replace(n.content, '[[' || r.target || ']]', '')))
                     // (length(r.target) + 4))::BIGINT AS n_applied,
         replace(n.content, '[[' || any_value(r.target) || ']]',
                 '[[' || any_value(r.new_target) || ']]') AS content
  FROM notes n JOIN renames r USING (path) GROUP BY n.path, n.content)"""
)


def _query(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}\n{select}"


def oracle_sql() -> dict[str, str]:
    measured = (NOTES, BODIES, MEASURES)
    clutter = (*measured, META, CLUTTER)
    graph = (NOTES, BODIES, GRAPH)
    mentions = (NOTES, BODIES, META, TARGETS, MENTIONS)
    edges = (*mentions, RANGES, planned(20))
    moves = (*clutter, MOVES)
    files_taken = rf"""
taken_files AS (
  SELECT path FROM notes
  UNION ALL SELECT '_trash/' || regexp_replace(regexp_extract(path, '[^/]*\z'), '\.md\z', '') || '-{NOW_MS}.md'
  FROM notes WHERE split_part(path, '/', 2)::BIGINT % 2 = 0)"""
    taken = (*clutter, files_taken, MOVES.replace("FROM notes", "FROM taken_files"))
    reviewed = "chosen AS (SELECT * FROM suggestions WHERE line = 1 AND split_part(path, '/', 2)::BIGINT % 3 <> 2)"
    report = r"""SELECT path AS title, replace(array_to_string(reasons, ', '), 'link-farm', 'link farm')
        || ' · ' || words || ' word(s)' AS detail, true AS checked FROM clutter"""
    with_orphans = r"""SELECT path, array_to_string(list_filter([
          list_filter(reasons, lambda r: r IN ('empty', 'stub'))[1],
          CASE WHEN path IN (SELECT path FROM lonely) THEN 'orphan' END,
          list_filter(reasons, lambda r: r = 'spam')[1],
          list_filter(reasons, lambda r: r = 'link-farm')[1]],
          lambda r: r IS NOT NULL), ',') AS reasons, words
        FROM flagged WHERE len(reasons) > 0 OR path IN (SELECT path FROM lonely)"""
    suggestion = """SELECT path, target, matched_text, line, context, start, "end", replacement
        FROM suggestions"""
    first_lines = "chosen AS (SELECT * FROM suggestions WHERE line = 1)"
    every_one = "chosen AS (SELECT * FROM suggestions)"
    written = "SELECT path, md5(content) AS content_md5, n_applied FROM written"
    return {
        "note_bodies": _query(
            "SELECT path, md5(body) AS body_md5, length(body)::BIGINT AS chars FROM bodies",
            NOTES, BODIES),
        "word_url_counts": _query("SELECT path, words, urls FROM measures", *measured),
        "note_tags": _query(
            "SELECT DISTINCT path, unnest(tags) AS tag FROM tag_lists", NOTES, BODIES, META),
        "protected_notes": _query("SELECT path FROM protected", NOTES, BODIES, META),
        "clutter_flags": _query(
            "SELECT path, array_to_string(reasons, ',') AS reasons, words FROM clutter", *clutter),
        "clutter_flags_with_orphans": _query(with_orphans, *clutter, GRAPH),
        "clutter_report": _query(report, *clutter),
        "clutter_places": _query(
            "SELECT path, row_number() OVER (ORDER BY icu_sort_key(path, 'root'), path) AS place"
            " FROM clutter", *clutter),
        "clutter_item_count": _query("SELECT count(*) AS items FROM clutter", *clutter),
        "clutter_summary": _query(
            "SELECT reason, count(*) AS notes FROM (SELECT unnest(reasons) AS reason FROM clutter)"
            " GROUP BY reason", *clutter),
        "resolve_links": _query("SELECT src, dst, n FROM graph", *graph),
        "unresolved_links": _query(
            "SELECT src, target, n FROM pointed WHERE dst IS NULL", *graph),
        "linked_targets": _query("SELECT DISTINCT dst AS path FROM graph", *graph),
        "orphans": _query("SELECT path FROM lonely", *graph),
        "link_targets": _query(
            "SELECT match, target, path, ord, match_len FROM targets",
            NOTES, BODIES, META, TARGETS),
        "protected_ranges": _query('SELECT path, s AS start, e AS "end" FROM ranges', NOTES, RANGES),
        "link_mentions": _query("SELECT path, key, start FROM mentions", *mentions),
        "link_targets_titles_only": _query(
            "SELECT match, target, path, ord, match_len FROM targets WHERE ord = 0",
            NOTES, BODIES, META, TARGETS),
        "link_mentions_exact_case": _query(
            "SELECT path, key, start FROM mentions", NOTES, BODIES, META, TARGETS,
            MENTIONS.replace("lower(content)", "content").replace("lower(match)", "match")),
        "suggest_links": _query(suggestion, *edges, recursive=True),
        "suggest_links_uncapped": _query(
            suggestion, *mentions, RANGES, planned(0), recursive=True),
        "suggest_links_substring": _query(
            suggestion, NOTES, BODIES, META, TARGETS, SUBSTRINGS, RANGES, planned(20), recursive=True),
        "clutter_flags_settings": _query(
            """SELECT path, array_to_string(reasons, ',') AS reasons, words FROM custom WHERE len(reasons) > 0""",
            *measured, META, CUSTOM),
        "apply_reviewed_links": _query(written, *edges, reviewed, WRITTEN, recursive=True),
        "linked_version": _query(
            """SELECT path, md5(coalesce(w.content, n.content)) AS content_md5
               FROM notes n LEFT JOIN written w USING (path)""",
            *edges, first_lines, WRITTEN, recursive=True),
        "trash_moves_taken": _query("SELECT path, new_path, status, error FROM moves", *taken),
        "move_errors": _query("SELECT path, error FROM moves WHERE status = 'error'", *taken),
        "move_summary_taken": _query(
            """SELECT count(*) FILTER (status = 'moved') AS moved,
               count(*) FILTER (status = 'error') AS failed FROM moves""", *taken),
        "edge_report": _query(
            """SELECT path || '  →  [[' || target || ']]' AS title,
               'line ' || line || ': ' || context AS detail, true AS checked FROM suggestions""",
            *edges, recursive=True),
        "apply_links": _query(written, *edges, every_one, WRITTEN, recursive=True),
        "apply_accepted_links": _query(written, *edges, first_lines, WRITTEN, recursive=True),
        "apply_summary": _query(
            "SELECT sum(n_applied)::BIGINT AS applied, count(*) AS notes FROM written",
            *edges, every_one, WRITTEN, recursive=True),
        "trash_moves": _query("SELECT path, new_path, status, error FROM moves", *moves),
        "move_summary": _query(
            """SELECT count(*) FILTER (status = 'moved') AS moved,
               count(*) FILTER (status = 'error') AS failed FROM moves""", *moves),
        "rewrite_inbound_links": _query(
            "SELECT path, md5(content) AS content_md5, n_applied FROM relinked",
            *moves, GRAPH, RELINKED),
        "linked_corpus": _query(
            """SELECT path, md5(coalesce(w.content, n.content)) AS content_md5
               FROM notes n LEFT JOIN written w USING (path)""",
            *edges, every_one, WRITTEN, recursive=True),
        "trashed_corpus": _query(
            """SELECT coalesce(d.new_path, n.path) AS path,
                      md5(coalesce(r.content, n.content)) AS content_md5
               FROM notes n LEFT JOIN done d ON d.path = n.path
               LEFT JOIN relinked r ON r.path = n.path""",
            *moves, GRAPH, RELINKED),
    }
