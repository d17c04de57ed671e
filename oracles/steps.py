"""Review steps in DuckDB SQL, by other methods than the Spark operators use.

Lines come first here: diff texts are split into lines once, and sections, hunks
and line numbers are running counts over them. Channels are merged with a full
join and snapshots with anti joins.
"""

from __future__ import annotations

from oracles.build import Steps, text, texts
from patchwell.functions import fixed_values as fv
from patchwell.functions.dialect import re2
from patchwell.sources import derived as d

STEPS = Steps()
NL = "chr(10)"
STEP = 1 << 40
#: threshold of the large-block rule in all registered queries
LARGE = 4


def has(column: str, pattern: str, any_case: bool = False) -> str:
    return f"regexp_matches({column}, {text(re2(pattern, any_case))})"


def group(column: str, pattern: str, i: int, any_case: bool = False) -> str:
    return f"regexp_extract({column}, {text(re2(pattern, any_case))}, {i})"


def trimmed(column: str) -> str:
    return f"trim({column}, {text(fv.WHITE_SPACE)})"


# --- inputs -------------------------------------------------------------------

STEPS.add(
    "docs",
    f"""
SELECT doc_id, source AS repo, text,
  source || '-r' || CAST(doc_id // {d.REVIEW_SIZE} AS VARCHAR) AS review_id,
  source || '/' || {texts(d.DIRECTORIES)}[doc_id % {len(d.DIRECTORIES)} + 1] || '/f'
    || CAST(doc_id AS VARCHAR) || {texts(d.ENDINGS)}[doc_id % {len(d.ENDINGS)} + 1] AS path
FROM documents""",
)
STEPS.add(
    "doc_lines",
    f"""
SELECT doc_id, repo, review_id, path, pos,
  CASE WHEN (doc_id * 7 + pos * 13) % {d.LINE_CYCLE} < {len(d.LINES)}
    THEN {texts(d.LINES)}[(doc_id * 7 + pos * 13) % {d.LINE_CYCLE} + 1] ELSE line END AS line,
  {texts(d.PREFIXES)}[(doc_id + pos) % {len(d.PREFIXES)} + 1] AS mark
FROM (
  SELECT doc_id, repo, review_id, path, unnest(string_split(text, {NL})) AS line,
    CAST(generate_subscripts(string_split(text, {NL}), 1) - 1 AS BIGINT) AS pos
  FROM docs)""",
)
STEPS.add(
    "doc_hunks",
    f"""
SELECT doc_id, pos // {d.HUNK_LINES} AS h,
  '@@ -' || CAST(1 + 10 * (pos // {d.HUNK_LINES}) AS VARCHAR) || ','
    || CAST(count(*) FILTER (mark <> '+') AS VARCHAR)
    || ' +' || CAST(1 + 10 * (pos // {d.HUNK_LINES}) AS VARCHAR) || ','
    || CAST(count(*) FILTER (mark <> '-') AS VARCHAR) || ' @@' || {NL}
    || string_agg(mark || line, {NL} ORDER BY pos) AS hunk
FROM doc_lines GROUP BY doc_id, pos // {d.HUNK_LINES}""",
)
STEPS.add(
    "doc_sections",
    f"""
SELECT doc_id, repo, review_id,
  'diff --git a/' || path || ' b/' || path || {NL}
    || CASE doc_id % 10 WHEN 0 THEN 'new file mode 100644' || {NL}
      WHEN 1 THEN 'deleted file mode 100644' || {NL}
      WHEN 2 THEN 'rename from old/' || path || {NL}
      WHEN 3 THEN 'Binary files differ' || {NL} ELSE '' END
    || '--- a/' || path || {NL}
    || CASE WHEN doc_id % 10 = 1 THEN '+++ /dev/null' ELSE '+++ b/' || path END || {NL}
    || hunks AS section
FROM docs JOIN (
  SELECT doc_id, string_agg(hunk, {NL} ORDER BY h) AS hunks FROM doc_hunks GROUP BY doc_id)
USING (doc_id)""",
)
CHANNEL = "CASE WHEN (doc_id // 20) % 4 = 0 THEN 'staged' ELSE 'unstaged' END"
STEPS.add(
    "f_raw",
    f"""
SELECT repo, review_id, channel, string_agg(section, {NL} ORDER BY doc_id) AS raw_diff
FROM (SELECT *, {CHANNEL} AS channel FROM doc_sections)
GROUP BY repo, review_id, channel""",
)
STEPS.add(
    "m_raw",
    f"""
SELECT repo, review_id, channel, string_agg(section, {NL} ORDER BY doc_id) AS raw_diff
FROM (
  SELECT *, {CHANNEL} AS channel FROM doc_sections WHERE doc_id % 7 <> 6 AND doc_id % 9 <> 0
  UNION ALL
  SELECT *, unnest(['staged', 'unstaged']) AS channel FROM doc_sections
  WHERE doc_id % 7 <> 6 AND doc_id % 9 = 0)
GROUP BY repo, review_id, channel""",
)
STEPS.add(
    "w_raw",
    f"""
SELECT repo, review_id, channel, string_agg(section, {NL} ORDER BY doc_id) AS raw_diff
FROM (
  SELECT *, {CHANNEL} AS channel FROM doc_sections WHERE doc_id % 9 <> 0
  UNION ALL
  SELECT *, unnest(['staged', 'unstaged']) AS channel FROM doc_sections WHERE doc_id % 9 = 0)
GROUP BY repo, review_id, channel""",
)
STEPS.add(
    "whole_lines",
    """
SELECT doc_id AS file_seq, review_id, path, pos, line,
  CASE WHEN doc_id % 2 = 0 THEN 'untracked' ELSE 'staged_list' END AS origin
FROM doc_lines""",
)
STEPS.add("snap_lines", "SELECT * FROM whole_lines WHERE file_seq % 7 >= 5")
STEPS.add(
    "contents",
    f"""
SELECT review_id, path, string_agg(line, {NL} ORDER BY pos) AS content
FROM doc_lines WHERE mark <> '-' GROUP BY review_id, path""",
)
STEPS.add(
    "review_dim",
    f"""
SELECT DISTINCT source AS repo,
  CASE WHEN n < 0 THEN source || '-empty' ELSE source || '-r' || CAST(n AS VARCHAR) END
    AS review_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(n + 1) AS ts
FROM (SELECT source, unnest([doc_id // {d.REVIEW_SIZE}, -1]) AS n FROM documents)""",
)
STEPS.add(
    "ignores",
    """
SELECT review_id, '.gitignore' AS path,
  CASE WHEN n % 3 = 0 THEN 'node_modules' || chr(10) || 'dist'
    ELSE 'node_modules' || chr(10) || '.env' END AS content
FROM (SELECT review_id, TRY_CAST(regexp_extract(review_id, '-r(\\d+)$', 1) AS BIGINT) AS n
  FROM review_dim)
WHERE n % 3 < 2""",
)

# --- diff texts to lines ------------------------------------------------------

HEADER = r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@"


def _parsing(p: str) -> None:
    """Steps that take ``{p}_raw`` apart."""
    STEPS.add(
        f"{p}_text",
        f"""
SELECT repo, review_id, channel, CASE channel WHEN 'staged' THEN 0 ELSE 1 END AS rank,
  unnest(string_split({trimmed('raw_diff')}, {NL})) AS line,
  generate_subscripts(string_split({trimmed('raw_diff')}, {NL}), 1) - 1 AS ord
FROM {p}_raw""",
    )
    STEPS.add(
        f"{p}_sectioned",
        f"""
SELECT *, CAST(sum(CASE WHEN ord > 0 AND starts_with(line, 'diff --git ') THEN 1 ELSE 0 END)
  OVER (PARTITION BY review_id, channel ORDER BY ord) AS BIGINT) AS section_seq
FROM {p}_text""",
    )
    STEPS.add(
        f"{p}_heads",
        f"""
SELECT repo, review_id, channel, rank, section_seq,
  string_agg(line, {NL} ORDER BY ord) AS section,
  bool_or(starts_with(line, 'Binary files')) AS is_binary,
  arg_min(line, ord) FILTER (starts_with(line, '+++ b/') OR starts_with(line, '+++ /dev/null'))
    AS new_side,
  arg_min(substr(line, 7), ord) FILTER (starts_with(line, '+++ b/')) AS new_path,
  arg_min(substr(line, 7), ord) FILTER (starts_with(line, '--- a/')) AS old_path,
  arg_min(line, ord) FILTER (starts_with(line, 'diff --git ')) AS git_line,
  arg_min(line, ord) FILTER (starts_with(line, 'new file mode')
    OR starts_with(line, 'deleted file mode') OR starts_with(line, 'rename from')) AS stated
FROM {p}_sectioned GROUP BY repo, review_id, channel, rank, section_seq""",
    )
    STEPS.add(
        f"{p}_files",
        f"""
SELECT * FROM (
  SELECT repo, review_id, channel, rank, section_seq,
    CASE WHEN starts_with(new_side, '+++ b/') THEN new_path
      WHEN new_side IS NOT NULL AND old_path IS NOT NULL THEN old_path
      WHEN new_path IS NOT NULL THEN new_path
      ELSE regexp_extract(git_line, 'diff --git a/.+ b/(.+)', 1) END AS path,
    CASE WHEN starts_with(stated, 'new') THEN 'added'
      WHEN starts_with(stated, 'deleted') THEN 'deleted'
      WHEN starts_with(stated, 'rename') THEN 'renamed' ELSE 'modified' END AS status
  FROM {p}_heads WHERE NOT is_binary)
WHERE path <> ''""",
    )
    STEPS.add(
        f"{p}_hunked",
        f"""
SELECT s.review_id, s.channel, f.path, s.rank, s.section_seq, s.ord, s.line,
  regexp_matches(s.line, '{HEADER}') AS is_header,
  sum(CASE WHEN regexp_matches(s.line, '{HEADER}') THEN 1 ELSE 0 END)
    OVER (PARTITION BY s.review_id, s.channel, s.section_seq ORDER BY s.ord) - 1 AS hunk_idx
FROM {p}_sectioned s JOIN {p}_files f
  ON s.review_id = f.review_id AND s.channel = f.channel AND s.section_seq = f.section_seq""",
    )

    def count(i: int) -> str:
        found = f"regexp_extract(line, '{HEADER}', {i})"
        return f"CASE WHEN {found} = '' THEN 1 ELSE CAST({found} AS BIGINT) END"

    STEPS.add(
        f"{p}_hunks",
        f"""
SELECT review_id, channel, path, rank, section_seq, CAST(hunk_idx AS BIGINT) AS hunk_idx,
  CAST(regexp_extract(line, '{HEADER}', 1) AS BIGINT) AS old_start, {count(2)} AS old_count,
  CAST(regexp_extract(line, '{HEADER}', 3) AS BIGINT) AS new_start, {count(4)} AS new_count
FROM {p}_hunked WHERE is_header""",
    )
    STEPS.add(
        f"{p}_lines",
        f"""
SELECT review_id, channel, path, rank, section_seq, hunk_idx, pos, line_number, line_type,
  CASE WHEN line = '' THEN '' ELSE substr(line, 2) END AS content, new_start, new_count
FROM (
  SELECT t.review_id, t.channel, t.path, t.rank, t.section_seq, h.hunk_idx, h.new_start,
    h.new_count, t.line,
    CAST(row_number() OVER w - 1 AS BIGINT) AS pos,
    CAST(h.new_start + coalesce(sum(CASE WHEN t.line = '' OR t.line[1] IN ('+', ' ')
      THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS BIGINT) AS line_number,
    CASE WHEN t.line = '' OR t.line[1] = ' ' THEN 'context' WHEN t.line[1] = '+' THEN 'added'
      WHEN t.line[1] = '-' THEN 'removed' END AS line_type
  FROM {p}_hunked t JOIN {p}_hunks h
    ON t.review_id = h.review_id AND t.channel = h.channel AND t.section_seq = h.section_seq
      AND t.hunk_idx = h.hunk_idx
  WHERE NOT t.is_header
  WINDOW w AS (PARTITION BY t.review_id, t.channel, t.section_seq, t.hunk_idx ORDER BY t.ord))
WHERE line_type IS NOT NULL""",
    )


_parsing("f")
_parsing("m")
_parsing("w")

# --- merging ------------------------------------------------------------------

def _merging(p: str) -> None:
    STEPS.add(
        f"{p}_counted",
        f"""
SELECT f.review_id, f.channel, f.section_seq, f.path, f.status,
  CAST(count(*) FILTER (line_type = 'added') AS BIGINT) AS additions,
  CAST(count(*) FILTER (line_type = 'removed') AS BIGINT) AS deletions
FROM {p}_files f LEFT JOIN {p}_lines l
  ON f.review_id = l.review_id AND f.channel = l.channel AND f.section_seq = l.section_seq
GROUP BY ALL""",
    )
    STEPS.add(
        f"{p}_staged",
        f"""
SELECT review_id, path, arg_max(status, section_seq) AS status,
  arg_max(additions, section_seq) AS additions, arg_max(deletions, section_seq) AS deletions,
  min(section_seq) AS file_ord, max(section_seq) AS kept
FROM {p}_counted WHERE channel = 'staged' GROUP BY review_id, path""",
    )
    STEPS.add(
        f"{p}_unstaged",
        f"""
SELECT review_id, path, arg_min(status, section_seq) AS status,
  CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
  {STEP} + min(section_seq) AS file_ord
FROM {p}_counted WHERE channel = 'unstaged' GROUP BY review_id, path""",
    )
    STEPS.add(
        f"{p}_merged",
        f"""
SELECT review_id, path, coalesce(s.status, u.status) AS status,
  coalesce(s.additions, 0) + coalesce(u.additions, 0) AS additions,
  coalesce(s.deletions, 0) + coalesce(u.deletions, 0) AS deletions,
  coalesce(s.file_ord, u.file_ord) AS file_ord, 0 AS src_class
FROM {p}_staged s FULL JOIN {p}_unstaged u USING (review_id, path)""",
    )


_merging("m")
_merging("w")
STEPS.add(
    "snap_files",
    """
SELECT review_id, path, origin, file_seq, CAST(count(*) AS BIGINT) AS additions
FROM snap_lines GROUP BY ALL""",
)
STEPS.add(
    "untracked_files",
    f"""
SELECT review_id, path, 'added' AS status, additions, 0 AS deletions,
  {2 * STEP} + file_seq AS file_ord, 2 AS src_class
FROM snap_files s WHERE origin = 'untracked'
  AND NOT EXISTS (SELECT 1 FROM m_merged m WHERE m.review_id = s.review_id AND m.path = s.path)""",
)
STEPS.add(
    "listed_files",
    f"""
SELECT review_id, path, 'added' AS status, additions, 0 AS deletions,
  {3 * STEP} + file_seq AS file_ord, 3 AS src_class
FROM snap_files s WHERE origin = 'staged_list'
  AND NOT EXISTS (SELECT 1 FROM (SELECT review_id, path FROM m_merged
      UNION ALL SELECT review_id, path FROM untracked_files) m
    WHERE m.review_id = s.review_id AND m.path = s.path)""",
)
STEPS.add(
    "changed",
    """
SELECT review_id, path, CAST(file_ord AS BIGINT) AS file_ord, CAST(src_class AS BIGINT)
  AS src_class, status, CAST(additions AS BIGINT) AS additions,
  CAST(deletions AS BIGINT) AS deletions
FROM (SELECT * FROM m_merged UNION ALL BY NAME SELECT * FROM untracked_files
  UNION ALL BY NAME SELECT * FROM listed_files)""",
)

# --- lines and hunks under review ---------------------------------------------

SECRET_CLASS = (
    "CASE "
    + " ".join(f"WHEN {has('path', p)} THEN '{name}'" for name, p in fv.SECRET_CLASSES)
    + " END"
)
STEPS.add(
    "kept_lines",
    f"""
SELECT l.review_id, l.path, l.rank * {STEP} + l.section_seq AS src_ord, l.hunk_idx, l.pos,
  l.line_number, l.line_type, l.content, l.new_start, l.new_count
FROM m_lines l LEFT JOIN m_staged s ON l.review_id = s.review_id AND l.path = s.path
WHERE l.channel = 'unstaged' OR l.section_seq = s.kept
UNION ALL
SELECT s.review_id, s.path, CASE origin WHEN 'untracked' THEN {2 * STEP} ELSE {3 * STEP} END
    + s.file_seq, 0, s.pos, s.pos + 1, 'added', s.line, 1, c.additions
FROM snap_lines s JOIN (SELECT * FROM untracked_files UNION ALL SELECT * FROM listed_files) c
  ON s.review_id = c.review_id AND s.path = c.path""",
)
STEPS.add(
    "file_class",
    f"""
SELECT review_id, path, file_ord, {has('path', fv.CODE_FILE)} AS is_code,
  {has('path', fv.PYTHON_FILE)} AS is_python,
  {has('path', fv.TYPESCRIPT_FILE)} AS is_typescript, {has('path', fv.SCRIPT_FILE)} AS is_script,
  {SECRET_CLASS} AS secret_class
FROM changed""",
)
STEPS.add(
    "checked",
    """
SELECT l.*, c.file_ord, c.is_code, c.is_python, c.is_typescript, c.is_script, c.secret_class
FROM kept_lines l JOIN file_class c ON l.review_id = c.review_id AND l.path = c.path
WHERE l.line_type = 'added'""",
)

# --- findings -----------------------------------------------------------------


def _finding(
    analyzer: str,
    rule: str,
    where: str,
    severity: str,
    message: str,
    suggestion: str,
    fix: str | None = None,
    source: str = "checked",
    place: int | None = None,
) -> str:
    order = fv.ANALYZERS.index(analyzer) if place is None else place
    kind = "'remove-line'" if fix else "CAST(NULL AS VARCHAR)"
    label = fix or "CAST(NULL AS VARCHAR)"
    return f"""
SELECT review_id, path, file_ord, src_ord, hunk_idx, pos, line_number AS line,
  CAST(NULL AS BIGINT) AS end_line, {severity} AS severity, 'static' AS source,
  '{analyzer}' AS analyzer, {order} AS analyzer_ord, '{rule}' AS rule,
  {message} AS message, {suggestion} AS suggestion, {kind} AS fix_kind, {label} AS fix_label,
  CAST(NULL AS VARCHAR) AS fix_env_key, CAST(NULL AS VARCHAR) AS redacted_text,
  CAST(NULL AS VARCHAR) AS secret_sha256
FROM {source} WHERE {where}"""


BREAKS = f"({has('content', fv.SET_TRACE_CALL)} OR {has('content', fv.BREAKPOINT_CALL)})"
DIRECTIVE = group("content", fv.TS_DIRECTIVE, 1)
TODO_REST = trimmed(group("content", fv.TODO_NOTE, 2, True))

STEPS.add(
    "found_console",
    _finding(
        "console-log",
        "console-script",
        f"is_code AND NOT is_python AND {has('content', fv.CONSOLE_CALL)}",
        "'warning'",
        f"'console.' || {group('content', fv.CONSOLE_CALL, 1)} || ' left in code'",
        text(fv.CONSOLE_SUGGESTION),
        text(fv.CONSOLE_FIX),
    )
    + "\nUNION ALL"
    + _finding(
        "console-log",
        "console-python",
        f"is_python AND {has('content', fv.PRINT_CALL)} AND NOT {has('content', fv.HASH_COMMENT)}",
        "'warning'",
        text(fv.PRINT_MESSAGE),
        text(fv.PRINT_SUGGESTION),
        text(fv.PRINT_FIX),
    ),
)
STEPS.add(
    "found_debugger",
    _finding(
        "debugger",
        "debugger-script",
        f"is_code AND NOT is_python AND {has('content', fv.DEBUGGER_WORD)}",
        "'error'",
        text(fv.DEBUGGER_MESSAGE),
        text(fv.DEBUGGER_SUGGESTION),
        text(fv.DEBUGGER_FIX),
    )
    + "\nUNION ALL"
    + _finding(
        "debugger",
        "debugger-python-call",
        f"is_python AND {BREAKS}",
        "'error'",
        text(fv.BREAKPOINT_MESSAGE),
        text(fv.BREAKPOINT_SUGGESTION),
        text(fv.BREAKPOINT_FIX),
    )
    + "\nUNION ALL"
    + _finding(
        "debugger",
        "debugger-python-import",
        f"is_python AND NOT {BREAKS} AND {has('content', fv.PDB_IMPORT)}",
        "'warning'",
        text(fv.PDB_IMPORT_MESSAGE),
        text(fv.PDB_IMPORT_SUGGESTION),
        text(fv.PDB_IMPORT_FIX),
    ),
)

# one row per pattern in order; the first that matches a line names its finding
PATTERNS = [
    (kind, i, p)
    for kind, own in fv.SECRET_PATTERNS.items()
    for i, p in enumerate((*own, *fv.UNIVERSAL_SECRETS))
]
STEPS.add(
    "secret_patterns",
    "SELECT * FROM (VALUES\n"
    + ",\n".join(
        f"('{kind}', {i}, {text(re2(p.regex, p.any_case))}, {text(p.label)},"
        f" {text(fv.SECRET_TEXTS[kind][0] + p.label + fv.SECRET_TEXTS[kind][1])},"
        f" {text(fv.SECRET_TEXTS[kind][2])})"
        for kind, i, p in PATTERNS
    )
    + ") AS t(kind, priority, regex, label, message, suggestion)",
)
COMMENT = (
    "CASE secret_class "
    + " ".join(f"WHEN '{k}' THEN {has('content', p)}" for k, p in fv.SECRET_COMMENTS.items())
    + " ELSE FALSE END"
)
# every matching pattern of every line by explicit tests, then the lowest priority
SECRET_TESTS = "\nUNION ALL ".join(
    f"SELECT review_id, path, src_ord, hunk_idx, pos, '{kind}' AS kind, {i} AS priority"
    f" FROM checked WHERE secret_class = '{kind}' AND NOT ({COMMENT})"
    f" AND {has('content', p.regex, p.any_case)}"
    for kind, i, p in PATTERNS
)
STEPS.add(
    "secret_hits",
    f"""
SELECT review_id, path, src_ord, hunk_idx, pos, kind, min(priority) AS priority
FROM ({SECRET_TESTS}) GROUP BY ALL""",
)
STEPS.add(
    "secret_lines",
    f"""
SELECT c.*, t.message, t.suggestion,
  CASE WHEN c.secret_class = 'code' THEN
    CASE WHEN {has('content', fv.ENV_KEY_NAME)}
      THEN upper(regexp_replace({group('content', fv.ENV_KEY_NAME, 1)},
        '([a-z])([A-Z])', '\\1_\\2', 'g'))
      ELSE '{fv.ENV_KEY_DEFAULT}' END END AS env_key
FROM checked c
JOIN secret_hits h ON c.review_id = h.review_id AND c.path = h.path AND c.src_ord = h.src_ord
  AND c.hunk_idx = h.hunk_idx AND c.pos = h.pos
JOIN secret_patterns t ON t.kind = h.kind AND t.priority = h.priority""",
)
STEPS.add(
    "found_secrets",
    f"""
SELECT review_id, path, file_ord, src_ord, hunk_idx, pos, line_number AS line,
  CAST(NULL AS BIGINT) AS end_line, 'error' AS severity, 'static' AS source,
  'secrets' AS analyzer, {fv.ANALYZERS.index('secrets')} AS analyzer_ord, 'secrets' AS rule,
  message, suggestion,
  CASE WHEN env_key IS NOT NULL THEN 'move-to-env' END AS fix_kind,
  'Move to .env as ' || env_key AS fix_label, env_key AS fix_env_key,
  CASE WHEN env_key IS NOT NULL AND {has('content', fv.QUOTED_VALUE)}
    THEN regexp_replace(content, {text(re2(fv.QUOTED_VALUE))}, 'process.env.' || env_key) END
    AS redacted_text,
  CASE WHEN env_key IS NOT NULL AND {has('content', fv.QUOTED_VALUE)}
    THEN sha256({group('content', fv.QUOTED_VALUE, 1)}) END AS secret_sha256
FROM secret_lines""",
)
STEPS.add(
    "found_todos",
    _finding(
        "todos",
        "todos",
        f"is_code AND {has('content', fv.TODO_NOTE, True)}",
        "'info'",
        f"upper({group('content', fv.TODO_NOTE, 1, True)}) || ' comment: ' ||"
        f" CASE WHEN {TODO_REST} = '' THEN '{fv.TODO_EMPTY}' ELSE {TODO_REST} END",
        text(fv.TODO_SUGGESTION),
    ),
)
STEPS.add(
    "large_hunks",
    f"""
SELECT l.review_id, l.path, c.file_ord, l.src_ord, l.hunk_idx, l.new_start, l.new_count,
  CAST(count(*) FILTER (line_type = 'added') AS BIGINT) AS added,
  string_agg(content, {NL} ORDER BY pos) FILTER (nth <= {fv.FUNCTION_NAME_LINES}) AS first_lines
FROM (SELECT *, row_number() OVER (PARTITION BY review_id, path, src_ord, hunk_idx
  ORDER BY pos) AS nth FROM kept_lines) l
JOIN file_class c ON l.review_id = c.review_id AND l.path = c.path
WHERE c.is_code GROUP BY ALL
HAVING count(*) FILTER (line_type = 'added') >= {LARGE}""",
)
NAME = (
    "coalesce("
    + ", ".join(f"nullif({group('first_lines', fv.FUNCTION_NAME, i)}, '')" for i in (1, 2, 3))
    + ", 'anonymous')"
)
STEPS.add(
    "found_large",
    f"""
SELECT review_id, path, file_ord, src_ord, hunk_idx, 0 AS pos, new_start AS line,
  new_start + new_count AS end_line, 'warning' AS severity, 'static' AS source,
  'large-functions' AS analyzer, {fv.ANALYZERS.index('large-functions')} AS analyzer_ord,
  'large-functions' AS rule,
  'Large change block (' || CAST(added AS VARCHAR) || ' lines added' ||
    CASE WHEN {NAME} = 'anonymous' THEN '' ELSE ' in ' || {NAME} END ||
    ') — consider breaking this up' AS message,
  'Functions over {LARGE} lines are harder to review and test. Consider extracting helpers.'
    AS suggestion,
  CAST(NULL AS VARCHAR) AS fix_kind, CAST(NULL AS VARCHAR) AS fix_label,
  CAST(NULL AS VARCHAR) AS fix_env_key, CAST(NULL AS VARCHAR) AS redacted_text,
  CAST(NULL AS VARCHAR) AS secret_sha256
FROM large_hunks""",
)
STEPS.add(
    "found_any",
    _finding(
        "type-any",
        "type-any",
        f"is_typescript AND {has('content', fv.ANY_TYPE)}",
        "'warning'",
        text(fv.ANY_MESSAGE),
        text(fv.ANY_SUGGESTION),
    ),
)
STEPS.add(
    "found_directive",
    _finding(
        "ts-directive",
        "ts-directive",
        f"is_script AND {has('content', fv.TS_DIRECTIVE)}",
        f"CASE {DIRECTIVE} WHEN 'nocheck' THEN 'error' ELSE 'warning' END",
        f"'@ts-' || {DIRECTIVE} || ' suppresses type checking'",
        f"CASE {DIRECTIVE} WHEN 'expect-error' THEN {text(fv.EXPECT_ERROR_SUGGESTION)}"
        f" ELSE 'Remove @ts-' || {DIRECTIVE} || ' and fix the type error instead.' END",
        f"'Remove @ts-' || {DIRECTIVE} || ' comment'",
    ),
)
STEPS.add(
    "f_checked",
    f"""
SELECT review_id, path, 0 AS file_ord, rank * {STEP} + section_seq AS src_ord, hunk_idx, pos,
  line_number, content, {has('path', fv.CODE_FILE)} AS is_code,
  {has('path', fv.PYTHON_FILE)} AS is_python,
  {has('path', fv.TYPESCRIPT_FILE)} AS is_typescript, {has('path', fv.SCRIPT_FILE)} AS is_script,
  {SECRET_CLASS} AS secret_class
FROM f_lines WHERE line_type = 'added'""",
)
STEPS.add(
    "f_kept",
    f"""
SELECT review_id, path, rank * {STEP} + section_seq AS src_ord, hunk_idx, pos, line_number,
  line_type, content, new_start, new_count FROM f_lines""",
)
STEPS.add(
    "f_class",
    f"""
SELECT DISTINCT review_id, path, 0 AS file_ord, {has('path', fv.CODE_FILE)} AS is_code
FROM f_files""",
)


def _of_arrivals(body: str) -> str:
    """A step over the lines under review, as one over all lines of the arriving diffs."""
    for name, own in (
        ("checked", "f_checked"),
        ("secret_hits", "f_secret_hits"),
        ("secret_lines", "f_secret_lines"),
        ("kept_lines", "f_kept"),
        ("file_class", "f_class"),
        ("large_hunks", "f_large_hunks"),
    ):
        body = body.replace(f"FROM {name}", f"FROM {own}").replace(f"JOIN {name}", f"JOIN {own}")
    return body


for _name in ("secret_hits", "secret_lines", "large_hunks"):
    STEPS.add(f"f_{_name}", _of_arrivals(STEPS.bodies[_name]))
for _name in (
    "found_console",
    "found_debugger",
    "found_secrets",
    "found_todos",
    "found_large",
    "found_any",
    "found_directive",
):
    STEPS.add(_name.replace("found", "arrived"), _of_arrivals(STEPS.bodies[_name]))
ALL_FOUND = (
    "found_console",
    "found_debugger",
    "found_secrets",
    "found_todos",
    "found_large",
    "found_any",
    "found_directive",
)
STEPS.add(
    "found",
    "\nUNION ALL BY NAME ".join(f"SELECT * FROM {name}" for name in ALL_FOUND),
)
STEPS.add(
    "found_long",
    _finding(
        "line-length",
        "long-line",
        "is_code AND length(content) > 60",
        "CASE WHEN length(content) > 120 THEN 'warning' ELSE 'info' END",
        "CAST(length(content) AS VARCHAR) || ' characters in a line'",
        "'Break the line.'",
        place=len(fv.ANALYZERS),
    ),
)
STEPS.add("found_more", "SELECT * FROM found UNION ALL BY NAME SELECT * FROM found_long")
STEPS.add(
    "responses",
    f"""
SELECT review_id, path,
  replace({texts(d.ANSWERS)}[doc_id % {len(d.ANSWERS)} + 1], '@',
    CAST(doc_id % 20 + 1 AS VARCHAR)) AS response
FROM docs""",
)
STEPS.add(
    "found_ai",
    f"""
SELECT a.review_id, a.path, c.file_ord, 0 AS src_ord, 0 AS hunk_idx, a.item_no AS pos,
  CASE WHEN TRY_CAST(item->>'line' AS DOUBLE) = floor(TRY_CAST(item->>'line' AS DOUBLE))
    THEN CAST(TRY_CAST(item->>'line' AS DOUBLE) AS BIGINT) END AS line,
  item->>'line' AS line_given, CAST(NULL AS BIGINT) AS end_line,
  item->>'severity' AS severity, 'ai' AS source, '{fv.AI_ANALYZER}' AS analyzer,
  {len(fv.ANALYZERS)} AS analyzer_ord, '{fv.AI_ANALYZER}' AS rule,
  item->>'message' AS message, item->>'suggestion' AS suggestion,
  CAST(NULL AS VARCHAR) AS fix_kind, CAST(NULL AS VARCHAR) AS fix_label,
  CAST(NULL AS VARCHAR) AS fix_env_key, CAST(NULL AS VARCHAR) AS redacted_text,
  CAST(NULL AS VARCHAR) AS secret_sha256
FROM (
  SELECT review_id, path, unnest(items) AS item,
    CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS item_no
  FROM (
    SELECT review_id, path, CAST(CAST(answer AS JSON) AS JSON[]) AS items FROM (
      SELECT r.review_id, r.path, replace(regexp_extract(r.response, '(?s)\\[.*\\]'),
        '"line": 1, "line":', '"line":') AS answer
      FROM responses r JOIN contents c ON r.review_id = c.review_id AND r.path = c.path
      WHERE c.content <> '')
    WHERE answer <> '' AND json_valid(answer))) a
JOIN changed c ON a.review_id = c.review_id AND a.path = c.path
WHERE item->>'line' NOT IN ('', '0', 'false') AND item->>'severity' NOT IN ('', '0', 'false')
  AND item->>'message' NOT IN ('', '0', 'false')""",
)
STEPS.add("found_both", "SELECT * FROM found UNION ALL BY NAME SELECT * FROM found_ai")

# --- files and reviews --------------------------------------------------------


def _risky(name: str, found: str, tally: str) -> None:
    STEPS.add(
        tally,
        f"""
SELECT review_id, path, CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors,
  CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warnings,
  CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS infos,
  CAST(count(*) AS BIGINT) AS findings
FROM {found} GROUP BY review_id, path""",
    )
    STEPS.add(
        name,
        f"""
SELECT *, CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END
  AS risk_rank
FROM (
  SELECT c.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
    coalesce(infos, 0) AS infos, coalesce(findings, 0) AS findings,
    CASE WHEN errors > 0 OR {has('c.path', fv.SENSITIVE_PATH, True)} THEN 'high'
      WHEN warnings > 0 OR additions + deletions > 100 THEN 'medium'
      WHEN findings > 0 THEN 'low' WHEN {has('c.path', fv.CONFIG_FILE)} THEN 'info'
      ELSE 'low' END AS risk
  FROM changed c LEFT JOIN {tally} t ON c.review_id = t.review_id AND c.path = t.path)""",
    )


_risky("risky", "found", "tallies")
_risky("risky_both", "found_both", "tallies_both")
SCORE = (
    "CAST(greatest(0, least(100, 100 - 15 * errors - 5 * warnings - infos)) AS BIGINT)"
)


def rollup(risky: str) -> str:
    return f"""
SELECT repo, review_id, ts, {SCORE} AS score, total_issues, errors, warnings, infos,
  file_count, additions, deletions
FROM (
  SELECT d.repo, d.review_id, d.ts, CAST(coalesce(sum(findings), 0) AS BIGINT) AS total_issues,
    CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors,
    CAST(coalesce(sum(warnings), 0) AS BIGINT) AS warnings,
    CAST(coalesce(sum(infos), 0) AS BIGINT) AS infos,
    CAST(count(f.path) AS BIGINT) AS file_count,
    CAST(coalesce(sum(additions), 0) AS BIGINT) AS additions,
    CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deletions
  FROM review_dim d LEFT JOIN {risky} f ON d.review_id = f.review_id GROUP BY ALL)"""


STEPS.add("rolled", rollup("risky"))
STEPS.add(
    "review_hits",
    """
SELECT d.repo, f.analyzer, row_number() OVER (PARTITION BY d.repo ORDER BY d.ts, f.review_id,
  r.risk_rank, f.file_ord, f.analyzer_ord, f.src_ord, f.hunk_idx, f.pos) AS nth
FROM found f JOIN risky r ON f.review_id = r.review_id AND f.path = r.path
JOIN review_dim d ON f.review_id = d.review_id""",
)

# --- history ------------------------------------------------------------------

STEPS.add(
    "history",
    """
SELECT CAST(user_id AS VARCHAR) AS repo, CAST(event_id AS VARCHAR) AS review_id, ts,
  CAST(greatest(0, 100 - CAST(floor(value) AS BIGINT) % 45) AS BIGINT) AS score,
  event_id % 7 + event_id % 5 + event_id % 3 AS total_issues, event_id % 3 AS errors,
  event_id % 5 AS warnings, event_id % 7 AS infos, event_id % 11 AS file_count
FROM events""",
)
STEPS.add(
    "hits",
    """
SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS analyzer, ts, event_id AS seq
FROM events""",
)
