"""One DuckDB query per registered query."""

from __future__ import annotations

from oracles.steps import NL, STEP, STEPS, rollup, trimmed
from patchwell.functions import fixed_values as fv
from patchwell.operators import report

FINDING = (
    "review_id, path, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line,"
    " severity, analyzer, rule, message, suggestion, fix_kind, fix_label, fix_env_key"
)
SRC = f"CAST(rank * {STEP} + section_seq AS BIGINT) AS src_ord"
LINE = (
    f"review_id, path, {SRC}, CAST(hunk_idx AS BIGINT) AS hunk_idx, pos, line_number, line_type,"
    " content"
)
CHANGED = (
    "review_id, path, CAST(file_ord AS BIGINT) AS file_ord, status,"
    " CAST(additions AS BIGINT) AS additions, CAST(deletions AS BIGINT) AS deletions"
)
ORDER = "analyzer_ord, src_ord, hunk_idx, pos"

BODIES: dict[str, str] = {
    "trimmed_diffs": f"SELECT repo, review_id, channel, {trimmed('raw_diff')} AS raw_diff FROM f_raw",
    "snapshot_lines": f"""
SELECT review_id, path, CAST(CASE origin WHEN 'untracked' THEN {2 * STEP} ELSE {3 * STEP} END
    + file_seq AS BIGINT) AS src_ord, pos, pos + 1 AS line_number, 'added' AS line_type,
  line AS content
FROM whole_lines""",
    "diff_sections": "SELECT repo, review_id, channel, section_seq, section FROM f_heads",
    "diff_files": f"SELECT repo, review_id, path, status, {SRC} FROM f_files",
    "diff_hunks": f"""
SELECT review_id, path, {SRC}, hunk_idx, old_start, old_count, new_start, new_count
FROM f_hunks""",
    "diff_lines": f"SELECT {LINE} FROM f_lines",
    "added_lines": f"SELECT {LINE} FROM f_lines WHERE line_type = 'added'",
    "file_change_counts": f"""
SELECT f.review_id, f.path, CAST(f.rank * {STEP} + f.section_seq AS BIGINT) AS src_ord,
  CAST(count(*) FILTER (line_type = 'added') AS BIGINT) AS additions,
  CAST(count(*) FILTER (line_type = 'removed') AS BIGINT) AS deletions
FROM f_files f LEFT JOIN f_lines l
  ON f.review_id = l.review_id AND f.channel = l.channel AND f.section_seq = l.section_seq
GROUP BY ALL""",
    "merged_files": f"SELECT {CHANGED} FROM w_merged",
    "changed_files": f"SELECT {CHANGED} FROM changed",
    "untracked_only": f"SELECT {CHANGED} FROM untracked_files",
    "staged_fallback": f"SELECT {CHANGED} FROM listed_files",
    "file_classes": """
SELECT review_id, path, is_code, is_python, is_typescript, is_script, secret_class
FROM file_class""",
    "console_findings": f"SELECT {FINDING} FROM found_console",
    "debugger_findings": f"SELECT {FINDING} FROM found_debugger",
    "secret_findings": f"SELECT {FINDING} FROM found_secrets",
    "todo_findings": f"SELECT {FINDING} FROM found_todos",
    "large_hunk_findings": f"SELECT {FINDING} FROM found_large",
    "type_any_findings": f"SELECT {FINDING} FROM found_any",
    "ts_directive_findings": f"SELECT {FINDING} FROM found_directive",
    "all_findings": f"SELECT {FINDING} FROM found",
    "added_rule_findings": f"""
SELECT analyzer || '-' || CAST(row_number() OVER (PARTITION BY review_id
  ORDER BY file_ord, {ORDER}) AS VARCHAR) AS finding_id, {FINDING}
FROM found_more""",
    "added_rule_hits": """
SELECT d.repo, f.analyzer, CAST(count(*) AS BIGINT) AS hits
FROM found_more f JOIN review_dim d ON f.review_id = d.review_id
GROUP BY d.repo, f.analyzer""",
    "finding_ids": f"""
SELECT review_id, analyzer || '-' || CAST(row_number() OVER (PARTITION BY review_id
  ORDER BY file_ord, {ORDER}) AS VARCHAR) AS finding_id, path, CAST(line AS BIGINT) AS line, rule
FROM found""",
    "rule_switches": """
SELECT d.review_id, CAST(greatest(0, least(100, 100
    - 5 * count(*) FILTER (severity = 'warning') - count(*) FILTER (severity = 'info')))
    AS BIGINT) AS score,
  CAST(count(severity) AS BIGINT) AS total_issues, CAST(0 AS BIGINT) AS errors,
  CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warnings,
  CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS infos
FROM review_dim d LEFT JOIN (
  SELECT review_id, severity FROM found_console
  UNION ALL SELECT review_id, severity FROM found_todos
  UNION ALL SELECT review_id, severity FROM found_any) f ON d.review_id = f.review_id
GROUP BY d.review_id""",
    "file_risk": "SELECT review_id, path, risk, errors, warnings, infos, findings FROM risky",
    "review_scores": "SELECT repo, review_id, score FROM rolled",
    "severity_counts": "SELECT review_id, total_issues, errors, warnings, infos FROM rolled",
    "review_rollup": "SELECT * FROM rolled",
    "empty_reviews": f"""
SELECT repo, review_id, CAST(100 AS BIGINT) AS score, CAST(0 AS BIGINT) AS total_issues,
  '{fv.EMPTY_REPORT}' AS report
FROM review_dim d WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.review_id = d.review_id)""",
    "files_by_risk": """
SELECT review_id, path, risk, CAST(row_number() OVER (PARTITION BY review_id
  ORDER BY risk_rank, file_ord) AS BIGINT) AS position
FROM risky""",
    "status_counts": """
SELECT review_id, CAST(count(*) FILTER (status = 'added') AS BIGINT) AS added,
  CAST(count(*) FILTER (status = 'modified') AS BIGINT) AS modified,
  CAST(count(*) FILTER (status = 'deleted') AS BIGINT) AS deleted,
  CAST(count(*) FILTER (status = 'renamed') AS BIGINT) AS renamed
FROM changed GROUP BY review_id""",
    "change_totals": """
SELECT review_id, CAST(count(*) AS BIGINT) AS file_count,
  CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions
FROM changed GROUP BY review_id""",
    "findings_by_severity": """
SELECT f.review_id, p.position AS file_position, f.path, CAST(f.line AS BIGINT) AS line,
  f.analyzer, f.message
FROM found f JOIN (
  SELECT review_id, path, CAST(row_number() OVER (PARTITION BY review_id
    ORDER BY risk_rank, file_ord) AS BIGINT) AS position FROM risky) p
  ON f.review_id = p.review_id AND f.path = p.path
WHERE f.severity = 'error'""",
    "file_rollup": """
SELECT review_id, path, status, risk, findings, findings = 0 AS is_clean, additions, deletions
FROM risky""",
    "history_snapshots": """
SELECT repo, review_id, ts, score, total_issues, errors, warnings, infos, file_count
FROM rolled""",
    "history_last50": """
SELECT repo, review_id, recency, ts, score, total_issues, file_count FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY ts DESC, review_id DESC)
    AS BIGINT) AS recency FROM history)
WHERE recency <= 50""",
    "clean_streak": """
SELECT repo, review_id, score, CAST(CASE WHEN score < 80 THEN 0 ELSE
  row_number() OVER (PARTITION BY repo, island ORDER BY ts, review_id)
    - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS BIGINT) AS streak
FROM (
  SELECT *, sum(CASE WHEN score < 80 THEN 1 ELSE 0 END)
    OVER (PARTITION BY repo ORDER BY ts, review_id ROWS UNBOUNDED PRECEDING) AS island
  FROM history)""",
    "current_streak": """
SELECT h.repo, CAST(count(*) FILTER (b.ts IS NULL OR h.ts > b.ts) AS BIGINT) AS streak
FROM history h LEFT JOIN (
  SELECT repo, max(ts) AS ts FROM history WHERE score < 80 GROUP BY repo) b ON h.repo = b.repo
GROUP BY h.repo""",
    "rule_hits": """
SELECT repo, analyzer, CAST(count(*) AS BIGINT) AS hits FROM hits GROUP BY repo, analyzer""",
    "top_rule": """
SELECT repo, analyzer, hits FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY hits DESC, ts, seq) AS place FROM (
    SELECT repo, analyzer, CAST(count(*) AS BIGINT) AS hits, min(ts) AS ts,
      arg_min(seq, (ts, seq)) AS seq
    FROM hits GROUP BY repo, analyzer))
WHERE place = 1""",
    "review_rule_hits": """
SELECT repo, analyzer, CAST(count(*) AS BIGINT) AS hits FROM review_hits
GROUP BY repo, analyzer""",
    "review_top_rule": """
SELECT repo, analyzer, hits FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY hits DESC, first) AS place FROM (
    SELECT repo, analyzer, CAST(count(*) AS BIGINT) AS hits, min(nth) AS first
    FROM review_hits GROUP BY repo, analyzer))
WHERE place = 1""",
    "rule_hit_map": """
SELECT repo, '{' || string_agg('"' || analyzer || '":' || hits, ',' ORDER BY analyzer) || '}'
  AS hit_counts
FROM (SELECT repo, analyzer, count(*) AS hits FROM review_hits GROUP BY repo, analyzer)
GROUP BY repo""",
    "streamed_history": """
WITH streaks AS (
  SELECT repo, review_id, ts, score, CAST(CASE WHEN score < 80 THEN 0 ELSE
    row_number() OVER (PARTITION BY repo, island ORDER BY ts, review_id)
      - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS BIGINT) AS streak
  FROM (SELECT *, sum(CASE WHEN score < 80 THEN 1 ELSE 0 END)
    OVER (PARTITION BY repo ORDER BY ts, review_id ROWS UNBOUNDED PRECEDING) AS island
    FROM history))
SELECT repo, review_id, recency, score, streak FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY ts DESC, review_id DESC)
    AS BIGINT) AS recency FROM streaks)
WHERE recency <= 50""",
    "streamed_rule_hits": """
SELECT repo, analyzer, CAST(count(*) AS BIGINT) AS hits FROM hits GROUP BY repo, analyzer""",
    "score_delta": """
SELECT repo, review_id, score, lag(score) OVER w AS previous_score,
  CAST(score - lag(score) OVER w AS BIGINT) AS score_change
FROM history WINDOW w AS (PARTITION BY repo ORDER BY ts, review_id)""",
    "score_band": """
SELECT repo, review_id, score,
  CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'warn' ELSE 'bad' END AS band
FROM history""",
    "diagnostics": f"""
SELECT review_id, path, CAST(greatest(0, line - 1) AS BIGINT) AS start_line,
  CAST(CASE WHEN coalesce(end_line, 0) <> 0 THEN greatest(0, end_line - 1)
    ELSE greatest(0, line - 1) END AS BIGINT) AS end_line, severity,
  CASE source WHEN 'ai' THEN analyzer || ' (AI)' ELSE analyzer END AS code,
  message || CASE WHEN coalesce(suggestion, '') = '' THEN '' ELSE {NL} || '💡 ' || suggestion END
    AS message
FROM found_both""",
}

# --- proximity: a line opens a group if no line of its file is up to 5 before it

STEPS.add(
    "openings",
    """
SELECT review_id, path, line FROM (SELECT DISTINCT review_id, path, line FROM found) a
WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.review_id = a.review_id AND b.path = a.path
  AND b.line < a.line AND b.line >= a.line - 5)""",
)
STEPS.add(
    "grouped",
    """
SELECT f.review_id, f.path, f.line, f.severity, max(o.line) AS start_line
FROM (SELECT *, row_number() OVER () AS id FROM found) f JOIN openings o
  ON f.review_id = o.review_id AND f.path = o.path AND o.line <= f.line
GROUP BY f.id, f.review_id, f.path, f.line, f.severity""",
)
BODIES["proximity_groups"] = """
SELECT review_id, path, CAST(start_line AS BIGINT) AS start_line,
  CAST(max(line) AS BIGINT) AS end_line, CAST(count(DISTINCT line) AS BIGINT) AS line_count
FROM grouped GROUP BY review_id, path, start_line"""
BODIES["group_severity"] = """
SELECT review_id, path, CAST(start_line AS BIGINT) AS start_line,
  CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors,
  CAST(count(DISTINCT line) - count(*) FILTER (severity = 'error') AS BIGINT) AS warnings
FROM grouped GROUP BY review_id, path, start_line"""

# --- fixes --------------------------------------------------------------------

STEPS.add(
    "first_on_line",
    f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id, path, line ORDER BY {ORDER}) AS nth
  FROM found_both)
WHERE nth = 1 AND fix_kind IS NOT NULL""",
)
STEPS.add(
    "offered",
    """
SELECT f.review_id, f.path, CAST(o.line AS BIGINT) AS line, f.analyzer, f.rule, o.fix_kind,
  o.fix_label, o.fix_env_key, o.redacted_text, o.secret_sha256
FROM found_both f JOIN first_on_line o
  ON f.review_id = o.review_id AND f.path = o.path AND greatest(f.line, 1) = o.line""",
)
BODIES["fix_candidates"] = """
SELECT review_id, path, line, rule, fix_kind, fix_label, fix_env_key FROM offered"""
BODIES["fix_edits"] = """
SELECT review_id, path, line, analyzer,
  CASE fix_kind WHEN 'remove-line' THEN 'delete' ELSE 'move-to-env' END AS edit,
  fix_label AS label, line - 1 AS from_line,
  CASE fix_kind WHEN 'remove-line' THEN line ELSE line - 1 END AS to_line,
  CAST(NULL AS VARCHAR) AS new_text, fix_env_key AS env_key
FROM offered"""
BODIES["redacted_lines"] = """
SELECT review_id, path, line, analyzer, redacted_text AS new_text
FROM offered WHERE redacted_text IS NOT NULL"""
BODIES["env_entries"] = """
SELECT review_id, path, line, fix_env_key AS env_key, secret_sha256,
  fix_env_key || '=sha256:' || secret_sha256 AS entry
FROM offered WHERE secret_sha256 IS NOT NULL"""
BODIES["ignore_updates"] = f"""
SELECT review_id, path, {NL} || '.env' || {NL} AS appended FROM ignores i
WHERE NOT contains(content, '.env')
  AND EXISTS (SELECT 1 FROM offered o WHERE o.review_id = i.review_id
    AND o.secret_sha256 IS NOT NULL)"""

# --- reports ------------------------------------------------------------------

ICON = "CASE severity WHEN 'error' THEN '🔴' WHEN 'warning' THEN '🟡' ELSE '🔵' END"
FILE_LINE = (
    "'- `' || path || '`' || CASE status WHEN 'added' THEN ' (+' || CAST(additions AS VARCHAR)"
    " || ' lines)' WHEN 'modified' THEN ' (+' || CAST(additions AS VARCHAR) || ', -'"
    " || CAST(deletions AS VARCHAR) || ')' ELSE '' END"
)
STATUS_NO = (
    "CASE status "
    + " ".join(f"WHEN '{s}' THEN {i}" for i, (s, _) in enumerate(fv.REPORT_STATUS_TITLES))
    + " END"
)
TITLE = (
    "CASE status "
    + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in fv.REPORT_STATUS_TITLES)
    + " END"
)
STEPS.add(
    "report_lines",
    f"""
SELECT review_id, 0 AS section, 1 AS position, '## What Changed' || {NL} AS text
FROM changed GROUP BY review_id
UNION ALL
SELECT review_id, 10 * ({STATUS_NO} + 1), 1, '### ' || {TITLE} || ' (' ||
  CAST(count(*) AS VARCHAR) || ')' FROM changed GROUP BY review_id, status
UNION ALL
SELECT review_id, 10 * ({STATUS_NO} + 1) + 1,
  row_number() OVER (PARTITION BY review_id, status ORDER BY file_ord), {FILE_LINE} FROM changed
UNION ALL
SELECT review_id, 10 * ({STATUS_NO} + 1) + 2, 1, '' FROM changed GROUP BY review_id, status
UNION ALL
SELECT review_id, {report.SUMMARY_SECTION}, 1, '## Summary' || {NL} || {NL}
  || '- **Files changed:** ' || CAST(count(*) AS VARCHAR) || {NL}
  || '- **Lines added:** ' || CAST(CAST(sum(additions) AS BIGINT) AS VARCHAR) || {NL}
  || '- **Lines removed:** ' || CAST(CAST(sum(deletions) AS BIGINT) AS VARCHAR) || {NL}
FROM changed GROUP BY review_id
UNION ALL
SELECT review_id, {report.NOTES_SECTION}, 1, '## Notes' || {NL} || {NL}
  || 'The following items were flagged during pre-push review:' || {NL}
FROM found GROUP BY review_id
UNION ALL
SELECT review_id, {report.NOTES_SECTION} + 1,
  row_number() OVER (PARTITION BY review_id ORDER BY file_ord, {ORDER}),
  '- ' || {ICON} || ' `' || path || ':' || CAST(line AS VARCHAR) || '` — ' || message
FROM found""",
)
BODIES["markdown_report"] = f"""
SELECT review_id, CAST(section AS BIGINT) AS section,
  CAST((position - 1) // {report.PART_LINES} AS BIGINT) AS part,
  string_agg(text, {NL} ORDER BY position) AS text
FROM report_lines GROUP BY review_id, section, (position - 1) // {report.PART_LINES}
UNION ALL
SELECT review_id, 0, 0, '{fv.EMPTY_REPORT}' FROM review_dim
WHERE review_id NOT IN (SELECT review_id FROM changed)"""
BODIES["report_parts"] = f"""
SELECT review_id, CAST(section AS BIGINT) AS section,
  CAST((position - 1) // 8 AS BIGINT) AS part, string_agg(text, {NL} ORDER BY position) AS text
FROM report_lines GROUP BY review_id, section, (position - 1) // 8"""

# --- history of all repositories ----------------------------------------------

BODIES["history_summary"] = f"""
WITH streaks AS ({BODIES['current_streak']}), tops AS ({BODIES['top_rule']})
SELECT r.repo, CAST(coalesce(h.reviews, 0) AS BIGINT) AS reviews, h.last_score,
  CAST(coalesce(s.streak, 0) AS BIGINT) AS streak,
  coalesce(t.analyzer, '') AS most_common_analyzer,
  CAST(coalesce(t.hits, 0) AS BIGINT) AS top_hits
FROM (SELECT repo FROM history UNION SELECT repo FROM review_dim) r
LEFT JOIN (SELECT repo, count(*) AS reviews, arg_max(score, (ts, review_id)) AS last_score
  FROM history GROUP BY repo) h ON r.repo = h.repo
LEFT JOIN streaks s ON r.repo = s.repo LEFT JOIN tops t ON r.repo = t.repo"""

BODIES["published_findings"] = BODIES["all_findings"]
BODIES["published_summary"] = f"""
SELECT s.repo, reviews, last_score, streak, score_change, most_common_analyzer, top_hits
FROM ({BODIES['history_summary']}) s LEFT JOIN (
  SELECT h.repo, CAST(arg_max(d.score_change, (h.ts, h.review_id)) AS BIGINT) AS score_change
  FROM history h JOIN ({BODIES['score_delta']}) d ON h.repo = d.repo AND h.review_id = d.review_id
  WHERE d.score_change IS NOT NULL
  GROUP BY h.repo) c ON s.repo = c.repo"""
BODIES["published_trends"] = f"""
SELECT c.repo, c.review_id, c.score, c.streak, d.score_change
FROM ({BODIES['clean_streak']}) c
JOIN ({BODIES['score_delta']}) d ON c.repo = d.repo AND c.review_id = d.review_id
JOIN history h ON c.repo = h.repo AND c.review_id = h.review_id
WHERE h.ts >= DATE '2024-01-16'"""
BODIES["split_diff_files"] = f"""
SELECT review_id, path, CAST(row_number() OVER (PARTITION BY review_id ORDER BY file_ord) AS BIGINT) AS place,
  status, additions, deletions
FROM ({BODIES['changed_files']})"""
BODIES["split_diff_findings"] = BODIES["all_findings"]
BODIES["running_summary"] = BODIES["history_summary"]
BODIES["running_history"] = f"""
SELECT s.repo, s.review_id, s.recency, s.score, s.streak, d.score_change
FROM ({BODIES['streamed_history']}) s
JOIN ({BODIES['score_delta']}) d ON s.repo = d.repo AND s.review_id = d.review_id"""

# --- prompts ------------------------------------------------------------------

STEPS.add(
    "kept_hunks",
    f"""
SELECT h.review_id, h.path, h.rank * {STEP} + h.section_seq AS src_ord, h.hunk_idx, h.new_start,
  h.new_count
FROM m_hunks h LEFT JOIN m_staged s ON h.review_id = s.review_id AND h.path = s.path
WHERE h.channel = 'unstaged' OR h.section_seq = s.kept
UNION ALL
SELECT review_id, path, file_ord, 0, 1, additions
FROM (SELECT * FROM untracked_files UNION ALL SELECT * FROM listed_files)""",
)
STEPS.add(
    "content_lines",
    f"""
SELECT review_id, path, unnest(string_split(content, {NL})) AS content,
  generate_subscripts(string_split(content, {NL}), 1) AS line_number
FROM contents WHERE content <> ''""",
)
STEPS.add(
    "details",
    f"""
SELECT review_id, path, string_agg(CASE line_type
    WHEN 'added' THEN '+ L' || CAST(line_number AS VARCHAR) || ': ' || content
    ELSE '- (removed): ' || content END, {NL} ORDER BY src_ord, hunk_idx, pos) AS changes
FROM kept_lines WHERE line_type <> 'context' GROUP BY review_id, path""",
)
STEPS.add(
    "around",
    """
SELECT h.review_id, h.path, CAST(h.src_ord AS BIGINT) AS src_ord,
  CAST(h.hunk_idx AS BIGINT) AS hunk_idx, CAST(c.line_number AS BIGINT) AS line_number,
  EXISTS (SELECT 1 FROM kept_lines l WHERE l.review_id = h.review_id AND l.path = h.path
    AND l.line_type = 'added' AND l.line_number = c.line_number) AS is_changed, c.content
FROM kept_hunks h JOIN content_lines c ON h.review_id = c.review_id AND h.path = c.path
  AND c.line_number BETWEEN h.new_start - 5 AND h.new_start + h.new_count + 5""",
)
BODIES["change_detail"] = "SELECT review_id, path, changes FROM details"
BODIES["context_ranges"] = "SELECT * FROM around"
STEPS.add(
    "contexts",
    f"""
SELECT review_id, path, string_agg(range, {NL} || '---' || {NL} ORDER BY src_ord, hunk_idx)
  AS context
FROM (
  SELECT h.review_id, h.path, h.src_ord, h.hunk_idx,
    coalesce(string_agg(CASE WHEN is_changed THEN '>>>' ELSE '   ' END || ' '
      || CAST(line_number AS VARCHAR) || ': ' || content, {NL} ORDER BY line_number), '') AS range
  FROM kept_hunks h LEFT JOIN around a ON h.review_id = a.review_id AND h.path = a.path
    AND h.src_ord = a.src_ord AND h.hunk_idx = a.hunk_idx
  GROUP BY ALL)
GROUP BY review_id, path""",
)
PROMPT = "'" + fv.PROMPT_FORMAT.replace("'", "''") + "'"
for _name, _column in (
    ("status", "f.status"),
    ("additions", "CAST(f.additions AS VARCHAR)"),
    ("deletions", "CAST(f.deletions AS VARCHAR)"),
    ("changes", "coalesce(t.changes, '')"),
    ("context", "coalesce(x.context, '')"),
    ("path", "f.path"),
):
    PROMPT = PROMPT.replace("{" + _name + "}", f"' || {_column} || '")
BODIES["review_prompts"] = f"""
SELECT f.review_id, f.path, {PROMPT} AS prompt
FROM changed f JOIN contents c ON f.review_id = c.review_id AND f.path = c.path
LEFT JOIN details t ON f.review_id = t.review_id AND f.path = t.path
LEFT JOIN contexts x ON f.review_id = x.review_id AND f.path = x.path
WHERE c.content <> ''"""
BODIES["llm_findings"] = """
SELECT review_id, 'ai-' || CAST(row_number() OVER (PARTITION BY review_id
  ORDER BY file_ord, pos) AS VARCHAR) AS finding_id, path, line, line_given, severity, message, suggestion
FROM found_ai"""
BODIES["ai_review_rollup"] = rollup("risky_both")


ARRIVED = ("console", "debugger", "secrets", "todos", "large", "any", "directive")
BODIES["streamed_findings"] = "\nUNION ALL ".join(
    f"SELECT a.review_id || '/' || CAST(d.doc_id AS VARCHAR) AS review_id, a.path,"
    f" CAST(line AS BIGINT) AS line, severity, rule, message"
    f" FROM arrived_{name} a JOIN docs d ON a.path = d.path"
    for name in ARRIVED
)
BODIES["arriving_file_findings"] = "\nUNION ALL ".join(
    f"SELECT review_id, path, CAST(line AS BIGINT) AS line, severity, rule, message FROM arrived_{name}"
    for name in ARRIVED
)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        sql = STEPS.query(body)
        # a body with its own WITH continues the list of steps
        out[name] = sql.replace("\n)\nWITH ", "\n),\n", 1) if body.strip().startswith("WITH") else sql
    return out
