"""What each rule finds, and what it does not."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.functions import rules
from patchwell.functions.dialect import java, re2
from patchwell.operators import diff, findings
from patchwell.plans.review import ReviewInputs, review_findings
from patchwell.settings import ReviewSettings
from tests.tables import added, raw_diffs, rows, section, snapshots

LONG = "abcdefgh" + "12345678"
GH = "ghp_" + "a1B2" * 9
NBSP = "\u00a0"

# (path, line, expected (rule, severity, message) list)
CASES = [
    ("a.ts", "console.log('x')", [("console-script", "warning", "console.log left in code")]),
    ("a.ts", f"  console.table{NBSP}(x)", [("console-script", "warning", "console.table left in code")]),
    ("a.ts", "\u00e9console.log(1)", [("console-script", "warning", "console.log left in code")]),
    ("a.ts", "myconsole.log(1); console.time(2)", []),
    ("a.ts", "console.info(1); console.dir(2)", [("console-script", "warning", "console.info left in code")]),
    ("a.ts", "print(1)", []),
    ("a.TS", "console.log(1)", []),
    ("a.md", "console.log(1)", []),
    ("a.ts\t", "console.log(1)", []),
    ("a.py", "print (x)", [("console-python", "warning", "print() statement left in code")]),
    ("a.py", "x = 1  # print(x)", [("console-python", "warning", "print() statement left in code")]),
    ("a.py", f"{NBSP}# print(x)", []),
    ("a.py", "console.log(x); pprint(x)", []),
    ("a.go", "// the debugger is here", [("debugger-script", "error", "debugger statement left in code")]),
    ("a.js", "debuggers; mydebugger", []),
    ("a.py", "debugger", []),
    ("a.py", "import pdb; pdb.set_trace()", [("debugger-python-call", "error", "Python debugger breakpoint left in code")]),
    ("a.py", "breakpoint ()", [("debugger-python-call", "error", "Python debugger breakpoint left in code")]),
    ("a.py", "import  pdb", [("debugger-python-import", "warning", "pdb import left in code")]),
    ("a.py", "import pdbpp", []),
    ("a.rb", "# todo: fix  it ", [("todos", "info", "TODO comment: fix  it")]),
    ("a.rb", f"# FIXME:{NBSP}", [("todos", "info", "FIXME comment: (no description)")]),
    ("a.rb", "# Hack::  a\rb", [("todos", "info", "HACK comment: a")]),
    ("a.rb", "# debug TODOS xxxx", []),
    ("a.json", "TODO", []),
    ("a.ts", "let x: any = 1", [("type-any", "warning", "Type `any` used — weakens type safety")]),
    ("a.tsx", f"f(x:{NBSP}any)", [("type-any", "warning", "Type `any` used — weakens type safety")]),
    ("a.mts", "let x: any", []),
    ("a.ts", "let x: anything", []),
    ("a.mjs", "// @ts-ignore", [("ts-directive", "warning", "@ts-ignore suppresses type checking")]),
    ("a.js", "// @ts-nocheck", [("ts-directive", "error", "@ts-nocheck suppresses type checking")]),
    ("a.cts", "// @ts-expect-error x", [("ts-directive", "warning", "@ts-expect-error suppresses type checking")]),
    ("a.vue", "// @ts-ignore", []),
    ("a.ts", "debugger; console.log(1)", [
        ("console-script", "warning", "console.log left in code"),
        ("debugger-script", "error", "debugger statement left in code"),
    ]),
]

SECRETS = [
    ("a.ts", f"const apiKey = '{LONG}'", "Possible hardcoded API key detected"),
    ("a.ts", f'PASSWORD: "{LONG}"', "Possible hardcoded Secret/password detected"),
    ("a.ts", "token = 'short'", None),
    ("a.ts", f"auth Bearer {LONG}{LONG}", "Possible hardcoded Bearer token detected"),
    ("a.ts", f"auth BEARER {LONG}{LONG}", None),
    ("a.ts", f"// secret = '{LONG}'", "Possible hardcoded Secret/password detected"),
    ("a.py", f"k = '{GH}'", "Possible hardcoded GitHub personal access token detected"),
    ("a.rs", "AKIA" + "A1B2" * 4, "Possible hardcoded AWS Access Key detected"),
    ("a.rs", "sk-" + "a1" * 10, "Possible hardcoded API secret key detected"),
    ("a.rs", "-----BEGIN EC " + "PRIVATE KEY-----", "Possible hardcoded Private key detected"),
    ("a.rs", "-----BEGIN " + "PRIVATE KEY-----", "Possible hardcoded Private key detected"),
    ("a.rs", "eyJ" + "a1.eyJ" + "b2.c3", "Possible hardcoded JWT token detected"),
    ("a.rs", "xoxb-" + "1" * 10, "Possible hardcoded Slack token detected"),
    ("a.rs", "SG." + "a" * 22 + "." + "b" * 22, "Possible hardcoded SendGrid API key detected"),
    (".env", f"MY_KEY={LONG}", "Possible Secret/credential committed in .env file"),
    (".env.local", f"DATABASE_URL=pg://u:{'p' * 4}@h", "Possible Database connection string with password committed in .env file"),
    (".env", f" MY_KEY={LONG}", None),
    (".env", f"# {GH}", None),
    ("config.env.json", f"MY_KEY={LONG}", "Possible Secret/credential committed in .env file"),
    ("ci.yml", f"password: {LONG}", "Secret in YAML — secret in CI/CD or config YAML"),
    ("ci.yaml", "POSTGRES_PASSWORD: 'x'", "Database password in YAML — secret in CI/CD or config YAML"),
    ("ci.yaml", f"--build-arg MY_KEY={LONG}", "Secret in build argument — secret in CI/CD or config YAML"),
    ("ci.yaml", f"Authorization: {LONG}{LONG}", "Auth header in YAML — secret in CI/CD or config YAML"),
    ("ci.yaml", f"value: {LONG}{LONG}{NBSP}", "Potential secret value — secret in CI/CD or config YAML"),
    ("ci.yaml", f"  # password: {LONG}", None),
    ("Dockerfile.ts", f"ARG BUILD_TOKEN={LONG}", "Secret in Docker ARG/ENV — secret exposed in Dockerfile"),
    ("my/Dockerfile", f"ENV DB_PWD {LONG}", "Secret in Docker ARG/ENV — secret exposed in Dockerfile"),
    ("Dockerfile", f"RUN curl x -H token={LONG}", "Auth token in curl command — secret exposed in Dockerfile"),
    ("q.sql", f"IDENTIFIED BY '{LONG}'", None),
    ("q.sql", f"identified by = '{LONG}'", "SQL password — credential in SQL file"),
    ("q.sql", 'pwd = "abcdef"', "Connection password in SQL — credential in SQL file"),
    ("q.sql", "x://user:" + "abcdef@h", "Connection string with password — credential in SQL file"),
    ("q.sql", f"-- password = '{LONG}'", None),
    ("p.json", f'"api_key": "{LONG}"', "Secret in JSON — credential in JSON config"),
    ("p.json", '"redis-url": "redis://u:' + 'p@h"', "Connection string with credentials — credential in JSON config"),
    ("a.md", GH, None),
    (".dockerignore", GH, None),
]


def found(spark, cases, config=ReviewSettings()):
    """Findings by case; every case is a review of its own."""
    given = raw_diffs(
        spark, *[(f"{i}", "staged", added(c[0], c[1], "end")) for i, c in enumerate(cases)]
    )
    lines = diff.reviewable_diff_lines(diff.file_sections(given), config.large_hunk)
    out = {i: [] for i in range(len(cases))}
    order = ("review_id", "analyzer_ord", "pos")
    for r in findings.static_findings(lines, config).orderBy(*order).collect():
        out[int(r.review_id)].append(r)
    return out


def test_quality_rules(spark):
    got = found(spark, CASES)
    for i, (path, line, expected) in enumerate(CASES):
        shown = [(r.rule, r.severity, r.message) for r in got[i] if r.rule != "secrets"]
        assert shown == expected, (path, line)


def test_secret_rule(spark):
    got = found(spark, SECRETS)
    for i, (path, line, message) in enumerate(SECRETS):
        shown = [r.message for r in got[i] if r.analyzer == "secrets"]
        assert shown == ([message] if message else []), (path, line)


def test_fixes_and_suggestions(spark):
    got = found(
        spark,
        [
            ("a.ts", f"const myApiKey = '{LONG}'"),
            ("a.ts", f"apikey: '{LONG}'"),
            ("ci.yml", f"token: {LONG}"),
            ("a.ts", "// @ts-expect-error"),
            ("a.ts", GH),
            ("a.ts", "let HTTPServer2Key = 1; const pwd = '" + LONG + "'"),
            # the closing quote of one value opens the first long enough one
            ("a.ts", "let k = 'x'; const pwd = '" + LONG + "'"),
        ],
    )
    fixes = [(r.fix_kind, r.fix_label, r.fix_env_key) for i in range(7) for r in got[i]]
    assert fixes == [
        ("move-to-env", "Move to .env as MY_API_KEY", "MY_API_KEY"),
        ("move-to-env", "Move to .env as SECRET_VALUE", "SECRET_VALUE"),
        (None, None, None),
        ("remove-line", "Remove @ts-expect-error comment", None),
        ("move-to-env", "Move to .env as SECRET_VALUE", "SECRET_VALUE"),
        ("move-to-env", "Move to .env as HTTPSERVER2KEY", "HTTPSERVER2KEY"),
        ("move-to-env", "Move to .env as K", "K"),
    ]
    assert [r.redacted_text for i in range(7) for r in got[i]] == [
        "const myApiKey = process.env.MY_API_KEY",
        "apikey: process.env.SECRET_VALUE",
        None,
        None,
        None,
        "let HTTPServer2Key = 1; const pwd = process.env.HTTPSERVER2KEY",
        f"let k = 'xprocess.env.K{LONG}'",
    ]
    assert got[3][0].suggestion == fv.EXPECT_ERROR_SUGGESTION


def large(spark, text, path="a.ts", threshold=3):
    given = raw_diffs(spark, ("r", "staged", section(path, text)))
    lines = diff.reviewable_diff_lines(diff.file_sections(given), threshold)
    return rows(
        findings.static_findings(lines, ReviewSettings(large_hunk=threshold)).filter(
            "analyzer = 'large-functions'"
        ),
        "line",
        "end_line",
        "message",
    )


@pytest.mark.parametrize(
    ("first", "name"),
    [
        ("+function run(x) {", " in run"),
        ("+const go = async (x) => 1", " in go"),
        ("+  if (x) {", " in if"),
        ("-var f = function () {", " in f"),
        ("\\ No newline at end of file\n+call(a,\n+b) {", " in call"),
        ("+plain text", ""),
    ],
)
def test_large_block_names(spark, first, name):
    text = f"@@ -1,9 +7,4 @@\n{first}\n+1\n+2\n+3"
    [(line, end_line, message)] = large(spark, text)
    assert (line, end_line) == (7, 11)
    assert re.fullmatch(rf"Large change block \(\d lines added{name}\) — .*", message)


def test_large_block_threshold_counts_added_lines_of_one_hunk(spark):
    assert large(spark, "@@ -1 +1,2 @@\n+a\n+b\n-c\n d\n@@ -9 +9 @@\n+e") == []
    assert len(large(spark, "@@ -1 +1,3 @@\n+a\n+b\n-c\n d\n+e")) == 1
    assert large(spark, "@@ -1 +1,3 @@\n+a\n+b\n+c", path="a.md") == []
    late = "@@ -1 +1,9 @@\n x\n x\n x\n x\n x\n+function late() {\n+1\n+2"
    assert "late" not in large(spark, late)[0][2]
    body = "\n".join(["+x"] * 50)
    assert large(spark, f"@@ -0,0 +1,49 @@\n{body[:-3]}", threshold=50) == []
    assert large(spark, f"@@ -0,0 +1,50 @@\n{body}", threshold=50)[0][:2] == (1, 51)


def test_switches_leave_rules_out(spark):
    case = [("a.ts", f"debugger; console.log('{GH}') // TODO @ts-nocheck : any")]
    everything = {r.analyzer for r in found(spark, case, ReviewSettings(large_hunk=1))[0]}
    assert everything == set(fv.ANALYZERS)
    for switch, analyzer in {
        "console_log": "console-log",
        "debugger": "debugger",
        "secrets": "secrets",
        "todos": "todos",
        "large_functions": "large-functions",
        "type_any": "type-any",
        "ts_directive": "ts-directive",
    }.items():
        config = ReviewSettings(large_hunk=1, **{switch: False})
        assert {r.analyzer for r in found(spark, case, config)[0]} == everything - {analyzer}
    assert found(spark, case, ReviewSettings(*[False] * 7, large_hunk=1))[0] == []


def test_only_added_lines_and_covered_snapshots(spark):
    text = section("a.ts", "@@ -1,2 +1,2 @@\n-debugger\n debugger\n+fine")
    files = snapshots(
        spark,
        ("r", "a.ts", "debugger", "untracked"),
        ("r", "b.ts", "x\ndebugger", "untracked"),
        ("r", "b.ts", "debugger", "staged_list"),
        ("r", "c.ts", "debugger", "staged_list"),
        ("r", "d.ts", "debugger", "reviewed"),
    )
    reviews = spark.createDataFrame([("repo", "r", None)], "repo string, review_id string, ts timestamp_ntz")
    given = ReviewInputs(raw_diffs(spark, ("r", "staged", text)), files, reviews)
    assert rows(review_findings(given), "path", "line", "rule") == [
        ("b.ts", 2, "debugger-script"),
        ("c.ts", 1, "debugger-script"),
    ]


PATTERNS = [(k, p) for k, own in fv.SECRET_PATTERNS.items() for p in own] + [
    ("code", p) for p in fv.UNIVERSAL_SECRETS
]


@pytest.mark.parametrize(("kind", "pattern"), PATTERNS, ids=lambda p: getattr(p, "label", p))
@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_hints_hold_for_whatever_a_secret_pattern_matches(kind, pattern, data):
    # ASCII letters only: ECMAScript folds no others onto them
    flags = re.IGNORECASE | re.ASCII if pattern.any_case else re.ASCII
    line = data.draw(st.from_regex(re.compile(pattern.regex, flags)))
    if re.search(pattern.regex, line, flags):
        assigns = kind == "docker" or any(h in line for h in rules.ASSIGNMENT_HINTS)
        own = assigns and any(h in line.lower() for h in rules.CLASS_HINTS)
        assert own or any(h in line for h in rules.UNIVERSAL_HINTS)


def test_dialects_spell_out_what_differs():
    assert java(r"\bx\s$") == r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))x[" + (
        r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]\z"
    )
    assert java(r"[.$\s]\.", any_case=True).startswith("(?i)[.$")
    assert re2(r"\b.") == r"\b[^\n\r\x{2028}\x{2029}]"


def test_white_space_is_that_of_ecmascript(spark):
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF]
    table = spark.createDataFrame([(c,) for c in chars], "c string")
    found = table.filter(F.rlike("c", F.lit(java(r"^\s$")))).collect()
    assert sorted(r.c for r in found) == sorted(fv.WHITE_SPACE)


def test_added_rules_from_lines_to_ids(spark):
    def rule(name, analyzer, word):
        return rules.Rule(
            name, analyzer,
            hint=lambda n: n.content.contains(word), hit=lambda n: n.content.contains(word),
            severity=rules.text("error"), message=rules.text(f"{word}!"), suggestion=rules.text("no"),
        )

    own = ReviewSettings(added_rules=(rule("r-two", "own", "two"), rule("r-one", "own", "one"), rule("r-log", "console-log", "log")))
    given = ReviewInputs(
        raw_diffs(spark, ("r", "staged", added("a.ts", "one two", "console.log(1)", "three"))),
        snapshots(spark), None,
    )
    out = findings.number_findings(review_findings(given, own))
    assert rows(out, "finding_id", "rule", "line", "severity") == [
        ("console-log-1", "console-script", 2, "warning"),
        ("console-log-4", "r-log", 2, "error"),
        ("own-2", "r-two", 1, "error"),
        ("own-3", "r-one", 1, "error"),
    ]
    assert rows(review_findings(given), "rule") == [("console-script",)]
    for bad in ((rule("type-any", "own", "x"),), (rule("", "own", "x"),), (rule("a", "b", "x"), rule("a", "c", "y")), (rule("a", fv.AI_ANALYZER, "x"),)):
        with pytest.raises(ValueError):
            rules.line_rules(ReviewSettings(added_rules=bad))
