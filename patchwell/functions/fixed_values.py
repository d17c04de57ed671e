"""Results are only right if these are exactly as stated.

Patterns use ECMAScript notation; ``dialect.java`` turns one into the same
pattern for Spark's regular-expression functions.
"""

from __future__ import annotations

from typing import NamedTuple

# White space as ECMAScript defines it (used by trim and \s).
WHITE_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Diff channels and snapshot origins, in merge order.
CHANNELS = ("staged", "unstaged")
ORIGINS = ("untracked", "staged_list")

# File classes.
CODE_FILE = (
    r"\.(js|jsx|ts|tsx|mjs|cjs|mts|cts|vue|svelte|py|rb|go|rs|java|kt|cs|c|cpp|h|hpp"
    r"|php|swift|sh|bash|zsh|ps1)$"
)
PYTHON_FILE = r"\.py$"
TYPESCRIPT_FILE = r"\.(ts|tsx)$"
SCRIPT_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs|mts|cts)$"
SECRET_CLASSES = (
    ("env", r"\.env(\..*)?$"),
    ("yaml", r"\.ya?ml$"),
    ("docker", r"Dockerfile"),
    ("sql", r"\.sql$"),
    ("json", r"\.json$"),
    ("code", CODE_FILE),
)
SENSITIVE_PATH = r"\b(auth|security|payment|middleware|session|crypto|login|token)\b"
CONFIG_FILE = r"\.(json|yml|yaml|toml|lock)$"

# Line patterns of the quality rules.
CONSOLE_CALL = r"\bconsole\.(log|warn|error|debug|info|trace|dir|table)\s*\("
PRINT_CALL = r"\bprint\s*\("
HASH_COMMENT = r"^\s*#"
DEBUGGER_WORD = r"\bdebugger\b"
SET_TRACE_CALL = r"\bpdb\.set_trace\s*\("
BREAKPOINT_CALL = r"\bbreakpoint\s*\("
PDB_IMPORT = r"\bimport\s+pdb\b"
TODO_NOTE = r"\b(TODO|FIXME|HACK|XXX|BUG)\b[:\s]*(.*)"
ANY_TYPE = r":\s*any\b"
TS_DIRECTIVE = r"@ts-(ignore|nocheck|expect-error)\b"
FUNCTION_NAME = (
    r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=.*(?:=>|\bfunction\b)"
    r"|(\w+)\s*\([^)]*\)\s*\{)"
)
FUNCTION_NAME_LINES = 5


class SecretPattern(NamedTuple):
    """One secret pattern; the label goes into the finding's message."""

    regex: str
    label: str
    any_case: bool = True


# Secret patterns. The first that matches a line names the finding;
# those of the file's class come before the universal ones.
SECRET_PATTERNS = {
    "code": (
        SecretPattern(r"(?:api[_-]?key|apikey)\s*[:=]\s*['\"][^'\"]{8,}['\"]", "API key"),
        SecretPattern(
            r"(?:secret|token|password|passwd|pwd)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
            "Secret/password",
        ),
        SecretPattern(r"(?:Bearer|bearer)\s+[a-zA-Z0-9\-_.]{20,}", "Bearer token", False),
    ),
    "env": (
        SecretPattern(
            r"^[A-Z_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|PWD|KEY|APIKEY|API_KEY)[A-Z_]*"
            r"\s*=\s*\S{8,}",
            "Secret/credential",
        ),
        SecretPattern(
            r"^DATABASE_URL\s*=\s*\S+:\/\/\S+:\S+@",
            "Database connection string with password",
        ),
    ),
    "yaml": (
        SecretPattern(
            r"(?:password|passwd|secret|token|api_?key|apikey)\s*:\s*['\"]?[^'\"#\s]{8,}",
            "Secret in YAML",
        ),
        SecretPattern(
            r"(?:POSTGRES_PASSWORD|MYSQL_ROOT_PASSWORD|MYSQL_PASSWORD|REDIS_PASSWORD)"
            r"\s*:\s*\S+",
            "Database password in YAML",
        ),
        SecretPattern(
            r"(?:--build-arg|ARG)\s+\w*(?:SECRET|TOKEN|PASSWORD|KEY)\w*\s*=\s*\S{8,}",
            "Secret in build argument",
        ),
        SecretPattern(
            r"(?:Authorization|Bearer)\s*:\s*['\"]?[a-zA-Z0-9\-_.]{20,}",
            "Auth header in YAML",
        ),
        SecretPattern(
            r"value:\s*['\"]?[a-zA-Z0-9\-_.]{20,}['\"]?\s*$", "Potential secret value"
        ),
    ),
    "docker": (
        SecretPattern(
            r"(?:ARG|ENV)\s+\w*(?:SECRET|TOKEN|PASSWORD|PASSWD|PWD|KEY|APIKEY|API_KEY)\w*"
            r"\s*=\s*\S{8,}",
            "Secret in Docker ARG/ENV",
        ),
        SecretPattern(
            r"(?:ARG|ENV)\s+\w*(?:SECRET|TOKEN|PASSWORD|PASSWD|PWD|KEY|APIKEY|API_KEY)\w*"
            r"\s+\S{8,}",
            "Secret in Docker ARG/ENV",
        ),
        SecretPattern(
            r"curl\s.*(?:Authorization|Bearer|token)\s*[:=]\s*\S{8,}",
            "Auth token in curl command",
        ),
    ),
    "sql": (
        SecretPattern(
            r"(?:PASSWORD|IDENTIFIED\s+BY)\s*(?:=|')\s*'[^']{6,}'", "SQL password"
        ),
        SecretPattern(
            r"(?:password|passwd|pwd)\s*=\s*['\"][^'\"]{6,}['\"]",
            "Connection password in SQL",
        ),
        SecretPattern(r":\/\/\w+:[^@\s]{6,}@", "Connection string with password"),
    ),
    "json": (
        SecretPattern(
            r"[\"'](?:api[_-]?key|apikey|secret|token|password|passwd|pwd|auth)[\"']"
            r"\s*:\s*[\"'][^\"']{8,}[\"']",
            "Secret in JSON",
        ),
        SecretPattern(
            r"[\"'](?:connection[_-]?string|database[_-]?url|redis[_-]?url)[\"']"
            r"\s*:\s*[\"'][^\"']*:\/\/\w+:[^@\"']+@",
            "Connection string with credentials",
        ),
    ),
}
UNIVERSAL_SECRETS = (
    SecretPattern(r"AKIA[0-9A-Z]{16}", "AWS Access Key", False),
    SecretPattern(
        r"(?:sk-|pk_live_|sk_live_|pk_test_|sk_test_)[a-zA-Z0-9]{20,}",
        "API secret key",
        False,
    ),
    SecretPattern(r"ghp_[a-zA-Z0-9]{36}", "GitHub personal access token", False),
    SecretPattern(r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", "Private key", False),
    SecretPattern(
        r"eyJ[a-zA-Z0-9\-_]+\.eyJ[a-zA-Z0-9\-_]+\.[a-zA-Z0-9\-_]+", "JWT token", False
    ),
    SecretPattern(r"xox[bpsar]-[a-zA-Z0-9\-]{10,}", "Slack token", False),
    SecretPattern(
        r"SG\.[a-zA-Z0-9\-_]{22,}\.[a-zA-Z0-9\-_]{22,}", "SendGrid API key", False
    ),
)
SECRET_COMMENTS = {
    "env": r"^\s*(#|$)",
    "yaml": r"^\s*#",
    "docker": r"^\s*#",
    "sql": r"^\s*--",
}
ENV_KEY_NAME = r"(?:const|let|var)\s+(\w+)"
ENV_KEY_DEFAULT = "SECRET_VALUE"
QUOTED_VALUE = r"['\"]([^'\"]{8,})['\"]"
IGNORE_FILE = ".gitignore"
IGNORE_ENTRY = ".env"

# Message around the label, and suggestion, by file class.
SECRET_TEXTS = {
    "env": (
        "Possible ",
        " committed in .env file",
        "Ensure .env is in .gitignore and never committed to version control.",
    ),
    "yaml": (
        "",
        " — secret in CI/CD or config YAML",
        "Use variable substitution, sealed secrets, or a secrets manager instead of"
        " hardcoding.",
    ),
    "docker": (
        "",
        " — secret exposed in Dockerfile",
        "Use --secret flag, multi-stage builds, or runtime env variables instead of"
        " build-time secrets.",
    ),
    "sql": (
        "",
        " — credential in SQL file",
        "Use parameterized connections or environment variables. Never commit passwords"
        " in SQL scripts.",
    ),
    "json": (
        "",
        " — credential in JSON config",
        "Move sensitive values to environment variables or a secrets manager.",
    ),
    "code": (
        "Possible hardcoded ",
        " detected",
        "Move this to an environment variable.",
    ),
}

# Texts of the quality rules.
CONSOLE_SUGGESTION = "Remove before pushing, or use a proper logging utility."
CONSOLE_FIX = "Remove this console statement"
PRINT_MESSAGE = "print() statement left in code"
PRINT_SUGGESTION = "Remove before pushing, or use the logging module."
PRINT_FIX = "Remove this print statement"
DEBUGGER_MESSAGE = "debugger statement left in code"
DEBUGGER_SUGGESTION = "Remove the debugger statement before pushing."
DEBUGGER_FIX = "Remove debugger statement"
BREAKPOINT_MESSAGE = "Python debugger breakpoint left in code"
BREAKPOINT_SUGGESTION = "Remove pdb/breakpoint() before pushing."
BREAKPOINT_FIX = "Remove debugger breakpoint"
PDB_IMPORT_MESSAGE = "pdb import left in code"
PDB_IMPORT_SUGGESTION = "Remove the pdb import before pushing."
PDB_IMPORT_FIX = "Remove pdb import"
TODO_EMPTY = "(no description)"
TODO_SUGGESTION = "Resolve this before pushing, or create a tracking issue."
ANY_MESSAGE = "Type `any` used — weakens type safety"
ANY_SUGGESTION = "Use a specific type, `unknown`, or a generic instead."
EXPECT_ERROR_SUGGESTION = (
    "Acceptable for tests, but fix the underlying type issue when possible."
)

# Severity weights of the score, and risk order.
SEVERITY_WEIGHTS = {"error": 15, "warning": 5, "info": 1}
RISK_ORDER = ("high", "medium", "low", "info")

# Report texts.
EMPTY_REPORT = "No changes detected."
REPORT_STATUS_TITLES = (
    ("added", "New Files"),
    ("modified", "Modified Files"),
    ("deleted", "Deleted Files"),
    ("renamed", "Renamed Files"),
)
SEVERITY_ICONS = {"error": "🔴", "warning": "🟡"}
OTHER_ICON = "🔵"

# Analyzers in the order in which they run.
ANALYZERS = (
    "console-log",
    "debugger",
    "secrets",
    "todos",
    "large-functions",
    "type-any",
    "ts-directive",
)
AI_ANALYZER = "ai-review"

# Prompt format, lines before and after a hunk shown as context.
CONTEXT_LINES = 5
CONTEXT_MARK = ">>>"
CONTEXT_BLANK = "   "
CONTEXT_BREAK = "\n---\n"
PROMPT_FORMAT = """You are a code reviewer. Review the following changes in "{path}" for bugs, edge cases, security issues, and improvements.

FILE: {path}
STATUS: {status}
ADDITIONS: {additions} lines
DELETIONS: {deletions} lines

CHANGES (+ = added, - = removed):
{changes}

CODE CONTEXT (>>> marks changed lines):
{context}

Respond ONLY with a JSON array of issues. Each issue must have:
- "line": number (the line number in the new file)
- "severity": "error" | "warning" | "info"
- "message": string (concise description of the issue)
- "suggestion": string (how to fix it)

If there are no issues, respond with an empty array: []
Do NOT include any text outside the JSON array."""
