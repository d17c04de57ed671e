"""The finding rules as Column expressions over one added line.

A rule is a set of functions from a ``Line`` (the columns of an added line and
the gates of its file) to Columns. All rules are evaluated in one pass; adding
one means adding a ``Rule`` to the list, no UDF is involved.

A rule has two tests. ``hint`` is cheap (a gate of the file and a literal search
on the raw bytes) and true on every line the rule can hit; it filters the lines
inside whole-stage code small enough for the JIT compiler. ``hit`` is exact and
only runs on what is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.functions.dialect import java
from patchwell.functions.text import capture, contains_any, contains_any_case, matches, trim
from patchwell.settings import ReviewSettings

Expr = Callable[["Line"], Column]


@dataclass(frozen=True)
class Line:
    """Columns a rule may read."""

    content: Column
    is_code: Column
    is_python: Column
    is_typescript: Column
    is_script: Column
    secret_class: Column

    @staticmethod
    def of_columns() -> "Line":
        names = ("content", "is_code", "is_python", "is_typescript", "is_script", "secret_class")
        return Line(*(F.col(n) for n in names))

    # expressions that several parts of a rule share, built once
    @cached_property
    def secret_label(self) -> Column:
        return secret_label(self.content, self.secret_class)

    @cached_property
    def env_key(self) -> Column:
        return F.when(self.secret_class == "code", env_key(self.content))

    @cached_property
    def directive(self) -> Column:
        return capture(self.content, fv.TS_DIRECTIVE, 1)

    @cached_property
    def python_breakpoint(self) -> Column:
        return matches(self.content, fv.SET_TRACE_CALL) | matches(
            self.content, fv.BREAKPOINT_CALL
        )


def text(value: str) -> Expr:
    return lambda line: F.lit(value)


def nothing(line: Line) -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Rule:
    """One rule: where it hits and what the finding says."""

    name: str
    analyzer: str
    hint: Expr
    hit: Expr
    severity: Expr
    message: Expr
    suggestion: Expr
    fix_kind: Expr = nothing
    fix_label: Expr = nothing
    fix_env_key: Expr = nothing
    #: place among a file's findings; None for that of a built-in analyzer
    place: int | None = None

    @property
    def order(self) -> int:
        return fv.ANALYZERS.index(self.analyzer) if self.place is None else self.place


#: findings of an assistant come after those of every rule
ASSISTANT_ORDER = 1 << 30


def _console_rules() -> list[Rule]:
    return [
        Rule(
            "console-script",
            "console-log",
            hint=lambda n: n.is_code & n.content.contains("console."),
            hit=lambda n: n.is_code & ~n.is_python & matches(n.content, fv.CONSOLE_CALL),
            severity=text("warning"),
            message=lambda n: F.concat(
                F.lit("console."), capture(n.content, fv.CONSOLE_CALL, 1), F.lit(" left in code")
            ),
            suggestion=text(fv.CONSOLE_SUGGESTION),
            fix_kind=text("remove-line"),
            fix_label=text(fv.CONSOLE_FIX),
        ),
        Rule(
            "console-python",
            "console-log",
            hint=lambda n: n.is_python & n.content.contains("print"),
            hit=lambda n: n.is_python
            & matches(n.content, fv.PRINT_CALL)
            & ~matches(n.content, fv.HASH_COMMENT),
            severity=text("warning"),
            message=text(fv.PRINT_MESSAGE),
            suggestion=text(fv.PRINT_SUGGESTION),
            fix_kind=text("remove-line"),
            fix_label=text(fv.PRINT_FIX),
        ),
    ]


def _debugger_rules() -> list[Rule]:
    return [
        Rule(
            "debugger-script",
            "debugger",
            hint=lambda n: n.is_code & n.content.contains("debugger"),
            hit=lambda n: n.is_code & ~n.is_python & matches(n.content, fv.DEBUGGER_WORD),
            severity=text("error"),
            message=text(fv.DEBUGGER_MESSAGE),
            suggestion=text(fv.DEBUGGER_SUGGESTION),
            fix_kind=text("remove-line"),
            fix_label=text(fv.DEBUGGER_FIX),
        ),
        Rule(
            "debugger-python-call",
            "debugger",
            hint=lambda n: n.is_python & contains_any(n.content, ("pdb", "breakpoint")),
            hit=lambda n: n.is_python & n.python_breakpoint,
            severity=text("error"),
            message=text(fv.BREAKPOINT_MESSAGE),
            suggestion=text(fv.BREAKPOINT_SUGGESTION),
            fix_kind=text("remove-line"),
            fix_label=text(fv.BREAKPOINT_FIX),
        ),
        Rule(
            "debugger-python-import",
            "debugger",
            hint=lambda n: n.is_python & n.content.contains("pdb"),
            hit=lambda n: n.is_python
            & matches(n.content, fv.PDB_IMPORT)
            & ~n.python_breakpoint,
            severity=text("warning"),
            message=text(fv.PDB_IMPORT_MESSAGE),
            suggestion=text(fv.PDB_IMPORT_SUGGESTION),
            fix_kind=text("remove-line"),
            fix_label=text(fv.PDB_IMPORT_FIX),
        ),
    ]


# Literals of which at least one occurs in every line that a secret pattern can
# match: in any letter case for the patterns of a class, as it is for the others.
CLASS_HINTS = (
    "key",
    "secret",
    "token",
    "passw",
    "pwd",
    "bearer",
    "auth",
    "identified",
    "curl",
    "value:",
    "://",
)
#: characters that assign a value, and the one word that does so without any;
#: only a Dockerfile can also set a value with a space
ASSIGNMENT_HINTS = ("=", ":", "'", "earer")
UNIVERSAL_HINTS = ("AKIA", "sk-", "_live_", "_test_", "ghp_", "PRIVATE KEY", "eyJ", "xox", "SG.")


def secret_label(content: Column, kind: Column) -> Column:
    """Label of the first pattern that matches, null if none does."""

    def first(patterns: tuple[fv.SecretPattern, ...]) -> Column:
        chain = None
        for p in patterns:
            test = matches(content, p.regex, p.any_case)
            chain = F.when(test, p.label) if chain is None else chain.when(test, p.label)
        return chain

    own = None
    for name, patterns in fv.SECRET_PATTERNS.items():
        scan = first(patterns)
        own = F.when(kind == name, scan) if own is None else own.when(kind == name, scan)
    universal = F.when(contains_any(content, UNIVERSAL_HINTS), first(fv.UNIVERSAL_SECRETS))
    return F.coalesce(own, universal)


def may_hold_secret(content: Column, kind: Column) -> Column:
    """False only on lines that no secret pattern of the class matches."""
    assigns = (kind == "docker") | contains_any(content, ASSIGNMENT_HINTS)
    return (assigns & contains_any_case(content, CLASS_HINTS)) | contains_any(
        content, UNIVERSAL_HINTS
    )


def is_secret_comment(content: Column, kind: Column) -> Column:
    chain = None
    for name, pattern in fv.SECRET_COMMENTS.items():
        test = matches(content, pattern)
        chain = F.when(kind == name, test) if chain is None else chain.when(kind == name, test)
    return chain.otherwise(False)


def _secret_text(kind: Column, part: int) -> Column:
    """Text before the label (0), after it (1) or the suggestion (2) of a class."""
    chain = None
    for name, texts in fv.SECRET_TEXTS.items():
        same = kind == name
        chain = F.when(same, texts[part]) if chain is None else chain.when(same, texts[part])
    return chain


def env_key(content: Column) -> Column:
    """Suggested environment-variable name for a value assigned in code."""
    name = capture(content, fv.ENV_KEY_NAME, 1)
    snake = F.upper(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))
    return F.when(name != "", snake).otherwise(fv.ENV_KEY_DEFAULT)


def _secret_rules() -> list[Rule]:
    return [
        Rule(
            "secrets",
            "secrets",
            hint=lambda n: n.secret_class.isNotNull() & may_hold_secret(n.content, n.secret_class),
            hit=lambda n: n.secret_class.isNotNull()
            & n.secret_label.isNotNull()
            & ~is_secret_comment(n.content, n.secret_class),
            severity=text("error"),
            message=lambda n: F.concat(
                _secret_text(n.secret_class, 0),
                n.secret_label,
                _secret_text(n.secret_class, 1),
            ),
            suggestion=lambda n: _secret_text(n.secret_class, 2),
            fix_kind=lambda n: F.when(n.env_key.isNotNull(), "move-to-env"),
            fix_label=lambda n: F.concat(F.lit("Move to .env as "), n.env_key),
            fix_env_key=lambda n: n.env_key,
        )
    ]


TODO_HINTS = ("todo", "fixme", "hack", "xxx", "bug")


def _todo_rules() -> list[Rule]:
    def message(n: Line) -> Column:
        tag = F.upper(capture(n.content, fv.TODO_NOTE, 1, any_case=True))
        rest = trim(capture(n.content, fv.TODO_NOTE, 2, any_case=True))
        return F.concat(
            tag, F.lit(" comment: "), F.when(rest == "", fv.TODO_EMPTY).otherwise(rest)
        )

    return [
        Rule(
            "todos",
            "todos",
            hint=lambda n: n.is_code & contains_any_case(n.content, TODO_HINTS),
            hit=lambda n: n.is_code & matches(n.content, fv.TODO_NOTE, any_case=True),
            severity=text("info"),
            message=message,
            suggestion=text(fv.TODO_SUGGESTION),
        )
    ]


def _type_any_rules() -> list[Rule]:
    return [
        Rule(
            "type-any",
            "type-any",
            hint=lambda n: n.is_typescript & n.content.contains("any"),
            hit=lambda n: n.is_typescript & matches(n.content, fv.ANY_TYPE),
            severity=text("warning"),
            message=text(fv.ANY_MESSAGE),
            suggestion=text(fv.ANY_SUGGESTION),
        )
    ]


def _directive_rules() -> list[Rule]:
    return [
        Rule(
            "ts-directive",
            "ts-directive",
            hint=lambda n: n.is_script & n.content.contains("@ts-"),
            hit=lambda n: n.is_script & matches(n.content, fv.TS_DIRECTIVE),
            severity=lambda n: F.when(n.directive == "nocheck", "error").otherwise("warning"),
            message=lambda n: F.concat(
                F.lit("@ts-"), n.directive, F.lit(" suppresses type checking")
            ),
            suggestion=lambda n: F.when(
                n.directive == "expect-error", fv.EXPECT_ERROR_SUGGESTION
            ).otherwise(
                F.concat(
                    F.lit("Remove @ts-"), n.directive, F.lit(" and fix the type error instead.")
                )
            ),
            fix_kind=text("remove-line"),
            fix_label=lambda n: F.concat(F.lit("Remove @ts-"), n.directive, F.lit(" comment")),
        )
    ]


def line_rules(settings: ReviewSettings) -> list[Rule]:
    """The enabled line rules; a disabled one never enters the plan."""
    switches = [
        (settings.console_log, _console_rules),
        (settings.debugger, _debugger_rules),
        (settings.secrets, _secret_rules),
        (settings.todos, _todo_rules),
        (settings.type_any, _type_any_rules),
        (settings.ts_directive, _directive_rules),
    ]
    own = [rule for enabled, make in switches if enabled for rule in make()]
    return own + added_rules(settings)


def added_rules(settings: ReviewSettings) -> list[Rule]:
    """The rules a job adds to the built-in ones, placed after them in the order given.

    Their names must differ from each other and from those of all built-in rules, switched
    on or off; an analyzer may be a new one or a built-in one, but not the assistant's.
    """
    every = (_console_rules, _debugger_rules, _secret_rules, _todo_rules, _type_any_rules, _directive_rules)
    taken = {rule.name for make in every for rule in make()} | {LARGE_FUNCTIONS}
    placed = []
    for i, rule in enumerate(settings.added_rules):
        if rule.name in taken or not rule.name:
            raise ValueError(f"rule name {rule.name!r} is empty or taken")
        if rule.analyzer in ("", fv.AI_ANALYZER):
            raise ValueError(f"rule {rule.name!r} may not use the analyzer {rule.analyzer!r}")
        taken.add(rule.name)
        placed.append(replace(rule, place=len(fv.ANALYZERS) + i))
    return placed


# --- the large-block rule looks at a hunk, not a line -------------------------

LARGE_FUNCTIONS = "large-functions"


def block_name(first_lines: Column) -> Column:
    """Name of the function that seems to start in the text, else 'anonymous'."""

    def name(text: Column) -> Column:
        # the groups are those of the one match found, so they are read from it alone
        first, second, third = (capture(text, fv.FUNCTION_NAME, i) for i in (1, 2, 3))
        return (
            F.when(first != "", first)
            .when(second != "", second)
            .when(third != "", third)
            .otherwise("anonymous")
        )

    found = F.regexp_substr(first_lines, F.lit(java(fv.FUNCTION_NAME)))
    # as a lambda, so that the (costly) search runs once for all groups
    return F.transform(F.array(F.coalesce(found, F.lit(""))), name)[0]


def large_block_message(added: Column, name: Column) -> Column:
    where = F.when(name == "anonymous", "").otherwise(F.concat(F.lit(" in "), name))
    return F.concat(
        F.lit("Large change block ("),
        added.cast("string"),
        F.lit(" lines added"),
        where,
        F.lit(") — consider breaking this up"),
    )


def large_block_suggestion(threshold: int) -> Column:
    return F.lit(
        f"Functions over {threshold} lines are harder to review and test."
        " Consider extracting helpers."
    )


def redacted(content: Column, key: Column) -> Column:
    """The line with its first quoted value replaced by a variable, null if none."""
    found = matches(content, fv.QUOTED_VALUE)
    rewritten = F.regexp_replace(
        content,
        F.lit(r"(?s)^(.*?)['\"][^'\"]{8,}['\"](.*)\z"),
        F.concat(F.lit("$1process.env."), key, F.lit("$2")),
    )
    return F.when(found, rewritten)


def secret_hash(content: Column) -> Column:
    """SHA-256 of the first quoted value, null if there is none."""
    return F.when(
        matches(content, fv.QUOTED_VALUE),
        F.sha2(capture(content, fv.QUOTED_VALUE, 1), 256),
    )
