"""File classes, computed once per file before its lines are exploded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchwell.functions import fixed_values as fv
from patchwell.functions.text import matches

#: gate columns that ``with_gates`` adds
GATES = ("is_code", "is_python", "is_typescript", "is_script", "secret_class")


def secret_class(path: Column) -> Column:
    """Which secret patterns apply to a file, or null for none."""
    chain = None
    for name, pattern in fv.SECRET_CLASSES:
        test = matches(path, pattern)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain


def gates(path: Column) -> list[Column]:
    """The gate columns of a file."""
    return [
        matches(path, fv.CODE_FILE).alias("is_code"),
        matches(path, fv.PYTHON_FILE).alias("is_python"),
        matches(path, fv.TYPESCRIPT_FILE).alias("is_typescript"),
        matches(path, fv.SCRIPT_FILE).alias("is_script"),
        secret_class(path).alias("secret_class"),
    ]


def is_scanned(is_code: Column, secret_kind: Column) -> Column:
    """Whether any rule can fire on the file (script files are code files)."""
    return is_code | secret_kind.isNotNull()
