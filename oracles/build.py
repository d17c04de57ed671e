"""Named SQL steps and the queries composed from those they need."""

from __future__ import annotations

import re


class Steps:
    """Common table expressions by name, in the order they were added."""

    def __init__(self) -> None:
        self.bodies: dict[str, str] = {}

    def add(self, name: str, body: str) -> None:
        self.bodies[name] = body.strip()

    def _needed(self, body: str, found: set[str]) -> None:
        for name in self.bodies:
            if name not in found and re.search(rf"\b{name}\b", body):
                found.add(name)
                self._needed(self.bodies[name], found)

    def query(self, body: str) -> str:
        """``body`` preceded by the steps it reads, directly or not."""
        found: set[str] = set()
        self._needed(body, found)
        steps = [
            f"{name} AS MATERIALIZED (\n{text}\n)"
            for name, text in self.bodies.items()
            if name in found
        ]
        head = "WITH " + ",\n".join(steps) + "\n" if steps else ""
        return head + body.strip()


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def texts(values: tuple[str, ...]) -> str:
    """A SQL list of string literals."""
    return "[" + ", ".join(text(v) for v in values) + "]"
