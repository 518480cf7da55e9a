"""Assembles WITH chains from named steps."""

from __future__ import annotations

import re

STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql.strip()


def needed(sql: str) -> list[str]:
    """Steps a text refers to, and theirs, in the order they were defined."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in STEPS:
            if name in words and name not in found:
                found.add(name)
                todo.append(STEPS[name])
    return [name for name in STEPS if name in found]


KINDS = {
    "i": "CAST({c} AS BIGINT)",
    "d": "round(CAST({c} AS DOUBLE), 6)",
    "s": "CAST({c} AS VARCHAR)",
    "y": "CAST(CAST({c} AS DATE) AS VARCHAR)",
    "b": "CAST({c} AS BOOLEAN)",
}


def answer(columns: str, body: str) -> str:
    """Full statement: the body's columns in shared types (i, d, s, y, b)."""
    outs = []
    for spec in columns.split():
        kind, names = spec.split(":")
        outs += [f"{KINDS[kind].format(c=c)} AS {c}" for c in names.split(",")]
    steps = ",\n".join(f"{name} AS (\n{STEPS[name]}\n)" for name in needed(body))
    head = f"WITH {steps}\n" if steps else ""
    return f"{head}SELECT {', '.join(outs)} FROM (\n{body.strip()}\n) AS answer"
