"""Completion of statements: what can come next, the likeliest first."""

from __future__ import annotations

import re

from quarry.plans.diagnostics import KEYWORDS

# Functions and operators that are offered.
FUNCTIONS = (
    "COUNT", "SUM", "AVG", "MAX", "MIN", "UPPER", "LOWER", "LENGTH", "TRIM", "SUBSTRING", "CONCAT", "NOW", "DATE", "TIME", "YEAR", "MONTH", "DAY", "ABS", "ROUND", "CEIL", "FLOOR", "IF", "COALESCE",
)
OPERATORS = ("=", "<>", ">", "<", ">=", "<=", "LIKE", "IN", "BETWEEN", "IS NULL", "IS NOT NULL", "AND", "OR")


def context(before: str) -> str:
    """table, join, column, operator, function or keyword: what the place after ``before`` asks for."""
    text = re.sub(r"\w*$", "", before)
    if re.search(r"\bon\s+$", text, re.I):
        return "join"
    if re.search(r"\b(from|join|into|update|table|describe)\s+$", text, re.I):
        return "table"
    if re.search(r"\b(select|where|and|or|by|set|having)\s+$|,\s*$|\(\s*$|(=|<|>)\s*$", text, re.I):
        return "column"
    if re.search(r"\b(where|and|or|having)\s+[\w.]+\s+$", text, re.I):
        return "operator"
    return "keyword"


def complete(before: str, tables: dict[str, list[str]]) -> list[tuple[str, str, float]]:
    """(text, kind, confidence) that may follow."""
    prefix = re.search(r"\w*$", before)[0].lower()
    kind = context(before)
    named = [t for t in tables if re.search(rf"\b{re.escape(t)}\b", before, re.I)]
    offers: list[tuple[str, str, float]] = []
    if kind == "join":
        offers += join_conditions(named, tables)
    if kind == "table":
        offers += [(t, "table", 0.9) for t in tables]
    if kind == "column":
        offers += [(c, "column", 0.9 if t in named else 0.6) for t in (named or tables) for c in tables[t]]
        offers += [(f, "function", 0.7) for f in FUNCTIONS]
    if kind == "operator":
        offers += [(o, "operator", 0.8) for o in OPERATORS]
    offers += [(k, "keyword", 0.8 if kind == "keyword" else 0.3) for k in KEYWORDS]
    best: dict[str, tuple[str, str, float]] = {}
    for text, what, sure in offers:
        if text.lower().startswith(prefix) and sure > best.get(text.lower(), ("", "", 0))[2]:
            best[text.lower()] = (text, what, sure)
    return sorted(best.values(), key=lambda x: (-x[2], x[0]))


def join_conditions(named: list[str], tables: dict[str, list[str]]) -> list[tuple[str, str, float]]:
    """Conditions that the last two tables could be joined by: the same key name, a table's name with id, common columns."""
    if len(named) < 2:
        return []
    a, b = named[-2:]
    out = []
    for x in tables[a]:
        for y in tables[b]:
            same = x.lower() == y.lower()
            key = x.lower().endswith(("id", "key"))
            tail = re.sub(r"^[a-z]_", "", x.lower()) == re.sub(r"^[a-z]_", "", y.lower())
            sure = 0.95 if same and key else 0.9 if tail and key else 0.8 if y.lower() in (f"{a.lower()}_id", f"{a.lower().rstrip('s')}_id") and x.lower() == "id" else 0.6 if same else 0
            if sure:
                out.append((f"{a}.{x} = {b}.{y}", "join", sure))
    return out
