"""Questions in simple English or Chinese to SQL, by patterns over known tables and columns; no network."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Words of questions and what they mean.
FUNCTIONS = {
    "AVG": ("average", "mean", "avg", "平均"),
    "SUM": ("total", "sum", "总和", "合计", "总"),
    "MAX": ("maximum", "highest", "largest", "max", "最大", "最高"),
    "MIN": ("minimum", "lowest", "smallest", "min", "最小", "最低"),
    "COUNT": ("how many", "number of", "count", "多少", "数量", "个数"),
}
COMPARISONS = (
    (">=", ("at least", "not less than", "大于等于", "至少")),
    ("<=", ("at most", "not more than", "小于等于", "至多")),
    (">", ("greater than", "more than", "above", "over", "大于", "高于", "超过")),
    ("<", ("less than", "below", "under", "小于", "低于")),
    ("<>", ("not equal to", "is not", "不等于")),
    ("=", ("equal to", "equals", "is", "等于", "是")),
)
GROUPS = ("grouped by", "group by", "per", "for each", "by", "按", "每个")


@dataclass
class Translation:
    sql: str
    confidence: float


def translate(question: str, tables: dict[str, list[str]]) -> Translation:
    """The SQL of a question and how sure it is; ValueError if no table is named.

    Questions may filter, aggregate, group, order, ask for the first rows, or
    for the rows of one table with those of another that shares a column with it;
    and ask to delete rows or to set a column.
    """
    text = question.strip().lower().rstrip("?？.。;；")
    words = re.findall(r"\w+", text)
    table = _table(text, words, tables)
    if changed := _change(text, table, tables):
        return changed
    if joined := _join(text, words, table, tables):
        return joined
    columns = {c.lower(): c for c in tables[table]}
    used = [columns[w] for w in re.findall(r"[A-Za-z_]\w*", text) if w in columns]
    order = _order(text, columns)
    text = order[0]
    used = [columns[w] for w in re.findall(r"[A-Za-z_]\w*", text) if w in columns]
    where, compared = _conditions(text, columns)
    group = _group(text, columns)
    sure = 0.9
    function = next((f for f, names in FUNCTIONS.items() if any(_has(text, n) for n in names)), None)
    if function:
        rest = [c for c in used if c not in compared and c != group]
        if function == "COUNT" or not rest:
            what = "COUNT(*)"
            sure -= 0.2 * (function != "COUNT")
        else:
            what = f"{function}({rest[0]})"
        select = f"{group}, {what}" if group else what
    else:
        shown = [c for c in dict.fromkeys(used) if c not in compared]
        select = ", ".join(shown) if shown and not re.search(r"\ball\b|所有|全部", text) else "*"
        group = None
    sql = f"SELECT {select} FROM {table}"
    if where:
        sql += " WHERE " + " AND ".join(where)
    if group and function:
        sql += f" GROUP BY {group}"
    return Translation(sql + order[1], sure)


def _order(text: str, columns: dict[str, str]) -> tuple[str, str]:
    """(the question without its order, ORDER BY and LIMIT)."""
    out, limit = "", re.search(r"\b(?:top|first)\s+(\d+)\b|前\s*(\d+)", text)
    m = re.search(r"(?:\b(?:sorted|ordered|order|sort)\s+by|按)\s*([a-z_]\w*)\s*(descending|desc|ascending|asc|降序|升序)?(?:\s*排序)?", text)
    if m and m[1] in columns and (m[0].isascii() or "序" in m[0]):
        out = f" ORDER BY {columns[m[1]]}{' DESC' if m[2] in ('descending', 'desc', '降序') else ''}"
        text = text[: m.start()] + text[m.end() :]
    elif limit and (m := re.search(r"\bby\s+([a-z_]\w*)", text)) and m[1] in columns:  # top 3 by a column: its greatest
        out = f" ORDER BY {columns[m[1]]} DESC"
        text = text[: m.start()] + text[m.end() :]
    if limit:
        out += f" LIMIT {limit[1] or limit[2]}"
        text = text.replace(limit[0], "")
    return text, out


def _literal(value: str) -> str:
    return f"'{value[1:-1]}'" if value[0] in "'\"" else value


def _change(text: str, table: str, tables: dict[str, list[str]]) -> Translation | None:
    """DELETE and UPDATE; without a condition the answer is less sure."""
    columns = {c.lower(): c for c in tables[table]}
    if re.match(r"(?:delete|remove|删除)", text):
        where, _ = _conditions(text, columns)
        return Translation(f"DELETE FROM {table}" + (" WHERE " + " AND ".join(where) if where else ""), 0.85 if where else 0.5)
    m = re.match(r"(?:set|change|update|更新)\s*(?:the\s+)?([a-z_]\w*)\s+(?:of|in)\s+\w+\s+to\s+(-?\d+(?:\.\d+)?|'[^']*'|\"[^\"]*\")(.*)", text)
    if m and m[1] in columns:
        where, _ = _conditions(m[3], columns)
        return Translation(f"UPDATE {table} SET {columns[m[1]]} = {_literal(m[2])}" + (" WHERE " + " AND ".join(where) if where else ""), 0.85 if where else 0.5)
    return None


def _join(text: str, words: list[str], table: str, tables: dict[str, list[str]]) -> Translation | None:
    """The rows of two tables that are named and share a column."""
    if not re.search(r"\b(?:with|and|join|joined|together)\b|和|以及|及其", text):
        return None
    named = sorted((t for t in tables if _has(text, t.lower()) or t.lower() in words), key=lambda t: text.index(t.lower()))
    for other in named[1:] if named and named[0] == table else [t for t in named if t != table]:
        shared = [c for c in tables[table] if c.lower() in {x.lower() for x in tables[other]}]
        if shared:
            where, _ = _conditions(text, {c.lower(): f"{t}.{c}" for t in (other, table) for c in tables[t]})
            return Translation(f"SELECT * FROM {table} JOIN {other} ON {table}.{shared[0]} = {other}.{shared[0]}" + (" WHERE " + " AND ".join(where) if where else ""), 0.75)
    return None


def _has(text: str, word: str) -> bool:
    return bool(re.search(rf"(?<![a-z_]){re.escape(word)}(?![a-z_])", text)) if word.isascii() else word in text


def _table(text: str, words: list[str], tables: dict[str, list[str]]) -> str:
    for name in sorted(tables, key=len, reverse=True):
        if name.lower() in words or f"{name.lower()}s" in words or _has(text, name.lower()):
            return name
    for name, columns in tables.items():
        if any(c.lower() in words for c in columns):
            return name
    raise ValueError("the question names no table")


def _conditions(text: str, columns: dict[str, str]) -> tuple[list[str], set[str]]:
    where, compared = [], set()
    for low, name in columns.items():
        for sign, spellings in COMPARISONS:
            m = re.search(rf"(?<!\w){re.escape(low)}\s*(?:is\s+)?(?:{re.escape(sign)}|{'|'.join(map(re.escape, spellings))})\s*(-?\d+(?:\.\d+)?|'[^']*'|\"[^\"]*\")", text)
            if m:
                value = m[1] if m[1][0] not in "\"" else f"'{m[1][1:-1]}'"
                where.append(f"{name} {sign} {value}")
                compared.add(name)
                break
    return where, compared


def _group(text: str, columns: dict[str, str]) -> str | None:
    for word in GROUPS:
        before = r"(?<!\w)" if word.isascii() else ""
        if (m := re.search(rf"{before}{re.escape(word)}\s*([A-Za-z_]\w*)", text)) and m[1] in columns:
            return columns[m[1]]
    return None
