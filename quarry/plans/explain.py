"""Plans as trees: text, Mermaid and HTML, with Spark's own size estimates."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Node:
    name: str
    detail: str = ""
    children: list[Node] = field(default_factory=list)
    #: the optimizer's estimates: size as it writes it, rows (None where unknown)
    size: str | None = None
    rows: str | None = None

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def tree(df: DataFrame, kind: str = "physical") -> Node:
    """The plan ('physical', 'optimized', 'analyzed', 'logical', or 'cost': optimized with estimates) as nodes; nothing is executed."""
    q = df._jdf.queryExecution()
    if kind == "cost":
        text = q.stringWithStats().split("== Physical Plan ==")[0]
    else:
        text = {"physical": q.executedPlan, "optimized": q.optimizedPlan, "analyzed": q.analyzed, "logical": q.logical}[kind]().toString()
    root, stack = None, []
    for line in text.splitlines():
        if not line.strip() or line.startswith("=="):
            continue
        m = re.match(r"^([\s:|+\-]*)(?:\*\s?\(?\d*\)?\s*)?(.*)$", line)
        depth = len(m[1]) // 3
        name, _, detail = m[2].partition(" ")
        node = Node(name, detail.strip())
        if m := re.search(r",?\s*Statistics\(sizeInBytes=([\d.E+]+ ?\w*)(?:, rowCount=([\d.E+]+))?[^)]*\)", detail):
            node.detail, node.size, node.rows = detail[: m.start()].strip(), m[1], m[2]
        if root is None:
            root = node
        else:
            del stack[depth:]
            (stack[-1] if stack else root).children.append(node)
        stack = [*stack[:depth], node]
    return root or Node("Empty")


def to_text(node: Node, indent: str = "") -> str:
    lines = [f"{indent}{node.name} {node.detail}{_cost(node)}".rstrip()]
    for c in node.children:
        lines.append(to_text(c, indent + "  "))
    return "\n".join(lines)


def to_mermaid(node: Node) -> str:
    lines, count = ["graph TD"], 0

    def add(n: Node) -> str:
        nonlocal count
        own, count = f"n{count}", count + 1
        lines.append(f'  {own}["{n.name}{_cost(n)}"]')
        for c in n.children:
            lines.append(f"  {own} --> {add(c)}")
        return own

    add(node)
    return "\n".join(lines)


def to_html(node: Node) -> str:
    inner = "".join(to_html(c) for c in node.children)
    return f"<ul><li><b>{html.escape(node.name)}</b> {html.escape(node.detail + _cost(node))}{inner}</li></ul>"


def _cost(node: Node) -> str:
    return "" if node.size is None else f" [{node.size}{f', {node.rows} rows' if node.rows else ''}]"


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pushed_filters(df: DataFrame) -> list[str]:
    """What the scans filter while reading."""
    return [f for part in re.findall(r"PushedFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString()) for f in part.split(", ") if f]


def read_columns(df: DataFrame) -> list[str]:
    """The columns that the scans read."""
    return [c for part in re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString()) for c in re.findall(r"(\w+):", part)]
