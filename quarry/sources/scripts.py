"""SQL scripts in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.files import Files


def split_statements(text: str) -> list[str]:
    """Statements between semicolons; quotes and -- comments are respected."""
    out, current, quote, i = [], [], "", 0
    while i < len(text):
        ch = text[i]
        if quote:
            current.append(ch)
            if ch == "\\" and i + 1 < len(text):
                i += 1
                current.append(text[i])
            elif ch == quote:
                quote = ""
        elif ch in "'\"`":
            quote = ch
            current.append(ch)
        elif text.startswith("--", i):
            i = text.find("\n", i)
            if i < 0:
                break
            current.append("\n")
        elif ch == ";":
            out.append("".join(current).strip())
            current = []
        else:
            current.append(ch)
        i += 1
    out.append("".join(current).strip())
    return [s for s in out if s]


def load_script(spark: SparkSession, path: str) -> list[str]:
    text = Files(spark).read(path)
    if text is None:
        raise FileNotFoundError(path)
    return split_statements(text)


def export(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result as parquet, csv (with a header), json or orc."""
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)
