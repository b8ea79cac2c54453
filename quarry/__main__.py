"""A shell: ``python -m quarry [store folder]``.  Statements end with a semicolon; ``exit;`` leaves."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from quarry.plans import diagnostics
from quarry.plans.engine import Engine


def shell(spark: SparkSession, root: str, lines: Iterator[str]) -> None:
    engine = Engine(spark, root)
    waiting = ""
    for line in lines:
        waiting += line.rstrip("\n") + "\n"
        if not waiting.rstrip().endswith(";"):
            continue
        sql, waiting = waiting.strip(), ""
        if sql.rstrip(";").strip().lower() in ("exit", "quit"):
            return
        try:
            out = engine.execute(sql)
            print(out) if isinstance(out, str) else out.show(100, truncate=False)
        except Exception as e:  # noqa: BLE001, the shell goes on
            print(str(e).split("\n")[0])
            names = {t: list(engine.columns(t)) for t in engine.tables()}
            if found := diagnostics.analyze(sql, names):
                print(diagnostics.format_findings(found))


if __name__ == "__main__":
    from quarry.session import session

    shell(session(), sys.argv[1] if len(sys.argv) > 1 else "quarry-store", iter(sys.stdin))
