"""Running a guarded query: time limit by cancelling its job group, row cap with a flag, markdown."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodestream.plans.guard import Rejected, check, guarded


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool = False
    seconds: float = 0.0
    meta: dict = field(default_factory=dict)

    def markdown(self, most: int = 50) -> str:
        """A table of the first rows, nulls as NULL."""
        line = lambda xs: "| " + " | ".join(xs) + " |"
        body = [line(["NULL" if v is None else str(v) for v in r]) for r in self.rows[:most]]
        more = [f"... {len(self.rows) - most} more rows"] if len(self.rows) > most else []
        return "\n".join([line(self.columns), "|" + "---|" * len(self.columns), *body, *more])


def execute(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], seconds: float = 5.0, most: int = 1000) -> Result:
    """The rows of an allowed query, ``most`` at most; TimeoutError when it runs longer than ``seconds``."""
    limit = check(spark, sql, {k: v.schema for k, v in views.items()}, most)
    df = guarded(spark, sql, views, limit + 1 if limit == most else limit)
    sc, group, late = spark.sparkContext, f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer, began = threading.Timer(seconds, stop), time.monotonic()
    sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        rows = [tuple(r) for r in df.collect()]
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query ran longer than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        sc._jsc.clearJobGroup()
    return Result(df.columns, rows[:most], len(rows) > most, time.monotonic() - began)


__all__ = ["Rejected", "Result", "execute"]
