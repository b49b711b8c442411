"""Commands of a shell over a system's tables: each answers with rows (command, field, value)."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import storage


def _fields(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns of the rows as (field, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])
    return rows.select(F.inline(pairs))


class Control:
    """Inspects tables ``log``, ``items``, ``index`` and, where there is one, ``containers``, and keeps what was forced: idleness, and whether collection is paused."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = tables
        self.forced: bool | None = None
        self.paused = False

    def log(self, number: str) -> DataFrame:
        return _fields(self.tables["log"].where(F.col("log_id") == int(number)), "event_type", "fp")

    def block(self, number: str) -> DataFrame:
        rows = self.tables["items"].where(F.col("block_id") == int(number))
        return rows.select(F.col("fp").alias("field"), F.col("item_size").cast("string").alias("value"))

    def chunk(self, fp: str) -> DataFrame:
        return _fields(self.tables["index"].where(F.col("fp") == fp), "size", "usage_count")

    def chunks(self) -> DataFrame:
        return _fields(self.tables["index"].agg(F.count(F.lit(1)).alias("items")), "items")

    def container(self, number: str, fp: str = "") -> DataFrame:
        rows = self.tables["containers"].where((F.col("container_id") == int(number)) & F.startswith("fp", F.lit(fp)))
        return rows.select(F.col("fp").alias("field"), F.col("size").cast("string").alias("value"))

    def gc(self, order: str = "status") -> DataFrame:
        """``pause`` and ``resume`` hold collection back; in either state the candidates that wait are counted."""
        if order not in ("status", "pause", "resume"):
            raise ValueError(f"gc takes status, pause or resume, not {order}")
        self.paused = {"pause": True, "resume": False}.get(order, self.paused)
        waiting = storage.usage_counts(self.tables["log"]).where("usage_count <= 0")
        return _fields(waiting.agg(F.count(F.lit(1)).alias("candidates")), "candidates")

    def idle(self, order: str = "status") -> DataFrame:
        if order not in ("status", "force-idle", "force-busy", "free"):
            raise ValueError(f"idle takes status, force-idle, force-busy or free, not {order}")
        self.forced = {"force-idle": True, "force-busy": False, "free": None}.get(order, self.forced)
        return self._said("idle", F.lit(self.forced))

    def _said(self, field: str, value: Column) -> DataFrame:
        return next(iter(self.tables.values())).sparkSession.range(1).select(F.lit(field).alias("field"), value.cast("string").alias("value"))

    def run(self, command: str) -> DataFrame:
        name, *words = command.split()
        if name.startswith("_") or name in ("run", "run_all") or not callable(getattr(self, name, None)):
            raise ValueError(f"no command {name}")
        return getattr(self, name)(*words).select(F.lit(command).alias("command"), "field", "value")

    def run_all(self, commands: Sequence[str]) -> DataFrame:
        out = None
        for command in commands:
            rows = self.run(command)
            out = rows if out is None else out.unionByName(rows)
        return out


def shell(control: Control, lines=sys.stdin, out=sys.stdout) -> None:
    """Reads commands until ``quit``; a wrong one is answered, not fatal."""
    for line in lines:
        line = line.strip()
        if line == "quit":
            break
        if not line:
            continue
        try:
            for row in control.run(line).limit(1000).toLocalIterator():
                print(row["field"], row["value"], file=out)
        except (ValueError, KeyError, TypeError) as ex:
            print(f"error: {ex}", file=out)
