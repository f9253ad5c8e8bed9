"""The folder of a run: its steps, what they found, and its log.

A step writes its table or artifact and then an entry under _steps/. A run that is started again under its id finds the
entries of finished steps and takes them up instead of working again; a step without an entry is done anew, over whatever it
left behind. What a step counts rides on its write (`DataFrame.observe`), so no table is scanned again for its summary.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from candlewick.sinks import artifacts as sink


class RunStopped(RuntimeError):
    """The run ended after the step it was asked to stop at; it can be resumed."""


class RunFolder:
    def __init__(self, spark: SparkSession, root: str, run_id: str, stop_after: str | None = None):
        self.spark, self.root, self.run_id, self.path = spark, root, run_id, f"{root}/{run_id}"
        self.stop_after, self.lines = stop_after, []
        self.entries = {entry["step"]: entry for entry in self._entries()}
        self.resumed = sorted(self.entries, key=lambda step: self.entries[step]["number"])

    def _entries(self) -> Iterator[dict]:
        try:
            bodies = self.spark.read.text(f"{self.path}/_steps/*.json", wholetext=True).collect()
        except AnalysisException:
            return
        yield from (json.loads(row["value"]) for row in bodies if row["value"].strip())

    def note(self, event: str, **values: Any) -> None:
        self.lines.append(sink.log_line(event, values))

    @contextmanager
    def logged(self) -> Iterator[RunFolder]:
        """Writes the log however the run ends."""
        try:
            yield self
        except Exception as error:
            self.note("run_stopped" if isinstance(error, RunStopped) else "run_failed", error=type(error).__name__)
            raise
        finally:
            sink.write_lines(self.spark, self.lines, f"{self.path}/logs.txt")

    def value(self, step: str, build: Callable[[], Any]) -> Any:
        """What `build` returned when the step was finished, as JSON has it."""
        if step not in self.entries:
            entry = {"step": step, "number": len(self.entries), "value": build()}
            sink.write_json(self.spark, entry, f"{self.path}/_steps/{step}.json")
            self.entries[step] = json.loads(json.dumps(entry, default=sink.plain))
        if step == self.stop_after:
            raise RunStopped(f"{self.run_id} stopped after {step}")
        return self.entries[step]["value"]

    def table(self, step: str, build: Callable[[], DataFrame], facts: Callable[[DataFrame], Mapping[str, str]]) -> tuple[DataFrame, dict]:
        """The table of a step, and the aggregates over it that `facts` names as SQL text, taken while it is written."""
        path = f"{self.path}/_steps/{step}"

        def write() -> dict:
            df = build()
            wanted, seen = facts(df), Observation(step)
            df = df.observe(seen, *[F.expr(f"{value} AS {name}") for name, value in wanted.items()])
            df.write.mode("overwrite").parquet(path)
            return {"schema": df.schema.json(), "facts": seen.get}

        found = self.value(step, write)
        rows = self.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(path)
        return rows, found["facts"]

    def drop_tables(self) -> None:
        """Free the space of the steps' tables; their entries stay."""
        for step, entry in self.entries.items():
            if isinstance(entry["value"], dict) and "schema" in entry["value"]:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_steps/{step}")
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
