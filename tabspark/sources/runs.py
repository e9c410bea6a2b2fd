"""The run history: a log of entries, each written whole or not at all.

A run with all its metrics is one row, in a folder of its own, and Spark shows a folder's file only when its job has
committed. So a run is never half visible, and appends from several sessions at once do not meet. Clearing writes an entry too,
which names the runs that it takes away; a run appended meanwhile stays. Compaction writes all visible runs as one entry and then
removes the old ones; readers that see both count a run once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

RUNS = ("run_id string, started_at string, model string, task string, target string, cv int, n_trials int, "
        "params string, steps string")
METRICS = "run_id string, metric string, value double"
LOG = f"{RUNS}, metrics map<string,double>, tables map<string,string>, cleared boolean"


@dataclass
class Runs:
    spark: SparkSession
    path: str

    def append(self, model: str, task: str, target: str, metrics: dict[str, float], cv: int | None = None,
               n_trials: int = 0, params: dict | None = None, steps: list | None = None,
               started_at: str | None = None, tables: dict[str, list[dict]] | None = None) -> str:
        """Record one run, with small tables such as its confusion or learning curve; returns its id."""
        run_id = uuid.uuid4().hex
        at = started_at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        values = {k: float(v) for k, v in metrics.items() if v is not None}
        kept = {name: json.dumps(rows, default=str) for name, rows in (tables or {}).items()}
        self._write(self.spark.createDataFrame([(run_id, at, model, task, target, cv, n_trials, json.dumps(params or {}),
                                                 json.dumps(steps or []), values, kept, False)], LOG))
        return run_id

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self.path}/log/{name}")
        return name

    def _log(self) -> DataFrame:
        """All entries; none before the first has been written."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def _visible(self) -> DataFrame:
        log = self._log()
        gone = log.where("cleared").select("run_id").distinct()
        return log.where("not cleared").dropDuplicates(["run_id"]).join(gone, "run_id", "left_anti").drop("cleared")

    def runs(self) -> DataFrame:
        return self._visible().select(*[c.split(" ")[0] for c in RUNS.split(", ")])

    def metrics(self) -> DataFrame:
        return self._visible().select("run_id", F.explode("metrics").alias("metric", "value"))

    def wide(self) -> DataFrame:
        """One row per run with a column per metric of any run, in time order."""
        return wide(self.runs(), self.metrics()).orderBy("started_at", "run_id")

    def compare(self, metric: str) -> DataFrame:
        """(run, model, value) of one metric over all runs that have it, in time order."""
        return compare(self.runs(), self.metrics(), metric)

    def detail(self, run_id: str) -> dict:
        """Parameters, steps, metrics and tables of one run."""
        row = self._visible().filter(F.col("run_id") == run_id).first()
        if row is None:
            raise KeyError(run_id)
        return {**row.asDict(), "params": json.loads(row["params"]), "steps": json.loads(row["steps"]), "metrics": dict(row["metrics"]),
                "tables": {name: json.loads(rows) for name, rows in (row["tables"] or {}).items()}}

    def clear(self) -> None:
        """Take away the runs that are visible now."""
        seen = self._visible()
        columns = [F.col("run_id") if f.name == "run_id" else F.lit(True).alias("cleared") if f.name == "cleared"
                   else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], LOG).schema.fields]
        self._write(seen.select(*columns))

    def compact(self) -> None:
        """Write the visible runs as one entry and remove those they came from, in a quiet hour: a reader may be at them.

        Entries that take runs away stay; they are a line for each run.
        """
        entry = F.regexp_extract(F.input_file_name(), "/log/([0-9a-f]{32})/", 1)
        found = self._log().select(entry.alias("entry"), "run_id", "cleared").groupBy("entry").agg(
            F.bool_or("cleared").alias("cleared"), F.collect_set("run_id").alias("runs")).where("not cleared").collect()
        if len(found) < 2:
            return
        held = [r for e in found for r in e["runs"]]
        kept = self._visible().filter(F.col("run_id").isin(held)).withColumn("cleared", F.lit(False))
        self._write(kept.select(*[c.split(" ")[0] for c in LOG.split(", ")]))
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for e in found:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{e['entry']}")
            folder.getFileSystem(conf).delete(folder, True)


def wide(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    plain = [c for c in runs.columns if c not in ("params", "steps")]
    pivoted = metrics.groupBy("run_id").pivot("metric").agg(F.first("value"))
    return runs.select(*plain).join(pivoted, "run_id", "left")


def compare(runs: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    chosen = metrics.filter(F.col("metric") == metric).select("run_id", "value")
    return (runs.join(chosen, "run_id").orderBy("started_at", "run_id")
            .select(F.concat_ws(" | ", "started_at", "model", "target").alias("run"), "model", "value"))
