"""Session and server attribution of a running event stream.

Every micro-batch runs the same relational fixpoint as the batch job, started from the
states the previous batch left.  All state lives in tables below one shared folder, one
version per batch: a repeated batch reads the version before it and overwrites its own, so
a restart gives the same rows.  Nothing is kept per trace in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.operators import binding, detect
from vestige.operators.segments import first_rows
from vestige.schema import CANONICAL
from vestige.session import settle

_EVENT = ", ".join(f"{n} {k}" for n, k in CANONICAL.items())
_STATE = "trace_id string, pid bigint, ts_ns bigint, seq bigint, step int, session string, server string"
_TABLES = {"waiting": _EVENT, "carried": _EVENT, "states": _STATE, "roots": "trace_id string, n_roots bigint", "cut": "cut bigint"}


class LiveAttribution:
    """``foreachBatch`` handler: events arrive in any order within ``delay_ns``.

    Events newer than the newest seen minus ``delay_ns`` wait for the next batch; events
    older than what was already decided are dropped.
    """

    def __init__(self, spark: SparkSession, folder: str, delay_ns: int, **options):
        self.spark, self.folder, self.delay_ns, self.options = spark, folder.rstrip("/"), delay_ns, options

    def _load(self, version: int) -> dict[str, DataFrame]:
        if version < 0:
            return {n: self.spark.createDataFrame([], ddl) for n, ddl in _TABLES.items()}
        return {n: self.spark.read.schema(ddl).parquet(f"{self.folder}/v{version}/{n}") for n, ddl in _TABLES.items()}

    def _store(self, version: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._advance(batch, batch_id, last=False)

    def finish(self, batch_id: int) -> None:
        """Decide what is still waiting after the stream has ended."""
        self._advance(self.spark.createDataFrame([], _EVENT), batch_id, last=True)

    def _advance(self, batch: DataFrame, version: int, last: bool) -> None:
        old = self._load(version - 1)
        done = old["cut"].agg(F.max("cut")).first()[0]
        pool = batch.select(*CANONICAL).unionByName(old["waiting"])
        if done is not None:
            pool = pool.filter(F.col("ts_ns") > done)
        pool = settle(pool)
        high = pool.agg(F.max("ts_ns")).first()[0]
        if high is None:
            cut = done
            ready = pool
        else:
            cut = high if last else max(high - self.delay_ns, done if done is not None else high - self.delay_ns)
            ready = pool.filter(F.col("ts_ns") <= cut)
        seen = ready.unionByName(old["carried"])
        ops = binding.operations(seen, roots_before=old["roots"], **self.options)
        if done is not None:
            ops = ops.filter(F.col("ts_ns") > done)
        ops = settle(ops)
        changes = binding.fixpoint(ops, old["states"])
        known = changes.select(*[c.split()[0] for c in _STATE.split(", ")]).unionByName(old["states"])
        out = binding.attribute(ready.select("trace_id", "seq", "ts_ns", "pid", "event"), known)
        out.write.mode("overwrite").parquet(f"{self.folder}/attributed/batch={version}")
        latest = first_rows(known, ["trace_id", "pid"], [F.col(c).desc() for c in ("ts_ns", "seq", "step")])
        new_roots = changes.filter("kind = 'root'").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_roots"))
        self._store(version, {
            "waiting": pool.filter(F.col("ts_ns") > cut) if high is not None else pool,
            "carried": self._carry(seen),
            "states": latest,
            "roots": new_roots.unionByName(old["roots"]).groupBy("trace_id").agg(F.sum("n_roots").alias("n_roots")),
            "cut": self.spark.createDataFrame([(cut,)], "cut bigint"),
        })

    @staticmethod
    def _carry(seen: DataFrame) -> DataFrame:
        """The few past events later ones still depend on: the last clone of a trace, server
        registrations, and the first report of every forked child."""
        clone = first_rows(
            seen.filter(F.col("event").isin("clone", "clone3")), ["trace_id"], [F.col("ts_ns").desc(), F.col("seq").desc()]
        )
        registered = seen.filter((F.col("event") == "execve") & detect.registration(F.col("argv")).isNotNull())
        forked = first_rows(
            seen.filter("event = 'sched_fork' AND parent_pid <> 0 AND child_pid <> 0 AND parent_pid <> child_pid"),
            ["trace_id", "child_pid"], [F.col("ts_ns"), F.col("seq")],
        )
        return clone.unionByName(registered).unionByName(forked)

    def results(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/attributed").parquet(f"{self.folder}/attributed")
