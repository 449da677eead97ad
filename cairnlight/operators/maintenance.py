"""Looking after a store: schema versions, drift, health, query advice."""

from __future__ import annotations

import hashlib
import re
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MaintenanceError(RuntimeError):
    """A schema change can't be read, applied or taken back."""


@dataclass(frozen=True)
class Change:
    """One schema change, from a file named ``<version>_<name>.sql``."""

    version: int
    name: str
    description: str
    up: str
    down: str | None
    checksum: str

    @classmethod
    def read(cls, path: Path) -> Change | None:
        named = re.fullmatch(r"(\d+)_(.+)\.sql", path.name)
        if not named:
            return None
        content = path.read_text()
        comments = [x.strip() for x in content.splitlines() if x.strip().startswith("--") and not x.strip().startswith("---")]
        marked = [x[len("-- Description:") :] for x in comments if x.startswith("-- Description:")]
        lines, cut = content.splitlines(), None
        for i, x in enumerate(lines):
            if cut is None and x.strip().lower().startswith(("-- down", "-- rollback")):
                cut = i
        up, down = lines[:cut], lines[cut + 1 :] if cut is not None else []
        first = comments[0][2:] if comments else "none given"
        return cls(int(named[1]), named[2], (marked or [first])[0].strip(), "\n".join(up), "\n".join(down) if any(x.strip() for x in down) else None, hashlib.md5(content.encode()).hexdigest())


def statements(sql: str) -> list[str]:
    """The statements of a script, without comment lines."""
    plain = "\n".join(x for x in sql.splitlines() if not x.strip().startswith("--"))
    return [s.strip() for s in plain.split(";") if s.strip()]


LEDGER = "version int, name string, description string, checksum string, applied boolean, at timestamp"


class Ledger:
    """Which changes were applied to a store, as an append-only Parquet table.

    The last row of a version tells its state. A change's row is written after
    its statements, so one that fails halfway is applied again.
    """

    def __init__(self, spark: SparkSession, path: str, changes: str | Path):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Path(changes)

    def discover(self) -> list[Change]:
        """All changes on file, by version; a version that occurs twice is an error."""
        found = sorted((c for c in map(Change.read, sorted(self.folder.glob("*.sql"))) if c), key=lambda c: c.version)
        for a, b in zip(found, found[1:]):
            if a.version == b.version:
                raise MaintenanceError(f"version {a.version} occurs twice")
        return found

    def rows(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def applied(self) -> DataFrame:
        """The versions in force, in order."""
        last = self.rows().groupBy("version").agg(F.max_by(F.struct("name", "description", "checksum", "applied", "at"), "at").alias("x"))
        return last.select("version", "x.*").where("applied").drop("applied").orderBy("version")

    def _note(self, change: Change, applied: bool) -> None:
        row = self.spark.createDataFrame([(change.version, change.name, change.description, change.checksum, applied)], LEDGER.rsplit(",", 1)[0])
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def pending(self) -> list[Change]:
        done = {r["version"] for r in self.applied().collect()}
        return [c for c in self.discover() if c.version not in done]

    def migrate(self) -> list[Change]:
        """Apply what is pending, in order; returns it."""
        waiting = self.pending()
        for change in waiting:
            for s in statements(change.up):
                self.spark.sql(s)
            self._note(change, True)
        return waiting

    def rollback(self) -> Change | None:
        """Take the last applied change back."""
        rows = self.applied().collect()
        if not rows:
            return None
        change = next((c for c in self.discover() if c.version == rows[-1]["version"]), None)
        if change is None or change.down is None:
            raise MaintenanceError(f"version {rows[-1]['version']} can't be taken back")
        for s in statements(change.down):
            self.spark.sql(s)
        self._note(change, False)
        return change

    def drift(self) -> DataFrame:
        """(version, problem) of applied changes whose files differ or are gone."""
        on_file = self.spark.createDataFrame([(c.version, c.checksum) for c in self.discover()], "v int, own string")
        joined = self.applied().join(on_file, F.col("version") == F.col("v"), "left")
        problem = F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("checksum"), "changed")
        return joined.select("version", problem.alias("problem")).where("problem IS NOT NULL").orderBy("version")

    def up_to_date(self) -> bool:
        return not self.pending()


def health(spark: SparkSession, ledger: Ledger | None = None) -> dict[str, object]:
    """Healthy; degraded if the session answers but changes are pending; else unhealthy."""
    began, answers, current = time.monotonic(), False, False
    try:
        answers = spark.sql("SELECT 1").first()[0] == 1
        current = ledger is None or ledger.up_to_date()
    except Exception as e:  # any failure is what is asked about
        return {"status": "Unhealthy" if not answers else "Degraded", "answers": answers, "current": False, "error": str(e)[:200], "ms": (time.monotonic() - began) * 1000}
    return {"status": "Healthy" if current else "Degraded", "answers": answers, "current": current, "error": None, "ms": (time.monotonic() - began) * 1000}


def analyzed(df: DataFrame) -> dict[str, object]:
    """Plan and running time of a query, whose rows are computed and thrown away."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    began = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    counted = {k: len(re.findall(rf"\b{k}\b", plan)) for k in ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Sort")}
    return {"ms": (time.monotonic() - began) * 1000, "plan": plan, **counted}


def advice(sql: str) -> list[str]:
    """What might make a query slow, from its text."""
    out, plain = [], re.sub(r"\s+", " ", sql).upper()
    if "SELECT *" in plain:
        out.append("name the columns, so that others are not read")
    if "LIKE '%" in plain:
        out.append("a pattern that begins with % reads every row; search the word index")
    if "LIMIT" not in plain:
        out.append("limit large results")
    if re.search(r"\bCROSS JOIN\b", plain):
        out.append("join on a key, as a cross join multiplies its sides")
    return out


def table_stats(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(table, files, bytes) of stored tables, the largest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name in names:
        root = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        files = root.getFileSystem(conf)
        if files.exists(root):
            s = files.getContentSummary(root)
            rows.append((name, s.getFileCount(), s.getLength()))
    return spark.createDataFrame(rows, "table string, files long, bytes long").orderBy(F.desc("bytes"), "table")


def merged(base, override):
    """JSON values, objects merged key by key, anything else replaced."""
    if isinstance(base, dict) and isinstance(override, dict):
        return base | {k: merged(base[k], v) if k in base else v for k, v in override.items()}
    return override


def setting(config, key: str, default):
    """A config's value, or ``default`` if it's absent or of another type."""
    value = config.get(key, default) if isinstance(config, dict) else default
    return value if default is None or isinstance(value, type(default)) else default


def require(config, keys: list[str]) -> None:
    if not isinstance(config, dict):
        raise MaintenanceError("the configuration must be an object")
    for k in keys:
        if k not in config:
            raise MaintenanceError(f"the configuration lacks {k}")
