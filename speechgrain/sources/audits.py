"""Audits that are kept and brought up to date: only sessions whose segments changed are audited again.

A store is a folder of runs. A run writes three tables: digests of the sessions that it audited, their audits, and the
sessions that have gone. It counts from the moment its entry ``commits/<number>`` exists, which only one run can create; a run that
died, or lost the race for its number, leaves files that nobody reads. What holds for a session is what its last run says.

A session's digest is a sum over its rows of 128 bits of hash and their number, so it doesn't depend on the order or layout of
rows; the settings of the audit are part of it. A second run over the same segments reads them and the stored digests, and
neither audits nor writes anything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs that are read together before they are folded into one.
FOLD_AFTER = 32


def digests(rows: DataFrame, by: str = "session_id", settings: dict | None = None) -> DataFrame:
    """``(by, digest)``: what all columns of a group's rows add up to, with the settings."""
    columns = [F.col(f"`{c}`") for c in sorted(c for c in rows.columns if c != by)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])  # hashes pass over nulls
    number = lambda seed: F.sum(F.xxhash64(F.lit(seed), nulls, *columns).cast("decimal(38,0)"))
    added = rows.groupBy(by).agg(number(1).alias("_a"), number(2).alias("_b"), F.count("*").alias("_n"))
    text = F.concat_ws("|", F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("_n").cast("string"), F.lit(json.dumps(settings or {}, sort_keys=True)))
    return added.select(by, F.sha2(text, 256).alias("digest"))


class AuditStore:
    """The folder ``path`` (any file system that Spark writes to) for groups named by the column ``by``."""

    def __init__(self, spark: SparkSession, path: str, by: str = "session_id"):
        self.spark, self.path, self.by = spark, path, by
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, dict]]:
        """(number, entry) of each run, in order."""
        folder = self.at(f"{self.path}/commits")
        if not self.files.exists(folder):
            return []
        names = sorted((f.getPath().getName() for f in self.files.listStatus(folder)), key=int)
        texts = {r.path.rsplit("/", 1)[1]: r.content for r in self.spark.read.format("binaryFile").load(f"{self.path}/commits").select("path", "content").collect()} if names else {}
        return [(int(n), json.loads(bytes(texts[n]))) for n in names if texts.get(n)]

    def _commit(self, number: int, entry: dict) -> None:
        draft = self.at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.hsync()
        out.close()
        target = self.at(f"{self.path}/commits/{number}")
        self.files.mkdirs(target.getParent())
        try:  # creating the lock succeeds once
            self.files.create(self.at(f"{self.path}/locks/{number}-{entry['after']}"), False).close()
        except Exception as error:
            raise RuntimeError(f"another run has been committed after {entry['after']}; run again") from error
        if self.files.exists(target) or not self.files.rename(draft, target):
            raise RuntimeError(f"run {number} exists; run again")

    def _table(self, name: str, runs: list[tuple[int, dict]]) -> DataFrame | None:
        parts = [(n, e["folder"]) for n, e in runs if name in e["tables"]]
        out = None
        for n, folder in parts:
            part = self.spark.read.parquet(f"{self.path}/{folder}/{name}").withColumn("run", F.lit(n).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def _latest(self, runs: list[tuple[int, dict]]) -> DataFrame | None:
        """``(by, run, digest)``: of each session its last run, if it hasn't gone."""
        known, gone = self._table("digests", runs), self._table("gone", runs)
        if known is None:
            return None
        rows = known.select(self.by, "digest", "run")
        if gone is not None:
            rows = rows.unionByName(gone.select(self.by, F.lit(None).cast("string").alias("digest"), "run"))
        last = rows.groupBy(self.by).agg(F.max_by(F.struct("digest"), "run").alias("_d"), F.max("run").alias("run"))
        return last.select(self.by, "run", F.col("_d.digest").alias("digest")).where("digest is not null")

    def read(self) -> DataFrame | None:
        """The audits that hold, with the number of the ``run`` that made each; None before the first run."""
        runs = self.commits()
        latest = self._latest(runs)
        return None if latest is None else self._table("audits", runs).join(latest.select(self.by, "run"), [self.by, "run"], "left_semi")

    def update(self, rows: DataFrame, audit: Callable[[DataFrame], DataFrame], settings: dict | None = None) -> tuple[int, int]:
        """Bring the store up to date with ``rows``; returns how many sessions were audited and how many are gone."""
        runs = self.commits()
        number = runs[-1][0] + 1 if runs else 1
        folder = f"run-{number}-{uuid.uuid4().hex}"
        at, known = f"{self.path}/{folder}", self._latest(runs)
        now = digests(rows, self.by, settings)
        changed = now if known is None else now.join(known.select(self.by, "digest"), [self.by, "digest"], "left_anti")
        changed.write.parquet(f"{at}/digests")  # the ids of what changed, read again below
        changed = self.spark.read.parquet(f"{at}/digests")
        tables, n, left = [], changed.count(), 0
        if n:
            audit(rows.join(changed.select(self.by), self.by, "left_semi")).write.parquet(f"{at}/audits")
            tables += ["digests", "audits"]
        if known is not None:
            known.join(rows.select(self.by).distinct(), self.by, "left_anti").select(self.by).write.parquet(f"{at}/gone")
            left = self.spark.read.parquet(f"{at}/gone").count()
            tables += ["gone"] * bool(left)
        if tables:
            self._commit(number, {"folder": folder, "tables": tables, "after": runs[-1][0] if runs else 0})
            if len(runs) + 1 >= FOLD_AFTER:
                self.fold()
        else:
            self.files.delete(self.at(at), True)
        return n, left

    def fold(self) -> None:
        """Write what holds as one run under the next number, and forget the entries of the runs before it."""
        runs = self.commits()
        latest = self._latest(runs)
        if latest is None or len(runs) < 2:
            return
        number, folder = runs[-1][0] + 1, f"run-{runs[-1][0] + 1}-{uuid.uuid4().hex}"
        latest.select(self.by, "digest").write.parquet(f"{self.path}/{folder}/digests")
        self.read().drop("run").write.parquet(f"{self.path}/{folder}/audits")
        self._commit(number, {"folder": folder, "tables": ["digests", "audits"], "after": runs[-1][0]})
        for n, entry in runs:
            self.files.delete(self.at(f"{self.path}/commits/{n}"), False)
            self.files.delete(self.at(f"{self.path}/{entry['folder']}"), True)
