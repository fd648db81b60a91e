"""Materialise-and-release for iterative operators.

Each round of an iterative operator writes its tables as Parquet under the
shared folder named by ``spark.checkpoint.dir`` and reads them back. That cuts
the lineage (round t never replays rounds 1..t-1), survives the loss of any
executor (files live on shared storage, not in executor memory), and gives
Catalyst real file sizes for its join choices. Tables of earlier rounds that
no later step reads are deleted as soon as a round is done, so disk use stays
at about two rounds of intermediate data however many rounds run.

Counts of what is written come from the write itself (``metrics``), not from
another pass. A loop that must survive the loss of its
driver leaves a small commit record after each round (:meth:`Workspace.commit`)
and finds them in a run's folder that is opened again (:meth:`Workspace.at`).
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from linkset.plans.session import checkpoint_dir

log = logging.getLogger(__name__)

ROWS_PER_TASK = 1 << 21     # rows that a task of an exchange gets, about


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside deals ``rows`` rows to tasks of about ``ROWS_PER_TASK``, so that a task's
    memory does not grow with the table. Tables that the session deals so by itself, by its number
    of shuffle partitions and to its cores, are left to it; else the number is set by the
    rows, and AQE does not join tasks by their (compressed) bytes. The settings are put back."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    need = -(-rows // ROWS_PER_TASK)
    if need <= min(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        yield
        return
    own = {"spark.sql.shuffle.partitions": str(-(-need // cores) * cores),
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None, label: str = "run"):
        self.spark = spark
        base = (root or checkpoint_dir(spark)).rstrip("/")
        self.root = f"{base}/linkset-{label}-{uuid.uuid4().hex[:12]}"
        self._seq = 0
        self._attempt = ""

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Workspace:
        """The workspace in ``folder`` itself, new or left by an earlier driver.
        What an unfinished round of that driver wrote is never read or
        overwritten: names differ from one opening to the next."""
        ws = cls.__new__(cls)
        ws.spark, ws.root, ws._seq = spark, folder.rstrip("/"), 0
        ws._attempt = uuid.uuid4().hex[:8] + "-"
        return ws

    def save(self, df: DataFrame, name: str, metrics: Mapping[str, Column] | None = None,
             by: str | None = None) -> DataFrame:
        """Run ``df`` once, write it to the shared folder, return the written table.
        ``metrics`` are aggregates over it, taken while it is written; the
        returned frame has them as ``metrics``. ``by``, the last column, gets a
        folder for each of its values."""
        path = self.folder(name)
        seen = Observation()
        writer = (df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df).write
        (writer.partitionBy(by) if by else writer).mode("errorifexists").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._linkset_path = path
        out.metrics = seen.get if metrics else {}
        return out

    def folder(self, name: str) -> str:
        """A new path for a caller that writes its own files; never given twice."""
        self._seq += 1
        return f"{self.root}/{self._attempt}{self._seq:04d}-{name}"

    def adopt(self, df: DataFrame, path: str) -> DataFrame:
        """Mark a frame read from ``path`` (written by the caller) for release."""
        df._linkset_path = path
        return df

    def release(self, *frames: DataFrame | None) -> None:
        """Delete the files behind frames returned by :meth:`save`."""
        for df in frames:
            if df is None:
                continue
            path = getattr(df, "_linkset_path", None)
            if path is not None:
                self.delete(path)
                df._linkset_path = None

    def close(self) -> None:
        """Delete everything this run wrote, results included. Call it once the
        results have been written elsewhere or are no longer needed."""
        self.delete(self.root)

    def commit(self, number: int, record: dict) -> None:
        """Leave the record of a finished round: there whole, or not there."""
        fs, path = self._fs(f"{self.root}/commits/{number:06d}.json")
        part = self._fs(f"{self.root}/commits/.{number:06d}-{uuid.uuid4().hex}")[1]
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if not fs.rename(part, path):
            raise OSError(f"cannot commit round {number} in {self.root}")

    def commits(self) -> list[dict]:
        """The records of finished rounds, in order; none in a new folder."""
        fs, folder = self._fs(f"{self.root}/commits")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        found = []
        for name in names:
            if name.startswith("."):
                continue
            source = fs.open(self._fs(f"{self.root}/commits/{name}")[1])
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            finally:
                source.close()
            found.append(json.loads(text))
        return found

    def _fs(self, path: str):
        hpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hpath

    def delete(self, path: str) -> None:
        try:
            fs, hpath = self._fs(path)
            fs.delete(hpath, True)
        except Exception as exc:  # deletion is an optimisation; never fail the job for it
            log.warning("could not delete %s: %s", path, exc)

