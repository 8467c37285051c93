"""Sets of tables in committed versions.

The tables of a version are written to a folder of their own. One write of a manifest
(a row for each table, with its rows and fingerprint) makes them valid; readers take the
last manifest that is complete. A write that breaks off leaves the earlier version as it
was, and a second writer of one version number is refused by the storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessile.sources import fingerprint

_MANIFEST = "version int, operation string, table string, folder string, columns string, rows long, fingerprint long, external_rows long"


class OverwriteError(ValueError):
    """A write that the manifest forbids."""


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def log(self) -> DataFrame:
        """All manifests, a row for each table of each version."""
        number = self.last()
        paths = [f"{self.path}/manifest/{k:08d}" for k in range(1, number + 1)]
        return self.spark.read.schema(_MANIFEST).json(paths) if paths else self.spark.createDataFrame([], _MANIFEST)

    def last(self) -> int:
        """The last version whose manifest is complete; 0 if there is none. Versions are numbered without gaps."""
        n = 0
        while self._exists(f"{self.path}/manifest/{n + 1:08d}/_SUCCESS"):
            n += 1
        return n

    def tables(self, version: int | None = None) -> dict[str, dict]:
        number = self.last() if version is None else version
        if not number:
            return {}
        return {r["table"]: r.asDict() for r in self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/{number:08d}").collect()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.tables(version)
        if table not in found:
            raise KeyError(f"no table {table} in version {version or self.last()}")
        return self.spark.read.parquet(found[table]["folder"])

    def commit(self, tables: Mapping[str, DataFrame], operation: str, external: str | None = None) -> int:
        """[S6 Q16] A new version: these tables, and the last version's others as they are. external: a condition that counts as external rows where its columns are.

        Each table is written, read back and counted before the manifest is; the manifest is one file.
        """
        before, number, folder = self.tables(), self.last() + 1, f"{self.path}/data/{uuid.uuid4().hex}"
        rows = [{**r, "version": number, "operation": operation} for name, r in before.items() if name not in tables]
        for name, frame in tables.items():
            at = f"{folder}/{name}"
            frame.write.mode("errorifexists").parquet(at)
            stored = self.spark.read.parquet(at)
            outside = F.lit(0).cast("long")
            if external and external.split()[0] in stored.columns:
                outside = F.count_if(F.expr(external))
            told = stored.agg(F.count("*").alias("rows"), F.coalesce(fingerprint(stored.columns), F.lit(0)).alias("fingerprint"), outside.alias("external_rows")).first()
            rows.append({"version": number, "operation": operation, "table": name, "folder": at, "columns": ",".join(stored.columns), **told.asDict()})
        manifest = self.spark.createDataFrame([tuple(r[f.split()[0]] for f in _MANIFEST.split(", ")) for r in rows], _MANIFEST)
        at = f"{self.path}/manifest/{number:08d}"
        # A folder without its mark is what a writer that broke off has left.
        manifest.coalesce(1).write.mode("errorifexists" if self._exists(f"{at}/_SUCCESS") else "overwrite").json(at)
        return number

    def rebuild(self, tables: Mapping[str, DataFrame], operation: str, external: str | None = None) -> int:
        """[Q17] A version that replaces all tables; refused if the last one has external rows, which a rebuild would lose."""
        held = {name: r["external_rows"] for name, r in self.tables().items() if r["external_rows"]}
        if held:
            raise OverwriteError(f"external rows would be lost: {held}")
        return self.commit(tables, operation, external)

    def verify(self, version: int | None = None) -> DataFrame:
        """[S8 S9] (table, rows, fingerprint, intact) of the stored tables against their manifest."""
        out = None
        for name, r in sorted(self.tables(version).items()):
            stored = self.spark.read.parquet(r["folder"])
            one = stored.agg(F.count("*").alias("rows"), F.coalesce(fingerprint(r["columns"].split(",")), F.lit(0)).alias("fingerprint"))
            one = one.select(F.lit(name).alias("table"), "rows", "fingerprint", ((F.col("rows") == r["rows"]) & (F.col("fingerprint") == r["fingerprint"])).alias("intact"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise KeyError("no version")
        return out
