"""Versioned Parquet store, and readers of exchange formats."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "text", "orc")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of a known format; CSV has a header and quoted line breaks."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.options(header=True, multiLine=True, escape='"').csv(path) if kind == "csv" else reader.format(kind).load(path)


@dataclass
class Store:
    """Named tables under `base`/<version>/<name>, with a manifest of versions.

    Versions are numbered, so two in one second differ. The manifest is a small JSON
    file that is written after a version's tables, by which a half-written version is
    never listed.
    """

    spark: SparkSession
    base: str
    max_versions: int = 10
    compression: str = "zstd"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifest(self) -> list[dict]:
        """Versions, oldest first: version, seq, created, tables, metadata."""
        fs, path = self._fs()
        file = path(f"{self.base}/versions.json")
        if not fs.exists(file):
            return []
        stream = fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write_manifest(self, rows: list[dict]) -> None:
        fs, path = self._fs()
        fs.mkdirs(path(self.base))
        temp, final = path(f"{self.base}/.versions.new"), path(f"{self.base}/versions.json")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(rows).encode()))
        out.close()
        fs.delete(final, False)
        fs.rename(temp, final)

    def save(self, tables: dict[str, DataFrame], metadata: dict | None = None) -> str:
        """Write a new version and drop the oldest beyond max_versions."""
        rows = self.manifest()
        seq = max((r["seq"] for r in rows), default=0) + 1
        created = self.spark.sql("SELECT date_format(current_timestamp(), 'yyyyMMdd_HHmmss') FROM VALUES (1)").first()[0]
        version = f"v_{created}_{seq:06d}"
        for name, df in tables.items():
            df.write.option("compression", self.compression).parquet(f"{self.base}/{version}/{name}")
        rows.append({"version": version, "seq": seq, "created": created, "tables": sorted(tables), "metadata": metadata or {}})
        self._write_manifest(rows[-self.max_versions :])
        fs, path = self._fs()
        for r in rows[: -self.max_versions]:
            fs.delete(path(f"{self.base}/{r['version']}"), True)
        return version

    def load(self, name: str, version: str | None = None) -> DataFrame:
        """A table of a version, the latest by default."""
        rows = self.manifest()
        known = [r["version"] for r in rows]
        if not known or (version and version not in known):
            raise FileNotFoundError(f"no version {version or ''} in {self.base}")
        return self.spark.read.parquet(f"{self.base}/{version or known[-1]}/{name}")

    def delete(self, version: str) -> bool:
        rows = self.manifest()
        if version not in [r["version"] for r in rows]:
            return False
        self._write_manifest([r for r in rows if r["version"] != version])
        fs, path = self._fs()
        return bool(fs.delete(path(f"{self.base}/{version}"), True))

    def snapshot(self, name: str, version: str | None = None) -> str:
        """A copy of a version under snapshots/<name>, which retention never drops."""
        rows = [r for r in self.manifest() if version in (None, r["version"])]
        if not rows:
            raise FileNotFoundError(f"nothing to copy in {self.base}")
        for t in rows[-1]["tables"]:
            self.load(t, rows[-1]["version"]).write.mode("overwrite").parquet(f"{self.base}/snapshots/{name}/{t}")
        return name

    def restore(self, name: str) -> str:
        """A new version from a snapshot."""
        fs, path = self._fs()
        tables = [s.getPath().getName() for s in fs.listStatus(path(f"{self.base}/snapshots/{name}"))]
        return self.save({t: self.spark.read.parquet(f"{self.base}/snapshots/{name}/{t}") for t in tables}, {"restored": name})

    def size(self) -> DataFrame:
        """One row: bytes, MB, GB and files under the base folder."""
        fs, path = self._fs()
        s = fs.getContentSummary(path(self.base)) if fs.exists(path(self.base)) else None
        n = s.getLength() if s else 0
        return self.spark.createDataFrame([(n, n / 2**20, n / 2**30, s.getFileCount() if s else 0)], "bytes long, mb double, gb double, files long")

    def versions(self) -> DataFrame:
        rows = [(r["version"], r["seq"], r["created"], r["tables"], json.dumps(r["metadata"])) for r in self.manifest()]
        return self.spark.createDataFrame(rows, "version string, seq long, created string, tables array<string>, metadata string")


def retained(manifest: DataFrame, keep: int) -> DataFrame:
    """Which versions (version, seq) stay when the newest `keep` do."""
    newest = manifest.orderBy(F.desc("seq")).limit(keep).select("version", F.lit(True).alias("kept"))
    return manifest.join(F.broadcast(newest), "version", "left").select("version", "seq", F.coalesce("kept", F.lit(False)).alias("kept"))
