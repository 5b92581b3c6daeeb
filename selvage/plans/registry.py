"""The registry: signed releases and their artefacts, stored as tables under one folder and read back by domain."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators import emit
from selvage.plans.run import Conflict, NotFound

_RELEASE = "domain string, version string, run_id string, signature string, manifest string"
_ARTEFACT = "domain string, version string, path string, media_type string, sha256 string, content binary"


class Registry:
    """root: a folder that all executors share. A release is written artefacts first, so one that is listed is whole."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def put(self, manifest: dict, artefacts: dict[str, bytes]) -> None:
        """Store a release; one of the same domain and version is a conflict, as are artefacts that the manifest does not list."""
        domain, version = manifest["domain"], manifest["version"]
        if not self.releases(domain).where(F.col("version") == version).isEmpty():
            raise Conflict(f"{domain} {version} exists")
        if {a["path"] for a in manifest["artefacts"]} != set(artefacts):
            raise Conflict("the manifest lists other artefacts")
        hashes = {a["path"]: a["sha256"] for a in manifest["artefacts"]}
        rows = [(domain, version, p, "application/schema+json" if p.endswith(".schema.json") else "application/json", hashes[p], bytearray(c)) for p, c in sorted(artefacts.items())]
        own = self.spark.createDataFrame(rows, _ARTEFACT)
        if not own.where(F.sha2("content", 256) != F.col("sha256")).isEmpty():
            raise Conflict("an artefact is not what the manifest says")
        own.write.mode("append").partitionBy("domain").parquet(f"{self.root}/artefacts")
        head = [(domain, version, manifest["runId"], manifest["signature"], json.dumps(manifest, sort_keys=True))]
        self.spark.createDataFrame(head, _RELEASE).coalesce(1).write.mode("append").partitionBy("domain").parquet(f"{self.root}/releases")

    def releases(self, domain: str) -> DataFrame:
        """version, run_id, signature, manifest of a domain's releases; only its folder is read."""
        return self._table("releases", _RELEASE).where(F.col("domain") == domain).select("version", "run_id", "signature", "manifest")

    def manifest(self, domain: str, version: str) -> dict:
        row = self.releases(domain).where(F.col("version") == version).first()
        if row is None:
            raise NotFound(f"{domain} {version}")
        return json.loads(row["manifest"])

    def artefacts(self, domain: str, version: str) -> DataFrame:
        """path, media_type, sha256 of a release."""
        self.manifest(domain, version)
        return self._table("artefacts", _ARTEFACT).where((F.col("domain") == domain) & (F.col("version") == version)).select("path", "media_type", "sha256")

    def artefact(self, domain: str, version: str, path: str) -> tuple[str, bytes]:
        """Media type and content."""
        row = self._table("artefacts", _ARTEFACT).where((F.col("domain") == domain) & (F.col("version") == version) & (F.col("path") == path)).select("media_type", "content").first()
        if row is None:
            raise NotFound(f"{domain} {version} {path}")
        return row["media_type"], bytes(row["content"])

    def difference(self, domain: str, before: str, after: str) -> DataFrame:
        return emit.difference(self.artefacts(domain, before), self.artefacts(domain, after))
