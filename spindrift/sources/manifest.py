"""Manifests: which source files make a dataset, and whether they are what they should be."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("annotations", "neurotransmitters", "connectivity")


@dataclass(frozen=True)
class Artifact:
    role: str
    filename: str
    size_bytes: int
    sha256: str


@dataclass(frozen=True)
class Manifest:
    dataset: str
    artifacts: tuple[Artifact, ...]
    expected_neurons: int | None = None

    def artifact(self, role: str) -> Artifact:
        return next(a for a in self.artifacts if a.role == role)


def load(text: str) -> Manifest:
    """From JSON; each role exactly once, sizes positive, hashes of 64 hexadecimal digits."""
    raw = json.loads(text)
    artifacts = tuple(Artifact(s["role"], s["filename"], int(s["size_bytes"]), s["sha256"].lower()) for s in raw["sources"])
    if sorted(a.role for a in artifacts) != sorted(ROLES):
        raise ValueError(f"a manifest has each of {', '.join(ROLES)} once")
    for a in artifacts:
        if a.size_bytes <= 0 or len(a.sha256) != 64 or set(a.sha256) - set("0123456789abcdef"):
            raise ValueError(f"{a.role}: bad size or hash")
    return Manifest(raw["dataset"], artifacts, raw.get("selection", {}).get("expected_neuron_count"))


#: Bytes of a file that one task may hold to hash it.
MOST_BYTES = 256 << 20


def hashes(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(filename, size_bytes, sha256) of the named files of a folder that are there.

    Files of up to MOST_BYTES are hashed by the executors, side by side. A hash can't be put together from parts, so a larger
    file is read as a stream, by the driver's JVM.
    """
    jvm, small, found = spark._jvm, [], []
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(where, name)
        if not system.exists(path):
            continue
        size = system.getFileStatus(path).getLen()
        if size <= MOST_BYTES:
            small.append((name, system.makeQualified(path).toString()))
            continue
        stream = system.open(path)
        try:
            found.append((name, size, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    schema = "filename string, size_bytes long, sha256 string"
    large = spark.createDataFrame(found, schema)
    if not small:
        return large
    listed = spark.createDataFrame(small, "filename string, path string")
    read = spark.read.format("binaryFile").load([path for _, path in small])
    hashed = read.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return listed.join(hashed, "path").select("filename", "size_bytes", "sha256").unionByName(large)


def verify(spark: SparkSession, manifest: Manifest, folder: str) -> DataFrame:
    """(role, filename, state): ok, missing, size or hash for each artifact, checked in this order."""
    wanted = spark.createDataFrame([(a.role, a.filename, a.size_bytes, a.sha256) for a in manifest.artifacts], "role string, filename string, want_size long, want_hash string")
    state = F.when(F.col("size_bytes").isNull(), "missing").when(F.col("size_bytes") != F.col("want_size"), "size").when(F.col("sha256") != F.col("want_hash"), "hash").otherwise("ok")
    return wanted.join(hashes(spark, folder, [a.filename for a in manifest.artifacts]), "filename", "left").select("role", "filename", state.alias("state"))


def require(verified: DataFrame) -> None:
    bad = [f"{r.role} ({r.state})" for r in verified.where("state <> 'ok'").collect()]  # three rows at most
    if bad:
        raise ValueError("unusable sources: " + ", ".join(bad))
