"""A vector table with versions: changes are small, removals included, and a read does not rank the history.

A store is a folder with

* a base: one row per model and id, in files by model,
* deltas: what later changes put in or took out, in the same layout, and
* manifests, one file per version, each with the base and the deltas that make it up.

A version becomes current when its manifest gets its name, in one step; readers open the files of the version they began
with. Of a key the latest change counts. Compaction writes a new base and leaves the deltas behind. Changes may be made at
the same time: whoever comes second builds on the version of the first.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecweave.operators.dedup import first_by_key
from vecweave.operators.joins import MAX_BROADCAST_BYTES, size_in_bytes
from vecweave.sources.vectors import latest_vectors

KEY = ["model", "id"]
# A store is compacted when it has more deltas, or when their rows exceed this share of the base.
MAX_DELTAS = 8
MAX_DELTA_SHARE = 0.25
_ATTEMPTS = 20


@dataclass(frozen=True)
class Part:
    """A folder with rows of the store, how many there are, and about how many bytes their keys take."""

    folder: str
    rows: int
    key_bytes: int


@dataclass(frozen=True)
class Manifest:
    """What a version is made of. ``deltas`` are in the order of the changes; ``schema`` is that of the rows, as JSON."""

    version: int = 0
    schema: str = ""
    base: Part | None = None
    deltas: tuple[Part, ...] = field(default=())

    def fields(self) -> StructType:
        """The schema of the rows; without fields, if there is none yet."""
        return StructType.fromJson(json.loads(self.schema)) if self.schema else StructType()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        told = json.loads(text)
        base = Part(**told["base"]) if told["base"] else None
        return cls(told["version"], told["schema"], base, tuple(Part(**part) for part in told["deltas"]))


class VectorStore:
    """Vectors by model and id, neither of them null, in the folder ``path``, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, max_broadcast_bytes: int = MAX_BROADCAST_BYTES):
        self.spark, self.path, self.max_broadcast_bytes = spark, path.rstrip("/"), max_broadcast_bytes
        jvm, self._paths = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        uri = self._files.makeQualified(self._paths(self.path)).toUri()
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration())

    # --- versions

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        """All versions whose manifest is still there."""
        folder = self._paths(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name[:12]) for name in names if name[:1].isdigit() and name.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, by default the current one; that of an empty store, if there is none."""
        known = self.versions()
        if version is None and not known:
            return Manifest()
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"the store has no version {version}")
        return Manifest.from_json(self.spark.read.text(self._manifest_path(version), wholetext=True).first()[0])

    def _become(self, manifest: Manifest) -> bool:
        """Make a manifest the current one; false if another one has its number already."""
        hidden = self._paths(f"{self.path}/manifests/_{uuid.uuid4()}")
        out = self._files.create(hidden, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(
            self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
        )
        try:
            self._context.rename(hidden, self._paths(self._manifest_path(manifest.version)), none)
        except Py4JJavaError as error:
            self._files.delete(hidden, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _change(self, make) -> Manifest:
        """Put what ``make`` makes of the current manifest in its place, and try again if another change was faster."""
        for _ in range(_ATTEMPTS):
            made = make(self.manifest())
            if self._become(made):
                return made
        raise RuntimeError(f"{_ATTEMPTS} other changes came first")

    def _write(self, rows: DataFrame, kind: str) -> Part:
        folder = f"{kind}-{uuid.uuid4()}"
        rows.write.partitionBy("model").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").select(*KEY)
        return Part(folder, written.count(), size_in_bytes(written))

    # --- changes

    def upsert(self, vectors: DataFrame) -> Manifest:
        """Put rows {id, model, embedding, ...} in the place of those with their model and id. With a column ``version``
        the newest of several rows of a key counts; without one, keys must be there once."""
        if "version" in vectors.columns:
            vectors = latest_vectors(vectors)
        return self._add(vectors.withColumn("removed", F.lit(False)))

    def remove(self, keys: DataFrame) -> Manifest:
        """Take out the vectors with the model and id of ``keys``. Keys that are not there do not matter."""
        schema = self.manifest().fields()
        if not schema:
            raise ValueError("the store is empty")
        gone = keys.select(*KEY).distinct().withColumn("removed", F.lit(True))
        empty = self.spark.createDataFrame([], schema)
        return self._add(empty.withColumn("removed", F.lit(True)).unionByName(gone, allowMissingColumns=True))

    def _add(self, rows: DataFrame) -> Manifest:
        part = self._write(rows, "delta")
        schema = rows.drop("removed").schema.json()

        def make(now: Manifest) -> Manifest:
            return Manifest(now.version + 1, now.schema or schema, now.base, (*now.deltas, part))

        return self._change(make)

    def compact(self) -> Manifest:
        """Write the current rows as a new base. Changes that are made meanwhile stay as deltas."""
        was = self.manifest()
        if not was.deltas:
            return was
        part = self._write(self._rows(was), "base")
        return self._change(lambda now: Manifest(now.version + 1, now.schema, part, now.deltas[len(was.deltas) :]))

    def compact_if_needed(self, max_deltas: int = MAX_DELTAS, max_share: float = MAX_DELTA_SHARE) -> bool:
        """Compact a store whose deltas have become many or large."""
        now = self.manifest()
        changed = sum(part.rows for part in now.deltas)
        if len(now.deltas) <= max_deltas and changed <= max_share * (now.base.rows if now.base else 0):
            return False
        self.compact()
        return True

    def forget(self, before: int | None = None) -> int:
        """Delete versions before one, by default all but the current, and the files that only they need; returns how many
        versions went. Readers of these versions must have ended."""
        known = self.versions()
        before = known[-1] if before is None and known else before or 0
        kept = [self.manifest(version) for version in known if version >= before]
        needed = {part.folder for one in kept for part in (*one.deltas, *([one.base] if one.base else []))}
        gone = [version for version in known if version < before]
        old = {part.folder for v in gone for one in [self.manifest(v)] for part in (*one.deltas, *([one.base] if one.base else []))}
        for version in gone:
            self._files.delete(self._paths(self._manifest_path(version)), False)
        for folder in old - needed:
            self._files.delete(self._paths(f"{self.path}/{folder}"), True)
        return len(gone)

    # --- reading

    def _part(self, part: Part, schema: StructType, model: str | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part.folder}")
        return rows if model is None else rows.filter(F.col("model") == model)

    def _rows(self, of: Manifest, model: str | None = None) -> DataFrame:
        if of.base is None and not of.deltas:
            raise ValueError("the store is empty")
        fields = of.fields()
        base = None if of.base is None else self._part(of.base, fields, model)
        if not of.deltas:
            return base
        deltas = [
            self._part(part, StructType([*fields.fields]).add("removed", "boolean"), model).withColumn("_number", F.lit(number))
            for number, part in enumerate(of.deltas)
        ]
        # A key is in a delta once: as many rows of it as there are deltas at most.
        changed = deltas[0] if len(deltas) == 1 else first_by_key(reduce(DataFrame.union, deltas), KEY, [F.desc("_number")])
        there = changed.filter("NOT removed").drop("removed", "_number")
        if base is None:
            return there
        keys = reduce(DataFrame.union, [delta.select(*KEY) for delta in deltas])
        if sum(part.key_bytes for part in of.deltas) <= self.max_broadcast_bytes:
            keys = F.broadcast(keys)
        return base.join(keys, KEY, "left_anti").select(*base.columns).union(there.select(*base.columns))

    def read(self, model: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the current one; with ``model`` only its files are read. Rows of the base
        stay where they are, if the keys of the deltas are few in bytes, as the manifest says."""
        return self._rows(self.manifest(version), model)
