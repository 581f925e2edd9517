"""A table of known vectors, laid out by key.

Files are bucketed by a hash of the key and sorted in it, with a Bloom filter of their keys, so a join by key reads the
table where it is: only the other side is moved to the buckets. Few keys are looked up in their own buckets alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
# Up to so many keys are looked up by name.
MAX_NAMED_KEYS = 500


class CacheTable:
    """Entries {key, model, embedding} with unique keys, in the folder ``path``.

    The table has a name in the catalog of the session, which follows from its path; another session opens the same files
    with the same ``buckets``. More buckets mean less memory for a join and smaller files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"vecweave_cache_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        place = path.replace("'", "''")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, model STRING, embedding ARRAY<FLOAT>) USING parquet "
            "OPTIONS ('parquet.bloom.filter.enabled#key' 'true') "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def read(self) -> DataFrame:
        """All entries, partitioned by key without a shuffle."""
        return self.spark.table(self.name)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The entries of the keys in the one column of ``keys``. If these are few, only their buckets are read."""
        few = keys.distinct().limit(MAX_NAMED_KEYS + 1).collect()
        if len(few) <= MAX_NAMED_KEYS:
            return self.read().filter(F.col("key").isin([row[0] for row in few]))
        return self.read().join(keys.toDF("key"), "key", "left_semi")

    def append(self, entries: DataFrame) -> None:
        """Add entries whose keys are not there yet: one file for each bucket that gets some."""
        rows = entries.select("key", "model", "embedding").repartition(self.buckets, "key").sortWithinPartitions("key")
        rows.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def forget(self) -> None:
        """Take the name out of the catalog of the session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
