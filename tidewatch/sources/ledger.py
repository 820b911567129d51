"""The ledger as a table in hash buckets: a batch rewrites only the buckets that it touches.

A version is a manifest that names the folder of each bucket. A batch reads the buckets of its keys, merges, writes these
buckets to a folder of its own and commits a manifest with them in place of the old ones. A batch that is replayed finds
its number in the manifest and changes nothing. Folders that no kept version names are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed as K
from tidewatch.operators import rings
from tidewatch.sources.shared import names_in, remove
from tidewatch.streaming.keyvalue import Conflict, StateTable

SAMPLE = "struct<ts: timestamp, score: double, source: string>"
ROW = (
    "canonical_key string, opportunity_id string, cluster_id string, cluster_at timestamp, first_seen timestamp, last_seen timestamp, last_score double, lifecycle_stage string, push_count long, "
    f"source_set array<string>, simhash long, text string, toks array<string>, samples array<{SAMPLE}>"
)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ledger rows (ROW) of both sides as one row a key.

    first_seen is the least; last_seen, score, stage, id, SimHash, text (its first LEDGER_TEXT characters) and tokens are those of the
    newest row, of equal times of the greater score; a cluster is that of the newest row that names one, and cluster_at its time (a row's last_seen if null); pushes add up; sources unite; the
    last SAMPLES_CAP samples stay. All but samples is one aggregate with map-side merging.
    """
    every = old.unionByName(new)
    newest = F.struct("last_seen", "last_score", "lifecycle_stage", "opportunity_id", "simhash", F.substring("text", 1, K.LEDGER_TEXT).alias("text"), "toks")
    named = F.when(F.coalesce("cluster_id", F.lit("")) != "", F.struct(F.coalesce("cluster_at", "last_seen").alias("cluster_at"), "cluster_id"))
    rows = every.groupBy("canonical_key").agg(
        F.min("first_seen").alias("first_seen"), F.max(newest).alias("n"), F.max(named).alias("c"), F.sum("push_count").alias("push_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_set")))).alias("source_set"),
    )
    held = rings.merge_rings(old.select("canonical_key", "samples"), new.select("canonical_key", "samples"), "canonical_key")
    out = rows.select("canonical_key", F.coalesce("c.cluster_id", F.lit("")).alias("cluster_id"), "c.cluster_at", "first_seen", "push_count", "source_set", "n.*").join(held, "canonical_key", "left")
    names = [part.strip().split(" ")[0] for part in ROW.replace(SAMPLE, "x").split(",")]
    return out.withColumn("samples", F.coalesce("samples", F.array().cast(f"array<{SAMPLE}>"))).select(*names)


class Ledger:
    """A ledger in a folder, in `buckets` buckets: a number that stays with the folder. `keep` versions stay readable."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 3):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.manifest = StateTable(spark, f"{self.path}/manifest", keep)

    def _bucket(self):
        return F.pmod(F.xxhash64("canonical_key"), F.lit(self.buckets)).cast("int")

    def _open(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def rows(self) -> DataFrame:
        """The last version; empty at first."""
        return self._open([*self.manifest.snapshot()[1].get("buckets", {}).values()])

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Merges rows (ROW) as batch `number`, and says whether it did: a number at or below the last one is a replay. For foreachBatch.

        The driver sees bucket numbers only, at most `buckets` of them.
        """
        version, state = self.manifest.snapshot()
        if number <= state.get("batch", -1):
            return False
        if state.get("of", self.buckets) != self.buckets:
            raise ValueError(f"the ledger has {state['of']} buckets")
        held = state.get("buckets", {})
        batch = batch.persist()
        try:
            touched = sorted(str(r["b"]) for r in batch.select(self._bucket().alias("b")).distinct().collect())
            old = self._open([held[b] for b in touched if b in held])
            folder = f"data/batch={number}"
            out = merged(old, batch).withColumn("bucket", self._bucket())
            # one file a bucket: the buckets are the shuffle's partitions, and a batch touches what it touches
            out.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        finally:
            batch.unpersist()
        buckets = held | {b: f"{folder}/bucket={b}" for b in touched}
        self.manifest.commit(version, {"batch": number, "of": self.buckets, "buckets": buckets})
        self._prune()
        return True

    def _prune(self) -> None:
        """Deletes the batches of which no kept version names a bucket."""
        rows = self.spark.read.schema("key string, value string").parquet(*[f"{self.manifest.path}/{n}" for n in names_in(self.spark, self.manifest.path) if n.startswith("v=")])
        named = rows.filter("key = 'buckets'").select(F.explode(F.from_json("value", "map<string,string>")).alias("b", "folder"))
        used = {r["f"] for r in named.select(F.element_at(F.split("folder", "/"), 2).alias("f")).distinct().collect()}
        for name in names_in(self.spark, f"{self.path}/data"):
            if name.startswith("batch=") and name not in used:
                remove(self.spark, f"{self.path}/data/{name}")


def ledger_sink(ledger: Ledger):
    """foreachBatch function of a ledger; one writer at a time, a second one gets Conflict."""

    def write(batch: DataFrame, number: int) -> None:
        ledger.merge(batch, number)

    return write


__all__ = ["ROW", "SAMPLE", "Conflict", "Ledger", "ledger_sink", "merged"]
