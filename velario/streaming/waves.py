"""Documents that arrive in waves: one Structured Streaming query for each project.

Every micro-batch finds new names, gives them codenames after the existing ones, saves the mapping
as the next version and appends the rewritten fragments. Numbering has one writer, the query's
driver. A batch that runs again after a failure rewrites its own output folder, and its names
already have codenames, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velario.operators import cluster, codenames, detect
from velario.operators.replace import find_surviving, replace_names
from velario.operators.store import MappingStore, upsert

FRAGMENTS = "batch_id string, doc_id long, file_ord int, seq long, channel string, sheet string, row int, col int, text string"


def process_wave(store: MappingStore, project: str, fragments: DataFrame, out_path: str, wave: int, detector: Callable[[DataFrame], DataFrame] | None = None, mode: str = "account_full", log: bool = True) -> DataFrame:
    """One wave: new names to the mapping, fragments rewritten to ``out_path/wave=n``."""
    fragments = fragments.persist()
    try:
        candidates = (detector or detect.detect_candidates)(fragments)
        known = store.load(project)
        old = known.select(F.lower("original").alias("low")).distinct()
        fresh = candidates.join(old, F.lower("text") == F.col("low"), "left_anti")
        # Known names take part in clustering, so a new spelling joins its name; their entries stay.
        seen = known.select(F.col("original").alias("text"), "kind", F.lit(0).cast("long").alias("count"), F.lit("known").alias("source"), F.lit(None).cast("string").alias("account_code"))
        review = codenames.assign_codenames(cluster.cluster_variants(fresh.unionByName(seen)), known, project, mode)
        new = codenames.review_to_mapping(review, project).join(old, F.lower("original") == F.col("low"), "left_anti")
        merged = upsert(known.drop("updated_at"), new)
        store.save(project, merged)
        mapping = store.load(project)
        target = f"{out_path.rstrip('/')}/wave={wave}"
        replace_names(fragments, mapping).write.mode("overwrite").parquet(target)
        done = store.spark.read.parquet(target)
        if log:
            leaks = find_surviving(done.select("doc_id", F.col("replaced").alias("text")), mapping).count()
            files = done.select("doc_id").distinct().count()
            store.log(project, "wave", files=files, entities=mapping.count(), leaks=leaks)
        return done
    finally:
        fragments.unpersist()


def stream_waves(spark: SparkSession, source: str, store_root: str, project: str, out_path: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Start the query over Parquet files of fragments that land in ``source``."""
    store = MappingStore(spark, store_root)
    stream = spark.readStream.schema(FRAGMENTS).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda rows, n: process_wave(store, project, rows, out_path, n, **options) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
