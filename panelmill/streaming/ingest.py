"""Incremental ingest of market-price files with Structured Streaming.

Export sites drop new CSV files into folders, with any mix of header spellings. The folders are
one file stream of text lines; each micro-batch takes the first line of its new files,
groups the files by header and reads every group exactly like the batch reader.
``trigger(availableNow=True)`` processes every file present and stops, so the job runs as a
scheduled batch while the checkpoint (under the shared ``spark.checkpoint.dir``) remembers which
files were already ingested. A micro-batch writes one partition ``batch_id=N`` of the table and
overwrites it when it is run again after a failure, so no file is ever counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelmill.sources.prices_csv import first_lines, header_groups, read_groups, text_lines


def ingest_sites(spark: SparkSession, folders: list[str], table_path: str,
                 checkpoint_root: str) -> None:
    """Add every not-yet-seen file of every folder to the table at ``table_path`` (parquet)."""

    def add(lines: DataFrame, batch_id: int) -> None:
        groups = header_groups(first_lines(lines))
        if groups:
            (read_groups(lines.sparkSession, groups).write.mode("overwrite")
             .parquet(f"{table_path}/batch_id={batch_id}"))

    streams = [text_lines(spark.readStream.text(f)) for f in folders]
    merged = streams[0]
    for s in streams[1:]:
        merged = merged.unionByName(s)
    q = (merged.writeStream.foreachBatch(add)
         .option("checkpointLocation", checkpoint_root)
         .trigger(availableNow=True).start())
    q.awaitTermination()
