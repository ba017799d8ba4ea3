"""Analysis of files as they arrive.

Everything up to the target path is stateless per document, so the batch plan
runs on a stream as it is.  Collision-free names for the whole corpus come from results
written by ``write_results_stream``, read back and planned by ``with_renames``; ``names.name_stream``
gives names as results arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doctriage.plans.analyze import analyze
from doctriage.plans.report import result_json, write_outputs
from doctriage.sources.corpus import decoded_path
from doctriage.sources.shared import shared_folder


def stream_text_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(
            decoded_path(F.col("_metadata.file_path")).alias("path"),
            F.col("value").alias("text"),
            F.lit(None).cast("string").alias("errors"),
        )
    )


def _append(df: DataFrame, form: str, out: str, name: str) -> StreamingQuery:
    progress = f"{shared_folder(df.sparkSession)}/doctriage/stream-{name}"
    return (
        df.writeStream.format(form)
        .option("path", out)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def write_json_stream(docs: DataFrame, out: str, name: str, **options) -> StreamingQuery:
    """Appends JSON lines for all documents that are there, then stops.

    ``name`` identifies the progress kept in the shared folder: a later run
    under the same name only picks up new files.
    """
    return _append(result_json(analyze(docs, **options)), "text", out, name)


def write_results_stream(docs: DataFrame, out: str, name: str, **options) -> StreamingQuery:
    """The same with whole results, as a Parquet table for reports and ``with_renames``."""
    return _append(analyze(docs, **options), "parquet", out, name)


def write_outputs_stream(docs: DataFrame, out: str, name: str, **options) -> StreamingQuery:
    """JSON lines and the report for all documents that are there, a folder of both for each batch; then stops.

    A batch is analysed once, and appears whole or not at all: a batch that is run again after a failure finds its folder
    or writes it anew, so no document is lost or reported twice.
    """
    progress = f"{shared_folder(docs.sparkSession)}/doctriage/stream-{name}"
    return (
        analyze(docs, **options)
        .writeStream.foreachBatch(lambda batch, n: write_outputs(batch, f"{out}/batch={n}", run=f"{name}-{n}"))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
