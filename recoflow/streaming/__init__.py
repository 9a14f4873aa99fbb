"""Streaming entry points.

The reference is batch only (no streams, watermarks or state). The one
streaming piece offered is the file-stream form of the rating reader, so a
folder that receives rating files can feed the same batch operators through
``foreachBatch``; no stateful streaming operator is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recoflow.sources.readers import RATING_FORMATS, ratings_schema


def read_ratings_stream(spark: SparkSession, folder: str, fmt: str = "tsv", schema=None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    opts = RATING_FORMATS[fmt]
    r = spark.readStream.schema(ratings_schema(schema)).option("sep", opts["sep"]).option("header", opts["header"])
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(folder)
