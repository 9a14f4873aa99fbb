"""The streaming rating reader feeds batch operators through foreachBatch."""

from pyspark.sql import functions as F

from recoflow.sources import fixtures as fx
from recoflow.sources import writers as wr
from recoflow.sources.tables import Tables
from recoflow.streaming import read_ratings_stream
from tests.conftest import SF_SMALL


def test_stream_roundtrip(spark):
    r = fx.ratings(Tables(spark, SF_SMALL))
    path = wr.write_lines(wr.delimited_lines(r, "\t"), wr.scratch_path(spark, "stream-in"))
    stream = read_ratings_stream(spark, path, "tsv", ["user_id", "item_id", "rating", "ts"])
    seen = []
    q = (stream.writeStream.foreachBatch(lambda df, _id: seen.append(df.agg(F.count(F.lit(1))).first()[0]))
         .option("checkpointLocation", wr.scratch_path(spark, "stream-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sum(seen) == r.count()
