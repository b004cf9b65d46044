"""Token streams put together: numbered chunks that come in any order, twice or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembled(chunks: DataFrame) -> DataFrame:
    """stream, text, chunks, repeats, next_seq, waiting of chunks(stream, seq, token), numbered from 0.

    text is what the chunks without a gap from 0 on say; next_seq the first number that is
    missing, waiting the chunks behind it, repeats those that came again. Of chunks with
    one number the least token counts; null tokens say nothing; null numbers or streams
    are left out. Only chunks of the text are gathered, into the text itself.
    """
    one = chunks.where("stream is not null and seq >= 0").groupBy("stream", "seq").agg(F.count("*").alias("times"), F.min("token").alias("token"))
    place = F.row_number().over(Window.partitionBy("stream").orderBy("seq")) - 1
    rows = one.withColumn("fits", F.col("seq") == place)
    said = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("seq", F.coalesce("token", F.lit("")).alias("token")))))
    out = rows.groupBy("stream").agg(said.alias("said"), F.count("*").alias("chunks"), F.sum(F.col("times") - 1).alias("repeats"), F.count_if("fits").alias("next_seq"))
    return out.select("stream", F.array_join(F.transform("said", lambda s: s["token"]), "").alias("text"), "chunks", "repeats", "next_seq", (F.col("chunks") - F.col("next_seq")).alias("waiting"))
