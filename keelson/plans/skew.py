"""Hot-key check on the given tables: every event of ``events`` is treated
as ONE video (the extreme skew), then the per-video frame numbering is
computed with a plain ``Window.partitionBy(video)`` and with the chunked
ordinal. Prints, for each, how the rows spread over the window's tasks and
whether both numberings agree.

    python -m keelson.plans.skew /root/testdata/sf0.1
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F


def main(sf_dir: str, partitions: int = 8, aqe: bool = False) -> dict:
    from keelson.operators.ordering import ordinal, time_chunk
    from keelson.session import get_spark
    spark = get_spark(f"local[{partitions}]", app="keelson-skew", shuffle_partitions=partitions,
                      extra={"spark.sql.adaptive.enabled": str(aqe).lower(),
                             # scale AQE's partition target down with the data, so
                             # coalescing behaves as it would on a large input
                             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                             "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(1).cast("bigint").alias("video_id"), "ts", "event_id")
    out = {}
    plain = ev.withColumn("rn", F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "event_id")))
    chunked = ordinal(ev, "video_id", ["ts", "event_id"], name="rn", chunk=time_chunk("ts"))
    for name, df in (("plain_window", plain), ("chunked_ordinal", chunked)):
        t0 = time.perf_counter()
        per_task = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        out[name] = {"tasks_with_rows": len(per_task), "max_rows_in_one_task": max(per_task), "rows": sum(per_task),
                     "seconds": round(time.perf_counter() - t0, 2)}
    diff = plain.select("event_id", F.col("rn").alias("a")).join(chunked.select("event_id", F.col("rn").alias("b")), "event_id") \
        .where("a != b").count()
    out["numbering_equal"] = diff == 0
    print(json.dumps(out))
    spark.stop()
    return out


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1", aqe=len(sys.argv) > 2 and sys.argv[2] == "aqe")
