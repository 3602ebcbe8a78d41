"""Photo arrivals: newest batch, ordering, series, existing files, bursts
(D4, F1, I1, G6, E9, M3 batch twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson import constants as K
from keelson.operators.ordering import DEFAULT_CHUNK_ROWS, depth_chunks, last_before, ordinal, running_sum


def max_mtime(df: DataFrame, ts: str = "modificationTime") -> DataFrame:
    """one row, partial + final max."""
    return df.agg(F.max(ts).alias("latest_modification"))


def latest_batch(df: DataFrame, window_sec: int = K.PHOTO_BATCH_WINDOW_SEC, ts: str = "modificationTime") -> DataFrame:
    """Files whose whole-second mtime is within ``window_sec`` of the
    newest. The newest time is a one-row aggregate attached by broadcast
    (a scalar, never collected to the driver)."""
    m = max_mtime(df, ts).withColumn("_one", F.lit(1))
    j = df.withColumn("_one", F.lit(1)).join(F.broadcast(m), "_one")
    return j.where(F.unix_timestamp(ts) >= F.unix_timestamp("latest_modification") - window_sec) \
        .drop("_one", "latest_modification")


def photos_newest(df: DataFrame, ts: str = "modificationTime", cols: list[str] | None = None) -> DataFrame:
    """Newest first, without the content column (bytes join later)."""
    keep = [c for c in (cols or df.columns) if c != "content"]
    return df.select(*keep).orderBy(F.col(ts).desc(), F.col(keep[0]).asc())


def risk_series(df: DataFrame, ts: str = "modificationTime", tie: str = "path", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Photos numbered oldest first (1..n) over the whole batch. The
    position is a chunked global ordinal (chunks of equal depth, also when all
    photos come in one second), not one task."""
    d = depth_chunks(df.withColumn("_one", F.lit(1)), "_one", [ts, tie], "_depth", chunk_rows)
    return ordinal(d, "_one", [ts, tie], name="photo_index", chunk=F.col("_depth")).drop("_one", "_depth")


def existing_only(df: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Keep rows whose file exists in the listing (left semi join)."""
    return df.join(files.select(key).distinct(), key, "left_semi")


def burst_sessions(df: DataFrame, gap_sec: int = K.PHOTO_BATCH_WINDOW_SEC, ts: str = "modificationTime",
                   tie: str = "path", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """M3 batch twin: arrivals cut into bursts where the gap to the previous
    arrival exceeds ``gap_sec``; one row per burst (session_no, start, end,
    photos). Previous time and the running burst number are chunked over the
    global order, so no single task sees every row."""
    d = depth_chunks(df.select(ts, tie).withColumn("_one", F.lit(1)), "_one", [ts, tie], "_depth", chunk_rows)
    d = ordinal(d, "_one", [ts, tie], name="_rn", chunk=F.col("_depth"), keep_chunk="_ck").drop("_depth")
    d = last_before(d, "_one", "_rn", F.col(ts), "_prev", chunk="_ck")
    new = (F.col("_prev").isNull() | (F.unix_micros(F.col(ts).cast("timestamp"))
                                      - F.unix_micros(F.col("_prev").cast("timestamp")) > gap_sec * 1_000_000)).cast("int")
    d = running_sum(d.withColumn("_new", new), "_one", [ts, tie], "_new", "session_no", chunk="_ck")
    return d.groupBy("session_no").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
                                       F.count(F.lit(1)).alias("photos"))
