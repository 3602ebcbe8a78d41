"""Rows that the pipeline records of a run (B2): one per video, put together
from the probe, the frame funnel, the segmentation rows and the wall times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson import schemas as SC
from keelson.functions import frames as FR

STAGES = ("extraction_wall_seconds", "preprocessing_wall_seconds", "inference_wall_seconds", "export_stage_wall_seconds", "pipeline_wall_seconds")
ROOTS = ("staging_frames_root", "processed_frames_root", "masks_root", "overlays_root", "curated_processed_root", "curated_segmentations_root")


def run_rows(probed: DataFrame, funnel: DataFrame, segmentations: DataFrame, times: DataFrame, roots: dict[str, str],
             start_sec: int, every_n: int, key: str = "video_id") -> DataFrame:
    """B2: the rows of ``video_pipeline_runs`` for every video in ``probed``
    (video_id, source_video, fps, source_total_frames, duration_sec).
    ``funnel`` is F2's, ``segmentations`` have a ``status`` per frame, ``times``
    the wall seconds per video. A folder is its root with the video's id
    below it, but for the curated ones. Missing counts are 0, missing times null."""
    done = segmentations.groupBy(key).agg(F.count_if(F.col("status") == "ok").alias("_ok"))
    counts = funnel.select(key, "extracted_frames", "quality_ok_frames", "deduplicated_frames", "candidate_processed_frames",
                           "processed_frames", "fallback_mode")
    start = FR.effective_start(F.lit(start_sec), F.col("duration_sec")).cast("int")
    d = probed.join(counts, key, "left").join(done, key, "left").join(times.select(key, *STAGES), key, "left")
    made = {
        "trim_start_sec": start, "extract_every_n_frames": F.lit(every_n), "segmented_frames": F.coalesce("_ok", F.lit(0)),
        "trimmed_frames": FR.trimmed_frames("source_total_frames", start, "fps"),
        **{c: F.coalesce(c, F.lit(0)) for c in ("extracted_frames", "quality_ok_frames", "deduplicated_frames", "candidate_processed_frames", "processed_frames")},
        **{c: F.round(c, 4) for c in STAGES},
        **{r: F.lit(roots.get(r)) if r.startswith("curated") else F.concat(F.lit(roots.get(r)), F.lit("/"), F.col(key)) for r in ROOTS}}
    return d.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SC.PIPELINE_RUNS.fields])
