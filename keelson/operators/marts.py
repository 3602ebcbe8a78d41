"""The five dashboard mart tables (L1-L5, K1) and the panel queries
(L6-L13, G9, G10, E4).

The reference rebuilds SQLite tables row by row from JSON manifests. Here a
mart is one DataFrame per table, computed from the per-frame class counts of
every asset at once; each is written with ``mode('overwrite')`` by the sink.
Keys: (kind, asset_id).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.num import rnd

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import risk as RK
from keelson.functions import text as TX
from keelson.operators import classes as OC
from keelson.operators.ordering import ordinal, time_chunk

KEYS = ["kind", "asset_id"]


MART_CLASSES = tuple(n for n in K.ALLOWED_CLASS_NAMES if n != "Ship hull")


def shares_risk(rows: Column) -> Column:
    """F13 of an asset's class rows (array): mean weight by share, 0 without."""
    total = F.aggregate(rows, F.lit(0.0), lambda a, c: a + c["pixel_share_pct"] / 100.0)
    weighted = F.aggregate(rows, F.lit(0.0), lambda a, c: a + c["pixel_share_pct"] / 100.0 * RK.fallback_weight(c["class_name"]))
    return F.when(total != 0, rnd(weighted / F.greatest(total, F.lit(1e-6)), 3)).otherwise(F.lit(0.0))


def primary_of(rows: Column) -> Column:
    """F16 of an asset's class rows (array): the defect class in most frames
    (then by share, pixels, smaller id)."""
    defects = F.filter(rows, lambda c: ~c["class_name"].isin(*K.NON_DEFECT_NAMES) & ((c["frames_present"] > 0) | (c["pixel_share_pct"] > 0)))
    best = F.array_max(F.transform(defects, lambda c: F.struct(
        c["frames_present"].alias("f"), c["pixel_share_pct"].alias("s"), c["pixel_count"].alias("p"), (-c["class_id"]).alias("i"),
        c["class_name_ru"].alias("n"))))
    return F.coalesce(best["n"], F.lit(K.NO_ISSUE_LABEL))


def class_metrics_mart(summary: DataFrame, meta: DataFrame) -> DataFrame:
    """L2 from a class summary (F6) keyed by KEYS: canonical names in the
    allowed set (D12), translation, share percent (C33)."""
    cm = summary.withColumn("class_name", CL.canonical_class("class_name")).where(F.col("class_name").isin(*MART_CLASSES))
    cm = cm.join(meta.select(*KEYS, "updated_at_epoch"), KEYS)
    return cm.select(*KEYS, "updated_at_epoch", "class_id", "class_name",
                     CL.translate("class_name").alias("class_name_ru"),
                     "frames_present", "pixel_count", TX.share_pct("pixel_share").alias("pixel_share_pct"))


def stage_times(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """K1 / L4: five wall-time columns to rows; 'other' = max(total - sum, 0)
    only when > .05; zero rows dropped; 3 decimals."""
    ex, pre, inf, exp = (F.coalesce(F.col(c), F.lit(0.0)) for c in (
        "extraction_wall_seconds", "preprocessing_wall_seconds", "inference_wall_seconds", "export_stage_wall_seconds"))
    # snapped to 9 decimals so float noise cannot decide the > .05 test
    other = F.greatest(rnd(F.coalesce(F.col("pipeline_wall_seconds"), F.lit(0.0)) - (ex + pre + inf + exp), 9), F.lit(0.0))
    names = K.STAGE_NAMES
    rows = F.array(
        F.struct(F.lit(names[0]).alias("stage_name"), rnd(ex, 3).alias("seconds"), F.lit(1).alias("stage_order")),
        F.struct(F.lit(names[1]).alias("stage_name"), rnd(pre, 3).alias("seconds"), F.lit(2).alias("stage_order")),
        F.struct(F.lit(names[2]).alias("stage_name"), rnd(inf, 3).alias("seconds"), F.lit(3).alias("stage_order")),
        F.struct(F.lit(names[3]).alias("stage_name"), rnd(exp, 3).alias("seconds"), F.lit(4).alias("stage_order")),
        F.struct(F.lit(names[4]).alias("stage_name"),
                 F.when(other > K.OTHER_STAGE_MIN, rnd(other, 3)).otherwise(F.lit(0.0)).alias("seconds"),
                 F.lit(5).alias("stage_order")))
    e = runs.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")
    return e.where(F.col("seconds") > 0)


def benchmark_mart(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scaling estimate rows per asset."""
    items = F.when(F.col("kind") == "photo", F.col("total_images")).otherwise(F.col("segmented_frames_raw"))
    curve = RK.benchmark_curve(items, "pipeline_wall_seconds", "inference_wall_seconds", F.col("kind"))
    return runs.select(*keys, F.explode(curve).alias("p")).select(*keys, "p.*")


def parallel_mart(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One- and two-video estimate rows."""
    return runs.select(*keys, F.explode(RK.parallel_estimate("pipeline_wall_seconds")).alias("p")).select(*keys, "p.*")


class Marts:
    """B7 / L1-L5, built lazily per table. ``lines``: (kind, asset_id,
    frame_idx, updated_at, l_linenumber, l_quantity, l_tax, l_discount,
    l_extendedprice) — one row per detected region of a frame (see
    bindings.mart_lines). All tables read :attr:`per_frame`, one aggregation
    over the lines. A single table is one plan from the lines; for several,
    :meth:`shared` writes ``per_frame`` once to the shared folder, so that
    they scan and join the lines once."""

    def __init__(self, lines: DataFrame, materialize: bool = False):
        self.lines = lines
        self.materialize = materialize

    def shared(self) -> "Marts":
        """These marts for the use of several tables."""
        return self if self.materialize else Marts(self.lines, True)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def per_frame(self) -> DataFrame:
        """Per (asset, frame): its pixels of each class (null where it has
        none), exact stage sums, number of lines, time. The class list is
        fixed, so conditional sums do in one aggregation what a group per
        class would do in two."""
        from keelson.sources.bindings import class_of_line
        dec, cls = "decimal(18,2)", class_of_line("l_linenumber")
        pixels = [F.sum(F.when(cls == cid, F.col("l_quantity"))).cast("bigint").alias(f"_p{cid}") for cid, _, _ in K.CLASS_INFO]
        sums = [F.sum(F.col(c).cast(dec)).alias(n) for n, c in (
            ("_q", "l_quantity"), ("_t", "l_tax"), ("_d", "l_discount"), ("_e", "l_extendedprice"))]
        g = self.lines.groupBy(*KEYS, "frame_idx").agg(*pixels, *sums, F.count(F.lit(1)).alias("_lines"),
                                                      F.max("updated_at").alias("frame_time"))
        if self.materialize:
            from keelson.session import cut_lineage
            return cut_lineage(g)
        return g

    def _pixels(self) -> Column:
        """The frame's classes in order, as entries (class_id, pixels)."""
        return F.filter(F.array(*[F.struct(F.lit(cid).alias("class_id"), F.col(f"_p{cid}").alias("pixels")) for cid, _, _ in K.CLASS_INFO]),
                        lambda e: e["pixels"].isNotNull())

    @cached_property
    def counts(self) -> DataFrame:
        """Per (asset, frame, class) pixels, long form."""
        return self.per_frame.select(*KEYS, "frame_idx", F.explode(self._pixels()).alias("e")).select(*KEYS, "frame_idx", "e.*")

    @cached_property
    def frames(self) -> DataFrame:
        from keelson.sources.bindings import with_predictions
        return with_predictions(self.per_frame.select(
            *KEYS, "frame_idx", "frame_time", F.map_from_entries(self._pixels()).alias("class_pixel_counts")))

    @cached_property
    def per_asset(self) -> DataFrame:
        """Per asset, one aggregation over the frames: update time, exact stage
        sums, frames, mean risk (F12), and its class rows (F6: pixels, frames
        and share of each visible class)."""
        from keelson.sources.bindings import stage_seconds, with_predictions
        f = with_predictions(self.per_frame.withColumn("class_pixel_counts", F.map_from_entries(self._pixels())))
        classes = [(cid, name) for cid, name, _ in OC.VISIBLE]
        g = f.groupBy(*KEYS).agg(
            *[F.sum(c).cast("decimal(28,2)").alias(c) for c in ("_q", "_t", "_d", "_e")], F.sum("_lines").alias("items"),
            F.max("frame_time").alias("updated_at"), F.count(F.lit(1)).alias("_frames"), F.avg("risk_score").alias("_avg"),
            *[F.coalesce(F.sum(f"_p{c}"), F.lit(0)).cast("bigint").alias(f"_p{c}") for c, _ in classes],
            *[F.count_if(F.col(f"_p{c}") > 0).alias(f"_f{c}") for c, _ in classes])
        total = sum((F.col(f"_p{c}") for c, _ in classes[1:]), F.col(f"_p{classes[0][0]}"))
        rows = F.array(*[F.struct(
            F.lit(c).alias("class_id"), CL.canonical_class(F.lit(name)).alias("class_name"),
            CL.translate(CL.canonical_class(F.lit(name))).alias("class_name_ru"), F.col(f"_f{c}").cast("bigint").alias("frames_present"),
            F.col(f"_p{c}").alias("pixel_count"),
            TX.share_pct(F.when(total > 0, rnd(F.col(f"_p{c}") / total, 6)).otherwise(F.lit(0.0))).alias("pixel_share_pct"))
            for c, name in classes])
        rows = F.filter(rows, lambda c: c["class_name"].isin(*MART_CLASSES))
        g = g.withColumn("_rows", rows).withColumn("_avg", rnd("_avg", 3))
        return stage_seconds(g, [*KEYS, "items", "updated_at", "_frames", "_avg", "_rows"])

    @cached_property
    def run_times(self) -> DataFrame:
        """The run keys: each asset's update time, from the lines' keys alone."""
        times = self.lines.groupBy(*KEYS).agg(F.max("updated_at").alias("updated_at"))
        return times.select(*KEYS, F.unix_timestamp("updated_at").alias("updated_at_epoch"))

    @cached_property
    def class_metrics(self) -> DataFrame:
        """L2."""
        rows = self.per_asset.select(*KEYS, F.unix_timestamp("updated_at").alias("updated_at_epoch"), F.explode("_rows").alias("c"))
        return rows.select(*KEYS, "updated_at_epoch", "c.class_id", "c.class_name", "c.class_name_ru", "c.frames_present",
                           "c.pixel_count", "c.pixel_share_pct")

    @cached_property
    def dynamics(self) -> DataFrame:
        """Frame label, position and translated primary sign per
        frame; photos are numbered oldest first (G6), videos keep frame_idx."""
        dyn = ordinal(self.frames.withColumn("_ak", F.concat_ws("|", "kind", F.col("asset_id").cast("string"))),
                      "_ak", ["frame_time", "frame_idx"], name="photo_index",
                      chunk=time_chunk("frame_time", 86_400_000_000), group_max=["frame_time"]).drop("_ak")
        dyn_idx = F.when(F.col("kind") == "photo", F.col("photo_index")).otherwise(F.col("frame_idx")).cast("bigint")
        return dyn.select(
            *KEYS, F.unix_timestamp("frame_time_last").alias("updated_at_epoch"), dyn_idx.alias("frame_idx"), dyn_idx.cast("string").alias("frame_label"),
            "risk_score", CL.translate("primary_sign_name").alias("dominant_class_name_ru"))

    @cached_property
    def _runs_raw(self) -> DataFrame:
        video = F.col("kind") == "video"
        return (self.per_asset.withColumn("updated_at_epoch", F.unix_timestamp("updated_at"))
                 .withColumn("updated_at_iso", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss"))
                 .withColumn("extracted_frames", F.when(video, F.col("items")).otherwise(F.lit(0)).cast("bigint"))
                 .withColumn("segmented_frames_raw", F.when(video, F.col("_frames")).otherwise(F.lit(0)).cast("bigint"))
                 .withColumn("total_images", F.when(video, F.lit(0)).otherwise(F.col("_frames")).cast("bigint")))

    @cached_property
    def runs(self) -> DataFrame:
        """L1: a projection of the asset row (F13 and F16 on its class rows)."""
        r = self._runs_raw.withColumn("fallback_risk", shares_risk(F.col("_rows"))).withColumn("primary_issue", primary_of(F.col("_rows")))
        video = F.col("kind") == "video"
        vc = RK.effective_video_counts("extracted_frames", F.lit(0), F.lit(0), F.lit(0), "segmented_frames_raw",
                                       "inference_wall_seconds", "pipeline_wall_seconds")
        pc = RK.effective_photo_counts("total_images", "inference_wall_seconds", "pipeline_wall_seconds")
        score0 = F.coalesce(F.col("_avg"), F.lit(0.0))
        score = F.when(score0 <= 0, F.coalesce(F.col("fallback_risk"), F.lit(0.0))).otherwise(score0)
        r = (r.withColumn("_vc", vc).withColumn("_pc", pc).withColumn("risk_score", score)
              .withColumn("state_label", RK.state_label("risk_score")))
        zero = F.lit(0).cast("bigint")
        issue_col = F.coalesce(F.col("primary_issue"), F.lit(K.NO_ISSUE_LABEL))
        return r.select(
            *KEYS, "updated_at_iso", "updated_at_epoch",
            F.col("asset_id").cast("string").alias("source_name"),
            "extracted_frames",
            F.when(video, F.col("_vc.quality_ok_frames")).otherwise(zero).alias("quality_ok_frames"),
            F.when(video, F.col("_vc.deduplicated_frames")).otherwise(zero).alias("deduplicated_frames"),
            F.when(video, F.col("_vc.processed_frames")).otherwise(zero).alias("processed_frames"),
            F.when(video, F.col("_vc.segmented_frames")).otherwise(F.col("total_images")).alias("segmented_frames"),
            "total_images",
            rnd("extraction_wall_seconds", 3).alias("extraction_wall_seconds"),
            rnd("preprocessing_wall_seconds", 3).alias("preprocessing_wall_seconds"),
            rnd(F.when(video, F.col("_vc.inference_wall_seconds")).otherwise(F.col("_pc.inference_wall_seconds")), 3)
            .alias("inference_wall_seconds"),
            rnd("export_stage_wall_seconds", 3).alias("export_stage_wall_seconds"),
            rnd("pipeline_wall_seconds", 3).alias("pipeline_wall_seconds"),
            F.when(video, F.col("_vc.avg_inference_ms")).otherwise(F.col("_pc.avg_inference_ms")).alias("avg_inference_ms"),
            "risk_score", RK.risk_band("risk_score", "dashboard").alias("risk_band"),
            issue_col.alias("primary_issue"), RK.issue_code(issue_col).alias("primary_issue_code"),
            "state_label", RK.state_code("state_label").alias("state_code"))

    @cached_property
    def stage_times(self) -> DataFrame:
        """L4."""
        return stage_times(self._runs_raw, KEYS + ["updated_at_epoch"])

    @cached_property
    def benchmark_curve(self) -> DataFrame:
        """L5."""
        return benchmark_mart(self._runs_raw, KEYS + ["updated_at_epoch"])

    @cached_property
    def parallel_estimate(self) -> DataFrame:
        """C42 per asset."""
        return parallel_mart(self._runs_raw, KEYS + ["updated_at_epoch"])

    def latest(self, kind: str) -> DataFrame:
        """G9 + D11 (``kind`` parameter) on the run keys: the newest
        (kind, asset_id) of ``kind`` (ties: smallest asset_id)."""
        return latest_run(self.run_times, kind).select(*KEYS)

    def scoped(self, assets: DataFrame) -> "Marts":
        """The same marts restricted to ``assets`` (kind, asset_id) before any
        aggregation. ``assets`` here is the latest run of one kind: at most
        one row per kind, so it is broadcast."""
        return Marts(self.lines.join(F.broadcast(assets), KEYS, "left_semi"), self.materialize)

    def tables(self) -> dict[str, DataFrame]:
        own = self.shared()
        return {n: own[n] for n in ("runs", "class_metrics", "dynamics", "stage_times", "benchmark_curve")}


def build_marts(lines: DataFrame) -> Marts:
    """The five mart tables (lazy; see :class:`Marts`)."""
    return Marts(lines)


# ---- panels -----------------------------------------------------------------

def latest_run(runs: DataFrame, kind: str | None = None, time_col: str = "updated_at_epoch",
               tie: Column | None = None) -> DataFrame:
    """Newest run per kind (ties: smallest asset_id). An aggregation
    (max of a struct) with map-side partials, not a window over a kind that
    may hold a third of the rows. Output has one row per kind, so it is
    bounded by the number of kinds."""
    r = runs if kind is None else runs.where(F.col("kind") == kind)
    tie = -F.col("asset_id") if tie is None else tie
    return r.groupBy("kind").agg(F.max(F.struct(F.col(time_col).alias("t"), tie.alias("tb"), F.struct(*[
        F.col(c) for c in r.columns if c != "kind"]).alias("row"))).alias("m")).select("kind", "m.row.*")


def latest_rows(table: DataFrame, runs: DataFrame, kind: str) -> DataFrame:
    """Rows of ``table`` that belong to the latest run of ``kind``. The
    latest-run side has at most one row per kind, so it is broadcast."""
    lr = latest_run(runs, kind).select("kind", "asset_id")
    return table.where(F.col("kind") == kind).join(F.broadcast(lr), ["kind", "asset_id"], "left_semi")


def latest_kind(runs: DataFrame, time_col: str = "updated_at_epoch") -> DataFrame:
    """The kind with the newest run; photo wins a tie."""
    return runs.agg(F.max(F.struct(F.col(time_col).alias("t"), (F.col("kind") == "photo").alias("p"),
                                   F.col("kind").alias("k")))["k"].alias("kind"))


def _defect_classes() -> Column:
    return ~F.col("class_name").isin(*K.NON_DEFECT_NAMES)


def _latest_marts(marts: Marts, kind: str) -> Marts:
    """Every panel reads only the latest run's asset, so the marts are
    computed for that asset alone."""
    return marts.scoped(marts.latest(kind))


def panel_issue_types(marts: Marts, kind: str) -> DataFrame:
    """L6 (D10: frames_present > 0)."""
    rows = _latest_marts(marts, kind).class_metrics
    return rows.where(_defect_classes() & (F.col("frames_present") > 0)).agg(F.count(F.lit(1)).alias("issue_types"))


def _latest_value(marts: Marts, kind: str, expr: Column) -> DataFrame:
    return _latest_marts(marts, kind).runs.select(expr.alias("value"))


def panel_primary_code(marts: Marts, kind: str) -> DataFrame:
    """L7."""
    return _latest_value(marts, kind, F.coalesce(F.col("primary_issue_code"), F.lit(K.ISSUE_DEFAULT_CODE)))


def panel_state_code(marts: Marts, kind: str) -> DataFrame:
    """L8."""
    return _latest_value(marts, kind, F.coalesce(F.col("state_code"), F.lit(K.STATE_DEFAULT_CODE)))


def panel_risk(marts: Marts, kind: str) -> DataFrame:
    """L9."""
    return _latest_value(marts, kind, F.col("risk_score"))


def panel_class_frames(marts: Marts, kind: str, k: int = 8) -> DataFrame:
    """L10 (I3): frames per defect class, top k by frames then share."""
    rows = _latest_marts(marts, kind).class_metrics.where(_defect_classes())
    return rows.orderBy(F.col("frames_present").desc(), F.col("pixel_share_pct").desc()).limit(k) \
        .select(F.col("class_name_ru").alias("metric"), F.col("frames_present").alias("value"))


def panel_class_table(marts: Marts, kind: str, k: int = 8) -> DataFrame:
    """L11 (I3 + C39): class table with the share as percent text."""
    rows = _latest_marts(marts, kind).class_metrics.where(_defect_classes())
    return rows.orderBy(F.col("frames_present").desc(), F.col("pixel_share_pct").desc()).limit(k).select(
        F.col("class_name_ru").alias("sign"), F.col("frames_present").alias("frames"),
        TX.pct_text("pixel_share_pct").alias("zone_share"))


def panel_dynamics(marts: Marts, kind: str, k: int = 12) -> DataFrame:
    """L12 (I5): risk series, first k points by frame_idx."""
    rows = _latest_marts(marts, kind).dynamics
    return rows.orderBy("frame_idx").limit(k).select(F.col("frame_label").alias("metric"),
                                                     F.col("risk_score").alias("value"))


def panel_class_share(marts: Marts, kind: str, k: int = 8) -> DataFrame:
    """L13 (I4, D10 share > 0): share per defect class, top k."""
    rows = _latest_marts(marts, kind).class_metrics.where(_defect_classes() & (F.col("pixel_share_pct") > 0))
    return rows.orderBy(F.col("pixel_share_pct").desc()).limit(k).select(
        F.col("class_name_ru").alias("metric"), F.col("pixel_share_pct").alias("value"))


def defect_table(marts: dict, k: int = 6) -> DataFrame:
    """I6 + C36: per asset, defect classes present by share then frames, the
    first k, with a comment. Per-asset top-k via row_number (partial limit)."""
    cm = marts["class_metrics"]
    d = cm.where(_defect_classes() & ((F.col("frames_present") > 0) | (F.col("pixel_share_pct") > 0)))
    w = Window.partitionBy(*KEYS).orderBy(F.col("pixel_share_pct").desc(), F.col("frames_present").desc(),
                                          F.col("class_id").asc())
    return (d.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= k)
             .select(*KEYS, "row_no", F.col("class_name_ru").alias("sign"), "frames_present", "pixel_share_pct",
                     TX.defect_comment("pixel_share_pct", "frames_present").alias("comment")))


def recommendations_mart(marts: dict, preset: str = "live") -> DataFrame:
    """C37 per asset: recommendations from risk and class shares."""
    cm = marts["class_metrics"]
    shares = cm.groupBy(*KEYS).agg(*[F.max(F.when(F.col("class_name") == n, F.col("pixel_share_pct"))).alias(a)
                                     for n, a in (("Corrosion", "_c"), ("Paint peel", "_p"), ("Marine growth", "_g"))])
    r = marts["runs"].join(shares, KEYS, "left")
    recs = TX.recommendations("risk_score", "_c", "_p", "_g", "extracted_frames", "segmented_frames", preset)
    return r.select(*KEYS, recs.alias("recommendations")).withColumn(
        "primary_recommendation", TX.primary_recommendation("recommendations"))


def reviewed_items(runs: DataFrame) -> DataFrame:
    """first non-zero of the funnel counters."""
    cols = ["segmented_frames", "processed_frames", "deduplicated_frames", "quality_ok_frames",
            "extracted_frames", "total_images"]
    return runs.select(*KEYS, F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in cols], F.lit(0))
                       .cast("bigint").alias("reviewed_items"))
