"""Independent DuckDB SQL for every registered query.

The driver's tables are pre-registered views in DuckDB. Each query below
first re-derives the domain views (the same bindings as
:mod:`keelson.sources.bindings`, written from scratch in SQL), then computes
its answer with plain windows and aggregates. Column names equal the Spark
output's. Float literals are cast to DOUBLE so both engines add the same
binary numbers; sums that feed rounded outputs use DECIMAL.
"""

from __future__ import annotations

from keelson import constants as K


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def HX(col: str) -> str:
    """16 hex chars -> unsigned 64-bit as HUGEINT (xor/bit_count safe)."""
    return f"(CASE WHEN length(trim({col})) > 0 THEN ('0x' || {col})::UBIGINT::HUGEINT END)"


CLASS_OF_LINE = ("CAST(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 9 ELSE 0 END AS INTEGER)")

VISIBLE_IDS = [c for c, _, _ in K.CLASS_INFO if c not in K.VISIBLE_EXCLUDED_IDS]
CLASS_NAMES = {c: n for c, n, _ in K.CLASS_INFO}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def class_name_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {c} THEN {_q(n)}" for c, n, _ in K.CLASS_INFO) + " ELSE 'Unknown' END"


def translate_sql(col: str) -> str:
    return ("CASE " + " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v)}" for k, v in K.CLASS_TRANSLATIONS.items())
            + f" ELSE {col} END")


def weight_sql(col: str) -> str:
    return ("CASE " + " ".join(f"WHEN {col} = {k} THEN {D(v)}" for k, v in K.RISK_WEIGHTS.items())
            + f" ELSE {D(K.DEFAULT_RISK_WEIGHT)} END")


def band_sql(col: str, preset: str = "pipeline") -> str:
    lo, hi = K.PIPELINE_BAND_CUTS if preset == "pipeline" else K.DASHBOARD_BAND_CUTS
    b = K.BAND_LABELS
    return f"CASE WHEN {col} >= {D(hi)} THEN {_q(b[2])} WHEN {col} >= {D(lo)} THEN {_q(b[1])} ELSE {_q(b[0])} END"


def three_sql(col: str, labels) -> str:
    lo, hi = K.PIPELINE_BAND_CUTS
    return f"CASE WHEN {col} >= {D(hi)} THEN {_q(labels[2])} WHEN {col} >= {D(lo)} THEN {_q(labels[1])} ELSE {_q(labels[0])} END"


def code_sql(col: str, table: dict, default: int) -> str:
    return ("CASE trim(coalesce(" + col + ", '')) " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in table.items())
            + f" ELSE {default} END")


# ---- bindings ------------------------------------------------------------

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


view("frames_v", [], f"""
SELECT user_id AS video_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
       event_id,
       (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / {D(1e6)} AS timestamp_sec,
       value AS brightness,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS laplacian_var,
       left(md5(event_type), 16) AS dhash
FROM events""")

view("flags_v", ["frames_v"], f"""
SELECT *, {HX('dhash')} AS hash_u,
       coalesce(brightness BETWEEN {D(K.MIN_BRIGHTNESS)} AND {D(K.MAX_BRIGHTNESS)}
                AND laplacian_var >= {D(K.MIN_LAPLACIAN)} AND dhash IS NOT NULL, false) AS quality_ok,
       laplacian_var * {D(K.LAPLACIAN_WEIGHT)}
         + greatest({D(0)}, {D(1)} - abs(brightness - {D(K.BRIGHTNESS_CENTER)}) / {D(K.BRIGHTNESS_CENTER)}) * {D(100)} AS score
FROM frames_v""")

view("g1_v", ["flags_v"], """
SELECT *, last_value(CASE WHEN quality_ok THEN dhash END IGNORE NULLS) OVER (
            PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hex
FROM flags_v""")

view("dedup_v", ["g1_v"], f"""
SELECT *, CAST(bit_count(xor(hash_u, {HX('prev_hex')})) AS INTEGER) AS hamming_to_prev,
       coalesce(prev_hex IS NOT NULL AND bit_count(xor(hash_u, {HX('prev_hex')})) <= {K.HAMMING_THRESHOLD}, false) AS is_duplicate,
       CASE WHEN quality_ok THEN prev_hex END AS prev_dhash
FROM g1_v""")

view("cand_v", ["dedup_v"], f"""
SELECT video_id, frame_idx, score, hash_u, dhash, 'normal' AS fallback_mode
FROM dedup_v WHERE quality_ok AND NOT is_duplicate
UNION ALL
SELECT video_id, frame_idx, score, hash_u, dhash, 'raw_extracted' AS fallback_mode FROM (
  SELECT d.*, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS r
  FROM dedup_v d
  WHERE hash_u IS NOT NULL AND video_id IN (
     SELECT video_id FROM dedup_v GROUP BY video_id HAVING count_if(quality_ok AND NOT is_duplicate) = 0))
WHERE r <= {K.FALLBACK_FRAMES}""")

view("class_counts_v", [], f"""
SELECT l_suppkey AS asset_id, l_orderkey AS frame_idx, {CLASS_OF_LINE} AS class_id,
       CAST(sum(l_quantity) AS BIGINT) AS pixels
FROM lineitem GROUP BY ALL""")


def frame_level(counts: str, keys: str) -> str:
    """Per-frame pivoted counts, ratios (round 6) and risk, from a long
    (keys, frame_idx, class_id, pixels) view."""
    piv = ", ".join(f"coalesce(sum(pixels) FILTER (WHERE class_id = {c}), 0) AS p{c}" for c in [0] + VISIBLE_IDS)
    ratios = ", ".join(f"CASE WHEN tot > 0 THEN round(p{c} / tot, 6) ELSE {D(0)} END AS r{c}" for c in VISIBLE_IDS)
    present = ", ".join(f"count_if(class_id = {c}) > 0 AS h{c}" for c in VISIBLE_IDS)
    acc = D(0)
    for c in VISIBLE_IDS:
        acc = f"({acc} + CASE WHEN h{c} AND r{c} > 0 THEN r{c} * {weight_sql(str(c))} ELSE {D(0)} END)"
    active = " + ".join(f"CASE WHEN h{c} AND r{c} > 0 THEN 1 ELSE 0 END" for c in VISIBLE_IDS)
    risk = (f"round(least({D(K.RISK_CAP)}, {acc} + least({D(K.COVERAGE_BONUS_CAP)}, ({active}) * {D(K.COVERAGE_BONUS_STEP)})"
            f" + least({D(K.CORROSION_BONUS_CAP)}, CASE WHEN h9 THEN r9 ELSE {D(0)} END * {D(K.CORROSION_BONUS_FACTOR)})"
            f" + least({D(K.DEFECT8_BONUS_CAP)}, {D(0)} * {D(K.DEFECT8_BONUS_FACTOR)})), 3)")
    # predicted ids (sorted non-void positive), dominant (max count, tie lowest id), primary sign
    pred = "list_filter([" + ", ".join(f"CASE WHEN p{c} > 0 THEN {c} END" for c in VISIBLE_IDS) + "], lambda x: x IS NOT NULL)"
    dom = "CASE " + "".join(
        f"WHEN p{c} > 0 AND " + " AND ".join([f"p{c} >= p{o}" if o > c else f"p{c} > p{o}" for o in VISIBLE_IDS if o != c] or ["true"])
        + f" THEN {c} " for c in VISIBLE_IDS) + "ELSE 0 END"
    sign = "coalesce(" + ", ".join(f"CASE WHEN p{c} > 0 THEN {c} END" for c in VISIBLE_IDS if c not in K.SIGN_EXCLUDED_IDS) + ", dominant_class_id)"
    return f"""
SELECT *, {risk} AS risk_score, {sign} AS primary_sign_id, {class_name_sql(sign)} AS primary_sign_name FROM (
  SELECT *, {ratios}, {pred} AS predicted_class_ids, {dom} AS dominant_class_id FROM (
    SELECT {keys}, frame_idx, sum(pixels) AS tot, {piv}, {present}
    FROM {counts} GROUP BY {keys}, frame_idx))"""


view("frame_pred_v", ["class_counts_v"], frame_level("class_counts_v", "asset_id"))

view("summary_v", ["class_counts_v"], "\nUNION ALL\n".join(
    f"""SELECT asset_id, {c} AS class_id, {_q(CLASS_NAMES[c])} AS class_name,
       CAST(coalesce(sum(pixels) FILTER (WHERE class_id = {c}), 0) AS BIGINT) AS pixel_count,
       count_if(class_id = {c} AND pixels > 0) AS frames_present,
       CASE WHEN sum(pixels) FILTER (WHERE class_id <> 0) > 0
            THEN round(coalesce(sum(pixels) FILTER (WHERE class_id = {c}), 0) / sum(pixels) FILTER (WHERE class_id <> 0), 6)
            ELSE {D(0)} END AS pixel_share
FROM class_counts_v GROUP BY asset_id""" for c in VISIBLE_IDS))

view("runs_v", [], f"""
SELECT CASE WHEN o_orderstatus = 'P' THEN 'photo' ELSE 'video' END AS kind, o_custkey AS asset_id,
       o_orderkey AS run_id, CAST(o_orderdate AS TIMESTAMP) AS updated_at,
       least(o_totalprice / {D(500000)}, {D(0.98)}) AS risk_score
FROM orders""")


def stage_sums(src: str, keys: str) -> str:
    """Stage sums in exact integer units of 1e-8 s, divided once (a correctly
    rounded division, the same double as Spark's exact decimal cast)."""
    dec = "DECIMAL(18,2)"
    u = D(100000000)
    return f"""
SELECT {keys}, items,
       CAST(q AS DOUBLE) AS extraction_wall_seconds, CAST(t AS DOUBLE) AS preprocessing_wall_seconds,
       CAST(d AS DOUBLE) AS inference_wall_seconds, CAST(CAST(e * 100 AS BIGINT) AS DOUBLE) / {u} AS export_stage_wall_seconds,
       CAST(CAST(q * 100 AS BIGINT) * 1000000 + CAST(t * 100 AS BIGINT) * 1000000 + CAST(d * 100 AS BIGINT) * 1000000
            + CAST(e * 100 AS BIGINT) + items * 100000 AS DOUBLE) / {u} AS pipeline_wall_seconds
FROM (SELECT {keys}, sum(CAST(l_quantity AS {dec})) AS q, sum(CAST(l_tax AS {dec})) AS t,
             sum(CAST(l_discount AS {dec})) AS d, sum(CAST(l_extendedprice AS {dec})) AS e, count(*) AS items
      FROM {src} GROUP BY {keys})"""


view("stage_v", [], stage_sums("(SELECT l_suppkey AS asset_id, * FROM lineitem)", "asset_id"))

view("media_v", [], "SELECT page_id, url AS path, CAST(length(html) AS BIGINT) AS length FROM pages")

view("arrivals_v", [], """
SELECT event_id, printf('photos/%d.jpg', event_id) AS path, CAST(ts AS TIMESTAMP) AS modificationTime, event_type, value
FROM events""")


def _split_args(text: str) -> list[str]:
    out, depth, cur, quote = [], 0, [], False
    for ch in text:
        if ch == "'":
            quote = not quote
        if not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                out.append("".join(cur))
                cur = []
                continue
        cur.append(ch)
    out.append("".join(cur))
    return out


def decimal_rounds(sql: str) -> str:
    """Rewrite ``round(x, n)`` / ``round_even(x, n)`` to round on
    DECIMAL(38,12) (the same rule as keelson.functions.num)."""
    import re
    pat = re.compile(r"(?<![A-Za-z0-9_])(round_even|round)\(")
    out, i = [], 0
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:m.start()])
        j, depth = m.end(), 1
        while depth:
            if sql[j] == "(":
                depth += 1
            elif sql[j] == ")":
                depth -= 1
            j += 1
        args = _split_args(sql[m.end():j - 1])
        x = decimal_rounds(args[0])
        n = args[1].strip() if len(args) > 1 else "0"
        out.append(f"CAST({m.group(1)}(CAST(({x}) AS DECIMAL(38,12)), {n}) AS DOUBLE)")
        i = j


def with_views(names: list[str], body: str) -> str:
    """Resolve view dependencies and emit ``WITH a AS (...), b AS (...) body``."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return decimal_rounds(body)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return decimal_rounds(f"WITH {ctes},\n{stripped[5:]}")
    return decimal_rounds(f"WITH {ctes}\n{body}")


# ---- queries -------------------------------------------------------------------

ORACLE: dict[str, str] = {}


def oracle(key: str, views: list[str], body: str) -> None:
    ORACLE[key] = with_views(views, body)


oracle("c2_frame_rows", ["frames_v"], """
SELECT video_id, frame_idx * 12 AS frame_idx, round(frame_idx * 12 / 25.0::DOUBLE, 6) AS timestamp_sec,
       printf('frames/%d/frame_%06d.jpg', video_id, frame_idx * 12) AS raw_frame_path
FROM frames_v""")

oracle("c9_hamming", ["frames_v"], f"""
SELECT a.video_id, a.frame_idx,
       CAST(bit_count(xor({HX('a.dhash')}, {HX('b.dhash')})) AS INTEGER) AS hamming,
       CAST(coalesce(bit_count(xor({HX('a.dhash')}, {HX('b.dhash')})), 64) AS INTEGER) AS visual_distance
FROM frames_v a LEFT JOIN frames_v b ON a.video_id = b.video_id AND b.frame_idx = a.frame_idx - 1""")

oracle("c11_quality_score", ["flags_v"], "SELECT video_id, frame_idx, round(score, 6) AS score FROM flags_v")

oracle("d1_quality_ok", ["flags_v"], "SELECT video_id, frame_idx, quality_ok FROM flags_v")

oracle("g1_prev_quality_hash", ["dedup_v"], """
SELECT video_id, frame_idx, quality_ok, prev_dhash, hamming_to_prev, is_duplicate FROM dedup_v""")

oracle("d2_keep_frames", ["dedup_v"], "SELECT video_id, frame_idx, dhash FROM dedup_v WHERE quality_ok AND NOT is_duplicate")

oracle("f2_frame_funnel", ["dedup_v"], f"""
SELECT video_id, CAST(extracted_frames AS BIGINT) AS extracted_frames, CAST(quality_ok_frames AS BIGINT) AS quality_ok_frames,
       CAST(deduplicated_frames AS BIGINT) AS deduplicated_frames,
       CAST(candidate_processed_frames AS BIGINT) AS candidate_processed_frames,
       CAST(least(candidate_processed_frames, {K.TARGET_FRAMES}) AS BIGINT) AS processed_frames,
       CAST(least(candidate_processed_frames, {K.TARGET_FRAMES}) AS BIGINT) AS segmented_frames, fallback_mode
FROM (SELECT video_id, count(*) AS extracted_frames, count_if(quality_ok) AS quality_ok_frames,
             count_if(quality_ok AND NOT is_duplicate) AS deduplicated_frames,
             CASE WHEN count_if(quality_ok AND NOT is_duplicate) > 0 THEN count_if(quality_ok AND NOT is_duplicate)
                  ELSE least(count_if(hash_u IS NOT NULL), {K.FALLBACK_FRAMES}) END AS candidate_processed_frames,
             CASE WHEN count_if(quality_ok AND NOT is_duplicate) > 0 THEN 'normal' ELSE 'raw_extracted' END AS fallback_mode
      FROM dedup_v GROUP BY video_id)""")

oracle("d5_fallback_dark", ["cand_v", "dedup_v"], f"""
SELECT video_id, frame_idx, fallback_mode FROM cand_v WHERE video_id % 7 <> 0
UNION ALL
SELECT video_id, frame_idx, 'raw_extracted' FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS r FROM dedup_v WHERE video_id % 7 = 0 AND hash_u IS NOT NULL)
WHERE r <= {K.FALLBACK_FRAMES}""")
oracle("d5_fallback", ["cand_v"], "SELECT video_id, frame_idx, fallback_mode FROM cand_v")

view("buckets_v", ["cand_v"], f"""
SELECT *, CAST(floor((rn * least({K.COVERAGE_BUCKETS}, t) - 1) / t) AS INTEGER) AS bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn,
         count(*) OVER (PARTITION BY video_id) AS t FROM cand_v)""")

oracle("g2_coverage_bucket", ["buckets_v"], "SELECT video_id, frame_idx, bucket FROM buckets_v")

oracle("g3_bucket_rank", ["buckets_v"], """
SELECT video_id, frame_idx, bucket,
       row_number() OVER (PARTITION BY video_id, bucket ORDER BY score DESC, frame_idx DESC) AS bucket_rank
FROM buckets_v""")


# ---- class statistics ------------------------------------------------------

def color_hex_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {c} THEN '#{r:02x}{g:02x}{b:02x}'" for c, _, (r, g, b) in K.CLASS_INFO) + " END"


view("cm_v", ["summary_v"], f"""
SELECT asset_id, class_id, CASE WHEN class_name = 'Ship hull' THEN 'Normal' ELSE class_name END AS class_name,
       {translate_sql('class_name')} AS class_name_ru, frames_present, pixel_count,
       round(coalesce(pixel_share, {D(0)}) * {D(100)}, 2) AS pixel_share_pct
FROM summary_v""")

view("ratios_v", ["class_counts_v"], """
SELECT c.asset_id, c.frame_idx, c.class_id, c.pixels, t.tot,
       CASE WHEN t.tot > 0 THEN round(c.pixels / t.tot, 6) ELSE CAST(0 AS DOUBLE) END AS ratio
FROM class_counts_v c JOIN (SELECT asset_id, frame_idx, sum(pixels) AS tot FROM class_counts_v GROUP BY ALL) t
  USING (asset_id, frame_idx)""")

oracle("f6_class_summary", ["summary_v"], f"""
SELECT asset_id, class_id, class_name, {color_hex_sql('class_id')} AS color_hex, pixel_count,
       CAST(frames_present AS BIGINT) AS frames_present, pixel_share FROM summary_v""")

oracle("f20_visible_pixels", ["frame_pred_v"],
       "SELECT asset_id, frame_idx, CAST(" + " + ".join(f"p{c}" for c in VISIBLE_IDS) + " AS BIGINT) AS visible_pixels FROM frame_pred_v")

oracle("c25_ratios", ["ratios_v"], "SELECT asset_id, frame_idx, class_id, ratio FROM ratios_v")

oracle("k3_explode_map", ["class_counts_v"], "SELECT asset_id, frame_idx, class_id, pixels FROM class_counts_v")

oracle("c18_risk_score", ["frame_pred_v"], "SELECT asset_id, frame_idx, risk_score FROM frame_pred_v")

oracle("c19_risk_band", ["frame_pred_v"], f"""
SELECT asset_id, frame_idx, {band_sql('risk_score', 'pipeline')} AS band_pipeline,
       {band_sql('risk_score', 'dashboard')} AS band_dashboard FROM frame_pred_v""")

oracle("c20_urgency_state", ["frame_pred_v"], f"""
SELECT asset_id, frame_idx, {three_sql('risk_score', K.URGENCY_LABELS)} AS urgency,
       {three_sql('risk_score', K.STATE_LABELS)} AS state_label FROM frame_pred_v""")

oracle("c21_codes", ["frame_pred_v"], f"""
SELECT asset_id, frame_idx, {code_sql(translate_sql('primary_sign_name'), K.ISSUE_CODES, K.ISSUE_DEFAULT_CODE)} AS issue_code,
       {code_sql(three_sql('risk_score', K.STATE_LABELS), K.STATE_CODES, K.STATE_DEFAULT_CODE)} AS state_code
FROM frame_pred_v""")

oracle("f4_dominant_class", ["frame_pred_v"], f"""
SELECT asset_id, frame_idx, CAST(dominant_class_id AS INTEGER) AS dominant_class_id,
       {class_name_sql('dominant_class_id')} AS dominant_class_name FROM frame_pred_v""")

oracle("f5_predicted_ids", ["frame_pred_v"],
       "SELECT asset_id, frame_idx, array_to_string(predicted_class_ids, ',') AS predicted_class_ids FROM frame_pred_v")

oracle("c27_primary_sign", ["frame_pred_v"],
       "SELECT asset_id, frame_idx, CAST(primary_sign_id AS INTEGER) AS primary_sign_id, primary_sign_name FROM frame_pred_v")

oracle("c47_predicted_names", ["frame_pred_v"], f"""
SELECT asset_id, frame_idx,
       array_to_string(list_transform(list_filter(predicted_class_ids, lambda x: x NOT IN (0, 1)), lambda x: {class_name_sql('x')}), ', ') AS video_names,
       array_to_string(list_transform(list_filter(predicted_class_ids, lambda x: x NOT IN (0)), lambda x: {class_name_sql('x')}), ', ') AS photo_names
FROM frame_pred_v""")

oracle("c26_text_fields", ["frame_pred_v", "class_counts_v"], f"""
SELECT f.asset_id, f.frame_idx, array_to_string(f.predicted_class_ids, ',') AS predicted_csv, j.counts_json
FROM frame_pred_v f JOIN (
  SELECT asset_id, frame_idx,
         '{{' || string_agg('"' || {class_name_sql('class_id')} || '":' || CAST(pixels AS VARCHAR), ',' ORDER BY class_id) || '}}' AS counts_json
  FROM class_counts_v GROUP BY ALL) j USING (asset_id, frame_idx)""")

oracle("g5_top_classes", ["ratios_v"], f"""
SELECT asset_id, frame_idx, CAST(class_rank AS INTEGER) AS class_rank, class_id, {class_name_sql('class_id')} AS class_name,
       pixels AS pixel_count, ratio AS pixel_share
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, frame_idx ORDER BY pixels DESC, class_id) AS class_rank
      FROM ratios_v WHERE class_id <> 0 AND pixels > 0)
WHERE class_rank <= 3""")

oracle("i8_frame_signs", ["frame_pred_v", "ratios_v"], f"""
SELECT f.asset_id, f.frame_idx,
       coalesce(s.primary_label, {translate_sql('f.primary_sign_name')}) AS primary_sign_label,
       coalesce(s.extras, '') AS extra_signs,
       CASE WHEN coalesce(s.extras, '') <> '' THEN s.extras
            WHEN {translate_sql('f.primary_sign_name')} NOT IN ('', {_q(K.CLASS_TRANSLATIONS['Normal'])}, {_q(K.CLASS_TRANSLATIONS['Void'])})
              THEN {translate_sql('f.primary_sign_name')}
            ELSE {_q(K.NO_SIGN_LABEL)} END AS truth_label
FROM frame_pred_v f LEFT JOIN (
  SELECT asset_id, frame_idx,
         max(label) FILTER (WHERE rk = 1) AS primary_label,
         string_agg(label, ', ' ORDER BY rk) FILTER (WHERE rk <= 3 AND ratio >= {D(K.EXTRA_SIGN_MIN_RATIO)}) AS extras
  FROM (SELECT *, {translate_sql(class_name_sql('class_id'))} AS label,
               row_number() OVER (PARTITION BY asset_id, frame_idx ORDER BY ratio DESC, class_id) AS rk
        FROM ratios_v WHERE class_id IN (2, 6, 9))
  GROUP BY ALL) s USING (asset_id, frame_idx)""")

oracle("d7_has_defect", ["frame_pred_v"], f"""
SELECT asset_id, frame_idx FROM frame_pred_v
WHERE {' OR '.join(f'(h{c} AND r{c} >= {D(K.DEFECT_MIN_RATIO)})' for c in (2, 6, 9))}
   OR primary_sign_name NOT IN ('', 'Normal', 'Void', 'Ship hull')""")

DIM_SQL = "(VALUES " + ", ".join(
    f"({c}, {_q(n)}, '#{r:02x}{g:02x}{b:02x}', {D(K.RISK_WEIGHTS.get(c, K.DEFAULT_RISK_WEIGHT))}, {str(c not in K.VISIBLE_EXCLUDED_IDS).lower()})"
    for c, n, (r, g, b) in K.CLASS_INFO) + ") AS d(class_id, class_name, color_hex, risk_weight, is_visible)"

oracle("e2_with_class", ["class_counts_v"], f"""
SELECT c.asset_id, c.frame_idx, c.class_id, c.pixels, coalesce(d.class_name, 'Unknown') AS class_name, d.color_hex, d.risk_weight
FROM class_counts_v c LEFT JOIN {DIM_SQL} USING (class_id)""")

oracle("e3_visible_only", ["class_counts_v"], f"""
SELECT c.asset_id, c.frame_idx, c.class_id, c.pixels, d.class_name
FROM class_counts_v c JOIN {DIM_SQL} USING (class_id) WHERE d.is_visible""")

oracle("f12_asset_risk", ["frame_pred_v"], f"""
SELECT asset_id, risk_score, max_risk_score, {band_sql('risk_score', 'pipeline')} AS risk_band
FROM (SELECT asset_id, round(avg(risk_score), 3) AS risk_score, round(max(risk_score), 3) AS max_risk_score
      FROM frame_pred_v GROUP BY asset_id)""")

view("heat_v", ["frame_pred_v"], "\nUNION ALL\n".join(
    f"""SELECT asset_id, frame_pos, frame_idx, {c} AS class_id, {_q(CLASS_NAMES[c])} AS class_name,
       round(p{c} / greatest(tot, 1) * {D(100)}, 2) AS share_pct
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY frame_idx) AS frame_pos FROM frame_pred_v)
WHERE frame_pos <= 18""" for c in VISIBLE_IDS))

oracle("f17_class_heatmap", ["heat_v"], "SELECT asset_id, CAST(frame_pos AS INTEGER) AS frame_pos, frame_idx, class_id, class_name, share_pct FROM heat_v")

oracle("k4_pivot_frames", ["heat_v"], "SELECT asset_id, class_id, class_name, " + ", ".join(
    f'coalesce(max(share_pct) FILTER (WHERE frame_pos = {i}), {D(0)}) AS "{i}"' for i in range(1, 19))
    + " FROM heat_v GROUP BY asset_id, class_id, class_name")

DEFECT_SQL = "class_name NOT IN ('Void', 'Normal', 'Ship hull') AND (frames_present > 0 OR pixel_share_pct > 0)"

oracle("f13_fallback_risk", ["cm_v"], f"""
SELECT asset_id, CASE WHEN s <> 0 THEN round(w / greatest(s, {D(1e-6)}), 3) ELSE {D(0)} END AS fallback_risk
FROM (SELECT asset_id,
             sum(pixel_share_pct / {D(100)} * CASE {' '.join(f"WHEN class_name = {_q(n)} THEN {D(v)}" for n, v in K.FALLBACK_RISK_WEIGHTS.items())}
                 ELSE {D(K.FALLBACK_RISK_DEFAULT)} END) AS w,
             sum(pixel_share_pct / {D(100)}) AS s
      FROM cm_v GROUP BY asset_id)""")

oracle("f15_issue_type_count", ["cm_v"], f"SELECT asset_id, count_if({DEFECT_SQL}) AS issue_types FROM cm_v GROUP BY asset_id")

oracle("f16_primary_issue", ["cm_v"], f"""
SELECT a.asset_id, coalesce(p.class_name_ru, {_q(K.NO_ISSUE_LABEL)}) AS primary_issue
FROM (SELECT DISTINCT asset_id FROM cm_v) a LEFT JOIN (
  SELECT asset_id, class_name_ru FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY frames_present DESC, pixel_share_pct DESC,
                                 pixel_count DESC, class_id) AS r
    FROM cm_v WHERE {DEFECT_SQL}) WHERE r = 1) p USING (asset_id)""")

oracle("f16_primary_issue_shadowed", ["cm_v"], f"""
SELECT a.asset_id, coalesce(p.class_name_ru, q.class_name_ru, {_q(K.NO_ISSUE_LABEL)}) AS primary_issue
FROM (SELECT DISTINCT asset_id FROM cm_v) a
LEFT JOIN (SELECT asset_id, class_name_ru FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY pixel_share_pct DESC, frames_present DESC,
                                 pixel_count DESC, class_id) AS r
    FROM cm_v WHERE {DEFECT_SQL}) WHERE r = 1) p USING (asset_id)
LEFT JOIN (SELECT asset_id, class_name_ru FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY pixel_share_pct DESC, frames_present DESC,
                                 pixel_count DESC, class_id) AS r
    FROM cm_v WHERE class_name <> 'Void') WHERE r = 1) q USING (asset_id)""")

def story_sql(target: int, buckets: int) -> str:
    return f"""
WITH f AS (SELECT asset_id, frame_idx, risk_score, len(predicted_class_ids) AS n,
                  row_number() OVER (PARTITION BY asset_id ORDER BY frame_idx) AS rn,
                  count(*) OVER (PARTITION BY asset_id) AS t FROM frame_pred_v),
     b AS (SELECT *, floor((rn * least({buckets}, t) - 1) / t) AS bk FROM f WHERE t > {target}),
     best AS (SELECT asset_id, frame_idx FROM (
              SELECT *, row_number() OVER (PARTITION BY asset_id, bk ORDER BY risk_score DESC, n DESC, frame_idx DESC) AS r
              FROM b) WHERE r = 1),
     np AS (SELECT asset_id, count(*) AS k FROM best GROUP BY asset_id)
SELECT asset_id, frame_idx, 'all' AS story_pick FROM f WHERE t <= {target}
UNION ALL SELECT asset_id, frame_idx, 'bucket' FROM best
UNION ALL SELECT asset_id, frame_idx, 'fill' FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.asset_id ORDER BY risk_score DESC, n DESC, frame_idx) AS r, np.k
  FROM b JOIN np USING (asset_id) WHERE (b.asset_id, b.frame_idx) NOT IN (SELECT asset_id, frame_idx FROM best))
WHERE r <= {target} - k"""


view("story_v", ["frame_pred_v"], story_sql(K.STORY_FRAMES, K.STORY_FRAMES))
oracle("g4_story_frames_fill", ["frame_pred_v"], story_sql(8, 3))
oracle("g4_story_frames", ["story_v"], "SELECT asset_id, frame_idx, story_pick FROM story_v")


# ---- marts -----------------------------------------------------------------

view("mlines_v", [], """
SELECT CASE WHEN o.o_orderstatus = 'P' THEN 'photo' ELSE 'video' END AS kind, o.o_custkey AS asset_id,
       l.l_orderkey AS frame_idx, CAST(o.o_orderdate AS TIMESTAMP) AS updated_at,
       l.l_linenumber, l.l_quantity, l.l_tax, l.l_discount, l.l_extendedprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

view("mcounts_v", ["mlines_v"], f"""
SELECT kind, asset_id, frame_idx, {CLASS_OF_LINE} AS class_id, CAST(sum(l_quantity) AS BIGINT) AS pixels
FROM mlines_v GROUP BY ALL""")

view("mframe_v", ["mcounts_v"], frame_level("mcounts_v", "kind, asset_id"))

view("mmeta_v", ["mlines_v"], """
SELECT kind, asset_id, max(updated_at) AS updated_at, CAST(epoch(max(updated_at)) AS BIGINT) AS updated_at_epoch,
       strftime(max(updated_at), '%Y-%m-%dT%H:%M:%S') AS updated_at_iso
FROM mlines_v GROUP BY kind, asset_id""")

view("mcm_v", ["mcounts_v", "mmeta_v"], "\nUNION ALL\n".join(
    f"""SELECT s.kind, s.asset_id, m.updated_at_epoch, {c} AS class_id, {_q(CLASS_NAMES[c])} AS class_name,
       {_q(K.CLASS_TRANSLATIONS[CLASS_NAMES[c]])} AS class_name_ru, CAST(s.f AS BIGINT) AS frames_present,
       CAST(s.p AS BIGINT) AS pixel_count,
       round(CASE WHEN s.t > 0 THEN round(s.p / s.t, 6) ELSE {D(0)} END * {D(100)}, 2) AS pixel_share_pct
FROM (SELECT kind, asset_id, coalesce(sum(pixels) FILTER (WHERE class_id = {c}), 0) AS p,
             count_if(class_id = {c} AND pixels > 0) AS f, sum(pixels) FILTER (WHERE class_id <> 0) AS t
      FROM mcounts_v GROUP BY kind, asset_id) s JOIN mmeta_v m USING (kind, asset_id)""" for c in VISIBLE_IDS))

view("mraw_v", ["mlines_v", "mframe_v", "mmeta_v"], f"""
SELECT m.kind, m.asset_id, m.updated_at_epoch, m.updated_at_iso, s.items,
       s.extraction_wall_seconds, s.preprocessing_wall_seconds, s.inference_wall_seconds,
       s.export_stage_wall_seconds, s.pipeline_wall_seconds,
       CAST(CASE WHEN m.kind = 'video' THEN s.items ELSE 0 END AS BIGINT) AS extracted_frames,
       CAST(CASE WHEN m.kind = 'video' THEN n.frames ELSE 0 END AS BIGINT) AS segmented_frames_raw,
       CAST(CASE WHEN m.kind = 'video' THEN 0 ELSE n.frames END AS BIGINT) AS total_images
FROM mmeta_v m
JOIN ({stage_sums('mlines_v', 'kind, asset_id')}) s USING (kind, asset_id)
JOIN (SELECT kind, asset_id, count(*) AS frames FROM mframe_v GROUP BY ALL) n USING (kind, asset_id)""")


def impute_sql(value: str, source: str, factor: float, floor: int) -> str:
    guess = f"greatest(CAST(round_even({source} * {D(factor)}, 0) AS BIGINT), least({source}, {floor}))"
    return f"CAST(CASE WHEN {value} <= 0 AND {source} > 0 THEN {guess} ELSE {value} END AS BIGINT)"


def video_counts_sql(extracted: str, segmented: str, inference: str, pipeline: str) -> str:
    """C31 as nested selects: q, d, p, s, inf, ms."""
    f = K.VIDEO_IMPUTE
    return f"""
SELECT *, CASE WHEN s > 0 THEN round(inf / s * {D(1000)}, 3) ELSE {D(0)} END AS ms FROM (
 SELECT *, {impute_sql(segmented, 'p', *f[3])} AS s FROM (
  SELECT *, {impute_sql('0', 'd', *f[2])} AS p FROM (
   SELECT *, {impute_sql('0', 'q', *f[1])} AS d FROM (
    SELECT *, {impute_sql('0', extracted, *f[0])} AS q,
           CASE WHEN {inference} <= 0 AND {pipeline} <> 0 THEN round({pipeline} * {D(K.VIDEO_INFERENCE_SHARE)}, 4)
                ELSE {inference} END AS inf
    FROM __SRC__))))"""


view("mruns_v", ["mraw_v", "mframe_v", "mcm_v"], f"""
SELECT kind, asset_id, updated_at_iso, updated_at_epoch, CAST(asset_id AS VARCHAR) AS source_name, extracted_frames,
       CAST(CASE WHEN kind = 'video' THEN q ELSE 0 END AS BIGINT) AS quality_ok_frames,
       CAST(CASE WHEN kind = 'video' THEN d ELSE 0 END AS BIGINT) AS deduplicated_frames,
       CAST(CASE WHEN kind = 'video' THEN p ELSE 0 END AS BIGINT) AS processed_frames,
       CAST(CASE WHEN kind = 'video' THEN s ELSE total_images END AS BIGINT) AS segmented_frames,
       total_images,
       round(extraction_wall_seconds, 3) AS extraction_wall_seconds,
       round(preprocessing_wall_seconds, 3) AS preprocessing_wall_seconds,
       round(CASE WHEN kind = 'video' THEN round(inf, 4) ELSE round(pinf, 4) END, 3) AS inference_wall_seconds,
       round(export_stage_wall_seconds, 3) AS export_stage_wall_seconds,
       round(pipeline_wall_seconds, 3) AS pipeline_wall_seconds,
       CASE WHEN kind = 'video' THEN ms ELSE pms END AS avg_inference_ms,
       risk_score, {band_sql('risk_score', 'dashboard')} AS risk_band,
       coalesce(primary_issue, {_q(K.NO_ISSUE_LABEL)}) AS primary_issue,
       {code_sql(f"coalesce(primary_issue, {_q(K.NO_ISSUE_LABEL)})", K.ISSUE_CODES, K.ISSUE_DEFAULT_CODE)} AS primary_issue_code,
       {three_sql('risk_score', K.STATE_LABELS)} AS state_label,
       {code_sql(three_sql('risk_score', K.STATE_LABELS), K.STATE_CODES, K.STATE_DEFAULT_CODE)} AS state_code
FROM (
  SELECT *, CASE WHEN coalesce(avg_risk, {D(0)}) <= 0 THEN coalesce(fallback_risk, {D(0)}) ELSE avg_risk END AS risk_score,
         CASE WHEN total_images > 0 THEN round(pinf / total_images * {D(1000)}, 3) ELSE {D(0)} END AS pms
  FROM (
    SELECT *, CASE WHEN inference_wall_seconds <= 0 AND pipeline_wall_seconds <> 0
                   THEN round(pipeline_wall_seconds * {D(K.PHOTO_INFERENCE_SHARE)}, 4) ELSE inference_wall_seconds END AS pinf
    FROM ({video_counts_sql('extracted_frames', 'segmented_frames_raw', 'inference_wall_seconds', 'pipeline_wall_seconds')
           .replace('__SRC__', '''(SELECT r.*, a.avg_risk, fb.fallback_risk, pi.primary_issue FROM mraw_v r
              LEFT JOIN (SELECT kind, asset_id, round(avg(risk_score), 3) AS avg_risk FROM mframe_v GROUP BY ALL) a USING (kind, asset_id)
              LEFT JOIN (SELECT kind, asset_id, CASE WHEN s <> 0 THEN round(w / greatest(s, ''' + D(1e-6) + '''), 3) ELSE ''' + D(0) + ''' END AS fallback_risk
                         FROM (SELECT kind, asset_id,
                                      sum(pixel_share_pct / ''' + D(100) + ''' * CASE ''' + ' '.join(f"WHEN class_name = {_q(n)} THEN {D(v)}" for n, v in K.FALLBACK_RISK_WEIGHTS.items()) + ''' ELSE ''' + D(K.FALLBACK_RISK_DEFAULT) + ''' END) AS w,
                                      sum(pixel_share_pct / ''' + D(100) + ''') AS s
                               FROM mcm_v GROUP BY ALL)) fb USING (kind, asset_id)
              LEFT JOIN (SELECT kind, asset_id, class_name_ru AS primary_issue FROM (
                           SELECT *, row_number() OVER (PARTITION BY kind, asset_id ORDER BY frames_present DESC,
                                     pixel_share_pct DESC, pixel_count DESC, class_id) AS rk
                           FROM mcm_v WHERE class_name NOT IN ('Void', 'Normal', 'Ship hull')
                             AND (frames_present > 0 OR pixel_share_pct > 0)) WHERE rk = 1) pi USING (kind, asset_id))''')})))""")

view("mdyn_v", ["mframe_v", "mlines_v", "mmeta_v"], f"""
SELECT f.kind, f.asset_id, m.updated_at_epoch,
       CAST(CASE WHEN f.kind = 'photo' THEN row_number() OVER (PARTITION BY f.kind, f.asset_id ORDER BY t.frame_time, f.frame_idx)
                 ELSE f.frame_idx END AS BIGINT) AS frame_idx,
       CAST(CAST(CASE WHEN f.kind = 'photo' THEN row_number() OVER (PARTITION BY f.kind, f.asset_id ORDER BY t.frame_time, f.frame_idx)
                 ELSE f.frame_idx END AS BIGINT) AS VARCHAR) AS frame_label,
       f.risk_score, {translate_sql('f.primary_sign_name')} AS dominant_class_name_ru
FROM mframe_v f JOIN (SELECT kind, asset_id, frame_idx, max(updated_at) AS frame_time FROM mlines_v GROUP BY ALL) t
  USING (kind, asset_id, frame_idx)
JOIN mmeta_v m USING (kind, asset_id)""")


def stage_rows_sql(src: str, keys: str) -> str:
    names = K.STAGE_NAMES
    cols = ["extraction_wall_seconds", "preprocessing_wall_seconds", "inference_wall_seconds", "export_stage_wall_seconds"]
    parts = [f"SELECT {keys}, {_q(names[i])} AS stage_name, round({c}, 3) AS seconds, {i + 1} AS stage_order FROM {src}"
             for i, c in enumerate(cols)]
    other = (f"greatest(round(pipeline_wall_seconds - (((extraction_wall_seconds + preprocessing_wall_seconds) + "
             f"inference_wall_seconds) + export_stage_wall_seconds), 9), {D(0)})")
    parts.append(f"SELECT {keys}, {_q(names[4])} AS stage_name, CASE WHEN {other} > {D(K.OTHER_STAGE_MIN)} "
                 f"THEN round({other}, 3) ELSE {D(0)} END AS seconds, 5 AS stage_order FROM {src}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE seconds > 0"


def curve_sql(src: str, keys: str, items: str, kind_expr: str) -> str:
    vf, vr = K.VIDEO_OVERHEAD
    pf, pr = K.PHOTO_OVERHEAD
    over = (f"CASE WHEN {kind_expr} = 'photo' THEN greatest({D(pf)}, pipeline_wall_seconds * {D(pr)}) "
            f"ELSE greatest({D(vf)}, pipeline_wall_seconds * {D(vr)}) END")
    return f"""
SELECT {keys}, scale, CAST(it * scale AS BIGINT) AS items,
       round(ov + greatest({D(0)}, pipeline_wall_seconds - ov) * scale, 3) AS pipeline_seconds,
       round(greatest({D(0)}, inference_wall_seconds) * scale, 3) AS inference_seconds
FROM (SELECT *, {items} AS it, {over} AS ov FROM {src}) CROSS JOIN (VALUES (1), (2), (3), (4)) AS sc(scale)
WHERE it > 0"""


oracle("l1_runs_mart", ["mruns_v"], "SELECT * FROM mruns_v")
oracle("l2_class_metrics_mart", ["mcm_v"], "SELECT * FROM mcm_v")
oracle("l3_dynamics_mart", ["mdyn_v"], "SELECT * FROM mdyn_v")
oracle("l4_stage_times_mart", ["mraw_v"], stage_rows_sql("mraw_v", "kind, asset_id, updated_at_epoch"))
oracle("l5_benchmark_curve_mart", ["mraw_v"],
       curve_sql("mraw_v", "kind, asset_id, updated_at_epoch",
                 "CASE WHEN kind = 'photo' THEN total_images ELSE segmented_frames_raw END", "kind"))
oracle("c42_parallel_estimate", ["mraw_v"], f"""
SELECT kind, asset_id, updated_at_epoch, {_q(K.PARALLEL_LABELS[0])} AS label, 1 AS videos,
       round(pipeline_wall_seconds, 3) AS sequential_seconds, round(pipeline_wall_seconds, 3) AS parallel_seconds
FROM mraw_v WHERE pipeline_wall_seconds > 0
UNION ALL
SELECT kind, asset_id, updated_at_epoch, {_q(K.PARALLEL_LABELS[1])}, 2,
       round(pipeline_wall_seconds * 2, 3), round(pipeline_wall_seconds * {D(K.PARALLEL_FACTOR)}, 3)
FROM mraw_v WHERE pipeline_wall_seconds > 0""")


def latest_sql(kind: str) -> str:
    return (f"(SELECT kind, asset_id FROM mruns_v WHERE kind = {_q(kind)} "
            f"ORDER BY updated_at_epoch DESC, asset_id ASC LIMIT 1)")


for _k in ("video", "photo"):
    lr = latest_sql(_k)
    oracle(f"l6_panel_issue_types_{_k}", ["mruns_v", "mcm_v"], f"""
SELECT count(*) AS issue_types FROM mcm_v WHERE kind = {_q(_k)} AND asset_id = (SELECT asset_id FROM {lr})
  AND class_name NOT IN ('Void', 'Normal', 'Ship hull') AND frames_present > 0""")
    oracle(f"l7_panel_primary_code_{_k}", ["mruns_v"], f"""
SELECT coalesce(primary_issue_code, {K.ISSUE_DEFAULT_CODE}) AS value FROM mruns_v
WHERE kind = {_q(_k)} ORDER BY updated_at_epoch DESC, asset_id LIMIT 1""")
    oracle(f"l8_panel_state_code_{_k}", ["mruns_v"], f"""
SELECT coalesce(state_code, {K.STATE_DEFAULT_CODE}) AS value FROM mruns_v
WHERE kind = {_q(_k)} ORDER BY updated_at_epoch DESC, asset_id LIMIT 1""")
    oracle(f"l9_panel_risk_{_k}", ["mruns_v"], f"""
SELECT risk_score AS value FROM mruns_v WHERE kind = {_q(_k)} ORDER BY updated_at_epoch DESC, asset_id LIMIT 1""")
    oracle(f"l10_panel_class_frames_{_k}", ["mruns_v", "mcm_v"], f"""
SELECT class_name_ru AS metric, frames_present AS value FROM mcm_v
WHERE kind = {_q(_k)} AND asset_id = (SELECT asset_id FROM {lr}) AND class_name NOT IN ('Void', 'Normal', 'Ship hull')
ORDER BY frames_present DESC, pixel_share_pct DESC LIMIT 8""")
    oracle(f"l11_panel_class_table_{_k}", ["mruns_v", "mcm_v"], f"""
SELECT class_name_ru AS sign, frames_present AS frames, printf('%.2f %%', pixel_share_pct) AS zone_share FROM mcm_v
WHERE kind = {_q(_k)} AND asset_id = (SELECT asset_id FROM {lr}) AND class_name NOT IN ('Void', 'Normal', 'Ship hull')
ORDER BY frames_present DESC, pixel_share_pct DESC LIMIT 8""")
    oracle(f"l12_panel_dynamics_{_k}", ["mruns_v", "mdyn_v"], f"""
SELECT frame_label AS metric, risk_score AS value FROM mdyn_v
WHERE kind = {_q(_k)} AND asset_id = (SELECT asset_id FROM {lr}) ORDER BY frame_idx LIMIT 12""")
    oracle(f"l13_panel_class_share_{_k}", ["mruns_v", "mcm_v"], f"""
SELECT class_name_ru AS metric, pixel_share_pct AS value FROM mcm_v
WHERE kind = {_q(_k)} AND asset_id = (SELECT asset_id FROM {lr}) AND class_name NOT IN ('Void', 'Normal', 'Ship hull')
  AND pixel_share_pct > 0 ORDER BY pixel_share_pct DESC LIMIT 8""")

oracle("e4_latest_run_rows", ["mruns_v", "mcm_v"], f"""
SELECT kind, asset_id, class_name, frames_present FROM mcm_v
WHERE (kind, asset_id) IN (SELECT kind, asset_id FROM {latest_sql('video')})""")

oracle("i3_top_by_frames", ["mcm_v"], """
SELECT kind, asset_id, CAST(pos AS INTEGER) AS pos, class_name_ru, frames_present FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, asset_id ORDER BY frames_present DESC, pixel_share_pct DESC, class_id) AS pos
  FROM mcm_v WHERE class_name NOT IN ('Void', 'Normal', 'Ship hull')) WHERE pos <= 8""")

oracle("i4_top_by_share", ["mcm_v"], """
SELECT kind, asset_id, CAST(pos AS INTEGER) AS pos, class_name_ru, pixel_share_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, asset_id ORDER BY pixel_share_pct DESC, class_id) AS pos
  FROM mcm_v WHERE class_name NOT IN ('Void', 'Normal', 'Ship hull') AND pixel_share_pct > 0) WHERE pos <= 8""")

oracle("i5_first_points", ["mdyn_v"], """
SELECT kind, asset_id, CAST(pos AS INTEGER) AS pos, frame_label, risk_score FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, asset_id ORDER BY frame_idx) AS pos FROM mdyn_v) WHERE pos <= 12""")

C = K.DEFECT_COMMENTS
oracle("i6_defect_table", ["mcm_v"], f"""
SELECT kind, asset_id, CAST(row_no AS INTEGER) AS row_no, class_name_ru AS sign, frames_present, pixel_share_pct,
       CASE WHEN pixel_share_pct >= 25 THEN {_q(C[0])} WHEN pixel_share_pct >= 10 THEN {_q(C[1])}
            WHEN frames_present >= 10 THEN {_q(C[2])} ELSE {_q(C[3])} END AS comment
FROM (SELECT *, row_number() OVER (PARTITION BY kind, asset_id ORDER BY pixel_share_pct DESC, frames_present DESC, class_id) AS row_no
      FROM mcm_v WHERE class_name NOT IN ('Void', 'Normal', 'Ship hull') AND (frames_present > 0 OR pixel_share_pct > 0))
WHERE row_no <= 6""")


def recs_sql(preset: str) -> str:
    t = K.RECOMMENDATIONS_LIVE if preset == "live" else K.RECOMMENDATIONS_STRICT
    c = K.RECOMMENDATION_CUTS_LIVE if preset == "live" else K.RECOMMENDATION_CUTS_STRICT
    items = [f"CASE WHEN r.risk_score >= {D(0.7)} THEN {_q(t['high'])} WHEN r.risk_score >= {D(0.45)} THEN {_q(t['medium'])} ELSE {_q(t['low'])} END",
             f"CASE WHEN coalesce(s.c, 0) >= {D(c['corrosion'])} THEN {_q(t['corrosion'])} END",
             f"CASE WHEN coalesce(s.p, 0) >= {D(c['peel'])} THEN {_q(t['peel'])} END",
             f"CASE WHEN coalesce(s.g, 0) >= {D(c['growth'])} THEN {_q(t['growth'])} END"]
    if preset != "live":
        items.append(f"CASE WHEN r.extracted_frames > 0 AND r.segmented_frames > 0 AND "
                     f"r.segmented_frames / greatest(r.extracted_frames, 1) < {D(c['coverage'])} THEN {_q(t['coverage'])} END")
    arr = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    return f"""
SELECT kind, asset_id, array_to_string(recs, ' | ') AS recommendations, coalesce(recs[1], {_q(K.DEFAULT_RECOMMENDATION)}) AS primary_recommendation
FROM (SELECT kind, asset_id, list_slice(CASE WHEN len(a) < 2 THEN list_append(a, {_q(t['filler'])}) ELSE a END, 1, 4) AS recs
      FROM (SELECT r.kind, r.asset_id, {arr} AS a
            FROM mruns_v r LEFT JOIN (
              SELECT kind, asset_id, max(pixel_share_pct) FILTER (WHERE class_name = 'Corrosion') AS c,
                     max(pixel_share_pct) FILTER (WHERE class_name = 'Paint peel') AS p,
                     max(pixel_share_pct) FILTER (WHERE class_name = 'Marine growth') AS g
              FROM mcm_v GROUP BY ALL) s USING (kind, asset_id)))"""


oracle("c37_recommendations", ["mruns_v", "mcm_v"], recs_sql("live"))
oracle("c37_recommendations_strict", ["mruns_v", "mcm_v"], recs_sql("strict"))

oracle("f19_reviewed_items", ["mruns_v"], """
SELECT kind, asset_id, CAST(coalesce(nullif(segmented_frames, 0), nullif(processed_frames, 0), nullif(deduplicated_frames, 0),
                                nullif(quality_ok_frames, 0), nullif(extracted_frames, 0), nullif(total_images, 0), 0) AS BIGINT) AS reviewed_items
FROM mruns_v""")

oracle("f14_timing_stats", ["mruns_v"], f"""
SELECT kind, asset_id,
       CASE WHEN n > 0 THEN round(inference_wall_seconds / n * {D(1000)}, 3) ELSE {D(0)} END AS ms_per_item,
       CASE WHEN n > 0 THEN round(pipeline_wall_seconds / n, 3) ELSE {D(0)} END AS sec_per_item
FROM (SELECT *, CASE WHEN kind = 'photo' THEN total_images ELSE segmented_frames END AS n FROM mruns_v)""")

oracle("l16_report_tables", ["mruns_v", "mcm_v"], f"""
SELECT r.kind, r.asset_id,
       CAST(coalesce(nullif(segmented_frames, 0), nullif(processed_frames, 0), nullif(deduplicated_frames, 0),
                     nullif(quality_ok_frames, 0), nullif(extracted_frames, 0), nullif(total_images, 0), 0) AS BIGINT) AS reviewed_items,
       c.issue_types, r.primary_issue, r.risk_score, {three_sql('r.risk_score', K.URGENCY_LABELS)} AS urgency,
       printf('%s показала, что среди выявленных не-фоновых признаков чаще всего отмечался признак "%s". '
              || 'Интегральный риск оценивается как %s (%.3f), приоритет действий - %s.',
              CASE WHEN r.kind = 'photo' THEN 'Фотоинспекция' ELSE 'Видеоинспекция' END, r.primary_issue,
              lower(r.risk_band), r.risk_score, lower({three_sql('r.risk_score', K.URGENCY_LABELS)})) AS summary,
       printf({_q(K.CONCLUSION_TEXT)}, CASE WHEN r.kind = 'photo' THEN 'Фотоинспекция' ELSE 'Видеоинспекция' END, r.primary_issue,
              lower(r.risk_band), r.risk_score) AS conclusion
FROM mruns_v r JOIN (SELECT kind, asset_id, count_if(class_name NOT IN ('Void', 'Normal', 'Ship hull')
                            AND (frames_present > 0 OR pixel_share_pct > 0)) AS issue_types FROM mcm_v GROUP BY ALL) c
  USING (kind, asset_id)""")

# ---- runs_v / stage_v ------------------------------------------------------------

oracle("g9_latest_run", ["runs_v"], """
SELECT kind, asset_id, run_id, updated_at, round(risk_score, 6) AS risk_score FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY updated_at DESC, run_id DESC) AS r FROM runs_v) WHERE r = 1""")

oracle("g10_latest_kind", ["runs_v"], """
SELECT kind FROM runs_v ORDER BY updated_at DESC, (kind = 'photo') DESC, kind DESC LIMIT 1""")

oracle("c29_c30_run_ids", ["runs_v"], """
SELECT run_id, coalesce(nullif(CAST(asset_id AS VARCHAR), ''), nullif(CAST(run_id AS VARCHAR), ''), 'unknown') AS asset_key,
       CAST(epoch(updated_at) AS BIGINT) AS updated_at_epoch, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at_iso
FROM runs_v""")

oracle("c19_run_band", ["runs_v"], f"""
SELECT run_id, s AS risk_score, {band_sql('s', 'pipeline')} AS band_pipeline, {band_sql('s', 'dashboard')} AS band_dashboard,
       {three_sql('s', K.STATE_LABELS)} AS state_label,
       {code_sql(three_sql('s', K.STATE_LABELS), K.STATE_CODES, K.STATE_DEFAULT_CODE)} AS state_code
FROM (SELECT run_id, round(risk_score, 3) AS s FROM runs_v)""")

oracle("k1_stage_times", ["stage_v"], stage_rows_sql("stage_v", "asset_id"))

oracle("c31_effective_video_counts", ["stage_v"], "SELECT asset_id, extracted_frames, q AS quality_ok_frames, "
       "d AS deduplicated_frames, p AS processed_frames, s AS segmented_frames, round(inf, 4) AS inference_wall_seconds, "
       "ms AS avg_inference_ms, (q <> 0 OR d <> 0 OR p <> 0 OR s <> 0 OR inf <> inference_wall_seconds) AS imputed FROM ("
       + video_counts_sql("extracted_frames", "0", "inference_wall_seconds", "pipeline_wall_seconds")
       .replace("__SRC__", "(SELECT *, items AS extracted_frames FROM stage_v)") + ")")

oracle("c32_effective_photo_counts", ["stage_v"], f"""
SELECT asset_id, CAST(items AS BIGINT) AS total_images, round(inf, 4) AS inference_wall_seconds,
       CASE WHEN items > 0 THEN round(inf / items * {D(1000)}, 3) ELSE {D(0)} END AS avg_inference_ms,
       (inf <> 0) AS imputed
FROM (SELECT *, CASE WHEN pipeline_wall_seconds <> 0 THEN round(pipeline_wall_seconds * {D(K.PHOTO_INFERENCE_SHARE)}, 4)
                     ELSE {D(0)} END AS inf FROM stage_v)""")

oracle("c41_benchmark_curve", ["stage_v"],
       curve_sql("(SELECT *, 'video' AS kind FROM stage_v)", "asset_id, kind", "items", "kind")
       + " UNION ALL " + curve_sql("(SELECT *, 'photo' AS kind FROM stage_v)", "asset_id, kind", "items", "kind"))


# ---- arrivals, media, hotspots ------------------------------------------------

oracle("f1_max_mtime", ["arrivals_v"], "SELECT max(modificationTime) AS latest_modification FROM arrivals_v")

oracle("d4_latest_batch", ["arrivals_v"], f"""
SELECT event_id, path, modificationTime FROM arrivals_v
WHERE CAST(floor(epoch(modificationTime)) AS BIGINT) >=
      (SELECT CAST(floor(epoch(max(modificationTime))) AS BIGINT) FROM arrivals_v) - {K.PHOTO_BATCH_WINDOW_SEC}""")

oracle("i1_photos_newest", ["arrivals_v"], "SELECT event_id, path, modificationTime FROM arrivals_v ORDER BY modificationTime DESC, event_id")

oracle("g6_risk_series", ["arrivals_v"], f"""
SELECT event_id, row_number() OVER (ORDER BY modificationTime, path) AS photo_index, path AS label,
       round(least(value / {D(490)}, {D(0.98)}), 3) AS risk_score
FROM arrivals_v""")

oracle("m3_burst_sessions_batch", ["arrivals_v"], f"""
SELECT session_no, min(modificationTime) AS session_start, max(modificationTime) AS session_end, count(*) AS photos
FROM (SELECT *, sum(new) OVER (ORDER BY modificationTime, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
      FROM (SELECT *, CASE WHEN prev IS NULL OR epoch_us(modificationTime) - epoch_us(prev) > {K.PHOTO_BATCH_WINDOW_SEC * 1_000_000}
                           THEN 1 ELSE 0 END AS new
            FROM (SELECT modificationTime, path, lag(modificationTime) OVER (ORDER BY modificationTime, path) AS prev
                  FROM arrivals_v)))
GROUP BY session_no""")

oracle("c1_path_names", ["media_v"], f"""
SELECT page_id, regexp_extract(path, '([^/]+)$', 1) AS filename,
       regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem,
       CASE WHEN trim(coalesce(path, '')) = '' THEN {_q('Источник не указан')}
            WHEN strpos(trim(path), '/') > 0 THEN
              CASE WHEN regexp_extract(regexp_replace(trim(path), '/+$', ''), '([^/]*)$', 1) = '' THEN trim(path)
                   ELSE regexp_extract(regexp_replace(trim(path), '/+$', ''), '([^/]*)$', 1) END
            ELSE trim(path) END AS source_name
FROM media_v""")

oracle("c28_size_kb", ["media_v"], f"SELECT page_id, length, round(length / {D(1024)}, 2) AS size_kb FROM media_v")

oracle("c38_safe_name", ["media_v"], """
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(path, ''), '[^\\p{L}\\p{N}._-]', '_', 'g'),
                                                 '^[._]+|[._]+$', '', 'g'), ''), 'item') AS safe_name
FROM media_v""")

oracle("e9_existing_only", ["media_v"], """
SELECT doc_id AS page_id, source FROM documents WHERE doc_id IN (SELECT page_id FROM media_v)""")

oracle("a12_peek", ["media_v"], "SELECT page_id, length FROM media_v ORDER BY page_id LIMIT 20")

PAGE_MATCHERS = {"bow-thruster": r"(?i)/de/", "propeller": r"(?i)/fr/", "engine": r"(?i)/it/"}
HOTSPOT_IDS = [h for h, _, _, _ in K.HOTSPOTS]


def matched_sql(matchers: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT {_q(h)} AS hotspot_id, path AS name, page_id AS ord FROM media_v WHERE regexp_matches(path, {_q(p)})"
        for h, p in matchers.items())


def assign_sql(matchers: dict, fallbacks: dict) -> str:
    rest = [h for h in HOTSPOT_IDS if h not in matchers]
    fb_rows = [f"({_q(h)}, {i + 1}, {_q(n)})" for h in matchers for i, n in enumerate(fallbacks.get(h, []))]
    fb = (f"SELECT f.hotspot_id, f.pos, f.name, 'fallback' AS origin FROM (VALUES {', '.join(fb_rows)}) AS f(hotspot_id, pos, name) "
          f"WHERE f.hotspot_id NOT IN (SELECT hotspot_id FROM m)") if fb_rows else None
    rest_arr = "[" + ", ".join(_q(h) for h in rest) + "]"
    chunk = f"""
SELECT {rest_arr}[h + 1] AS hotspot_id, CAST(i - h * size AS BIGINT) AS pos, name, 'chunk' AS origin FROM (
  SELECT *, CAST(floor((i - 1) / size) AS INTEGER) AS h FROM (
    SELECT path AS name, row_number() OVER (ORDER BY page_id, path) AS i,
           CAST(ceil(count(*) OVER () / {len(rest)}) AS BIGINT) AS size
    FROM media_v WHERE path NOT IN (SELECT name FROM m)))""" if rest else None
    parts = ["SELECT hotspot_id, CAST(row_number() OVER (PARTITION BY hotspot_id ORDER BY ord, name) AS BIGINT) AS pos, "
             "name, 'matched' AS origin FROM m"] + [p for p in (fb, chunk) if p]
    return f"WITH m AS ({matched_sql(matchers)}) SELECT hotspot_id, pos, {_q(K.HOTSPOT_PHOTO_PREFIX)} || name AS photo_url, origin " \
           f"FROM ({' UNION ALL '.join(parts)})"


HOTSPOT_DIM = "(VALUES " + ", ".join(f"({i}, {_q(h)}, {_q(t)})" for i, (h, t, _, _) in enumerate(K.HOTSPOTS)) \
    + ") AS hd(hotspot_order, hotspot_id, text)"

view("assign_v", ["media_v"], assign_sql(PAGE_MATCHERS, K.HOTSPOT_FALLBACK_FILES))
oracle("l17_assign_hotspot_photos", ["assign_v"], "SELECT hotspot_id, pos, photo_url, origin FROM assign_v")
oracle("l17_hotspot_counts", ["assign_v"], f"""
SELECT hd.hotspot_id, hd.text, CAST(coalesce(c.photos, 0) AS BIGINT) AS photos
FROM {HOTSPOT_DIM} LEFT JOIN (SELECT hotspot_id, count(*) AS photos FROM assign_v GROUP BY ALL) c USING (hotspot_id)""")
oracle("e6_match_photos", ["media_v"], f"SELECT hotspot_id, name AS filename FROM ({matched_sql(PAGE_MATCHERS)})")
oracle("e7_exclude_taken", ["media_v"], f"""
SELECT page_id AS source_order, path AS filename FROM media_v
WHERE path NOT IN (SELECT name FROM ({matched_sql(PAGE_MATCHERS)}))""")
view("assign_g8_v", ["media_v"], assign_sql({"propeller": r"(?i)/fr/"}, {"propeller": []}))
oracle("g8_even_chunks", ["assign_g8_v"], "SELECT hotspot_id, pos, photo_url FROM assign_g8_v WHERE origin = 'chunk'")
oracle("e10_hotspot_lists", ["assign_v"], f"""
SELECT hd.hotspot_id, hd.text, a.pos, a.photo_url FROM {HOTSPOT_DIM} LEFT JOIN assign_v a USING (hotspot_id)""")

oracle("e5_sensor_for", [], f"""
SELECT d.doc_id AS data_key, d.doc_id AS hotspot_id,
       coalesce(CAST(s.m.q AS VARCHAR), {_q(K.SENSOR_MISSING)}) AS quality1_text,
       coalesce(CAST(s.m.t AS VARCHAR), {_q(K.SENSOR_MISSING)}) AS toxic1_text
FROM documents d LEFT JOIN (
  SELECT doc_id, min({{'q': CAST(quality AS DOUBLE), 't': CAST(toxic AS DOUBLE)}}) AS m FROM labels GROUP BY doc_id) s
  USING (doc_id)""")

oracle("k2_sensors_long", [], """
SELECT doc_id AS data_key, 'quality' AS metric, 1 AS idx, CAST(quality AS DOUBLE) AS value FROM labels
UNION ALL SELECT doc_id, 'toxic', 1, CAST(toxic AS DOUBLE) FROM labels""")

oracle("k2_sensors_arrays", [], """
SELECT data_key, metric, string_agg(CAST(value AS VARCHAR), ',' ORDER BY idx) AS values FROM (
  SELECT doc_id AS data_key, 'quality' AS metric, 1 AS idx, CAST(quality AS DOUBLE) AS value FROM labels
  UNION ALL SELECT doc_id, 'toxic', 1, CAST(toxic AS DOUBLE) FROM labels) GROUP BY data_key, metric""")

oracle("j1_all_manifests", ["runs_v"], """
SELECT kind, asset_id, run_id, CAST(NULL AS VARCHAR) AS segment FROM runs_v
UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer""")

# ---- patches -------------------------------------------------------------------

view("patches_v", [], "SELECT vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS pixels, label FROM embeddings")


def fold_sum(lst: str) -> str:
    return f"list_reduce({lst}, lambda a, x: a + x, {D(0)})"


def refl(v: str, n: int) -> str:
    return f"(CASE WHEN ({v}) < 0 THEN -({v}) WHEN ({v}) >= {n} THEN {2 * n - 2} - ({v}) ELSE ({v}) END)"


def at(y: str, x: str) -> str:
    return f"pixels[{refl(y, 8)} * 8 + {refl(x, 8)} + 1]"


LAP_V = (f"(((({at('i // 8 - 1', 'i % 8')} + {at('i // 8 + 1', 'i % 8')}) + "
         f"{at('i // 8', 'i % 8 - 1')}) + {at('i // 8', 'i % 8 + 1')}) - {D(4)} * {at('i // 8', 'i % 8')})")
view("lap_v", ["patches_v"], f"""
SELECT frame_id, {fold_sum('list_transform(vals, lambda v: (v - m) * (v - m))')} / 64 AS laplacian_var FROM (
  SELECT frame_id, vals, {fold_sum('vals')} / 64 AS m FROM (
    SELECT frame_id, list(v ORDER BY i) AS vals FROM (
      SELECT frame_id, i, {LAP_V} AS v FROM (SELECT frame_id, pixels, unnest(range(64)) AS i FROM patches_v))
    GROUP BY frame_id))""")

DHASH8 = ("lpad(lower(hex(('0b' || array_to_string(list_transform(list_filter(range(64), lambda i: i % 8 < 7), "
          "lambda i: CASE WHEN pixels[i + 2] > pixels[i + 1] THEN '1' ELSE '0' END), ''))::UBIGINT)), 16, '0')")

oracle("c6_brightness", ["patches_v"], f"SELECT frame_id, round({fold_sum('pixels')} / len(pixels), 6) AS brightness FROM patches_v")
oracle("c7_laplacian_var", ["lap_v"], "SELECT frame_id, round(laplacian_var, 6) AS laplacian_var FROM lap_v")
oracle("c8_dhash", ["patches_v"], f"SELECT frame_id, {DHASH8} AS dhash FROM patches_v")
oracle("c12_norm_stats", ["patches_v"], f"""
SELECT frame_id, round(list_min(n), 9) AS norm_min, round(list_max(n), 9) AS norm_max,
       round({fold_sum('n')} / len(n), 9) AS norm_mean
FROM (SELECT frame_id, list_transform(pixels, lambda x: x / {D(255)}) AS n FROM patches_v)""")

SCALED = f"list_transform(pixels, lambda x: round((x + {D(0.5)}) * {D(255)}, 0))"
MEAN3 = "[" + ", ".join(D(m) for m in K.IMAGENET_MEAN) + "]"
STD3 = "[" + ", ".join(D(s) for s in K.IMAGENET_STD) + "]"
oracle("c14_normalize_channels", ["patches_v"], f"""
SELECT frame_id, round({fold_sum('n')}, 6) AS norm_sum, round(list_min(n), 6) AS norm_min, round(list_max(n), 6) AS norm_max
FROM (SELECT frame_id, list_transform({SCALED}, lambda v, i: (v / {D(255)} - {MEAN3}[(i - 1) % 3 + 1]) / {STD3}[(i - 1) % 3 + 1]) AS n
      FROM patches_v)""")


def mask_sql(threshold=None) -> str:
    chan = f"list_transform(list_slice(pixels, p * 8 + 1, p * 8 + 8), lambda v: v + {D(0.5)})"
    idx = f"CAST(list_position({chan}, list_max({chan})) - 1 AS INTEGER)"
    if threshold is not None:
        idx = f"CASE WHEN list_max({chan}) >= {D(threshold)} THEN {idx} ELSE 0 END"
    return f"list_transform(range(8), lambda p: {idx})"


view("mask_v", ["patches_v"], f"SELECT frame_id, pixels, {mask_sql()} AS mask FROM patches_v")
COLOR_LIST = "CASE c " + " ".join(f"WHEN {c} THEN [{r}, {g}, {b}]" for c, _, (r, g, b) in K.CLASS_INFO) + " ELSE [0, 0, 0] END"
oracle("f11_argmax_mask", ["mask_v"], "SELECT frame_id, array_to_string(mask, ',') AS mask FROM mask_v")
# two-head output: the best channel's class id ([1, 2, 6, 9], further channels 0)
# where it reaches the threshold
TWO_HEAD = f"list_transform({mask_sql()}, lambda c: coalesce([1, 2, 6, 9][c + 1], 0))"
REACHED = f"list_transform(range(8), lambda p: list_max(list_slice(pixels, p * 8 + 1, p * 8 + 8)) + {D(0.5)} >= {D(K.TWO_HEAD_THRESHOLD)})"
view("two_head_v", ["patches_v"], f"""
SELECT frame_id, [CASE WHEN r[i] THEN c[i] ELSE 0 END FOR i IN range(1, 9)] AS mask
FROM (SELECT frame_id, {TWO_HEAD} AS c, {REACHED} AS r FROM patches_v)""")
oracle("f10_two_head_mask", ["two_head_v"], "SELECT frame_id, array_to_string(mask, ',') AS mask FROM two_head_v")
oracle("n5_two_head_channels", ["two_head_v"], """
WITH c AS (SELECT frame_id, class_id, count(*) AS n FROM (SELECT frame_id, unnest(mask) AS class_id FROM two_head_v) GROUP BY ALL)
SELECT t.frame_id, array_to_string(any_value(t.mask), ',') AS mask, string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS counts,
       coalesce(string_agg(CAST(class_id AS VARCHAR), ',' ORDER BY class_id) FILTER (class_id <> 0), '') AS predicted,
       coalesce(arg_min(class_id, -n * 100 + class_id) FILTER (class_id <> 0), 1) AS dominant_class_id
FROM two_head_v t JOIN c ON t.frame_id = c.frame_id GROUP BY t.frame_id""")
oracle("n5_two_head_binary", ["patches_v"], f"""
WITH s AS (SELECT frame_id, [pixels[p * 8 + 1] + 0.5 >= 0.5 FOR p IN range(8)] AS fore,
                  [{{'id': [1, 2, 6, 9][i], 'score': pixels[i] + 0.5}} FOR i IN range(1, 5)] AS scores FROM patches_v),
r AS (SELECT frame_id, fore, len([f FOR f IN fore IF f]) AS n, [{{'id': x.id, 'score': -x.neg}} FOR x IN list_sort([{{'neg': -x.score, 'id': x.id}} FOR x IN scores])] AS ranked FROM s),
a AS (SELECT *, CASE WHEN ranked[1].score >= {K.ACTIVE_SCORE_THRESHOLD} THEN [x FOR x IN ranked IF x.score >= {K.ACTIVE_SCORE_THRESHOLD}]
                     ELSE ranked[1:1] END AS active FROM r),
d AS (SELECT *, [x FOR x IN active IF x.id <> 1] AS defects FROM a),
e AS (SELECT *, list_sum([x.score FOR x IN defects]) AS whole, n > 0 AND len(defects) > 0 AS has_some FROM d),
-- at most four defects: each takes its rounded part of what is left, the last one the rest
k1 AS (SELECT *, CASE WHEN len(defects) = 1 THEN n ELSE least(CAST(round_even(n * (defects[1].score / whole), 0) AS BIGINT), n) END AS t1 FROM e),
k2 AS (SELECT *, CASE WHEN len(defects) < 2 THEN 0 WHEN len(defects) = 2 THEN n - t1
                      ELSE least(CAST(round_even(n * (defects[2].score / whole), 0) AS BIGINT), n - t1) END AS t2 FROM k1),
k3 AS (SELECT *, CASE WHEN len(defects) < 3 THEN 0 ELSE n - t1 - t2 END AS t3 FROM k2),
c AS (SELECT *, list_sort([{{'id': defects[i].id, 't': [t1, t2, t3][i]}} FOR i IN range(1, len(defects) + 1)]) AS parts FROM k3)
SELECT frame_id, array_to_string([CASE WHEN f AND len(defects) > 0 THEN defects[1].id ELSE 0 END FOR f IN fore], ',') AS mask,
       CASE WHEN has_some THEN '0:' || (8 - n) || ',' || array_to_string([x.id || ':' || x.t FOR x IN parts], ',') ELSE '1:8' END AS counts,
       array_to_string([x.id FOR x IN defects], ',') AS predicted,
       CASE WHEN len(defects) > 0 THEN defects[1].id ELSE 1 END AS dominant_class_id
FROM c""")
oracle("f3_mask_histogram", ["mask_v"], """
SELECT frame_id, class_id, count(*) AS pixels FROM (SELECT frame_id, unnest(mask) AS class_id FROM mask_v) GROUP BY ALL""")
oracle("c15_colorize", ["mask_v"], f"""
SELECT frame_id, array_to_string(list_transform(mask, lambda c: printf('#%02x%02x%02x', ({COLOR_LIST})[1], ({COLOR_LIST})[2],
       ({COLOR_LIST})[3])), ',') AS colors FROM mask_v""")
oracle("c16_blend", ["mask_v"], f"""
SELECT frame_id, array_to_string(list_transform(range(8), lambda i:
         CAST(round(({SCALED})[i * 8 + 1] * {D(1 - K.OVERLAY_ALPHA)} + CAST(({COLOR_LIST.replace('CASE c ', 'CASE mask[i + 1] ')})[1] AS DOUBLE)
                    * {D(K.OVERLAY_ALPHA)}, 0) AS INTEGER)), ',') AS overlay
FROM mask_v""")
# the same rows from runs
for _runs, _pixels in (("f3_run_histogram", "f3_mask_histogram"), ("c15_run_colors", "c15_colorize"),
                       ("n5_run_two_head_channels", "n5_two_head_channels"), ("n5_run_two_head_binary", "n5_two_head_binary")):
    ORACLE[_runs] = ORACLE[_pixels]
oracle("f11_mask_runs", ["mask_v"], """
WITH p AS (SELECT frame_id, unnest(mask) AS v, generate_subscripts(mask, 1) AS i FROM mask_v),
s AS (SELECT frame_id, v, i, lag(v) OVER (PARTITION BY frame_id ORDER BY i) IS DISTINCT FROM v AS fresh FROM p),
r AS (SELECT frame_id, v, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY frame_id ORDER BY i) AS nth FROM s),
n AS (SELECT frame_id, nth, any_value(v) AS v, count(*) AS n FROM r GROUP BY ALL)
SELECT frame_id, string_agg(v || 'x' || n, ',' ORDER BY nth) AS runs FROM n GROUP BY frame_id""")
BYTES = f"list_transform({SCALED}, lambda v: CAST(greatest(0, least(255, v)) AS BIGINT))"
oracle("c16_run_overlay", ["mask_v"], f"""
WITH b AS (SELECT frame_id, mask, {BYTES} AS px FROM mask_v)
SELECT frame_id, array_to_string(list_transform(range(24), lambda i: printf('%02x',
         (px[CAST(i // 3 * 8 + i % 3 + 1 AS INTEGER)] * {round(100 - 100 * K.OVERLAY_ALPHA)}
          + ({COLOR_LIST.replace('CASE c ', 'CASE mask[CAST(i // 3 + 1 AS INTEGER)] ')})[CAST(i % 3 + 1 AS INTEGER)] * {round(100 * K.OVERLAY_ALPHA)} + 50) // 100)), '') AS overlay,
       'ok' AS status FROM b""")
oracle("c13_preprocess", ["patches_v"], f"""
WITH b AS (SELECT frame_id, label, {BYTES} AS px FROM patches_v),
-- the upper left pixels of the four blocks: rows and columns 2 and 4
m AS (SELECT frame_id, coalesce(label NOT IN (3, 5), true) AS ok,
             list_transform([19, 21, 35, 37], lambda i: CAST(round_even((px[i] + px[i + 1] + px[i + 8] + px[i + 9]) / 4.0, 0) AS BIGINT)) AS q FROM b)
SELECT frame_id, CASE WHEN ok THEN array_to_string(list_transform(q, lambda v: printf('%02x', v)), '') END AS processed,
       CASE WHEN ok THEN '2,2,6,6' ELSE '' END AS crop,
       CASE WHEN ok THEN 2 END AS processed_width, CASE WHEN ok THEN 2 END AS processed_height,
       CASE WHEN ok THEN round(list_min(q) / {D(255)}, 9) END AS norm_min, CASE WHEN ok THEN round(list_max(q) / {D(255)}, 9) END AS norm_max,
       CASE WHEN ok THEN round(list_sum(q) / 4.0 / {D(255)}, 9) END AS norm_mean,
       CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT ok THEN 'undecodable' END AS error
FROM m""")
oracle("n1_frame_metrics", ["patches_v", "lap_v"], f"""
SELECT p.frame_id, 8 AS width, 8 AS height, 'ok' AS status, round({fold_sum('p.pixels')} / len(p.pixels), 6) AS brightness,
       round(l.laplacian_var, 6) AS laplacian_var,
       {DHASH8.replace('pixels[', 'p.pixels[')} AS dhash
FROM patches_v p JOIN lap_v l USING (frame_id)""")

view("n4_counts_v", ["mask_v"], """
SELECT frame_id, class_id, count(*) AS cnt FROM (SELECT frame_id, unnest(mask) AS class_id FROM mask_v) GROUP BY ALL""")
N4_W = ("CASE class_id " + " ".join(f"WHEN {k} THEN {D(v)}" for k, v in K.RISK_WEIGHTS.items())
        + f" ELSE {D(K.DEFAULT_RISK_WEIGHT)} END")
oracle("n4_score_frames", ["mask_v", "n4_counts_v"], f"""
SELECT m.frame_id, array_to_string(m.mask, ',') AS mask, CAST(r.dominant_class_id AS INTEGER) AS dominant_class_id, r.risk_score
FROM mask_v m JOIN (
  SELECT frame_id,
         coalesce(first(class_id ORDER BY cnt DESC, class_id) FILTER (WHERE class_id <> 0), 0) AS dominant_class_id,
         round(least({D(K.RISK_CAP)},
             {fold_sum(f'list(CASE WHEN ratio > 0 THEN ratio * {N4_W} ELSE {D(0)} END ORDER BY class_id) FILTER (WHERE class_id <> 0)')}
             + least({D(K.COVERAGE_BONUS_CAP)}, count_if(class_id <> 0 AND ratio > 0) * {D(K.COVERAGE_BONUS_STEP)})
             + least({D(K.CORROSION_BONUS_CAP)}, coalesce(max(ratio) FILTER (WHERE class_id = 9), {D(0)}) * {D(K.CORROSION_BONUS_FACTOR)})
             + least({D(K.DEFECT8_BONUS_CAP)}, coalesce(max(ratio) FILTER (WHERE class_id = 8), {D(0)}) * {D(K.DEFECT8_BONUS_FACTOR)})), 3)
           AS risk_score
  FROM (SELECT *, round(cnt / {D(8)}, 6) AS ratio FROM n4_counts_v) GROUP BY frame_id) r USING (frame_id)""")
ORACLE["n4_score_runs"] = ORACLE["n4_score_frames"]

# ---- classifier scores ------------------------------------------------------

view("scores_v", ["class_counts_v"], """
SELECT asset_id, frame_idx, tot, fg, round(p1 / tot, 6) AS s1, round(p2 / tot, 6) AS s2, round(p6 / tot, 6) AS s6,
       round(p9 / tot, 6) AS s9 FROM (
  SELECT asset_id, frame_idx, sum(pixels) AS tot, sum(pixels) FILTER (WHERE class_id <> 0) AS fg,
         coalesce(sum(pixels) FILTER (WHERE class_id = 1), 0) AS p1, coalesce(sum(pixels) FILTER (WHERE class_id = 2), 0) AS p2,
         coalesce(sum(pixels) FILTER (WHERE class_id = 6), 0) AS p6, coalesce(sum(pixels) FILTER (WHERE class_id = 9), 0) AS p9
  FROM class_counts_v GROUP BY ALL)""")

view("active_v", ["scores_v"], f"""
SELECT *, CASE WHEN len(list_filter(ranked, lambda e: -e.neg >= {D(K.ACTIVE_SCORE_THRESHOLD)})) > 0
               THEN list_transform(list_filter(ranked, lambda e: -e.neg >= {D(K.ACTIVE_SCORE_THRESHOLD)}), lambda e: e.id)
               ELSE [ranked[1].id] END AS active
FROM (SELECT *, list_sort([{{'neg': -s1, 'id': 1}}, {{'neg': -s2, 'id': 2}}, {{'neg': -s6, 'id': 6}}, {{'neg': -s9, 'id': 9}}]) AS ranked
      FROM scores_v)""")

view("defects_v", ["active_v"], """
SELECT *, list_filter(active, lambda x: x <> 1) AS defects,
       list_transform(list_filter(active, lambda x: x <> 1),
                      lambda c: CASE c WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 6 THEN s6 WHEN 9 THEN s9 END) AS dscores
FROM active_v""")

oracle("f9_active_classes", ["defects_v"], """
SELECT asset_id, frame_idx, array_to_string(active, ',') AS active, array_to_string(defects, ',') AS defects FROM defects_v""")


def _share(i: int) -> str:
    return f"CAST(round_even(fg * (dscores[{i}] / ssum), 0) AS BIGINT)"


oracle("f8_apportion", ["defects_v"], f"""
SELECT asset_id, frame_idx, class_id, pixels FROM (
  SELECT asset_id, frame_idx, defects[1] AS class_id,
         CASE WHEN n = 1 THEN greatest(fg, 0) ELSE least({_share(1)}, greatest(fg, 0)) END AS pixels
  FROM d WHERE n >= 1
  UNION ALL
  SELECT asset_id, frame_idx, defects[2],
         CASE WHEN n = 2 THEN greatest(fg - c1, 0) ELSE least({_share(2)}, greatest(fg - c1, 0)) END
  FROM d WHERE n >= 2
  UNION ALL
  SELECT asset_id, frame_idx, defects[3], greatest(fg - c1 - c2, 0) FROM d WHERE n >= 3)
""".replace("FROM d ", "FROM (SELECT *, "
            f"CASE WHEN n = 1 THEN greatest(fg, 0) ELSE least({_share(1)}, greatest(fg, 0)) END AS c1, "
            f"CASE WHEN n >= 2 THEN (CASE WHEN n = 2 THEN greatest(fg - (CASE WHEN n = 1 THEN greatest(fg, 0) ELSE least({_share(1)}, greatest(fg, 0)) END), 0) "
            f"ELSE least({_share(2)}, greatest(fg - (CASE WHEN n = 1 THEN greatest(fg, 0) ELSE least({_share(1)}, greatest(fg, 0)) END), 0)) END) END AS c2 "
            f"FROM (SELECT *, len(defects) AS n, {fold_sum('dscores')} AS ssum FROM defects_v WHERE fg > 0)) d "))

oracle("f7_binary_summary", ["defects_v"], "\nUNION ALL\n".join(
    f"""SELECT asset_id, {c} AS class_id, {_q(CLASS_NAMES[c])} AS class_name, {color_hex_sql(str(c))} AS color_hex,
       CAST(coalesce(sum(px) FILTER (WHERE class_id = {c}), 0) AS BIGINT) AS pixel_count,
       count_if(class_id = {c} AND px > 0) AS frames_present,
       CASE WHEN sum(px) > 0 THEN round(coalesce(sum(px) FILTER (WHERE class_id = {c}), 0) / sum(px), 6) ELSE {D(0)} END AS pixel_share
FROM (SELECT a.asset_id, u.class_id, u.px FROM (SELECT DISTINCT asset_id FROM defects_v) a LEFT JOIN (
        SELECT asset_id, unnest(defects) AS class_id,
               greatest(1, CAST(round_even(unnest(dscores) * {D(1000)}, 0) AS BIGINT)) AS px FROM defects_v) u USING (asset_id))
GROUP BY asset_id""" for c in VISIBLE_IDS))


# ---- remaining inventory items ----------------------------------------------

oracle("e1_join_metrics", ["frames_v"], """
SELECT video_id, printf('frame_%06d.jpg', frame_idx) AS filename, round(timestamp_sec, 6) AS timestamp_sec,
       brightness, laplacian_var FROM frames_v""")

oracle("d9_filter_or_all", ["cm_v"], """
SELECT asset_id, class_id, frames_present FROM (
  SELECT *, coalesce(class_name NOT IN ('Void', 'Normal', 'Ship hull') AND frames_present > 0, false) AS p,
         max(CASE WHEN coalesce(class_name NOT IN ('Void', 'Normal', 'Ship hull') AND frames_present > 0, false) THEN 1 ELSE 0 END)
           OVER (PARTITION BY asset_id) AS anyp
  FROM cm_v) WHERE p OR anyp = 0""")

oracle("f18_distinct_in_order", ["frame_pred_v"], f"""
SELECT asset_id, CAST(label_rank AS INTEGER) AS label_rank, label FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY f, label) AS label_rank FROM (
    SELECT asset_id, {translate_sql('primary_sign_name')} AS label, min(frame_idx) AS f FROM frame_pred_v GROUP BY ALL))
WHERE label_rank <= 3""")


oracle("i7_review_rows", ["story_v", "frame_pred_v", "ratios_v"], f"""
SELECT s.asset_id, s.frame_idx, {_q(K.FRAME_LABEL_PREFIX + ' ')} || CAST(s.frame_idx AS VARCHAR) AS frame_label,
       CASE WHEN coalesce(x.extras, '') <> '' THEN x.extras
            WHEN {translate_sql('f.primary_sign_name')} NOT IN ('', {_q(K.CLASS_TRANSLATIONS['Normal'])}, {_q(K.CLASS_TRANSLATIONS['Void'])})
              THEN {translate_sql('f.primary_sign_name')}
            ELSE {_q(K.NO_SIGN_LABEL)} END AS truth_label, '-' AS time_text
FROM story_v s JOIN frame_pred_v f USING (asset_id, frame_idx) LEFT JOIN (
  SELECT asset_id, frame_idx,
         string_agg(label, ', ' ORDER BY rk) FILTER (WHERE rk <= 3 AND ratio >= {D(K.EXTRA_SIGN_MIN_RATIO)}) AS extras
  FROM (SELECT *, {translate_sql(class_name_sql('class_id'))} AS label,
               row_number() OVER (PARTITION BY asset_id, frame_idx ORDER BY ratio DESC, class_id) AS rk
        FROM ratios_v WHERE class_id IN (2, 6, 9)) GROUP BY ALL) x USING (asset_id, frame_idx)""")

PIV = [0, *VISIBLE_IDS]
COUNTS_TEXT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN n{c} > 0 THEN '{c}:' || p{c} END" for c in PIV) + "], lambda x: x IS NOT NULL), ',')"
RATIOS_TEXT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN n{c} > 0 THEN '{c}:' || printf('%.6f', round(p{c} / tot, 6)) END" for c in PIV) + "], lambda x: x IS NOT NULL), ',')"


def frame_texts(counts: str, keys: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE class_id = {c}) AS n{c}, coalesce(sum(pixels) FILTER (WHERE class_id = {c}), 0) AS p{c}" for c in PIV)
    return f"SELECT {keys}, frame_idx, {COUNTS_TEXT} AS counts_text, {RATIOS_TEXT} AS ratios_text FROM (SELECT {keys}, frame_idx, sum(pixels) AS tot, {cols} FROM {counts} GROUP BY {keys}, frame_idx)"


oracle("l14_photo_record", ["mframe_v", "mcounts_v"], f"""
SELECT m.asset_id, printf('%d.jpg', m.frame_idx) AS filename, 'raw/photos/' || printf('%d.jpg', m.frame_idx) AS source_path,
       m.frame_idx AS size_bytes, round(m.frame_idx / {D(1024)}, 2) AS size_kb, 'images/' || printf('%d.jpg', m.frame_idx) AS processed_image,
       'masks/' || printf('%d.jpg', m.frame_idx) AS mask_image, 'overlays/' || printf('%d.jpg', m.frame_idx) AS overlay_image,
       CAST(dominant_class_id AS INTEGER) AS dominant_class_id, {class_name_sql('dominant_class_id')} AS dominant_class_name,
       array_to_string(list_transform(predicted_class_ids, lambda x: {class_name_sql('x')}), ', ') AS predicted_class_names,
       t.counts_text AS class_pixel_counts, t.ratios_text AS class_pixel_ratios, 'multiclass_segmentation' AS prediction_mode, risk_score
FROM mframe_v m JOIN ({frame_texts('mcounts_v', 'kind, asset_id')}) t USING (kind, asset_id, frame_idx) WHERE kind = 'photo'""")

oracle("l15_frame_record", ["story_v", "frame_pred_v", "ratios_v", "class_counts_v"], f"""
SELECT s.asset_id, s.frame_idx, round(s.frame_idx / {D(25)}, 6) AS timestamp_sec, CAST(f.primary_sign_id AS INTEGER) AS dominant_class_id,
       f.primary_sign_name AS dominant_class_name, array_to_string(f.predicted_class_ids, ',') AS predicted_class_ids,
       x.ratios_text AS class_pixel_ratios, coalesce(t.top, '') AS top_classes,
       printf('frames/frame_%06d.jpg', s.frame_idx) AS processed_image, printf('masks/frame_%06d.jpg', s.frame_idx) AS mask_image,
       printf('overlays/frame_%06d.jpg', s.frame_idx) AS overlay_image
FROM story_v s JOIN frame_pred_v f USING (asset_id, frame_idx) JOIN ({frame_texts('class_counts_v', 'asset_id')}) x USING (asset_id, frame_idx)
LEFT JOIN (
  SELECT asset_id, frame_idx, string_agg(CAST(class_id AS VARCHAR), ',' ORDER BY r) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id, frame_idx ORDER BY pixels DESC, class_id) AS r
    FROM ratios_v WHERE class_id <> 0 AND pixels > 0) WHERE r <= 3 GROUP BY ALL) t USING (asset_id, frame_idx)""")

CROP = ("0.05", "0.10", "0.95", "0.90")
oracle("c5_crop_box", [], f"""
SELECT page_id, x1 AS plain_x1, y1 AS plain_y1, x2 AS plain_x2, y2 AS plain_y2,
       least(greatest(x1, 0), w - 1) AS clamped_x1, least(greatest(y1, 0), h - 1) AS clamped_y1,
       least(greatest(x2, least(greatest(x1, 0), w - 1) + 1), w) AS clamped_x2, least(greatest(y2, least(greatest(y1, 0), h - 1) + 1), h) AS clamped_y2
FROM (SELECT *, CAST(floor(w * {D(CROP[0])}) AS INTEGER) AS x1, CAST(floor(h * {D(CROP[1])}) AS INTEGER) AS y1,
             CAST(floor(w * {D(CROP[2])}) AS INTEGER) AS x2, CAST(floor(h * {D(CROP[3])}) AS INTEGER) AS y2
      FROM (SELECT page_id, CAST(page_id % 23 AS INTEGER) + 1 AS w, CAST(page_id % 31 AS INTEGER) + 1 AS h FROM pages))""")
oracle("c24_class_ids", [], """
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '0,0' WHEN 1 THEN '1,1' WHEN 2 THEN '2,2' WHEN 6 THEN '6,6' WHEN 9 THEN '9,9' ELSE '' END AS ids
FROM part""")
oracle("c45_asset_path", [], "SELECT page_id, regexp_replace(url, '/+$', '') || '/img/' || page_id AS path FROM pages")
oracle("c48_describe", [], f"""
SELECT doc_id, text, CASE {' '.join(f"WHEN text = {_q(k)} THEN {_q(v)}" for k, v in K.HOTSPOT_DESCRIPTIONS.items())} ELSE {_q(K.HOTSPOT_DEFAULT_DESCRIPTION)} END AS description
FROM (SELECT doc_id, CASE doc_id % 5 {' '.join(f"WHEN {i} THEN {_q(t)}" for i, (_, t, _, _) in enumerate(K.HOTSPOTS))} ELSE source END AS text FROM documents)""")

oracle("c35_time_label", ["frames_v"], f"""
SELECT video_id, frame_idx, CASE WHEN timestamp_sec IS NULL THEN {_q(K.TIME_NOT_GIVEN)}
                                ELSE printf('%.1f', round(timestamp_sec, 1)) || {_q(K.TIME_SUFFIX)} END AS time_label
FROM frames_v""")

oracle("c43_trimmed_frames", ["frames_v"], """
SELECT video_id, CAST(greatest(count(*) - CAST(round_even(3 * 25.0::DOUBLE, 0) AS BIGINT), 0) AS BIGINT) AS trimmed_frames
FROM frames_v GROUP BY video_id""")

oracle("c44_json_map", ["class_counts_v"], "SELECT asset_id, frame_idx, class_id, pixels FROM class_counts_v")


# ---- representative selection (H1-H6) as list folds --------------------------

def selection_sql(target: int, buckets: int, k: int) -> str:
    gap, dist, gdist = K.MIN_INDEX_GAP, K.BUCKET_MIN_DISTANCE, K.GLOBAL_MIN_DISTANCE
    pick = "STRUCT(s DOUBLE, f BIGINT, h HUGEINT)"
    rr = "STRUCT(d BIGINT, b INTEGER, s DOUBLE, f BIGINT, h HUGEINT)"
    far = "coalesce(bit_count(xor(e.h, x.h)), 64)"
    h1 = (f"list_reduce(arr, lambda acc, x: CASE WHEN len(acc) < {k} AND len(list_filter(acc, lambda e: "
          f"abs(e.f - x.f) < {gap} OR {far} < {dist})) = 0 THEN list_append(acc, x) ELSE acc END, []::{pick}[])")
    h2 = (f"list_reduce(arr, lambda acc, x: CASE WHEN len(acc) < {k} AND len(list_filter(acc, lambda e: "
          f"abs(e.f - x.f) < {gap})) = 0 THEN list_append(acc, x) ELSE acc END, h1)")
    h4 = (f"list_reduce(arr2, lambda acc, x: CASE WHEN len(acc) < {target} AND (len(acc) < nb OR "
          f"len(list_filter(acc, lambda e: {far} < {gdist})) = 0) THEN list_append(acc, x) ELSE acc END, []::{rr}[])")
    return f"""
WITH c AS (SELECT video_id, frame_idx, score, hash_u,
                  count(*) OVER (PARTITION BY video_id) AS t,
                  row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM cand_v),
     big AS (SELECT *, least({buckets}, t) AS nb, CAST(floor((rn * least({buckets}, t) - 1) / t) AS INTEGER) AS bucket
             FROM c WHERE t > {target}),
     bk AS (SELECT video_id, bucket, any_value(nb) AS nb,
                   list({{'s': score, 'f': frame_idx, 'h': hash_u}} ORDER BY score DESC, frame_idx DESC) AS arr
            FROM big GROUP BY video_id, bucket),
     walk AS (SELECT video_id, bucket, nb, {h2} AS picks FROM (SELECT *, {h1} AS h1 FROM bk)),
     flat AS (SELECT video_id, bucket, nb, unnest(picks) AS x, unnest(range(len(picks))) AS d FROM walk),
     rr AS (SELECT video_id, {h4} AS sel FROM (
              SELECT video_id, any_value(nb) AS nb,
                     list({{'d': d, 'b': bucket, 's': x.s, 'f': x.f, 'h': x.h}} ORDER BY d, bucket) AS arr2
              FROM flat GROUP BY video_id)),
     chosen AS (SELECT video_id, unnest(sel).f AS frame_idx FROM rr),
     nchosen AS (SELECT video_id, count(*) AS n FROM chosen GROUP BY video_id),
     fill AS (SELECT b.video_id, b.frame_idx,
                     row_number() OVER (PARTITION BY b.video_id ORDER BY b.score DESC, b.frame_idx) AS r
              FROM big b ANTI JOIN chosen USING (video_id, frame_idx))
SELECT video_id, frame_idx, 'all' AS picked_by FROM c WHERE t <= {target}
UNION ALL SELECT video_id, frame_idx, 'round_robin' FROM chosen
UNION ALL SELECT f.video_id, f.frame_idx, 'fill' FROM fill f LEFT JOIN nchosen n USING (video_id)
          WHERE f.r <= {target} - coalesce(n.n, 0)"""


oracle("h6_select_representative", ["cand_v"], selection_sql(K.TARGET_FRAMES, K.COVERAGE_BUCKETS, K.FRAMES_PER_BUCKET))
oracle("h1_select_compact", ["cand_v"], selection_sql(16, 6, 3))


# ---- E8: near frames by hash distance ------------------------------------------

view("varied_v", ["frames_v"], f"""
SELECT video_id, CAST(floor(frame_idx / 50.0) AS INTEGER) AS bucket, frame_idx,
       xor({HX("dhash")}, (((1::HUGEINT << (CAST(floor(brightness) AS INTEGER) % 20)) - 1) << CAST(frame_idx % 3 * 20 AS INTEGER))) AS hash
FROM frames_v""")


def near_sql(distance: int) -> str:
    return f"""
SELECT a.video_id, a.bucket, a.frame_idx, min(b.frame_idx) AS near_idx
FROM varied_v a LEFT JOIN varied_v b ON a.video_id = b.video_id AND a.bucket = b.bucket AND b.frame_idx < a.frame_idx
  AND bit_count(xor(a.hash, b.hash)) <= {distance}
GROUP BY a.video_id, a.bucket, a.frame_idx"""


oracle("e8_near_frames_1", ["varied_v"], near_sql(1))
oracle("e8_near_frames_6", ["varied_v"], near_sql(6))


# ---- streaming operators (outputs of completed availableNow runs) -------------

oracle("m2_stream_duplicates", ["dedup_v"], """
SELECT video_id, frame_idx, quality_ok, prev_dhash, hamming_to_prev, is_duplicate FROM dedup_v""")
oracle("m2_stream_duplicates_any_order", ["dedup_v"], """
SELECT video_id, frame_idx, quality_ok, prev_dhash, hamming_to_prev, is_duplicate FROM dedup_v""")

oracle("m4_stream_daily_counts", [], """
SELECT day_start, event_type, n FROM (
  SELECT time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP)) AS day_start, event_type, count(*) AS n
  FROM events GROUP BY ALL)
WHERE day_start + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 1 DAY FROM events)""")

oracle("m5_stream_latest_run", ["runs_v"], """
SELECT kind, asset_id, run_id, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY updated_at DESC, run_id DESC) AS r FROM runs_v) WHERE r = 1""")


# ---- marts from manifests: an order is a run, its lines are its frames -----------

KINDC = "CASE WHEN o_orderstatus = 'P' THEN 'photo' ELSE 'video' END"
view("man_v", [], f"""
SELECT *, {KINDC} AS kind, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS updated_at_epoch,
       strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS updated_at_iso,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS VARCHAR)
            WHEN o_custkey % 5 <> 0 THEN 'batch-' || o_orderkey ELSE 'g' || o_orderkey END AS asset_id,
       CAST(CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 1000) ELSE 0 END AS BIGINT) AS ex
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
view("manline_v", ["man_v"], f"""
SELECT m.kind, m.asset_id, m.updated_at_epoch, m.o_custkey, m.o_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS q,
       max(l_discount) AS l_discount, max(l_tax) AS l_tax, {CLASS_OF_LINE} AS c
FROM man_v m JOIN lineitem l ON l.l_orderkey = m.o_orderkey GROUP BY ALL""")
view("mancls_v", ["manline_v"], f"""
SELECT kind, asset_id, updated_at_epoch, o_orderkey, c, {class_name_sql('c')} AS class_name, {translate_sql(class_name_sql('c'))} AS class_name_ru,
       n AS frames_present, s AS pixel_count, round(round(s / sum(s) OVER (PARTITION BY o_orderkey), 6) * {D(100)}, 2) AS pixel_share_pct
FROM (SELECT kind, asset_id, updated_at_epoch, o_orderkey, c, count(*) AS n, CAST(sum(q) AS BIGINT) AS s
      FROM manline_v WHERE o_custkey % 7 <> 0 GROUP BY kind, asset_id, updated_at_epoch, o_orderkey, c)""")
oracle("b7_manifest_class_metrics", ["mancls_v"], """
SELECT kind, asset_id, updated_at_epoch, class_name, class_name_ru, frames_present, pixel_count, pixel_share_pct FROM mancls_v""")
oracle("b7_manifest_dynamics", ["manline_v"], f"""
SELECT kind, asset_id, updated_at_epoch, CAST(l_linenumber AS BIGINT) AS frame_idx, CAST(l_linenumber AS VARCHAR) AS frame_label,
       l_discount AS risk_score,
       {translate_sql("CASE WHEN c = 1 AND o_orderkey % 2 = 0 THEN 'Ship hull' ELSE " + class_name_sql('c') + " END")} AS dominant_class_name_ru
FROM manline_v""")
view("mansec_v", ["man_v"], f"""
SELECT kind, asset_id, updated_at_epoch, round(o_totalprice / {D(50000)}, 3) AS extraction_wall_seconds,
       CASE WHEN o_custkey % 2 = 0 THEN round(o_totalprice / {D(45000)}, 3) ELSE round(o_totalprice / {D(40000)}, 3) END AS preprocessing_wall_seconds,
       CASE WHEN o_custkey % 3 = 1 THEN {D(0)} ELSE round(o_totalprice / {D(30000)}, 3) END AS inference_wall_seconds,
       CASE WHEN o_custkey % 2 = 0 THEN round(o_totalprice / {D(60000)}, 3) ELSE {D(0)} END AS export_stage_wall_seconds,
       round(o_totalprice / {D(9000)}, 3) AS pipeline_wall_seconds
FROM man_v""")
oracle("b7_manifest_stage_times", ["mansec_v"], stage_rows_sql("mansec_v", "kind, asset_id, updated_at_epoch"))
oracle("b7_manifest_benchmark_curve", ["man_v"], f"""
SELECT kind, asset_id, updated_at_epoch, 1 AS scale, CAST(o_custkey AS BIGINT) AS items,
       round(o_totalprice / {D(9000)}, 3) AS pipeline_seconds, {D(0)} AS inference_seconds FROM man_v""")
view("mancnt_v", ["man_v"], f"""
SELECT *, {impute_sql('s0', 'p', *K.VIDEO_IMPUTE[3])} AS s FROM (
 SELECT *, {impute_sql('0', 'd', *K.VIDEO_IMPUTE[2])} AS p FROM (
  SELECT *, {impute_sql('d0', 'q', *K.VIDEO_IMPUTE[1])} AS d FROM (
   SELECT *, {impute_sql('q0', 'ex', *K.VIDEO_IMPUTE[0])} AS q FROM (
    SELECT *, CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE floor(ex * {D(0.8)}) END AS BIGINT) AS q0,
           CAST(CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE floor(ex * {D(0.6)}) END AS BIGINT) AS d0,
           CAST(CASE WHEN o_custkey % 5 = 0 THEN floor(ex * {D(0.3)}) ELSE 0 END AS BIGINT) AS s0,
           (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM man_v))))""")
oracle("f19_manifest_reviewed_items", ["mancnt_v"], """
SELECT kind, asset_id, updated_at_epoch,
       CAST(CASE WHEN kind = 'photo' THEN lines ELSE coalesce(nullif(s0, 0), nullif(d0, 0), nullif(q0, 0), ex) END AS BIGINT) AS reviewed_items
FROM mancnt_v""")
WEIGHT_OF_NAME = "CASE " + " ".join(f"WHEN class_name = {_q(n)} THEN {D(v)}" for n, v in K.FALLBACK_RISK_WEIGHTS.items()) + f" ELSE {D(K.FALLBACK_RISK_DEFAULT)} END"
MANIFEST_RUNS = f"""
WITH shares AS (
  SELECT kind, asset_id, round(list_reduce(list_prepend({D(0)}, list(pixel_share_pct / {D(100)} * {WEIGHT_OF_NAME} ORDER BY pos)), lambda a, b: a + b)
           / greatest(list_reduce(list_prepend({D(0)}, list(pixel_share_pct / {D(100)} ORDER BY pos)), lambda a, b: a + b), {D(1e-6)}), 3) AS fb
  FROM (SELECT x.*, f.pos FROM mancls_v x JOIN (SELECT o_orderkey, {CLASS_OF_LINE} AS c, min(l_linenumber) AS pos
        FROM man_v JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) f ON f.o_orderkey = x.o_orderkey AND f.c = x.c) GROUP BY ALL),
issue AS (
  SELECT kind, asset_id, class_name_ru FROM (
    SELECT *, row_number() OVER (PARTITION BY kind, asset_id ORDER BY frames_present DESC, pixel_share_pct DESC, pixel_count DESC, c) AS rk
    FROM mancls_v WHERE class_name NOT IN ('Normal', 'Ship hull', 'Void') AND (frames_present > 0 OR pixel_share_pct > 0)) WHERE rk = 1),
r AS (
  SELECT m.*, t.extraction_wall_seconds AS e, t.preprocessing_wall_seconds AS pre, t.export_stage_wall_seconds AS xp, t.pipeline_wall_seconds AS pw,
         round(CASE WHEN t.inference_wall_seconds <= 0 AND t.pipeline_wall_seconds <> 0
              THEN round(t.pipeline_wall_seconds * CASE WHEN m.kind = 'video' THEN {D(K.VIDEO_INFERENCE_SHARE)} ELSE {D(K.PHOTO_INFERENCE_SHARE)} END, 4)
              ELSE t.inference_wall_seconds END, 4) AS inf,
         coalesce(i.class_name_ru, {_q(K.NO_ISSUE_LABEL)}) AS primary_issue,
         CASE WHEN o_custkey % 4 <> 0 AND round(least(o_totalprice / {D(500000)}, {D(.98)}), 3) > 0
              THEN round(least(o_totalprice / {D(500000)}, {D(.98)}), 3) ELSE coalesce(h.fb, {D(0)}) END AS risk_score,
         CASE WHEN m.kind = 'video' THEN s ELSE lines END AS shown
  FROM mancnt_v m JOIN mansec_v t USING (kind, asset_id) LEFT JOIN issue i USING (kind, asset_id) LEFT JOIN shares h USING (kind, asset_id))
SELECT kind, asset_id, updated_at_iso, updated_at_epoch,
       CASE WHEN kind = 'photo' THEN CASE WHEN o_custkey % 5 <> 0 THEN asset_id ELSE 'photo-batch' END
            WHEN o_custkey % 3 <> 0 THEN 'cam/' || o_orderkey || '.mp4' ELSE asset_id END AS source_name,
       ex AS extracted_frames, CASE WHEN kind = 'video' THEN q ELSE 0 END AS quality_ok_frames,
       CASE WHEN kind = 'video' THEN d ELSE 0 END AS deduplicated_frames, CASE WHEN kind = 'video' THEN p ELSE 0 END AS processed_frames,
       CAST(shown AS BIGINT) AS segmented_frames, CAST(CASE WHEN kind = 'photo' THEN lines ELSE 0 END AS BIGINT) AS total_images,
       e AS extraction_wall_seconds, pre AS preprocessing_wall_seconds, inf AS inference_wall_seconds, xp AS export_stage_wall_seconds,
       pw AS pipeline_wall_seconds, CASE WHEN shown > 0 THEN round(inf / shown * {D(1000)}, 3) ELSE {D(0)} END AS avg_inference_ms,
       risk_score, {band_sql('risk_score', 'dashboard')} AS risk_band, primary_issue,
       {code_sql('primary_issue', K.ISSUE_CODES, K.ISSUE_DEFAULT_CODE)} AS primary_issue_code,
       {three_sql('risk_score', K.STATE_LABELS)} AS state_label,
       {code_sql(three_sql('risk_score', K.STATE_LABELS), K.STATE_CODES, K.STATE_DEFAULT_CODE)} AS state_code
FROM r"""
oracle("b7_manifest_runs", ["mancnt_v", "mansec_v", "mancls_v"], MANIFEST_RUNS)
oracle("a6_manifest_files", ["mancnt_v", "mansec_v", "mancls_v"], f"""
SELECT * EXCLUDE (updated_at_iso, updated_at_epoch) FROM ({MANIFEST_RUNS})
WHERE kind = 'video' OR regexp_replace(asset_id, '^(batch-|g)', '') = (
  SELECT max(CAST(o_orderkey AS VARCHAR)) FROM mancnt_v WHERE kind = 'photo')""")
LINE_SIGN = translate_sql("CASE WHEN c = 1 AND o_orderkey % 2 = 0 THEN 'Ship hull' ELSE " + class_name_sql('c') + " END")
oracle("i7_manifest_review_rows", ["manline_v"], f"""
SELECT kind, asset_id, updated_at_epoch, CAST(rn AS INTEGER) AS row_no,
       CASE WHEN kind = 'video' THEN {_q(K.FRAME_LABEL_PREFIX + ' ')} || l_linenumber ELSE 'p' || l_linenumber END AS item,
       CASE WHEN kind = 'photo' THEN {LINE_SIGN}
            WHEN c IN (2, 6, 9) THEN {LINE_SIGN} ELSE {_q(K.NO_SIGN_LABEL)} END AS sign,
       CASE WHEN kind = 'video' THEN CASE WHEN l_tax > 0 THEN format('{{:.1f}}', round(l_tax * 10, 1)) ELSE '-' END
            WHEN l_discount > 0 THEN format('{{:.3f}}', round(l_discount, 3)) ELSE '-' END AS value,
       'f' || l_linenumber || '.jpg' AS image
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS rn FROM manline_v) WHERE rn <= 8""")
