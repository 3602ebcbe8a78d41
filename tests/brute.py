"""Brute-force, single-machine statements of order-dependent operators,
used only as test oracles for the distributed versions."""

from __future__ import annotations


def _dist(a, b) -> int:
    if a is None or b is None:
        return 64
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def _score(row) -> float:
    return row["score"]


def select_walk(rows: list[dict], target=64, buckets=24, per_bucket=3, gap=6, dist=8, global_dist=6) -> list[int]:
    """Representative frames of one video as a sequential walk.
    rows: dicts with frame_idx, score, hash. Returns selected frame_idx sorted."""
    rows = sorted(rows, key=lambda r: r["frame_idx"])
    total = len(rows)
    if total <= max(target, 1):
        return [r["frame_idx"] for r in rows]
    nb = max(1, min(buckets, total))
    per_bucket_picks = []
    for b in range(nb):
        part = rows[b * total // nb:(b + 1) * total // nb]
        if not part:
            continue
        order = sorted(part, key=lambda r: (_score(r), r["frame_idx"]), reverse=True)
        picked: list[dict] = []

        def fits(c, use_dist):
            for p in picked:
                if abs(p["frame_idx"] - c["frame_idx"]) < gap:
                    return False
                if use_dist and _dist(p["hash"], c["hash"]) < dist:
                    return False
            return True

        for c in order:
            if len(picked) >= per_bucket:
                break
            if fits(c, True):
                picked.append(c)
        for c in order:
            if len(picked) >= per_bucket:
                break
            if any(p["frame_idx"] == c["frame_idx"] for p in picked):
                continue
            if fits(c, False):
                picked.append(c)
        per_bucket_picks.append(picked or order[:1])
    chosen: list[dict] = []
    depth_max = max((len(p) for p in per_bucket_picks), default=0)
    done = False
    for d in range(depth_max):
        for picks in per_bucket_picks:
            if d >= len(picks):
                continue
            c = picks[d]
            diverse = all(_dist(s["hash"], c["hash"]) >= global_dist for s in chosen)
            if not diverse and len(chosen) >= nb:
                continue
            chosen.append(c)
            if len(chosen) >= target:
                done = True
                break
        if done:
            break
    if len(chosen) < target:
        taken = {c["frame_idx"] for c in chosen}
        rest = sorted((r for r in rows if r["frame_idx"] not in taken),
                      key=lambda r: (_score(r), -r["frame_idx"]), reverse=True)
        chosen += rest[:target - len(chosen)]
    return sorted(c["frame_idx"] for c in chosen)


def prev_good(rows: list[dict], threshold=1) -> list[dict]:
    """G1 as a loop over one video's frames in order."""
    out, prev = [], None
    for r in sorted(rows, key=lambda r: r["frame_idx"]):
        ham = _dist(r["hash"], prev) if (prev is not None and r["hash"] is not None) else None
        out.append({"frame_idx": r["frame_idx"], "prev": prev, "dup": prev is not None and ham is not None and ham <= threshold})
        if r["ok"]:
            prev = r["hash"]
    return out
