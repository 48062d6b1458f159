"""Decision histories: which stage kept, dropped, rescued or relabelled each candidate, and why."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.policies import CorePolicy, INNER, PriorFilter, ScoreGate, StreamConflict, thresholds
from maskwright.operators import match
from maskwright.operators.runs import MASK

# Stage names in order.
STAGES = ("raw_retrieval", "metrics_completion", "size_aware_score_gate", "satellite_prior_filter",
          "core_exclusion_or_soft_core_rescue", "stream_conflict_resolution", "final_gt_write", "diagnostics_emit")
TRACE_STAGES = ("score_gate", "prior_filter", "core_policy")


def _no_thresholds() -> Column:
    return F.create_map().cast("map<string,double>")


def candidate_history(
    candidates: DataFrame,
    side: int,
    gate: ScoreGate = ScoreGate(),
    prior: PriorFilter = PriorFilter(),
    core: CorePolicy | None = CorePolicy(),
    conflict: StreamConflict | None = StreamConflict(),
) -> DataFrame:
    """Status and one event per stage reached for each satellite candidate.

    Columns read: score, area, solidity, aspect_sym_moment, dist_to_center, and with a conflict
    policy the match of ``match.stream_conflicts`` (matched_stream_id, overlap ratios). A stage
    given as None is recorded as skipped. Relabelled candidates miss the core and conflict
    stages but are written.
    """
    area, score = F.coalesce("area", F.lit(0)), F.coalesce("score", F.lit(0.0))
    sol, asp, dist = F.col("solidity"), F.col("aspect_sym_moment"), F.col("dist_to_center")
    df = candidates
    if "matched_stream_id" not in df.columns:
        for c, kind in (("matched_stream_id", "long"), ("overlap_ratio_satellite", "double"), ("overlap_ratio_stream", "double")):
            df = df.withColumn(c, F.lit(None).cast(kind))
    df = df.withColumn("_gate", gate.decide(area, score)).withColumn("_prior", prior.decide(area, sol, asp, dist, side))
    alive1 = F.col("_gate.decision") == "pass"
    df = df.withColumn(
        "_s2",
        F.when(~alive1, "dropped").when(F.col("_prior.decision") == "pass", "alive")
        .when((F.col("_prior.decision") == "relabel") & (F.col("_prior.target") == INNER), "relabeled_inner_galaxy")
        .otherwise("dropped"),
    )
    in_core = F.col("_s2") == "alive"
    if core is None:
        df = df.withColumn("_core", F.struct(F.lit("skipped").alias("decision"), F.lit("core_disabled").alias("reason")))
        df = df.withColumn("_s3", F.col("_s2"))
    else:
        df = df.withColumn("_core", core.decide(dist, area, score, sol, asp, side))
        df = df.withColumn("_s3", F.when(~in_core, F.col("_s2")).when(F.col("_core.decision") == "pass", "alive")
                           .when(F.col("_core.decision") == "rescue", "rescued").otherwise("dropped"))
    in_conflict = F.col("_s3").isin("alive", "rescued")
    if conflict is None:
        df = df.withColumn("_conf", F.struct(F.lit("skipped").alias("decision"), F.lit("conflict_disabled").alias("reason")))
        df = df.withColumn("_s4", F.col("_s3"))
    else:
        df = df.withColumn("_conf", conflict.decide(F.col("matched_stream_id"), F.coalesce("overlap_ratio_satellite", F.lit(0.0)), area, sol, asp))
        df = df.withColumn("_s4", F.when(~in_conflict, F.col("_s3")).when(F.col("_conf.decision") == "drop", "dropped")
                           .when(F.col("_conf.decision") == "win", "kept").otherwise(F.col("_s3")))
    written = F.col("_s4").isin("alive", "rescued", "kept", "relabeled_inner_galaxy")
    relabelled = F.col("_s4") == "relabeled_inner_galaxy"
    final = F.when(relabelled, F.lit("relabeled_inner_galaxy")).when(written, F.lit("kept")).otherwise(F.col("_s4"))

    base = [("score", score), ("area_clean_px", area), ("solidity", sol), ("aspect_sym_moment", asp),
            ("dist_to_center_px", dist), ("dist_to_center_frac", dist / F.lit(float(side)))]
    hit = F.col("matched_stream_id").isNotNull()
    overlap = [("overlap_ratio_satellite", F.when(hit, F.col("overlap_ratio_satellite"))),
               ("overlap_ratio_stream", F.when(hit, F.col("overlap_ratio_stream")))]

    def thin(pairs) -> Column:
        whole = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("double"))])
        return F.map_filter(whole, lambda _, v: v.isNotNull())

    def event(stage, before, rule, version, values, verdict, after, metrics) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"), before.alias("input_state"), F.lit(rule).alias("rule_name"),
            F.lit(version).alias("threshold_version"), values.alias("threshold_values"),
            verdict["decision"].alias("decision"), verdict["reason"].alias("reason"), after.alias("output_state"),
            metrics.alias("metrics_snapshot_thin"),
        )

    def fixed(decision: str, reason) -> dict[str, Column]:
        return {"decision": F.lit(decision), "reason": reason if isinstance(reason, Column) else F.lit(reason)}

    alive = F.lit("alive")
    conflict_values = (
        _no_thresholds() if conflict is None
        else F.map_concat(thresholds(conflict), F.create_map(F.lit("matched_stream_id"), F.col("matched_stream_id").cast("double")))
    )
    rule2 = "area_solidity_aspect" if prior.hard_center_radius_frac is None else "hard_center_area_solidity_aspect"
    events = [
        event(STAGES[0], F.lit("raw"), "raw_intake", "raw_v1", _no_thresholds(), fixed("pass", "raw_accept"), alive, thin(base)),
        event(STAGES[1], alive, "metrics_fill", "metrics_v1", _no_thresholds(), fixed("pass", "metrics_filled"), alive, thin(base)),
        event(STAGES[2], alive, "size_tier_score", gate.version, thresholds(gate), F.col("_gate"),
              F.when(alive1, "alive").otherwise("dropped"), thin(base)),
        F.when(alive1, event(STAGES[3], alive, rule2, prior.version, thresholds(prior), F.col("_prior"), F.col("_s2"), thin(base))),
        F.when(in_core, event(STAGES[4], alive, "core_radius_with_soft_rescue", core.version if core else "disabled",
                              thresholds(core) if core else _no_thresholds(), F.col("_core"), F.col("_s3"), thin(base))),
        F.when(in_conflict, event(STAGES[5], F.col("_s3"), "gt_stream_overlap", conflict.version if conflict else "disabled",
                                  conflict_values, F.col("_conf"), F.col("_s4"), thin(base + overlap))),
        F.when(written, event(STAGES[6], F.col("_s4"), "persist_to_final", "final_v1", _no_thresholds(),
                              fixed("pass", F.when(relabelled, "write_relabeled_inner_galaxy").otherwise("write_kept")),
                              final, thin(base))),
    ]
    out = df.withColumn("final_status", final).withColumn(
        "history", F.filter(F.array(*events), lambda e: e.isNotNull())
    )
    return out.drop("_gate", "_prior", "_core", "_conf", "_s2", "_s3", "_s4")


def history_summary(histories: DataFrame, gate: ScoreGate = ScoreGate(), prior: PriorFilter = PriorFilter(),
                    core: CorePolicy | None = CorePolicy(), conflict: StreamConflict | None = StreamConflict()) -> DataFrame:
    """Per image: raw, final and inner counts, drops per stage, final statuses, versions used."""
    dropped_at = F.expr("element_at(filter(history, e -> e.decision = 'drop'), 1).stage")
    h = histories.withColumn("_drop", F.when(F.size(F.filter("history", lambda e: e["decision"] == "drop")) > 0, dropped_at))
    gates = STAGES[2:6]
    return h.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_raw_satellites"),
        F.count_if(F.col("final_status") == "kept").alias("n_final_satellites"),
        F.count_if(F.col("final_status") == "relabeled_inner_galaxy").alias("n_final_inner_galaxy"),
        F.count_if(F.col("final_status") == "dropped").alias("n_dropped"),
        *[F.count_if(F.col("_drop") == s).alias(f"drop_{s}") for s in gates],
    ).select(
        "*", F.lit(gate.version).alias("v_score_gate"), F.lit(prior.version).alias("v_prior_filter"),
        F.lit(core.version if core else "disabled").alias("v_core_policy"),
        F.lit(conflict.version if conflict else "disabled").alias("v_conflict_policy"),
    )


def satellite_trace(
    candidates: DataFrame, side: int, gate: ScoreGate | None = ScoreGate(),
    prior: PriorFilter | None = PriorFilter(), core: CorePolicy | None = CorePolicy(),
) -> DataFrame:
    """Three satellite stages with an outcome per stage; a stage given as None is disabled."""
    area, score = F.coalesce("area", F.lit(0)), F.coalesce("score", F.lit(0.0))
    sol, asp, dist = F.col("solidity"), F.col("aspect_sym_moment"), F.col("dist_to_center")
    verdicts = (
        gate and gate.decide(area, score),
        prior and prior.decide(area, sol, asp, dist, side),
        core and core.decide(dist, area, score, sol, asp, side),
    )
    df, dropped = candidates, F.lit(False)
    results = []
    for i, (stage, v) in enumerate(zip(TRACE_STAGES, verdicts)):
        before = dropped
        if v is None:
            outcome, reason = F.when(before, "not_reached").otherwise("disabled"), F.lit(None).cast("string")
        else:
            df = df.withColumn(f"_v{i}", v)
            d = F.col(f"_v{i}.decision")
            outcome = F.when(before, "not_reached").when(d == "pass", "pass").when(d == "rescue", "rescue").otherwise("drop")
            reason = F.when(~before, F.col(f"_v{i}.reason"))
            dropped = before | ~d.isin("pass", "rescue")
        results.append(F.struct(F.lit(stage).alias("stage"), outcome.alias("outcome"), reason.alias("reason")))
    df = df.withColumn("stage_results", F.array(*results))
    first = F.expr("get(filter(stage_results, r -> r.outcome = 'drop'), 0)")
    return (
        df.withColumn("_first", first)
        .withColumn("final_status", F.when(F.col("_first").isNull(), "kept").otherwise("removed"))
        .withColumn("first_drop_stage", F.col("_first.stage"))
        .withColumn("first_drop_reason", F.col("_first.reason"))
        .drop("_v0", "_v1", "_v2", "_first")
    )


# -- streams against satellites ----------------------------------------------------------

_FOLD_SCHEMA = """image_id long, kind string, stream_idx long, sat_idx long, action string, overlap_px long,
    overlap_ratio_stream double, overlap_ratio_satellite double, stream_like boolean, satellite_compact boolean,
    y int, x0 int, x1 int"""


def _fold(limits: dict[str, float]):
    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["x1"].max()) + 1
        px, meta = {}, {}
        row = {c: pdf[c].to_numpy() for c in ("kind", "idx", "y", "x0", "x1", "area", "solidity", "aspect_sym_moment", "curvature_ratio")}
        for i in range(len(pdf)):
            key = row["kind"][i], row["idx"][i]
            px.setdefault(key, []).append(row["y"][i] * width + np.arange(row["x0"][i], row["x1"][i]))
            meta.setdefault(key, {c: row[c][i] for c in ("area", "solidity", "aspect_sym_moment", "curvature_ratio")})
        px = {k: np.concatenate(v) for k, v in px.items()}
        image, log, changed = pdf["image_id"].iloc[0], [], set()
        streams = sorted(i for k, i in px if k == "stream")
        sats = sorted(i for k, i in px if k == "sat")
        for s in streams:
            own, ms = px["stream", s], meta["stream", s]
            like_shape = ms["aspect_sym_moment"] >= limits["aspect"] or ms["curvature_ratio"] >= limits["curvature"]
            for t in sats:
                mine, mt = px["sat", t], meta["sat", t]
                shared = np.isin(mine, own, assume_unique=True)
                n = int(shared.sum())
                if n == 0:
                    continue
                sa, ta = max(int(ms["area"]), 1), max(int(mt["area"]), 1)
                like = bool(like_shape or sa >= ta * limits["ratio"])
                compact = bool(mt["solidity"] >= limits["solidity"] and mt["aspect_sym_moment"] <= limits["compact_aspect"])
                drop = (limits["stream_first"] and not like and compact
                        and n / sa >= limits["overlap"] and n / ta >= limits["overlap"])
                if drop:
                    action = "drop_stream"
                else:
                    px["sat", t] = mine[~shared]
                    changed.add(t)
                    action = "trim_satellite" if n < len(mine) else "drop_satellite"
                log.append((image, "action", s, t, action, n, round(n / sa, 4), round(n / ta, 4), like, compact, None, None, None))
                if drop:
                    break
        for t in sorted(changed):
            cells = np.sort(px["sat", t])
            if len(cells) == 0:
                continue
            cuts = np.flatnonzero((np.diff(cells) != 1) | (cells[1:] % width == 0)) + 1
            for part in np.split(cells, cuts):
                y, a = divmod(int(part[0]), width)
                log.append((image, "run", None, t, None, None, None, None, None, None, y, a, a + len(part)))
        names = [c.split()[0] for c in _FOLD_SCHEMA.replace("\n", " ").split(",")]
        out = pd.DataFrame(log, columns=names)
        for c in ("stream_idx", "sat_idx", "overlap_px", "y", "x0", "x1"):
            out[c] = out[c].astype("Int64")
        return out

    return job


def cross_type_conflict(
    streams: DataFrame, sats: DataFrame, policy: str = "stream_first", keep_stream_aspect_min: float = 1.9,
    keep_stream_curvature_min: float = 1.2, keep_stream_area_ratio: float = 1.5,
    drop_compact_stream_overlap: float = 0.75, satellite_solidity_min: float = 0.83, satellite_aspect_max: float = 1.75,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolve overlaps stream by stream: drop a compact stream, or cut it out of the satellite.

    ``streams`` and ``sats`` are run rows that carry area, solidity, aspect_sym_moment and
    curvature_ratio of their mask. Only masks that overlap another type take part; they are
    folded one image (or overlap component, if it is crowded) at a time, since later steps see trimmed masks. Returns stream
    runs, satellite runs and the action log.
    """
    pairs = match.pair_intersections(streams, sats, "stream_idx", "sat_idx")
    nodes = match.solve_groups(pairs.select("image_id", "stream_idx", "sat_idx"), "stream_idx", "sat_idx")
    cols = ["y", "x0", "x1", "area", "solidity", "aspect_sym_moment", "curvature_ratio"]

    def side(runs: DataFrame, kind: str, idx: str) -> DataFrame:
        member = nodes.select("image_id", F.col(idx).alias("idx"), "solve_key").distinct()
        ready = runs.select("image_id", F.col("inst_id").alias("idx"), *cols)
        for c, d in (("solidity", 1.0), ("aspect_sym_moment", 1.0), ("curvature_ratio", 1.0)):
            ready = ready.withColumn(c, F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, d).otherwise(F.col(c)))
        return ready.join(member, ["image_id", "idx"]).withColumn("kind", F.lit(kind))

    limits = {"stream_first": policy == "stream_first", "aspect": keep_stream_aspect_min, "curvature": keep_stream_curvature_min,
              "ratio": keep_stream_area_ratio, "overlap": drop_compact_stream_overlap, "solidity": satellite_solidity_min,
              "compact_aspect": satellite_aspect_max}
    work = side(streams, "stream", "stream_idx").unionByName(side(sats, "sat", "sat_idx"))
    from maskwright.session import cut

    log = cut(work.groupBy("solve_key").applyInPandas(_fold(limits), _FOLD_SCHEMA))
    actions = log.where("kind = 'action'").drop("kind", "y", "x0", "x1")
    gone = actions.where("action = 'drop_stream'").select("image_id", F.col("stream_idx").alias("inst_id")).distinct()
    touched = actions.where("action <> 'drop_stream'").select("image_id", F.col("sat_idx").alias("inst_id")).distinct()
    new_runs = log.where("kind = 'run'").select("image_id", F.col("sat_idx").alias("inst_id"), "y", "x0", "x1")
    keep = [*MASK, "y", "x0", "x1"]
    return (
        streams.select(*keep).join(gone, MASK, "left_anti"),
        sats.select(*keep).join(touched, MASK, "left_anti").unionByName(new_runs),
        actions,
    )
