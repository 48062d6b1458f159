"""Post-processing layers of stored predictions: which masks survive a policy configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from maskwright.functions.policies import CorePolicy, PriorFilter, ScoreGate, StreamSanity
from maskwright.operators import match, score, shape
from maskwright.plans.history import cross_type_conflict


@dataclass(frozen=True)
class PostConfig:
    """Stages of the prediction-only layer; None switches a stage off."""

    sanity: StreamSanity | None = StreamSanity()
    gate: ScoreGate | None = ScoreGate()
    prior: PriorFilter | None = PriorFilter()
    core: CorePolicy | None = CorePolicy()
    conflict: dict | None = field(default_factory=dict)


def satellite_keep(cfg: PostConfig, side: int, with_gate: bool = True) -> Column:
    """Whether a satellite passes the enabled scalar stages."""
    area, sc = F.coalesce("area", F.lit(0)), F.coalesce("score", F.lit(0.0))
    sol, asp, dist = F.col("solidity"), F.col("aspect_sym_moment"), F.col("dist_to_center")
    keep = F.lit(True)
    if cfg.gate is not None and with_gate:
        keep = keep & (cfg.gate.decide(area, sc)["decision"] == "pass")
    if cfg.prior is not None:
        keep = keep & (cfg.prior.decide(area, sol, asp, dist, side)["decision"] == "pass")
    if cfg.core is not None:
        keep = keep & cfg.core.decide(dist, area, sc, sol, asp, side)["decision"].isin("pass", "rescue")
    return keep


def post_pred_only(masks: DataFrame, runs: DataFrame, cfg: PostConfig, height: int, width: int,
                   stream_label: str = "streams") -> tuple[DataFrame, DataFrame | None]:
    """Runs of the surviving masks with their type, and the conflict log.

    ``masks`` has one row per mask with its shape figures; ``runs`` image_id, inst_id, y, x0, x1.
    """
    streams = masks.where(F.col("type_label") == stream_label)
    sats = masks.where(F.col("type_label") == "satellites")
    if cfg.sanity is not None:
        stream_runs = runs.join(streams.select("image_id", "inst_id"), ["image_id", "inst_id"], "left_semi")
        edge = shape.edge_touch_ratio(stream_runs, height, width).select("image_id", "inst_id", "edge_ratio")
        streams = streams.join(edge, ["image_id", "inst_id"], "left")
        streams = streams.where(cfg.sanity.reason(F.col("area"), F.coalesce("edge_ratio", F.lit(0.0)), height, width).isNull())
    sats = sats.where(satellite_keep(cfg, min(height, width)))
    cols = ["image_id", "inst_id", "area", "solidity", "aspect_sym_moment", "curvature_ratio"]
    only = runs.select("image_id", "inst_id", "y", "x0", "x1")
    sr, tr = only.join(streams.select(*cols), ["image_id", "inst_id"]), only.join(sats.select(*cols), ["image_id", "inst_id"])
    log = None
    if cfg.conflict is not None:
        sr, tr, log = cross_type_conflict(sr, tr, **cfg.conflict)
    keep = ["image_id", "inst_id", "y", "x0", "x1"]
    out = sr.select(*keep).withColumn("type_label", F.lit(stream_label)).unionByName(
        tr.select(*keep).withColumn("type_label", F.lit("satellites")))
    return out, log


def policy_sweep(primary: DataFrame, num_gt: DataFrame, cfg: PostConfig, taxonomy, side: int, roi,
                 taus: tuple[float, ...] = score.SWEEP) -> DataFrame:
    """Pooled scores at each swept gate value, full frame and inside the ROI.

    ``primary``: primary match of every raw satellite with its shape figures and ``raw_index``.
    Everything that does not depend on the score is decided once; a candidate is then
    repeated only for the gate values it passes, and the one-to-one winner found per value.
    """
    base = primary.where(satellite_keep(cfg, side, with_gate=False))
    values = F.array(*[F.lit(t) for t in taus])
    at = base.withColumn("tau", F.explode(F.filter(values, lambda t: F.col("score") >= t)))
    one = match.cover_ratios(match.one_to_one_flags(at, "raw_index", ("tau",)))
    label = taxonomy.classify(F.col("matched_gt_id"), F.col("purity"), F.col("completeness"),
                              F.col("seed_gt_ratio"), F.col("is_one_to_one"))["taxonomy_label"]
    from maskwright.functions.policies import MATCHED, in_roi

    rows = one.select("tau", "image_id", "matched_gt_id", label.isin(*MATCHED).alias("_ok"),
                      in_roi(F.col("cx"), F.col("cy"), roi).alias("_roi"))
    rows = rows.withColumn("scope", F.explode(F.when(F.col("_roi"), F.array(F.lit("full_frame"), F.lit("roi"))).otherwise(F.array(F.lit("full_frame")))))
    # First per ground truth, so that the distinct count is a plain sum afterwards.
    per_gt = rows.groupBy("tau", "scope", "image_id", "matched_gt_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("ok"))
    sums = per_gt.groupBy("tau", "scope").agg(
        F.sum("n").alias("num_pred"), F.sum("ok").alias("matched"),
        F.count_if((F.col("ok") > 0) & F.col("matched_gt_id").isNotNull()).alias("unique_gt_covered"))
    frame = num_gt.agg(F.sum("num_gt").alias("full_frame"), F.sum("num_gt_roi").alias("roi")).select(
        F.expr("stack(2, 'full_frame', full_frame, 'roi', roi) as (scope, num_gt)")).withColumn("tau", F.explode(values))
    out = frame.join(F.broadcast(sums), ["tau", "scope"], "left").na.fill(0)
    p, r = F.try_divide("matched", "num_pred"), F.try_divide("unique_gt_covered", "num_gt")
    return out.select(
        F.col("tau").alias("threshold"), "scope", p.alias("precision"), r.alias("recall"), score.f1(p, r).alias("f1"),
        "matched", (F.col("num_pred") - F.col("matched")).alias("unmatched"), "unique_gt_covered", "num_gt", "num_pred")


def sweep_picks(rows: DataFrame, minimum: float = 0.90) -> DataFrame:
    """Per scope: step area, best F1 setting, and how many settings reach both minima."""
    auc = score.step_auc(rows, ["scope"])
    ok = (F.col("precision") >= F.lit(minimum)) & (F.col("recall") >= F.lit(minimum))
    best = rows.groupBy("scope").agg(
        F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.when(F.col("f1").isNotNull(), F.struct("f1", -F.col("threshold")))).alias("b"),
        F.count_if(ok).alias("n_feasible"), F.min(F.when(ok, F.col("threshold"))).alias("feasible_lowest"),
        F.max(F.when(ok, F.col("threshold"))).alias("feasible_highest"))
    return best.join(auc, "scope", "left").select(
        "scope", "auc_pr", F.col("b.threshold").alias("best_threshold"), F.col("b.precision").alias("best_precision"),
        F.col("b.recall").alias("best_recall"), F.col("b.f1").alias("best_f1"), "n_feasible", "feasible_lowest", "feasible_highest")
