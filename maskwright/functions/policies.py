"""Decision rules as column expressions. Each returns a struct (decision, reason[, target])."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, functions as F

# Class names, their category ids and the accepted spellings.
TIDAL, SATELLITES, INNER = "tidal_features", "satellites", "inner_galaxy"
CATEGORY_ID = {TIDAL: 1, SATELLITES: 2, INNER: 3}
LABEL_ALIASES = {
    "streams": TIDAL,
    "stellar stream": TIDAL,
    "stellar streams": TIDAL,
    "satellite galaxy": SATELLITES,
    "satellite galaxies": SATELLITES,
    TIDAL: TIDAL,
    SATELLITES: SATELLITES,
    INNER: INNER,
}
# Matching classes, accepted ones first.
TAXONOMY = ("compact_complete", "diffuse_core", "reject_unmatched", "reject_low_purity")
MATCHED = ("compact_complete", "diffuse_core")
UNMATCHED = ("reject_unmatched", "reject_low_purity")


def _verdict(decision: str, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def normalize_type_label(label: Column) -> Column:
    """Canonical class; an unknown spelling fails the job."""
    known = literal_map(LABEL_ALIASES)[label]
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown type_label: "), label)).cast("string"))


@dataclass(frozen=True)
class ScoreGate:
    small_area_max_px: int = 200
    medium_area_max_px: int = 600
    small_min_score: float = 0.60
    medium_min_score: float = 0.20
    large_min_score: float = 0.18
    version = "score_gate_v1_static"

    def decide(self, area: Column, score: Column) -> Column:
        def tier(name: str, least: float) -> Column:
            return F.when(score >= F.lit(least), _verdict("pass", f"pass_{name}")).otherwise(
                _verdict("drop", f"drop_{name}_score")
            )

        return (
            F.when(area < self.small_area_max_px, tier("small", self.small_min_score))
            .when(area < self.medium_area_max_px, tier("medium", self.medium_min_score))
            .otherwise(tier("large", self.large_min_score))
        )


@dataclass(frozen=True)
class PriorFilter:
    area_min: int = 30
    solidity_min: float = 0.83
    aspect_sym_max: float = 1.75
    hard_center_radius_frac: float | None = 0.03
    hard_center_action: str = "drop"  # or relabel_inner_galaxy

    @property
    def version(self) -> str:
        return "prior_v2_slim" if self.hard_center_radius_frac is None else "prior_v3_center_aware"

    def decide(self, area: Column, solidity: Column, aspect: Column, dist: Column,
               min_side: int) -> Column:
        def out(decision: str, reason: str, target: str | None = None) -> Column:
            return F.struct(
                F.lit(decision).alias("decision"),
                F.lit(reason).alias("reason"),
                F.lit(target).cast("string").alias("target"),
            )

        if self.hard_center_action not in ("drop", "relabel_inner_galaxy"):
            raise ValueError(self.hard_center_action)
        center = (
            out("relabel", "prior_hard_center", INNER)
            if self.hard_center_action == "relabel_inner_galaxy"
            else out("drop", "prior_hard_center")
        )
        in_center = (
            F.lit(False)
            if self.hard_center_radius_frac is None
            else dist / F.lit(float(min_side)) < F.lit(self.hard_center_radius_frac)
        )
        return (
            F.when(in_center, center)
            .when(area < self.area_min, out("drop", "prior_area_low"))
            .when(solidity < F.lit(self.solidity_min), out("drop", "prior_solidity"))
            .when(aspect > F.lit(self.aspect_sym_max), out("drop", "prior_aspect"))
            .otherwise(out("pass", "pass_prior_filter"))
        )


@dataclass(frozen=True)
class CorePolicy:
    hard_core_radius_frac: float = 0.03
    soft_core_radius_frac: float = 0.08
    rescue_area_min_px: int = 600
    rescue_solidity_min: float = 0.90
    rescue_aspect_max: float = 1.80
    rescue_score_min: float = 0.18
    version = "core_policy_v1_strict"

    def decide(self, dist: Column, area: Column, score: Column, solidity: Column,
               aspect: Column, min_side: int) -> Column:
        frac = F.coalesce(dist / F.lit(float(min_side)), F.lit(float("inf")))
        rescued = (
            (area >= self.rescue_area_min_px)
            & (score >= F.lit(self.rescue_score_min))
            & (F.coalesce(solidity, F.lit(0.0)) >= F.lit(self.rescue_solidity_min))
            & (F.coalesce(aspect, F.lit(0.0)) <= F.lit(self.rescue_aspect_max))
        )
        return (
            F.when(frac < F.lit(self.hard_core_radius_frac), _verdict("drop", "drop_hard_core"))
            .when(
                frac < F.lit(self.soft_core_radius_frac),
                F.when(rescued, _verdict("rescue", "rescue_soft_core")).otherwise(
                    _verdict("drop", "drop_soft_core")
                ),
            )
            .otherwise(_verdict("pass", "pass_outside_core"))
        )


@dataclass(frozen=True)
class StreamSanity:
    min_area: int = 50
    max_area_frac: float = 0.5
    edge_touch_frac: float = 0.8
    max_area_px: int | None = None

    def reason(self, area: Column, edge_ratio: Column, height: int, width: int) -> Column:
        """NULL when the mask is kept."""
        top = self.max_area_px if self.max_area_px is not None else int(self.max_area_frac * height * width)
        rule = F.when(area < self.min_area, F.lit("sanity_area_low")).when(
            area > top, F.lit("sanity_area_high")
        )
        if self.edge_touch_frac < 1.0:
            rule = rule.when(edge_ratio > F.lit(self.edge_touch_frac), F.lit("sanity_edge"))
        return rule


@dataclass(frozen=True)
class StreamConflict:
    rescue_overlap_ratio_satellite: float = 0.90
    rescue_area_min_px: int = 600
    rescue_solidity_min: float = 0.90
    rescue_aspect_max: float = 1.80
    version = "conflict_policy_v1_dr1"

    def decide(self, stream_id: Column, ratio: Column, area: Column, solidity: Column,
               aspect: Column) -> Column:
        compact = (F.coalesce(solidity, F.lit(0.0)) >= F.lit(self.rescue_solidity_min)) & (
            F.coalesce(aspect, F.lit(0.0)) <= F.lit(self.rescue_aspect_max)
        )
        wins = (
            (ratio >= F.lit(self.rescue_overlap_ratio_satellite))
            & (area >= self.rescue_area_min_px)
            & compact
        )
        return (
            F.when(stream_id.isNull(), _verdict("pass", "pass_no_stream_conflict"))
            .when(wins, _verdict("win", "satellite_wins"))
            .when(area < self.rescue_area_min_px, _verdict("drop", "area_under_600_swallowed_by_stream"))
            .when(~compact, _verdict("drop", "not_compact_enough_to_win"))
            .otherwise(_verdict("drop", "lost_to_stream_area_ge_600"))
        )


@dataclass(frozen=True)
class Taxonomy:
    """Thresholds of the prediction classes and of the image evidence."""

    min_purity_for_match: float = 0.50
    completeness_complete: float = 0.50
    complete_one_to_one_min_completeness: float = 0.95
    complete_one_to_one_max_seed_ratio: float = 3.0
    annulus_r_in_frac: float = 1.2
    annulus_r_out_frac: float = 2.0
    radial_n_rings: int = 6

    def classify(self, gt_id: Column, purity: Column, completeness: Column, ratio: Column,
                 one_to_one: Column) -> Column:
        def out(label: str, reason: str) -> Column:
            return F.struct(F.lit(label).alias("taxonomy_label"), F.lit(reason).alias("label_reason"))

        paired = (
            (completeness >= F.lit(self.complete_one_to_one_min_completeness))
            & one_to_one
            & (ratio <= F.lit(self.complete_one_to_one_max_seed_ratio))
        )
        return (
            F.when(gt_id.isNull(), out("reject_unmatched", "no_gt_overlap"))
            .when(paired, out("compact_complete", "one_to_one_complete_seed_ratio_ok"))
            .when(purity < F.lit(self.min_purity_for_match), out("reject_low_purity", "mixed_coverage"))
            .when(completeness >= F.lit(self.completeness_complete), out("compact_complete", "pure_and_complete"))
            .otherwise(out("diffuse_core", "pure_but_core_only"))
        )


def thresholds(policy) -> Column:
    """Threshold values of a policy as map<string,double>."""
    values = {k: v for k, v in asdict(policy).items() if isinstance(v, (int, float))}
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def in_roi(cx: Column, cy: Column, roi: tuple[int, int, int, int] | None) -> Column:
    """Centroid inside a half-open box (y0, x0, y1, x1); no box means inside, no centroid outside."""
    if roi is None:
        return F.lit(True)
    y0, x0, y1, x1 = (float(v) for v in roi)
    return F.coalesce((cy >= y0) & (cy < y1) & (cx >= x0) & (cx < x1), F.lit(False))


def official_scope(mode: Column) -> Column:
    """Scope whose numbers are the official ones for a benchmark mode."""
    return (
        F.when(mode == "fbox_gold_satellites", F.lit("roi"))
        .when(mode == "gt_canonical", F.lit("full_frame"))
        .otherwise(F.raise_error(F.concat(F.lit("no official scope for mode "), mode)).cast("string"))
    )
