"""Validated settings. Every operator takes one of these; the defaults are fixed values
that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class SizeLimits:
    """Group sizes up to which one task may hold a group; larger groups take the spread form."""

    window_rows: int = 4_000_000
    fold_rows: int = 2_000
    join_rows: int = 5_000
    percentile_rows: int = 2_000_000
    dimension_rows: int = 100_000

    def __post_init__(self) -> None:
        _require(
            min(self.window_rows, self.fold_rows, self.join_rows, self.percentile_rows, self.dimension_rows) > 0,
            "size limits must be positive",
        )


LIMITS = SizeLimits()


@dataclass(frozen=True)
class DetectionPolicy:
    min_confidence: float = 0.25
    max_frame_gap: int = 1
    warmup_frames: int = 1

    def __post_init__(self) -> None:
        _require(0 <= self.min_confidence <= 1, "min_confidence must be within [0, 1]")
        _require(self.max_frame_gap >= 1 and self.warmup_frames >= 0, "frame settings out of range")


@dataclass(frozen=True)
class LandingPolicy:
    edge_margin_px: float = 2.0
    edge_margin_ratio: float = 0.001
    min_intersection_pixels: float = 16.0
    occupancy_ratio: float = 0.01
    use_center_check: bool = True
    use_bottom_center_check: bool = True
    min_area_pixels: float = 64.0

    def __post_init__(self) -> None:
        _require(self.edge_margin_px >= 0 and self.edge_margin_ratio >= 0, "margins must not be negative")
        _require(0 <= self.occupancy_ratio <= 1, "occupancy_ratio must be within [0, 1]")
        _require(self.min_area_pixels > 0, "min_area_pixels must be positive")


@dataclass(frozen=True)
class FlowPolicy:
    threshold_px: float = 2.0
    residual_threshold_px: float = 2.0
    min_valid_pixels: int = 25
    inner_crop_ratio: float = 0.15
    ring_expansion_ratio: float = 0.50
    min_background_pixels: int = 100
    min_valid_ratio: float = 0.50
    local_stationary_px: float = 2.0
    local_moving_px: float = 6.0

    def __post_init__(self) -> None:
        _require(0 <= self.inner_crop_ratio < 0.5, "inner_crop_ratio must be within [0, 0.5)")
        _require(self.local_stationary_px < self.local_moving_px, "stationary must be below moving")


@dataclass(frozen=True)
class ScenePolicy:
    background_median_max: float = 2.0
    background_p90_max: float = 5.0
    grid_spread_max: float = 3.0
    min_valid_background_ratio: float = 0.20
    grid_rows: int = 4
    grid_columns: int = 4


@dataclass(frozen=True)
class BoxMotionPolicy:
    match_min_iou: float = 0.10
    match_max_center_distance_ratio: float = 1.5
    match_min_score: float = 0.25
    stationary_threshold_px: float = 3.0
    moving_threshold_px: float = 8.0
    min_size_ratio: float = 0.5
    max_size_ratio: float = 2.0
    min_visible_ratio: float = 0.75

    def __post_init__(self) -> None:
        _require(self.stationary_threshold_px < self.moving_threshold_px, "stationary must be below moving")
        _require(0 < self.min_size_ratio <= self.max_size_ratio, "size ratios must be ordered")


@dataclass(frozen=True)
class HybridPolicy:
    strong_moving_residual_px: float = 8.0
    min_association_score: float = 0.35
    min_iou: float = 0.20


@dataclass(frozen=True)
class HomographyGate:
    name: str = "fixed"
    mode: str = "fixed"
    fixed_min_inlier_ratio: float = 0.5
    high_inlier_ratio: float = 0.50
    low_inlier_ratio: float = 0.35
    min_matches: int = 40
    min_inliers: int = 20
    max_condition_number: float = 1e5
    max_reprojection_error_px: float = 3.0
    min_spatial_coverage: float = 0.08
    min_projected_overlap_ratio: float = 0.50

    def __post_init__(self) -> None:
        _require(self.mode in {"fixed", "adaptive"}, "mode must be fixed or adaptive")
        _require(self.low_inlier_ratio <= self.high_inlier_ratio, "inlier ratios must be ordered")


@dataclass(frozen=True)
class CameraModel:
    width: int = 1920
    height: int = 1080
    fx: float = 1389.7
    fy: float = 1387.1
    cx: float = 954.007
    cy: float = 558.896


@dataclass(frozen=True)
class MotionFitPolicy:
    min_features: int = 12
    min_inliers: int = 8
    min_inlier_ratio: float = 0.5
    residual_threshold_px: float = 2.0
    fb_error_px: float = 1.0
    hypotheses: int = 200

    def __post_init__(self) -> None:
        _require(self.hypotheses >= 1 and self.min_features >= 3, "fit settings out of range")


@dataclass(frozen=True)
class CalibrationPolicy:
    min_samples: int = 8
    max_samples: int = 450
    min_camera_step_px: float = 1.0
    min_gps_step: float = 0.02
    max_rms_residual: float = 0.5
    min_inlier_ratio: float = 0.7
    min_directional_diversity: float = 0.1
    scale_min: float = 1e-6
    scale_max: float = 10.0
    outlier_mad_factor: float = 3.5
    allow_reflection: bool = False

    def __post_init__(self) -> None:
        _require(2 <= self.min_samples <= self.max_samples, "sample limits must be ordered")
        _require(0 < self.scale_min <= self.scale_max, "scale limits must be ordered")


@dataclass(frozen=True)
class NavigationPolicy:
    max_frame_gap: int = 1
    warmup_frames: int = 1
    max_delta_per_frame: float = 5.0
    z_policy: str = "hold_last_valid_z"
    recovery_min_healthy_frames: int = 1

    def __post_init__(self) -> None:
        _require(
            self.z_policy in {"hold_last_valid_z", "zero_delta_from_anchor", "return_none_if_schema_allows"},
            "unknown z_policy",
        )


@dataclass(frozen=True)
class MatchingPolicy:
    min_similarity: float = 0.45
    min_correspondences: int = 6
    max_correspondences: int = 512
    dedup_radius_px: float = 4.0
    min_inliers: int = 6
    min_inlier_ratio: float = 0.35
    max_rms: float = 8.0
    min_polygon_area: float = 64.0
    max_frame_ratio: float = 0.75
    min_visible_ratio: float = 0.25
    min_edge_px: float = 4.0
    max_aspect: float = 10.0
    max_distortion: float = 8.0
    box_min_width: float = 4.0
    box_min_height: float = 4.0
    box_min_area: float = 64.0
    box_max_frame_ratio: float = 0.75
    min_confidence: float = 0.35
    weight_inlier: float = 0.30
    weight_similarity: float = 0.25
    weight_reprojection: float = 0.15
    weight_visibility: float = 0.15
    weight_coverage: float = 0.15

    def __post_init__(self) -> None:
        weights = (
            self.weight_inlier, self.weight_similarity, self.weight_reprojection,
            self.weight_visibility, self.weight_coverage,
        )
        _require(min(weights) >= 0 and sum(weights) > 0, "confidence weights must be positive")
        _require(self.min_correspondences <= self.max_correspondences, "correspondence limits must be ordered")
