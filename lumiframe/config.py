"""Parameters of the frame operators. A fixed default per field; operators take a config and never change it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Fixed values of the scan, the filters, the scores and the artefacts.
    ema_alpha: float = 0.4
    sample_interval_sec: float = 3.0
    motion_threshold: float = 0.3
    motion_tiers: tuple[float, ...] = (0.3, 0.6, 1.0)
    min_brightness: float = 10.0
    min_contrast: float = 5.0
    min_face_size: float = 30.0
    min_face_ratio: float = 0.1
    min_confidence: float = 0.97
    max_confidence: float = 0.99
    keep_score: float = 0.5
    stop_score: float = 1.5
    search_all: bool = False
    detector_score: float = 0.9
    nms_iou: float = 0.4
    nms_top_k: int = 5000
    nms_keep: int = 750
    detector_side: float = 1000.0
    legacy_confidence_scaling: bool = False
    prior_variances: tuple[float, float] = (0.1, 0.2)
    prior_strides: tuple[int, ...] = (8, 16, 32)
    prior_sizes: tuple[tuple[int, ...], ...] = ((16, 32), (64, 128), (256, 512))
    animation_sec: float = 3.0
    preview_padding_sec: float = 0.5
    preview_max_sec: float = 1.0
    preview_frames: int = 30
    split_min_duration_sec: float = 60.0
    video_extensions: tuple[str, ...] = ("mp4", "avi", "mov", "mkv", "wmv", "flv", "webm")
    score_chain: tuple[str, ...] = ("BasicFilter", "GeometryFilter")
    frame_chain: tuple[str, ...] = ("QualityFilter",)


DEFAULT = EngineConfig()
