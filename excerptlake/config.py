"""Parameters of scanning and matching, with the published defaults (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

VIDEO_SUFFIXES = (".avi", ".flv", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".ts", ".webm", ".wmv")
STAGES = ("inventory", "fingerprint", "match")
QUEUE_TABS = ("pending", "staged", "rejected")
PAGE_SIZE = 40
VARIANTS = ("normal", "cropped", "flipped")


@dataclass(frozen=True)
class MatchConfig:
    hash_threshold: int = 8
    color_threshold: float = 0.25
    min_ratio: float = 0.02
    max_ratio: float = 0.95
    top_n: int = 5
    min_visual_score: float = 0.15
    min_matched_scenes: int = 3
    min_scene_duration: float = 5.0
    min_match_spread: float = 2.0
    min_candidate_match_spread: float = 2.0
    visual_weight: float = 0.65
    audio_weight: float = 0.35


@dataclass(frozen=True)
class FingerprintConfig:
    scene_threshold: float = 0.3
    top_margin: float = 0.12
    bottom_margin: float = 0.12
    side_margin: float = 0.06
    max_scenes: int = 60
    blank_std_threshold: float = 4.0
    hwaccel: str = "none"
    extract_max_dim: int = 1920
    force_vaapi_above_max_dim: bool = True


def validate_scan(stages, roots, allowed_roots, hwaccel: str, workers: int, max_workers: int) -> list[str]:
    """Problems of a scan request; an empty list lets it start."""
    problems = [f"unknown stage {s}" for s in stages if s not in STAGES]
    if not stages:
        problems.append("no stage chosen")
    problems += [f"root not allowed: {r}" for r in roots if r not in set(allowed_roots)]
    if hwaccel not in ("none", "vaapi"):
        problems.append(f"unknown hwaccel {hwaccel}")
    if isinstance(workers, bool) or not isinstance(workers, int) or not 2 <= workers <= max_workers:
        problems.append(f"workers must be from 2 to {max_workers}")
    return problems


def chosen_stages(wanted) -> list[str]:
    """The wanted stages in their fixed order."""
    return [s for s in STAGES if s in set(wanted)]


def stages_from(stages: list[str], start: str | None) -> list[str]:
    """The stages from start on; all of them if start is none of them."""
    return stages[stages.index(start) :] if start in stages else stages
