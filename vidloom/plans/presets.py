"""Analysis settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Preset:
    """Parameters of an analysis; the defaults are those of the batch mode."""

    name: str = "custom"
    match_threshold: float = 0.65
    top_k: int = 10
    candidate_limit: int = 20
    skip_threshold: float = 0.90
    max_gap_sec: float = 5.0
    frame_step: int = 1
    input_size: int = 224
    window_size: float = 30.0
    min_segment_duration: float = 5.0
    min_segment_matches: int = 3
    offset_tolerance: float = 3.0
    early_stop: bool = True
    early_stop_margin: float = 0.04

    def clamped(self) -> Preset:
        """Within the ranges that the settings allow."""
        return replace(
            self, match_threshold=min(0.99, max(0.3, self.match_threshold)), candidate_limit=max(0, self.candidate_limit), frame_step=max(1, self.frame_step),
            min_segment_matches=max(1, self.min_segment_matches), offset_tolerance=max(1.0, self.offset_tolerance), top_k=max(1, self.top_k),
        )

    def signature(self) -> str:
        """Identifies the parameters under which a pair was compared, early stop included."""
        import hashlib
        import json

        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:20]


# The presets, fastest first.
PRESETS = {
    "ultra_fast": Preset("ultra_fast", match_threshold=0.58, top_k=1, candidate_limit=6, skip_threshold=0.6, max_gap_sec=45, frame_step=30, input_size=128, window_size=180, min_segment_duration=12, min_segment_matches=2, offset_tolerance=8),
    "fast": Preset("fast", match_threshold=0.6, top_k=2, candidate_limit=10, skip_threshold=0.7, max_gap_sec=30, frame_step=16, input_size=160, window_size=120, min_segment_duration=8, min_segment_matches=2, offset_tolerance=5),
    "normal": Preset("normal", match_threshold=0.64, top_k=5, candidate_limit=20, skip_threshold=0.82, max_gap_sec=18, frame_step=6, input_size=224, window_size=60, min_segment_duration=5, min_segment_matches=3, offset_tolerance=3),
    "precise": Preset("precise", match_threshold=0.68, top_k=10, candidate_limit=40, skip_threshold=0.92, max_gap_sec=8, frame_step=3, input_size=256, window_size=30, min_segment_duration=3, min_segment_matches=3, offset_tolerance=2),
    "perfect": Preset("perfect", match_threshold=0.72, top_k=24, candidate_limit=0, skip_threshold=0.98, max_gap_sec=3, frame_step=1, input_size=384, window_size=15, min_segment_duration=2, min_segment_matches=2, offset_tolerance=1),
}


def preset_from_row(row: dict) -> Preset:
    """A preset from a row of analysis_config."""
    return Preset(row["preset_name"], row["match_threshold"], row["top_k"], row["candidate_limit"], row["skip_threshold"], row["max_gap_sec"], row["frame_step"], window_size=float(row["window_size"]), offset_tolerance=row["offset_tolerance"])
