"""Thresholds and shapes of the curation and training feed. Every operator takes them as arguments or as this object."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Thresholds:
    """Admission limits; values exactly on a limit pass. ``overlay`` reads a second file on top, key by key."""

    max_cer: float = 0.02
    min_snr_db: float = 20.0
    min_dnsmos: float = 3.0
    max_clipping: float = 0.001
    min_seconds: float = 2.0
    max_seconds: float = 13.0
    min_sample_rate: int = 22_050
    frames_per_second: float = 50.0
    max_frames: int = 1_520
    allow_multi_speaker: bool = False
    tiers: tuple[str, ...] = ("A", "B")
    min_utterances: int = 2
    ref_min_seconds: float = 3.0
    ref_max_seconds: float = 15.0
    num_refs: int = 3
    val_ratio: float = 0.02
    seed: int = 42

    def overlay(self, values: dict) -> "Thresholds":
        known = {f.name for f in dataclasses.fields(self)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown thresholds: {sorted(unknown)}")
        return dataclasses.replace(self, **values)


PACKAGED = Thresholds(min_seconds=1.0, max_seconds=30.0)  # the packaged corpus was filtered by quality before


def load_config(*paths: str) -> dict:
    """Key-value configuration from JSON or, where PyYAML is there, YAML files; later files overlay earlier ones (shallow)."""
    out: dict = {}
    for path in paths:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError(f"PyYAML is needed to read {path}") from e
            out.update(yaml.safe_load(text) or {})
        else:
            out.update(json.loads(text))
    return out
