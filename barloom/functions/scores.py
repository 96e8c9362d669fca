"""Composite scores of a running episode, for columns and for arrays alike."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

# What the wave score reads, and the weights, centres and widths of both scores.
WAVE_PARTS = ("participation", "taker_slope", "win_prob", "trend")


def wave_score(v: Mapping[str, Any], fall: Any, clip: Callable) -> Any:
    """Strength of the move from 0 to 100; ``fall`` is the drawdown in units of its scale, ``clip`` cuts to [0, 1]."""
    return 100.0 * (
        0.28 * clip((v["participation"] - 45.0) / 45.0) + 0.22 * clip((v["taker_slope"] + 0.02) / 0.10)
        + 0.18 * clip((v["win_prob"] - 0.35) / 0.35) + 0.18 * clip((v["trend"] + 0.15) / 0.60) + 0.14 * (1.0 - clip(fall)))


def top_score(runup: Any, fall: Any, volume_lost: Any, quote_lost: Any, exhaustion: Any, since_peak: Any, clip: Callable) -> Any:
    """Risk that the top is in, from 0 to 100."""
    return 100.0 * (
        0.22 * clip((runup - 1.5) / 3.0) + 0.20 * clip(fall) + 0.18 * clip(volume_lost) + 0.14 * clip(quote_lost / 0.10)
        + 0.14 * clip((exhaustion - 45.0) / 55.0) + 0.12 * clip(since_peak / 6.0))
