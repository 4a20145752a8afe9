"""Tunables of the analytics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000


@dataclass(frozen=True)
class Config:
    # Defaults of the analytics' semantics.
    tz_offset_secs: int = 0
    conversation_timeout_ms: int = 4 * HOUR
    big_moment_static: int = 20
    big_moment_percentile: int = 90
    big_moment_floor: int = 10
    reconnect_ms: tuple[int, int, int] = (1 * DAY, 7 * DAY, 30 * DAY)
    reconnect_median_factor: float = 3.0
    rapid_response_ms: int = 60 * SECOND
    overnight_hours: tuple[int, int] = (23, 7)
    overnight_force_gap_ms: int = 8 * HOUR
    overnight_evening_gap_ms: int = 4 * HOUR
    max_response_gap_ms: int = 24 * HOUR
    histogram_edges_ms: tuple[int, ...] = (30 * SECOND, MINUTE, 5 * MINUTE, 15 * MINUTE, HOUR, 6 * HOUR, DAY)
    top_emojis: int = 10
    phrase_min_token_bytes: int = 3
    phrase_min_count: int = 3
    recurring_top: int = 20
    distinctive_top: int = 30
    # points: text and event weights, then one weight for each kind of attachment
    base_point: float = 1.0
    word_log_weight: float = 0.1
    emoji_weight: float = 0.2
    question_weight: float = 0.5
    apology_weight: float = 2.0
    encouragement_weight: float = 3.0
    link_weight: float = 2.0
    starter_weight: float = 5.0
    rapid_weight: float = 2.0
    image_weight: float = 3.0
    video_weight: float = 5.0
    audio_weight: float = 4.0
    gif_weight: float = 2.0
    # rating
    rating_weights: tuple[float, ...] = (0.20, 0.15, 0.15, 0.15, 0.10, 0.10, 0.15)
    # insights
    insight_samples: tuple[int, int, int] = (50, 100, 500)
    insight_max_per_category: int = 100
    insight_ratios: tuple[float, float, float, float] = (1.2, 1.5, 2.0, 3.0)


DEFAULT = Config()
