"""Thresholds and years, with the usual values as defaults. Nothing in the operators is hard-wired."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    years: tuple[int, int, int] = (2022, 2023, 2024)
    annual_cap: float = 75_000.0
    near_cap_share: float = 0.80
    meal_limit: float = 100.0
    speaker_fee_ceiling: float = 3_500.0
    venue_ceiling: float = 3_000.0
    total_ceiling: float = 8_000.0
    cost_per_head: float = 100.0
    min_attendees: int = 3
    min_signed: float = 0.80
    rapid_days: int = 30
    repeat_events: int = 3
    high_repeat_events: int = 6
    min_peers: int = 10
    fmv_rate: float = 0.95
    interaction_meal_limits: tuple[tuple[str, float], ...] = (("breakfast", 25.0), ("lunch", 50.0), ("dinner", 100.0))
    other_meal_limit: float = 125.0
    weekly_interactions: int = 3
    vague_texts: tuple[str, ...] = ("", "Meeting", "Other")
    recipient_types: tuple[str, ...] = ("Covered Recipient Physician", "Covered Recipient Non-Physician Practitioner")
    meal_nature: str = "Food and Beverage"
    consulting_nature: str = "Consulting Fee"
    speaking_patterns: tuple[str, ...] = ("speaker", "faculty")

    @property
    def near_cap(self) -> float:
        return self.annual_cap * self.near_cap_share
