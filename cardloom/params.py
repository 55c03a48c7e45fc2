"""Thresholds of the card pipeline, passed to operators as plain values (fixed values of the data contract)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Segmentation:
    """Hysteresis over motion. ``enter`` must be above ``exit``."""

    enter: float = 12.0
    enter_frames: int = 2
    exit: float = 6.0
    exit_frames: int = 5
    min_frames: int = 10
    low_confidence_frames: int = 12
    candidate_motion: float = 6.0
    fallback_weight: float = 4.0
    blur: float = 50.0
    duplicate_distance: int = 6

    def __post_init__(self) -> None:
        if self.enter <= self.exit:
            raise ValueError("enter must be greater than exit")


@dataclass(frozen=True)
class Backstop:
    """Split of long windows in which the picture changed without motion."""

    start: int = 18
    interval: int = 6
    cell_change: float = 8.0
    cells: int = 2
    checks: int = 2
    seed: int = 6
    grid: int = 16


@dataclass(frozen=True)
class Review:
    auto_approve: float = 0.85
    review: float = 0.70
    page_size: int = 50

    def __post_init__(self) -> None:
        for name in ("auto_approve", "review"):
            if not 0.0 <= getattr(self, name) <= 1.0:  # also false for what is no number
                raise ValueError(f"{name} must be from 0 to 1")

    def updated(self, **changes: float) -> Review:
        """These thresholds with some changed, checked."""
        return replace(self, **changes)


#: The structured fields of a card, in canonical order (fixed values).
FIELDS = (
    "deceased_name", "address", "owner", "relation", "phone", "date_of_death", "date_of_burial", "description", "sex", "age",
    "grave_type", "grave_fee", "undertaker", "board_of_health_no", "svc_no",
)
#: Older names of fields (fixed values).
ALIASES = {"owner_name": "deceased_name", "owner_address": "address", "type_of_grave": "grave_type"}
