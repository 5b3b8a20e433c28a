"""Declarative description of a fact table, its analysis windows and the detection thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class FactSpec:
    """Column roles of a fact table. Every metric and detection operator reads columns only through this."""

    id: str = "txn_id"
    time: str = "ts"
    amount: str = "amount"
    outcome: str = "status"
    failed_value: str = "FAILED"
    latency: str = "latency_ms"
    code: str = "response_code"
    simulated: str | None = None
    dims: tuple[str, ...] = ("gateway", "sender_bank", "payment_method", "region", "device", "network")
    intersections: tuple[tuple[str, ...], ...] = (
        ("gateway", "sender_bank"),
        ("gateway", "payment_method"),
        ("gateway", "sender_bank", "payment_method"),
    )
    source_dim: str = "gateway"
    timeout_codes: tuple[str, ...] = ("TIMEOUT",)
    infrastructure_codes: tuple[str, ...] = ("PROCESSING_ERROR", "TIMEOUT")

    @property
    def dimension_sets(self) -> tuple[tuple[str, ...], ...]:
        """The scanned sets: every single dimension plus the named intersections, never the power set."""
        return tuple((d,) for d in self.dims) + self.intersections

    def check_dimensions(self, names) -> None:
        unknown = [n for n in names if n not in self.dims]
        if unknown:
            raise ValueError(f"unknown cohort dimension(s): {unknown}")


@dataclass(frozen=True)
class Windows:
    """Half-open windows. Baseline runs up to the current window; prior is its last, equally long stretch."""

    current_start: datetime
    current_end: datetime
    baseline_start: datetime | None = None

    def __post_init__(self):
        if self.current_end <= self.current_start:
            raise ValueError("the current window is empty")

    @property
    def prior_start(self) -> datetime:
        return self.current_start - (self.current_end - self.current_start)


@dataclass(frozen=True)
class DetectionConfig:
    """Thresholds a cohort must clear, in the order they are applied."""

    min_cohort_size: int = 100
    min_baseline_size: int = 300
    min_absolute_delta: float = 0.02
    min_sigma: float = 3.0
    suppression_margin: float = 2.0
