"""Tunable settings. Every default is a production default of the monitored workload."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectionConfig:
    """Thresholds of the detectors; frame lengths are counted in rollup buckets."""

    bucket_seconds: int = 60
    baseline_buckets: int = 60
    min_baseline_buckets: int = 30
    window_buckets: int = 5
    gap_buckets: int = 1
    sd_multiplier: float = 3.0
    min_errors_per_bucket: float = 2.0
    latency_ratio: float = 3.0
    min_latency_ms: float = 200.0
    min_occurrences: int = 3
    silence_min_minutes: int = 5
    silence_min_lines_per_minute: float = 5.0
    silence_baseline_minutes: int = 60
    silence_lookback_minutes: int = 180
    merge_gap_minutes: int = 10

    @property
    def window_seconds(self) -> int:
        return self.window_buckets * self.bucket_seconds

    @property
    def baseline_offset_seconds(self) -> int:
        """Distance from a window's start back to the end of its baseline."""
        return self.gap_buckets * self.bucket_seconds

    @property
    def baseline_seconds(self) -> int:
        return self.baseline_buckets * self.bucket_seconds

    @property
    def reach_seconds(self) -> int:
        """How far before an end point any frame looks."""
        return self.window_seconds + self.baseline_offset_seconds + self.baseline_seconds


@dataclass(frozen=True)
class PacketBudget:
    """Size limits of the classification packet."""

    signatures: int = 8
    endpoints: int = 6
    timeline_buckets: int = 20
    error_lines: int = 15
    healthy_lines: int = 8
    message_chars: int = 240


@dataclass(frozen=True)
class CommitBudget:
    """Size limits of the correlation packet and of the candidate search."""

    lookback_hours: int = 48
    commits: int = 25
    files_per_commit: int = 12
    body_chars: int = 400
    subject_chars: int = 200
    example_chars: int = 300
    diff_lines_per_commit: int = 40
    diff_lines_total: int = 300


@dataclass(frozen=True)
class AlertPolicy:
    min_severity: str = "high"
    max_age_minutes: int = 360
    max_attempts: int = 3


@dataclass(frozen=True)
class RetentionPolicy:
    """Days to keep; 0 keeps everything."""

    log_days: float = 14
    rollup_days: float = 90
