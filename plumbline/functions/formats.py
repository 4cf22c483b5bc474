"""Number formats of the report sinks. They round the exact binary value half to even, which Spark's format_string does not."""

from __future__ import annotations


def mean_std(mean: float, std: float | None) -> str:
    return f"{mean:.6f}" if std is None else f"{mean:.6f}+/-{std:.6f}"


def delta(x: float) -> str:
    return f"{x:+.6f}"


def relative(percent: float | None) -> str:
    return "ref=0, ratio undefined" if percent is None else f"{percent:+.2f}%"
