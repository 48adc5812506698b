"""Phase arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def wrapped(x, period) -> Column:
    """``x`` reduced to [0, period)."""
    x, period = _col(x), _col(period)
    return x - F.floor(x / period) * period


def phase_distance(t, period, epoch) -> Column:
    """Signed distance in days to the nearest event centre, in [-P/2, P/2)."""
    t, period, epoch = _col(t), _col(period), _col(epoch)
    return wrapped(t - epoch + period / 2, period) - period / 2


def phase_fold(t, reference, period) -> Column:
    """Phase in [0, 1)."""
    t, reference, period = _col(t), _col(reference), _col(period)
    turns = (t - reference) / period
    phase = turns - F.floor(turns)
    return F.when(phase >= 1, F.lit(0.0)).otherwise(phase)


def cycle(t, period, epoch) -> Column:
    """Nearest cycle number, halves up."""
    t, period, epoch = _col(t), _col(period), _col(epoch)
    return F.floor((t - epoch) / period + 0.5).cast("bigint")


def in_window(t, period, epoch, duration) -> Column:
    """Strictly inside half a duration (days) of an event centre."""
    return F.abs(phase_distance(t, period, epoch)) < _col(duration) / 2


def box_factor(t, period, epoch, duration, depth) -> Column:
    """1 - depth inside the window, 1 outside."""
    return F.when(in_window(t, period, epoch, duration), 1 - _col(depth)).otherwise(F.lit(1.0))
