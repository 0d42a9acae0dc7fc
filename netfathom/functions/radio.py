"""Scalar rules on radio, registration and probe columns. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: clamps of plausible readings, thresholds of bars, bins of latencies
RANGES = {"rsrp": (-140, -43), "rsrq": (-34, 3), "rssnr": (-20, 30)}
BARS = (-128, -118, -108, -98)


def carrier_bars(rsrp: Column) -> Column:
    """Thresholds reached; 0 for null."""
    return sum((F.when(rsrp >= t, 1).otherwise(0) for t in BARS), F.lit(0))


def latency_bin(ms: Column) -> Column:
    """Steps of 10 ms below 1 s and of 100 ms below 10 s; then 10 000."""
    return F.when(ms < 1000, ms - ms % 10).when(ms < 10000, ms - ms % 100).otherwise(10000)


def enb(rat: Column, ci: Column) -> Column:
    """The mast of an LTE cell identity of 28 bits."""
    return F.when((rat == "LTE") & ci.between(0, (1 << 28) - 1), F.shiftright(ci, 8))


def sector(rat: Column, ci: Column) -> Column:
    return F.when((rat == "LTE") & ci.between(0, (1 << 28) - 1), ci.bitwiseAND(255))


def band_label(rat: Column, band: Column) -> Column:
    """B40 for LTE, n40 for NR, else 'band 40'."""
    return F.when(band.isNull(), None).when(rat == "LTE", F.concat(F.lit("B"), band)).when(rat == "NR", F.concat(F.lit("n"), band)).otherwise(F.concat(F.lit("band "), band))


def share_label(rat: Column, band: Column) -> Column:
    return F.when((rat == "LTE") | (rat == "NR"), band_label(rat, band)).otherwise(F.concat(F.lit("?"), band))


def normalise_plmn(plmn: Column) -> Column:
    """mcc-mnc without leading zeros of the mnc, of which one digit stays; null for anything else."""
    return F.when(F.size(F.split(plmn, "-")) == 2, F.regexp_replace(plmn, r"-0+(?=[^-])", "-"))


def normalise_error(code: Column) -> Column:
    """The text before the first colon, trimmed; 'unspecified' if there is none."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(code, ":", 1)), F.lit("")), F.lit("unspecified"))


def clamp_flag(value: Column, name: str) -> Column:
    """Whether a reading lies outside of its plausible range; false for null."""
    lo, hi = RANGES[name]
    return F.coalesce(~value.between(lo, hi), F.lit(False))


def speed_window_ms(speed: Column) -> Column:
    """How long a fix may stand for a place: 50 m at its speed, within 10 to 120 s."""
    moving = F.least(F.lit(120000), F.greatest(F.lit(10000), (F.lit(50000.0) / speed).cast("long")))
    return F.when(speed.isNull() | F.isnan(speed) | (speed < 0), 10000).when(speed == 0, 120000).otherwise(moving)
