"""Instants in UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_instant(as_of: dt.datetime | None = None) -> Column:
    """The load's timestamp: the current one, or a fixed one for repeatable loads.

    `as_of` without a zone is taken as UTC.
    """
    if as_of is None:
        return F.current_timestamp()
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    micros = (as_of - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def to_utc(wall_time: Column, zone: str) -> Column:
    """The UTC reading of a wall-clock time taken in `zone`."""
    return F.to_utc_timestamp(wall_time, zone)
