"""Times without a zone as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: Column) -> Column:
    """Microseconds since 1970 of the wall-clock reading, whatever the session time zone."""
    local = c.cast("timestamp_ntz")
    day = F.unix_date(local.cast("date")).cast("bigint") * 86400
    clock = F.hour(local) * 3600 + F.minute(local) * 60
    seconds = F.extract(F.lit("SECOND"), local)  # decimal with six places
    return (day + clock) * 1_000_000 + (seconds * 1_000_000).cast("bigint")
