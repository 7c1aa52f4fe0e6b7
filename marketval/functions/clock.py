"""UTC instants shown in a market's own zone. The zone is a parameter, never the machine's."""

from pyspark.sql import Column, functions as F


def to_local(moment: Column, zone: Column | str) -> Column:
    return F.from_utc_timestamp(moment, zone)


def local_date(moment: Column, zone: Column | str) -> Column:
    return to_local(moment, zone).cast("date")


def local_stamp(moment: Column, zone: Column | str) -> Column:
    """'2026-09-04 10:30 PM', the hour without a leading zero."""
    return F.date_format(to_local(moment, zone), "yyyy-MM-dd h:mm a")
