"""Event-stream frames: ``event:`` and ``data:`` lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(event: Column, data: Column) -> Column:
    """One frame; every line of the data gets its own data line."""
    body = F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")
    return F.concat(F.lit("event: "), event, F.lit("\n"), body, F.lit("\n\n"))


def decode(raw: Column) -> Column:
    """Struct of event (default ``message``), data and token (of JSON data); comment lines are skipped."""
    lines = F.split(raw, "\n")
    value = lambda line: F.regexp_replace(line, r"^[a-z]+: ?", "")
    event = F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit("event:"))), F.lit(-1))
    data = F.array_join(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), value), "\n")
    return F.struct(F.coalesce(value(event), F.lit("message")).alias("event"), data.alias("data"), F.get_json_object(data, "$.token").alias("token"))
