"""Severities by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numbers that log libraries give to severity names.
LEVELS = {"trace": 10, "debug": 20, "info": 30, "warn": 40, "warning": 40, "error": 50, "fatal": 60, "critical": 60}


def level_of(c: Column) -> Column:
    """Numbers as they are, names in any case by the table, null for the rest."""
    low = F.lower(F.trim(c.cast("string")))
    out = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in LEVELS.items()])
    return F.coalesce(out, F.when(low.rlike(r"^\d{1,9}$"), low).try_cast("int"))
