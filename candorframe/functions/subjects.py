"""Age, face and screening rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age limits and the child-share limit of the screening rule.
MINOR_AGE = 18.0
POSSIBLE_MINOR_AGE = 27.0
MINOR_SHARE = 0.50


def classify_minor(age: Column, child_share: Column, usable: Column) -> Column:
    """LIKELY_MINOR / POSSIBLE_MINOR / ADULT / UNDETERMINED; a NaN or infinite age is no estimate."""
    known = F.when(~F.isnan(age) & (F.abs(age) != float("inf")), age)
    return (
        F.when(known < MINOR_AGE, "LIKELY_MINOR")
        .when(known < POSSIBLE_MINOR_AGE, "POSSIBLE_MINOR")
        .when(child_share >= MINOR_SHARE, "POSSIBLE_MINOR")
        .when(usable, "ADULT")
        .otherwise("UNDETERMINED")
    )
