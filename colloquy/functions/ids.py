"""Identifiers: 32 hex digits or dashed UUIDs, in either letter case, name the same thing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = "^[^0-9a-z]*(?:urn:uuid:)?[^0-9a-z]*([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})[^0-9a-z]*$"


def dashed(col: Column) -> Column:
    """Lower-case dashed UUID; a text that is no UUID comes back trimmed and in lower case, null stays null.

    Braces, blanks and a ``urn:uuid:`` prefix around the digits are dropped.
    """
    return F.regexp_replace(F.lower(F.trim(col)), UUID_PATTERN, "$1-$2-$3-$4-$5")
