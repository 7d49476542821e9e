"""Names that are safe to store and to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a file is called without a name, and what an id of a roster looks like.
UNNAMED = "upload.mp4"
ROSTER_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,49}$"


def safe_name(name: Column) -> Column:
    """The last part of a path, with all but letters, digits, dots, lines, dashes and blanks as `_`, without blanks and dots around it; UNNAMED if nothing is left."""
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1)
    kept = F.regexp_replace(F.regexp_replace(last, r"[^\p{L}\p{N}._\- ]", "_"), r"^[ .]+|[ .]+$", "")
    return F.when(kept == "", UNNAMED).otherwise(kept)


def is_roster_id(name: Column) -> Column:
    return F.coalesce(name.rlike(ROSTER_ID), F.lit(False))
