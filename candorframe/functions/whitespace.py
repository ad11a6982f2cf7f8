"""White space as the rules mean it: every Unicode space and the separators, not only the blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]+"


def strip(text: Column | str) -> Column:
    """``text`` without white space at both ends."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(text, "(?U)^" + SPACE, ""), "(?U)" + SPACE + r"\z", "")
