"""Rounding that is the same in every engine.

Rounding a double at a tie (33.995, 0.5075) depends on whether the engine
looks at the binary value or its shortest decimal text. Going through
DECIMAL(38,12) first fixes the digits, then rounds half-up (``rnd``) or
half-even (``brnd``) on exact decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,12)"


def rnd(x, n: int = 0) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast(DEC), n).cast("double")


def brnd(x, n: int = 0) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.bround(c.cast(DEC), n).cast("double")
