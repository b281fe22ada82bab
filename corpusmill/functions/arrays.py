"""Row-local functions on token arrays; all run inside one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.constants import PAD_ID


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _col(ids) -> Column:
    return F.col(ids) if isinstance(ids, str) else ids


def truncate(ids, n: int) -> Column:
    """First ``n`` entries."""
    return F.slice(_col(ids), 1, n)


def pad(ids, n: int, pad_id=PAD_ID) -> Column:
    """Fill on the right with ``pad_id`` up to ``n`` entries; longer arrays are unchanged."""
    ids = _col(ids)
    return F.concat(ids, F.array_repeat(_lit(pad_id), F.greatest(F.lit(0), F.lit(n) - F.size(ids))))


def crop_last(ids, n: int) -> Column:
    """Last ``n`` entries."""
    ids = _col(ids)
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - F.lit(n - 1)), F.lit(n))


def shift_targets(ids, fill=PAD_ID) -> Column:
    """Next-token targets: drop the first entry, append ``fill``; same length as the input."""
    ids = _col(ids)
    shifted = F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.array(_lit(fill)))
    return F.when(F.size(ids) == 0, ids).otherwise(shifted)
