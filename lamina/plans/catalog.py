"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from . import aggregation, chunks, codes, comparison, conversion, detection, filesystems, formats, fusion_policy, kernels, loops, measures, media, more, protection, records, recovery, sequence, sequence_more, series, streams  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
