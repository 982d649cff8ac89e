"""Collects every named query."""

from . import (  # noqa: F401
    build_queries,
    correction_queries,
    gate_queries,
    image_queries,
    mask_queries,
    model_queries,
    plate_queries,
    radiometry_queries,
    rank_queries,
    scalar_queries,
    spectral_queries,
    view_queries,
)
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
