"""Queries over the given tables, one module per part of the inventory."""

from catalog.base import REGISTRY
from catalog import (  # noqa: F401
    q_evaluate,
    q_folds,
    q_grid,
    q_jobs,
    q_models,
    q_prep,
    q_raster,
    q_scalars,
    q_target,
)

__all__ = ["REGISTRY"]
