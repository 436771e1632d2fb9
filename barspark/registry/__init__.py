"""Registered queries over the driver's tables, each with its SQL counterpart where there is one."""

from . import cleaning, evaluation, features, forecasting, preparation, signals, sources, streams
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
