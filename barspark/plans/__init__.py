from .ewm import ewm, span_alpha
from .layout import SLOT_SECONDS, Layout
from .prefix import exclusive_prefix
from .series import (
    chunk_end_sql,
    chunk_sql,
    earlier,
    join_salted,
    number_rows,
    numbered_once,
    over,
    per_chunk,
    running_max,
    settle,
    so_far,
    spread,
)
from .stage import shared_dir, stage, stage_path

__all__ = [
    "SLOT_SECONDS",
    "Layout",
    "chunk_end_sql",
    "chunk_sql",
    "earlier",
    "ewm",
    "exclusive_prefix",
    "join_salted",
    "number_rows",
    "numbered_once",
    "over",
    "per_chunk",
    "running_max",
    "settle",
    "shared_dir",
    "so_far",
    "span_alpha",
    "spread",
    "stage",
    "stage_path",
]
