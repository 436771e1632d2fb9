"""Physical layout of a bar series on the cluster.

A series is never handled as one group: one symbol may hold a third of all rows. Rows get a
position ``rn`` inside their series, positions are cut into chunks, and every window runs per
``(symbol, chunk)``.
"""

from __future__ import annotations

from dataclasses import dataclass

# Bar period labels and the shortest length of such a bar in seconds.
SLOT_SECONDS = {
    "M1": 60,
    "M5": 300,
    "M15": 900,
    "M30": 1800,
    "H1": 3600,
    "H4": 14400,
    "D1": 86400,
    "W1": 604800,
    "MN1": 2419200,
}


@dataclass(frozen=True)
class Layout:
    """Sizes that bound every group.

    ``timeframe``     bar period of the series; a series has at most one bar per period
    ``bucket_slots``  periods per numbering bucket, hence the most rows in one bucket
    ``chunk_rows``    rows per window chunk; a chunk task holds this many rows plus the halo
    ``fanout``        chunks (or buckets) scanned together at the first level of a prefix scan
    """

    timeframe: str = "M1"
    bucket_slots: int = 4096
    chunk_rows: int = 1024
    fanout: int = 4096

    def __post_init__(self):
        if self.timeframe not in SLOT_SECONDS:
            raise ValueError(f"unknown timeframe {self.timeframe!r}")
        if min(self.bucket_slots, self.chunk_rows, self.fanout) < 1:
            raise ValueError("layout sizes must be positive")

    @property
    def bucket_seconds(self) -> int:
        return SLOT_SECONDS[self.timeframe] * self.bucket_slots
