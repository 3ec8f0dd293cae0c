"""Versioned zone transition tables and vectorised conversion of local times to UTC."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

FIRST_YEAR, LAST_YEAR = 1950, 2100
#: No zone has two changes within so many seconds; a table is built by steps of this width.
_STEP = 6 * 86400


def database_version() -> str:
    """The release of the zone database in use, for instance 2025b."""
    for base in TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            p = Path(base, name)
            if p.exists():
                with p.open(errors="replace") as f:
                    return f.readline().replace("# version", "").strip()
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """offsets[i] (seconds) holds from changes[i - 1] (epoch seconds) up to changes[i]."""

    name: str
    version: str
    changes: np.ndarray = field(compare=False)
    offsets: np.ndarray = field(compare=False)

    @staticmethod
    def build(name: str) -> ZoneTable:
        zone = ZoneInfo(name)

        def offset(t: int) -> int:
            return int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())

        at = int(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC).timestamp())
        end = int(datetime(LAST_YEAR, 1, 1, tzinfo=UTC).timestamp())
        changes, offsets = [], [offset(at)]
        while at < end:
            after = at + _STEP
            if (now := offset(after)) != offsets[-1]:
                lo, hi = at, after
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if offset(mid) != offsets[-1] else (mid, hi)
                changes.append(hi)
                offsets.append(now)
            at = after
        return ZoneTable(name, database_version(), np.array(changes, np.int64), np.array(offsets, np.int64))

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        return self.offsets[np.searchsorted(self.changes, utc, side="right")]

    def to_utc(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTC seconds, valid). Of a local time that occurs twice the earlier instant counts; a skipped one is invalid."""
        best = np.full(local.shape, np.iinfo(np.int64).max)
        for o in np.unique(self.offsets):
            utc = local - o
            best = np.where(self.offset_at(utc) == o, np.minimum(best, utc), best)
        valid = best != np.iinfo(np.int64).max
        return np.where(valid, best, 0), valid

    def seasons(self, year: int = 2015) -> tuple[int, int]:
        """(standard, daylight) offset in seconds: the smaller and the larger one of a year."""
        first = int(datetime(year, 1, 1, tzinfo=UTC).timestamp())
        both = self.offset_at(np.array([first, first + 182 * 86400]))
        return int(both.min()), int(both.max())
