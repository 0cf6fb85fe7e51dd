"""Versioned zone transition tables: UTC offsets of IANA zones as sorted arrays for vectorised look-up."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class ZoneTable:
    """``offsets[i]`` (seconds) holds from ``instants[i-1]`` up to ``instants[i]`` (UTC seconds).

    ``walls[i]`` is the first wall-clock second that can only lie after change i, so one binary search settles
    repeated wall times (earlier instant) and skipped ones (offset in force before the change).
    """

    zone: str
    version: str
    instants: np.ndarray
    offsets: np.ndarray
    walls: np.ndarray
    names: tuple[tuple[str, int], ...]

    def wall_to_utc(self, wall: np.ndarray) -> np.ndarray:
        return wall - self.offsets[np.searchsorted(self.walls, wall, side="right")]


def data_version() -> str:
    """Version of the zone data in use, as far as the system tells it."""
    for base in TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            p = Path(base) / name
            if p.exists():
                return p.read_text(errors="replace").split("\n")[0].replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1024)
def zone_table(zone: str, first_year: int = 1900, last_year: int = 2100) -> ZoneTable | None:
    """The table of one zone, or None for a name that is no zone."""
    try:
        tz = ZoneInfo(zone)
    except Exception:
        return None

    def at(sec: int) -> tuple[int, str]:
        t = (_EPOCH + timedelta(seconds=sec)).astimezone(tz)
        return int(t.utcoffset().total_seconds()), t.tzname() or ""

    start = int((datetime(first_year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    end = int((datetime(last_year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    instants, offsets, names = [], [at(start)[0]], {}
    before = at(start)
    for day in range(start + 86_400, end, 86_400):
        now = at(day)
        if now[0] != before[0]:
            lo, hi = day - 86_400, day
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid)[0] == before[0] else (lo, mid)
            instants.append(hi)
            offsets.append(now[0])
        if now != before and now[1].isalpha():
            names[now[1]] = now[0]
        before = now
    if before[1].isalpha():
        names[before[1]] = before[0]
    a, o = np.array(instants, dtype=np.int64), np.array(offsets, dtype=np.int64)
    digest = hashlib.sha256(a.tobytes() + o.tobytes()).hexdigest()[:8]
    return ZoneTable(zone, f"{data_version()}:{digest}", a, o, a + np.maximum(o[:-1], o[1:]), tuple(sorted(names.items())))
