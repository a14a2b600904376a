"""Measurements of benches: timing, their record by name, and what they extrapolate to."""

from __future__ import annotations

import json
import os
import platform
import time
from collections.abc import Callable
from typing import Any


def timed(work: Callable[[], Any]) -> tuple[Any, float]:
    """What work returns, and the seconds it took."""
    began = time.perf_counter()
    return work(), time.perf_counter() - began


def best_of(work: Callable[[], Any], times: int = 3) -> tuple[Any, float]:
    """What the last run returns, and the seconds of the fastest."""
    runs = [timed(work) for _ in range(times)]
    return runs[-1][0], min(s for _, s in runs)


def read_measurements(path: str) -> dict:
    """What was recorded, nothing if there is no record."""
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def write_measurements(path: str, values: dict, merge: bool = True) -> dict:
    """Records values by name over what is there, with the machine they are from."""
    kept = (read_measurements(path) if merge else {}) | values | {"machine": {"system": platform.system(), "python": platform.python_version(), "cpus": os.cpu_count()}}
    with open(f"{path}.new", "w") as f:
        json.dump(kept, f, indent=1, sort_keys=True)
    os.replace(f"{path}.new", path)
    return kept


def growth(points: list[tuple[int, float]], room: float) -> dict[str, float]:
    """From sizes and what they took: the most and the least a unit, their spread, and the units that fill the room at the last rate."""
    each = [took / n for n, took in points if n]
    return {"last": each[-1], "least": min(each), "most": max(each), "spread": max(each) / max(min(each), 1e-9), "until_full": room / max(each[-1], 1e-9)}


def rebuild_ratio(rebuild: Callable[[], Any], batch: Callable[[], Any], times: int = 3) -> float:
    """How many batches a full rebuild costs."""
    return best_of(rebuild, times)[1] / max(best_of(batch, times)[1], 1e-9)
