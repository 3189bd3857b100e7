"""Submit independent Spark jobs from a few driver threads, errors kept as data."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any


def message(error: Exception) -> str:
    """The first line that says something; never empty, as an empty text would read as no error."""
    return str(error).strip().split("\n")[0] or type(error).__name__


def each(items: Iterable[Any], job: Callable[[Any], Any], workers: int = 4) -> list[tuple[Any, Any, str | None]]:
    """``(item, result, error)`` per item, in order. Only the submission happens here; the rows of
    every job stay on the executors."""
    def guarded(item: Any) -> tuple[Any, Any, str | None]:
        try:
            return item, job(item), None
        except Exception as error:  # noqa: BLE001 - a failing item is a row, never a failed run
            return item, None, message(error)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(guarded, items))
