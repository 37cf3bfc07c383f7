"""Frames kept across several queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class FrameCache:
    """Builds each named frame once and keeps it persisted until dropped.

    Frames spill to disk when memory is short and are rebuilt from their sources
    when an executor is lost.
    """

    def __init__(self) -> None:
        self._frames: dict[str, DataFrame] = {}

    def get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._frames[name]

    def names(self) -> list[str]:
        return list(self._frames)

    def drop(self, name: str) -> None:
        frame = self._frames.pop(name, None)
        if frame is not None:
            frame.unpersist()

    def drop_all_but(self, *names: str) -> None:
        for name in set(self._frames) - set(names):
            self.drop(name)

    def clear(self) -> None:
        for name in list(self._frames):
            self.drop(name)

    def __enter__(self) -> FrameCache:
        return self

    def __exit__(self, *_exc) -> None:
        self.clear()
