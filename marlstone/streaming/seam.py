"""The seam of sealed segments and a live tip: each block is answered from exactly one side."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SeamError


@dataclass(frozen=True)
class Snapshot:
    """sealed_through: the last sealed block, None if nothing is sealed (which isn't block 0); rows: live rows."""

    sealed_through: int | None
    rows: list[dict] = field(default_factory=list)


class MemoryTip:
    """Live rows in memory. A snapshot is one step: watermark and rows are of the same moment."""

    def __init__(self, block: str):
        self.block, self._rows, self._sealed, self._lock = block, {}, {}, threading.Lock()

    def append(self, table: str, rows: list[dict]) -> None:
        with self._lock:
            sealed = self._sealed.get(table)
            for r in rows:
                if r.get(self.block) is None:
                    raise SeamError("a live row without a block")
                if sealed is not None and r[self.block] <= sealed:
                    raise SeamError("a live row in a sealed block")
            self._rows.setdefault(table, []).extend(rows)

    def seal_through(self, table: str, block: int) -> None:
        with self._lock:
            if self._sealed.get(table) is not None and block < self._sealed[table]:
                raise SeamError("the watermark can't go back")
            self._sealed[table] = block
            self._rows[table] = [r for r in self._rows.get(table, []) if r[self.block] > block]

    def snapshot(self, table: str) -> Snapshot:
        with self._lock:
            return Snapshot(self._sealed.get(table), list(self._rows.get(table, [])))


def seam(cold: DataFrame, tip: MemoryTip, table: str) -> DataFrame:
    """Sealed rows up to the watermark and live rows beyond it. The snapshot comes first, so segments listed later may hold more
    than it says is sealed; what they hold beyond the watermark is left to the live side."""
    taken = tip.snapshot(table)
    if taken.sealed_through is not None:
        sealed = cold.where(F.col(tip.block) <= taken.sealed_through)
    else:
        sealed = cold.limit(0)
    if any(taken.sealed_through is not None and r[tip.block] <= taken.sealed_through for r in taken.rows):
        raise SeamError("live rows at or below the watermark")
    if not taken.rows:
        return sealed
    names = list(dict.fromkeys(k for r in taken.rows for k in r))
    kinds = dict(cold.dtypes)
    data = [tuple(r.get(n) for n in names) for r in taken.rows]
    hot = cold.sparkSession.createDataFrame(data, ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))
    return sealed.unionByName(hot, allowMissingColumns=True)
