"""A two-tier, least-recently-used store of persisted filter results."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Tier:
    rows: int  # results up to this many rows
    entries: int
    held: OrderedDict[tuple, tuple[DataFrame, int]] = field(default_factory=OrderedDict)


class ResultCache:
    """Small and medium results stay persisted until pushed out; larger ones are not kept."""

    def __init__(self, small: tuple[int, int] = (50_000, 100), medium: tuple[int, int] = (500_000, 50)):
        self.tiers = (Tier(*small), Tier(*medium))
        self.revision = 0

    def get(self, key: tuple) -> tuple[DataFrame, int] | None:
        for tier in self.tiers:
            if key in tier.held:
                tier.held.move_to_end(key)
                return tier.held[key]
        return None

    def put(self, key: tuple, df: DataFrame, count: int) -> str | None:
        """Keep a persisted result; returns the tier's name, or None for a result that is too large."""
        for name, tier in zip(("small", "medium"), self.tiers):
            if count <= tier.rows:
                tier.held[key] = df, count
                if len(tier.held) > tier.entries:
                    _, (old, _) = tier.held.popitem(last=False)
                    old.unpersist()
                return name
        return None

    def clear(self) -> None:
        for tier in self.tiers:
            for df, _ in tier.held.values():
                df.unpersist()
            tier.held.clear()

    def invalidate(self) -> None:
        """New data: nothing kept is valid any more."""
        self.clear()
        self.revision += 1

    def snapshot(self) -> dict[str, int]:
        return {"revision": self.revision, "small": len(self.tiers[0].held), "medium": len(self.tiers[1].held)}
