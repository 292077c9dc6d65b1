"""Two-layer access queues: a first access enters ``recent``, a second while there promotes to ``hot``."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AccessQueues:
    """Both queues in order of insertion, oldest first."""

    def __init__(self, recent_size=200, hot_size=50):
        self.recent_size, self.hot_size = max(1, recent_size), max(1, hot_size)
        self.recent: OrderedDict[str, float] = OrderedDict()
        self.hot: OrderedDict[str, float] = OrderedDict()

    def touch(self, key: str, ts: float) -> bool:
        """Records an access; whether it promoted the key."""
        if key in self.hot:
            self.hot[key] = ts
            self.hot.move_to_end(key)
            return False
        if key in self.recent:
            del self.recent[key]
            self.hot[key] = ts
            while len(self.hot) > self.hot_size:
                self.hot.popitem(last=False)
            return True
        self.recent[key] = ts
        while len(self.recent) > self.recent_size:
            self.recent.popitem(last=False)
        return False

    def replay(self, events: Iterable[tuple[str, float]]) -> list[bool]:
        return [self.touch(k, t) for k, t in events]

    def dump(self) -> dict:
        """Both queues as JSON values, oldest first."""
        return {"recent": list(self.recent.items()), "hot": list(self.hot.items())}

    def load(self, saved) -> None:
        """Takes queues over from ``dump``, the newest up to their sizes; anything unreadable leaves them empty."""
        try:
            recent, hot = ([(str(k), float(t)) for k, t in saved.get(n, [])] for n in ("recent", "hot"))
        except (AttributeError, TypeError, ValueError):
            recent = hot = []
        self.recent, self.hot = OrderedDict(recent[-self.recent_size :]), OrderedDict(hot[-self.hot_size :])

    def get_recent(self) -> list[str]:
        """Keys accessed once, newest first."""
        return list(reversed(self.recent))

    def get_hot(self) -> list[str]:
        """Promoted keys, newest first."""
        return list(reversed(self.hot))

    def stats(self) -> dict[str, int]:
        return {"recent_count": len(self.recent), "hot_count": len(self.hot), "recent_capacity": self.recent_size, "hot_capacity": self.hot_size}


def promotions(events: DataFrame, key: str, ts: str, scope: str | None = None, recent_size: int = 200, hot_size: int = 50) -> DataFrame:
    """Events that promote, ``(scope, key, ts)``. Order decides, so each scope is one ordered fold; scopes are parallel."""
    base = events.select((F.col(scope) if scope else F.lit("all")).cast("string").alias("scope"), F.col(key).cast("string").alias("key"), F.col(ts).cast("double").alias("ts"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "key"], kind="stable")
        return pdf[AccessQueues(recent_size, hot_size).replay(zip(pdf["key"], pdf["ts"]))]

    return base.groupBy("scope").applyInPandas(fold, "scope string, key string, ts double")
