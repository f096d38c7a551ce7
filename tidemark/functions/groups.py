"""Declared groups of features, computed together in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Group:
    """aggs: aggregates with their names; derived: columns made of them; hidden: names that the result leaves out.
    seen: which rows the group is about, where it isn't all; a customer without one has nulls. The aggregates heed it."""

    aggs: dict[str, Column]
    derived: dict[str, Column] = field(default_factory=dict)
    seen: Column | None = None
    hidden: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [n for n in (*self.aggs, *self.derived) if n not in self.hidden]


def aggregate(rows: DataFrame, key: str, groups: Sequence[Group]) -> DataFrame:
    """One row a key with the columns of all groups: one pass over the rows, whatever their number."""
    aggs = []
    for g in groups:
        some = F.count_if(g.seen) > 0 if g.seen is not None else None
        aggs += [(x if some is None else F.when(some, x)).alias(n) for n, x in g.aggs.items()]
    out = rows.groupBy(key).agg(*aggs)
    out = out.withColumns({n: x for g in groups for n, x in g.derived.items()})
    return out.select(key, *[n for g in groups for n in g.names])
