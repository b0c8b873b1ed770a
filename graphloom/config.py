"""Limits of work and what a backend can do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Most that one call may ask for. Fixed values.
LIMITS = {"depth": 10, "nodes": 1000, "edges": 5000, "files": 200, "results": 500}
#: Lowest quality of hybrid retrieval that is accepted. Fixed values.
ACCEPTANCE = {"recall_at_5": 0.70, "reciprocal_rank": 0.50, "hit_rate": 0.80}


@dataclass(frozen=True)
class Budget:
    """A limit that was asked for, the one that holds, and whether more was there."""

    name: str
    asked: int
    limit: int
    overflow: bool = False

    @property
    def status(self) -> str:
        return "clamped" if self.asked > self.limit else "partial" if self.overflow else "within"


def resolve(name: str, asked: int | None) -> Budget:
    """The smaller of what is asked for and the most allowed; nothing asked means the most allowed."""
    most = LIMITS[name]
    return Budget(name, most if asked is None else asked, most if asked is None else max(0, min(asked, most)))


def limited(df: DataFrame, budget: Budget) -> tuple[DataFrame, Budget]:
    """First rows within the budget, and whether the budget cut any off. One row more than the limit is looked for."""
    more = df.limit(budget.limit + 1).count() > budget.limit
    return df.limit(budget.limit), Budget(budget.name, budget.asked, budget.limit, more)


@dataclass(frozen=True)
class Capabilities:
    regex: bool = True
    full_text: bool = True
    vectors: bool = False

    def check(self, mode: str) -> None:
        """Raises for a search mode that this backend can't run."""
        if mode.startswith("hybrid") and not self.vectors:
            raise ValueError(f"{mode} needs vectors")


def accepted(recall_at_5: float, reciprocal_rank: float, hit_rate: float, payload: float, lexical_payload: float) -> bool:
    """Whether hybrid retrieval is good enough, with a payload at most a tenth above that of lexical retrieval."""
    good = recall_at_5 >= ACCEPTANCE["recall_at_5"] and reciprocal_rank >= ACCEPTANCE["reciprocal_rank"] and hit_rate >= ACCEPTANCE["hit_rate"]
    return good and payload <= lexical_payload * 1.1
