"""A privacy budget that refuses to be overspent."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame


class BudgetError(ValueError):
    pass


class Budget:
    """``spend`` hands out parts of a total; ``split`` gives the common shares of one."""

    def __init__(self, total: float, allow_infinite: bool = False) -> None:
        if total <= 0 or math.isinf(total) and not allow_infinite:
            raise BudgetError("the total must be positive; infinity needs allow_infinite=True")
        self.total, self.spent = float(total), {}

    @property
    def left(self) -> float:
        return self.total - sum(self.spent.values())

    def spend(self, stage: str, eps: float) -> float:
        if eps < 0 or eps > self.left + 1e-12:
            raise BudgetError(f"{stage} asks for {eps}, {self.left} of {self.total} are left")
        self.spent[stage] = self.spent.get(stage, 0.0) + eps
        return float(eps)

    def rest(self, stage: str) -> float:
        return self.spend(stage, self.left)

    def split(self, dims: int, shares: tuple[str, ...]) -> dict[str, float]:
        """Each share gets total / (dims + number of shares), ``value`` the rest."""
        part = self.total / (dims + len(shares))
        return {name: self.spend(name, part) for name in shares} | {"value": self.rest("value")}


class Ledger:
    """A budget for each private source; a release of a table charges all sources that it is read from.

    Sources are the files and folders that the table's plan reads, whatever was derived from them, so a second release
    under another name or after a filter finds what the first has spent. Tables that are written and read again
    ``inherit`` the sources of what they were written from. A table that isn't read from files is its own source, by its plan.
    """

    def __init__(self, total: float) -> None:
        self.total = Budget(total).total
        self.accounts: dict[str, Budget] = {}
        self.origins: dict[str, set[str]] = {}

    def sources(self, df: DataFrame) -> set[str]:
        """Part files and folders of partitions count as the table that they belong to."""
        found = {re.sub(r"(/[^/]*=[^/]*)*/part-[^/]*$|(/[^/]*=[^/]*)+/[^/]*$", "", f) for f in df.inputFiles()} or {f"plan {df.semanticHash()}"}
        return set().union(*(self.origins.get(s, {s}) for s in found))

    def inherit(self, written: DataFrame, of: DataFrame) -> DataFrame:
        origins = self.sources(of)
        for source in self.sources(written) - origins:
            self.origins[source] = origins
        return written

    def left(self, df: DataFrame) -> float:
        """What every source of the table can still give."""
        return min(self.accounts[s].left if s in self.accounts else self.total for s in self.sources(df))

    def charge(self, df: DataFrame, stage: str, eps: float) -> None:
        """Spend ``eps`` of each source, or of none: BudgetError if one of them has less left."""
        sources = self.sources(df)
        if eps < 0 or eps > self.left(df) + 1e-12:
            raise BudgetError(f"{stage} asks for {eps}, {self.left(df)} of {self.total} are left of {', '.join(sorted(sources))}")
        for source in sources:
            self.accounts.setdefault(source, Budget(self.total)).spend(stage, eps)
