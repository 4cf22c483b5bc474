"""Contracts in passing: counts and totals that are taken while rows are written or read anyway, by ``observe``, and judged afterwards.

A check that scans the table again costs a pass each; these cost an addition a row in the pass that is made in any case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.functions.scalar import all_finite, finite
from plumbline.operators.integrity import ContractError

MOST = 1000  # groups in a table of expected totals


class Passing:
    """Totals by group against a table of expected totals, finiteness and positive scale, of the rows that pass through ``watch``.

    ``expected``: {group: rows}, a short table of the protocol. One watch is for one action; a second raises, as its rows would be judged by the first's.
    """

    def __init__(self, expected: dict[str, int], group: str = "domain", numbers: tuple[str, ...] = (), positive: tuple[str, ...] = ()):
        if len(expected) > MOST:
            raise ValueError(f"{len(expected)} groups; a table of expected totals has at most {MOST}")
        self.expected, self.group, self.numbers, self.positive = dict(expected), group, numbers, positive
        self.seen: Observation | None = None

    def watch(self, df: DataFrame) -> DataFrame:
        if self.seen is not None:
            raise ValueError("one watch is for one action")
        self.seen = Observation()
        kinds, g = dict(df.dtypes), F.col(self.group)
        whole: list[Column] = [all_finite(F.col(c)) if kinds[c].startswith("array") else finite(F.col(c)) for c in self.numbers]
        above: list[Column] = [F.coalesce(F.col(c) > 0, F.lit(False)) for c in self.positive]
        every = lambda tests: reduce(lambda a, b: a & b, tests, F.lit(True))
        known = g.isin(*self.expected) if self.expected else F.lit(False)
        totals = [F.count_if(F.coalesce(g == k, F.lit(False))).alias(f"g{i}") for i, k in enumerate(self.expected)]
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"), F.count_if(~every(whole)).alias("not finite"), F.count_if(~every(above)).alias("not positive"), F.count_if(~F.coalesce(known, F.lit(False))).alias("other groups"), *totals)

    def report(self) -> list[dict]:
        """(item, expected, actual, ok), once the action is done: rows, finiteness, scale, rows of groups that none expects, and each group's total."""
        got = self.seen.get
        rows = [("rows", sum(self.expected.values()), got["rows"]), ("not finite", 0, got["not finite"]), ("not positive", 0, got["not positive"]), ("other groups", 0, got["other groups"])]
        rows += [(f"{self.group}:{k}", n, got[f"g{i}"]) for i, (k, n) in enumerate(self.expected.items())]
        return [{"item": i, "expected": e, "actual": a, "ok": e == a} for i, e, a in rows]

    def check(self) -> list[dict]:
        """The report, if all is as expected; else ContractError, which names the gaps."""
        rows = self.report()
        gaps = [f"{r['item']}: {r['actual']}, not {r['expected']}" for r in rows if not r["ok"]]
        if gaps:
            raise ContractError("; ".join(gaps[:10]))
        return rows
