"""The daily decision run: gates, weights, composite, book and trades of newly arrived sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CompositeConfig, ConstructionConfig, CostConfig, RegimeConfig
from ..operators import composite as S
from ..operators.calendar import with_position
from ..operators.labels import forward_returns, horizon_long, rank_ic
from ..operators.portfolio import HELD, build_book, carry_forward
from ..session import stage


@dataclass(frozen=True)
class DailyDesk:
    """What the run reads of the market, and its settings.

    ``prices``, ``panel``, ``labels`` and ``adv`` are point-in-time tables by date; a decision reads of them
    only what is dated up to its own session.
    """

    sessions: DataFrame  # date, pos
    prices: DataFrame  # date, symbol, adj_close
    panel: DataFrame  # date, symbol, factor, value
    labels: DataFrame  # date, regime_column, regime
    adv: DataFrame  # date, symbol, adv
    sectors: DataFrame  # symbol, sector
    composite: CompositeConfig
    regime: RegimeConfig
    construction: ConstructionConfig
    costs: CostConfig
    min_names: int
    tie_code: Column | None = None

    def between(self, df: DataFrame, first: int, last: int) -> DataFrame:
        """The rows of sessions ``first`` to ``last``, by date bounds that reach the scan."""
        own = self.sessions.filter(F.col("pos").between(first, last))
        ends = own.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        return df.filter(F.col("date").between(F.lit(ends["a"]), F.lit(ends["b"]))) if ends["a"] else df.filter(F.lit(False))

    def realised(self, done: int, last: int) -> DataFrame:
        """``(factor, pos, ic)`` of the sessions whose labels came in after session ``done`` and by ``last``."""
        h = self.composite.horizon
        first = max(done - h + 1, 0)
        closes = self.between(self.prices, first, last)
        labels = horizon_long(forward_returns(closes, self.sessions, (h,)), (h,))
        ic = rank_ic(self.between(self.panel, first, last - h), labels, series=("factor", "horizon"), min_names=self.min_names)
        return with_position(ic, self.sessions).filter(F.col("pos").between(first, last - h)).select("factor", "pos", "ic")

    def decide(
        self, fresh: DataFrame, done: int, first: int, last: int, ic: DataFrame, gates: DataFrame, opening: DataFrame
    ) -> dict[str, DataFrame]:
        """Decide the sessions ``fresh`` (date, pos), which lie in ``first`` to ``last``.

        ``done`` is the last session that was decided before; ``ic`` and ``gates`` hold what had been
        realised and decided by then, ``opening`` the book. Only the trailing window of both is read.
        """
        new_ic = stage(self.realised(done, last), "new-ic")
        low = max(first - self.composite.window - self.composite.horizon, 0)
        recent = stage(self.sessions.filter(F.col("pos").between(low, last)).select("date", (F.col("pos") - low).cast("int").alias("pos")), "recent")
        known = ic.filter(F.col("pos") >= low).select("factor", "pos", "ic").unionByName(new_ic.filter(F.col("pos") >= low))
        known = stage(known.select("factor", (F.col("pos") - low).alias("pos"), "ic").join(F.broadcast(recent), "pos").drop("pos"), "known-ic")
        today = fresh.select("date")
        decided = S.regime_gates(known, self.between(self.labels, low, last), recent, self.composite, self.regime, tested_only=False)
        decided = stage(decided.join(F.broadcast(today), "date", "left_semi"), "new-gates")
        every = gates.filter(F.col("pos") >= low).select("date", "factor", "on").unionByName(decided.select("date", "factor", "on"))
        weights = S.trailing_weights(S.gated_ic(known, every), recent, self.composite).join(F.broadcast(today), "date", "left_semi")
        weights = stage(weights, "new-weights")
        section = self.between(self.panel, first, last).join(F.broadcast(today), "date", "left_semi")
        signal = S.composite(S.gated_panel(section, decided), weights, self.composite)
        book = build_book(
            signal, self.between(self.adv, first, last), self.sectors, self.construction, self.costs,
            carry=True, opening=opening, tie_code=self.tie_code,
        )
        costs = book.trades.select("date", "symbol", "cost_bps")
        moved = book.positions.join(costs, ["date", "symbol"], "left").withColumn("decided", F.lit(True))
        columns = ["date", "symbol", "prev_weight", "weight", "candidate", "banded", "adv", "cost_bps", "decided"]
        moved = stage(moved.select(*columns), "positions")
        held, state = self.unchanged(moved, fresh, opening)
        return {
            "ic": new_ic,
            "gates": with_position(decided.select("date", "factor", "on"), self.sessions),
            "weights": weights,
            "positions": moved.unionByName(held.select(*columns)),
            "state": state,
        }

    def unchanged(self, moved: DataFrame, fresh: DataFrame, opening: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the positions of sessions without a signal, where the book stays as it is; the book in the end)."""
        eve = self.sessions.agg(F.date_sub(F.min("date"), 1)).first()[0]
        before = opening.select(F.lit(eve).alias("date"), "symbol", "weight").unionByName(moved.select("date", "symbol", "weight"))
        calendar = fresh.select("date", "pos").unionByName(self.sessions.sparkSession.createDataFrame([(eve, -1)], "date date, pos int"))
        # A name that was sold keeps a row of weight 0, so that a date whose book is empty counts as decided.
        kept = stage(carry_forward(before, calendar), "kept").filter(F.abs("weight") > HELD)
        none = {"candidate": F.lit(False), "banded": F.lit(False), "adv": F.lit(None).cast("double"), "cost_bps": F.lit(None).cast("double"), "decided": F.lit(False)}
        held = kept.filter((F.col("date") > F.col("as_of")) & (F.col("date") > F.lit(eve))).withColumn("prev_weight", F.col("weight")).withColumns(none)
        end = fresh.agg(F.max("date")).first()[0]
        final = kept.filter(F.col("date") == F.lit(end)).select("symbol", "weight")
        return held, final
