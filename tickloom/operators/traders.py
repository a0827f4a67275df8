"""Backtests: sequential portfolio state, one group for each strategy, rows in time order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from enum import IntEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OHLCV(IntEnum):
    OPEN, HIGH, LOW, CLOSE, VOLUME = range(5)


def market_rows(prices: DataFrame, weights: DataFrame, ts: str = "ts", entity: str = "entity", strategy: str = "strategy") -> DataFrame:
    """One row for each (strategy, ts): arrays of entities with their open, close, volume, adjust, weight (null: none).

    prices: ts, entity, open, close, volume, adjust; weights: strategy, ts, entity, w. Arrays are packed by a shuffle
    on ts, so a backtest reads T rows and no long panel.
    """
    day = prices.groupBy(ts).agg(F.sort_array(F.collect_list(F.struct(entity, "open", "close", "volume", "adjust"))).alias("m"))
    soft = weights.groupBy(strategy, ts).agg(F.map_from_entries(F.collect_list(F.struct(entity, "w"))).alias("w"))
    names = weights.select(strategy).distinct()
    grid = day.join(F.broadcast(names))  # strategies are few, and each needs every day
    return grid.join(soft, [strategy, ts], "left").select(strategy, ts, F.col(f"m.{entity}").alias("entity"), "m.open", "m.close", "m.volume", "m.adjust", "w")


class Book:
    """Cash, shares by entity, last closes and adjust factors."""

    def __init__(self, cash: float) -> None:
        self.cash, self.shares, self.close, self.adjust = cash, {}, {}, {}

    def mark(self, day: dict[str, tuple], use_adjusts: bool) -> float:
        """Scales shares by the change of adjust factors, carries closes forward, returns the value of the holdings."""
        for i, (_, close, _, adjust) in day.items():
            if use_adjusts and np.isfinite(adjust) and adjust > 0:
                if i in self.shares:
                    self.shares[i] *= adjust / self.adjust.get(i, 1.0)
                self.adjust[i] = adjust
            if np.isfinite(close):
                self.close[i] = close
        return self.value()

    def value(self) -> float:
        """The holdings at their last closes; what never had one counts nothing."""
        return float(sum(n * self.close.get(i, 0.0) for i, n in self.shares.items()))


def _tradable(row: tuple) -> bool:
    """Whether a stock has a price to trade at: a finite, positive open. Volume does not matter."""
    return bool(np.isfinite(row[0]) and row[0] > 0)


def _close_out(book: Book, day: dict[str, tuple], fee: Callable[[float], float]) -> None:
    """Sells what has no price today at its last close; what never had a close stays."""
    for i in [i for i in book.shares if (i not in day or not _tradable(day[i])) and i in book.close]:
        amount = book.shares.pop(i) * book.close[i]
        book.cash += amount - fee(amount)


def benchmark_trade(book: Book, day: dict[str, tuple], weights: dict[str, float]) -> None:
    """Untradable holdings go at their last close; the rest is traded to weight * value / open, without fees or lots."""
    _close_out(book, day, lambda amount: 0.0)
    value = book.value() + book.cash
    targets = {i: w * value / day[i][0] for i, w in weights.items() if w and i in day and _tradable(day[i])}
    for i in set(book.shares) | set(targets):
        if i not in day or not _tradable(day[i]):
            continue
        change = targets.get(i, 0.0) - book.shares.get(i, 0.0)
        book.cash -= change * day[i][0]
        book.shares[i] = targets.get(i, 0.0)
    book.shares = {i: n for i, n in book.shares.items() if n}


def lot_trade(lots: Callable[[dict[str, float], np.random.Generator], dict[str, float] | None], lot_size: float, fee_base: float, fee_rate: float):
    """Trades whole lots towards the weights that `lots` picks among tradable stocks, paying max(fee_base, |value| * fee_rate) a trade.

    Forced sales come first and pay fees too; targets follow from what is left. The difference to a target is rounded
    to whole lots, halves to even, and holdings below a lot are sold. Cash may become negative. Where lots gives None
    nothing is traded but remnants below a lot.
    """
    fee = lambda amount: max(fee_base, abs(amount) * fee_rate)

    def trade(book: Book, day: dict[str, tuple], weights: dict[str, float], rng: np.random.Generator) -> None:
        _close_out(book, day, fee)
        value = book.value() + book.cash
        can = {i for i, row in day.items() if _tradable(row)}
        picked = lots({i: w for i, w in weights.items() if i in can}, rng)
        for i in sorted(can & (set(book.shares) | set(picked or ()))):
            price, held = day[i][0], book.shares.get(i, 0.0)
            change = 0.0 if picked is None else float(np.round((picked.get(i, 0.0) * value / price - held) / lot_size)) * lot_size
            if abs(held + change) < lot_size:
                change = -held
            if change:
                book.cash -= change * price + fee(change * price)
                book.shares[i] = held + change
        book.shares = {i: n for i, n in book.shares.items() if n}

    return trade


def simulate(rows: pd.DataFrame, trade, initial_cash: float, use_adjusts: bool = True, seed: int | None = None) -> Iterator[tuple]:
    """(ts, holdings, cash) after each row, in order of ts. Targets use today's close, after forced sales, and trade at today's open."""
    book, rng = Book(initial_cash), np.random.default_rng(seed)
    for r in rows.sort_values("ts").itertuples(index=False):
        number = lambda x: np.nan if x is None else float(x)
        day = {i: tuple(map(number, x)) for i, *x in zip(r.entity, r.open, r.close, r.volume, r.adjust, strict=True)}
        book.mark(day, use_adjusts)
        if r.w is not None:
            weights = {i: w for i, w in (r.w.items() if isinstance(r.w, dict) else r.w) if w is not None and np.isfinite(w)}
            args = (book, day, weights) if trade is benchmark_trade else (book, day, weights, rng)
            trade(*args)
        yield r.ts, float(sum(n * book.close.get(i, 0.0) for i, n in book.shares.items())), book.cash


def _run(rows: DataFrame, make_trade, initial_cash: float, use_adjusts: bool, seed: int | None, strategy: str) -> DataFrame:
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(simulate(pdf, make_trade(), initial_cash, use_adjusts, seed), columns=["ts", "holdings", "cash"])
        out.insert(0, strategy, pdf[strategy].iloc[0])
        return out

    return rows.groupBy(strategy).applyInPandas(run, f"{strategy} {kinds[strategy]}, ts {kinds['ts']}, holdings double, cash double")


def benchmark(rows: DataFrame, initial_cash: float, use_adjusts: bool = True, strategy: str = "strategy") -> DataFrame:
    """Frictionless backtest of each strategy: strategy, ts, holdings, cash, every tick."""
    return _run(rows, lambda: benchmark_trade, initial_cash, use_adjusts, None, strategy)


def simple_trader(rows: DataFrame, initial_cash: float, lots=None, *, lot_size: int = 100, fee_base: float = 0.0, fee_rate: float = 0.0, seed: int | None = None, strategy: str = "strategy") -> DataFrame:
    """Backtest in lots with fees; `lots(weights, rng)` picks the weights to aim at (default: as they are)."""
    pick = lots or (lambda weights, rng: weights)
    return _run(rows, lambda: lot_trade(pick, lot_size, fee_base, fee_rate), initial_cash, True, seed, strategy)


def random_trader(rows: DataFrame, initial_cash: float, portfolio_size: int = 20, seed: int = 0, **kwargs) -> DataFrame:
    """Draws portfolio_size of the tradable stocks without replacement by weight, each aimed at (sum of tradable weights) / portfolio_size.

    Without a positive weight among them nothing is traded.
    """

    def pick(weights: dict[str, float], rng: np.random.Generator) -> dict[str, float] | None:
        names = sorted(i for i, w in weights.items() if w > 0)
        if not names:
            return None
        p = np.array([weights[i] for i in names])
        n = min(portfolio_size, len(names))
        chosen = rng.choice(len(names), n, replace=False, p=p / p.sum())
        return {names[k]: float(p.sum()) / portfolio_size for k in chosen}

    return simple_trader(rows, initial_cash, pick, seed=seed, **kwargs)
