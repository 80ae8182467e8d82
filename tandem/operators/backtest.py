"""The trading rule and its accounts.

Only the path of positions is sequential: sizes depend on the initial capital, and decisions on z,
on the position and on how long it's held. So a fold over (idx, z), one per pair and parameter
set, yields round trips; prices, costs, cash, interest and value follow by joins and windows.

The fold's state is finite: flat or in a trade of an age up to the longest holding, and what the last bar asked for. So a long series
is cut into segments. Each segment after the first is first mapped from every state it may be entered in to the state it
leaves, all states side by side; the maps are composed in order, a row for each segment; then each segment is folded from
its own state. No task holds more bars than a segment has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.cut import cut
from ..functions.scalars import quantities
from ..functions.spans import numbered

KEYS = ("pair_id", "label")


def decide(z: float, direction: int, held: int, entry: float, leave: float, stop: float, longest: int) -> str:
    """What a bar's z asks for at the next bar: hold, long, short, or the reason to leave."""
    if z != z:
        return "hold"
    if not direction:
        return "long" if z <= -entry else "short" if z >= entry else "hold"
    if direction * z <= -stop:
        return "stop_loss"
    if held >= longest:
        return "max_holding"
    return "reversion" if abs(z) <= leave else "hold"


#: direction, bar of the entry, what the last bar asked for, and whether a refused entry waits for z to leave the band.
State = tuple[int, int, str, bool]
START: State = (0, -1, "hold", False)
INTENTS = ("hold", "long", "short", "stop_loss", "max_holding", "reversion")
#: Bars of a series that one task folds.
SEGMENT = 8192


def replay(idx: np.ndarray, z: np.ndarray, entry: float, leave: float, stop: float, longest: int, skip: frozenset[int] = frozenset(), state: State = START) -> tuple[list[tuple[int, int, int, str]], State]:
    """Trips (direction, entry bar, exit bar, reason) that end within these bars, and the state after them; fills come a bar after
    the decision.

    An entry at a bar of ``skip`` isn't taken, nor any other until z has left the entry band.
    """
    (direction, since, pending, waiting), trips = state, []
    for t, value in zip(idx.tolist(), z.tolist(), strict=True):
        if pending in ("long", "short") and (waiting or t in skip):
            waiting = True
        elif pending in ("long", "short"):
            direction, since = (1 if pending == "long" else -1), t
        elif pending != "hold":
            trips.append((direction, since, t, pending))
            direction = 0
        if waiting and value == value and abs(value) < entry:
            waiting = False
        pending = decide(value, direction, t - since, entry, leave, stop, longest)
    return trips, (direction, since, pending, waiting)


def round_trips(idx: np.ndarray, z: np.ndarray, entry: float, leave: float, stop: float, longest: int, skip: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, str]]:
    """All trips of a whole series; one that is open at its end is closed there."""
    trips, (direction, since, _, _) = replay(idx, z, entry, leave, stop, longest, skip)
    yield from trips
    if direction:
        yield direction, since, int(idx[-1]), "end_of_data"


def states(longest: int, border: int) -> list[State]:
    """Every state that bars before ``border`` can leave, by what it means for later ones: a trade older than ``longest`` bars counts as
    so old, and one that is about to end has no age."""
    flat = [(0, -1, asked, waiting) for asked in INTENTS[:3] for waiting in (False, True)]
    held = [(d, border - age, "hold", False) for d in (1, -1) for age in range(longest + 1)]
    return flat + held + [(d, border, asked, False) for d in (1, -1) for asked in INTENTS[3:]]


def place_of(state: State, longest: int, border: int) -> int:
    """Number in states() of a state that bars before ``border`` have left."""
    direction, since, asked, waiting = state
    if not direction:
        return 2 * INTENTS.index(asked) + waiting
    side = direction < 0
    if asked == "hold":
        return 6 + side * (longest + 1) + min(border - since, longest)
    return 6 + 2 * (longest + 1) + 3 * side + INTENTS.index(asked) - 3


def transitions(idx: np.ndarray, z: np.ndarray, entry: float, leave: float, stop: float, longest: int, skip: frozenset[int], border: int) -> list[State | None]:
    """For each of states() the state after these bars, all at once; the entry bar of a trade that came in is given as None."""
    first = states(longest, border)
    direction, since, asked, waiting = (np.array(x) for x in zip(*((d, s, INTENTS.index(a), w) for d, s, a, w in first), strict=True))
    came = direction != 0
    for t, value in zip(idx.tolist(), z.tolist(), strict=True):
        enters = (asked == 1) | (asked == 2)
        refused = enters & (waiting | (t in skip))
        waiting = waiting | refused
        taken, left = enters & ~refused, asked > 2
        direction = np.where(taken, np.where(asked == 1, 1, -1), np.where(left, 0, direction))
        since = np.where(taken, t, since)
        came &= ~(taken | left)
        if value != value:
            asked = np.zeros_like(asked)
            continue
        if abs(value) < entry:
            waiting = np.zeros_like(waiting)
        outside = 1 if value <= -entry else 2 if value >= entry else 0
        inside = np.where(direction * value <= -stop, 3, np.where(t - since >= longest, 4, 5 if abs(value) <= leave else 0))
        asked = np.where(direction == 0, outside, inside)
    return [(d, None if c else s, INTENTS[a], w) for d, s, a, w, c in zip(direction.tolist(), since.tolist(), asked.tolist(), waiting.tolist(), came.tolist(), strict=True)]


def config_table(spark, configs: list[dict]) -> DataFrame:
    """Parameter sets (few; they're literals of the plan), to be broadcast."""
    return F.broadcast(spark.createDataFrame(pd.DataFrame(configs).astype({c: "float64" for c in ("entry", "exit", "stop", "capital", "fraction")})))


def with_config(rows: DataFrame, configs: list[dict]) -> DataFrame:
    """Each row once for each parameter set."""
    return rows.crossJoin(config_table(rows.sparkSession, configs))


PIECE = "pair_id string, label string, part bigint, longest bigint, last_index bigint, kind string, sign bigint, entry_index bigint, exit_index bigint, asked string, waiting boolean"
PIECES = [c.split()[0] for c in PIECE.split(", ")]


def path(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Round trips of every pair and parameter set; rows have idx, z, entry, exit, stop, max_holding and, perhaps, skip."""

    def arguments(group: pd.DataFrame) -> tuple:
        p = group.iloc[0]
        skip = frozenset(group.idx[group["skip"]].tolist()) if "skip" in group else frozenset()
        return group.idx.to_numpy(), group.z.to_numpy(float), p.entry, p.exit, p.stop, int(p.max_holding), skip

    def pieces(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """The first segment's trips and the state after it; of the others the state after each state, in the order of states()."""
        group = group.sort_values("idx")
        values = arguments(group)
        name = (key[0], key[1], key[2], values[5], int(values[0][-1]))
        if key[2] == 0:
            trips, state = replay(*values)
            out = [(*name, "trip", d, a, b, reason, False) for d, a, b, reason in trips] + [(*name, "state", state[0], state[1], None, state[2], state[3])]
        else:
            out = [(*name, "state", s[0], s[1], None, s[2], s[3]) for s in transitions(*values, border=key[2] * segment)]
        return pd.DataFrame(out, columns=PIECES).astype({"entry_index": "Int64", "exit_index": "Int64"})

    def compose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """The state that each segment is entered in, the first one's trips, and the trip that the end of the data closes."""
        out, state, last = [group[group.kind == "trip"]], START, None
        for part, own in group[group.kind == "state"].groupby("part", sort=True):
            longest, border = int(own.longest.iloc[0]), int(part) * segment
            if part:
                out.append(pd.DataFrame([(*key, part, longest, None, "state", state[0], state[1], None, state[2], state[3])], columns=PIECES))
            r = own.iloc[place_of(state, longest, border) if part else 0]
            state = (int(r.sign), state[1] if pd.isna(r.entry_index) else int(r.entry_index), r.asked, bool(r.waiting))
            last = int(r.last_index)
        if state[0]:
            out.append(pd.DataFrame([(*key, 0, 0, last, "trip", state[0], state[1], last, "end_of_data", False)], columns=PIECES))
        return pd.concat([x.astype({"last_index": "Int64", "entry_index": "Int64", "exit_index": "Int64"}) for x in out])

    def fold(key: tuple, group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if group.empty or state.empty:
            return pd.DataFrame(columns=TRIP)
        s = state.iloc[0]
        trips, _ = replay(*arguments(group.sort_values("idx")), (int(s.sign), int(s.entry_index), s.asked, bool(s.waiting)))
        return pd.DataFrame([(key[0], key[1], *t) for t in trips], columns=TRIP)

    TRIP = ["pair_id", "label", "sign", "entry_index", "exit_index", "exit_reason"]  # noqa: N806
    cols = [*KEYS, "idx", "z", "entry", "exit", "stop", "max_holding", *(["skip"] if "skip" in rows.columns else [])]
    cut_up = rows.select(*cols, F.floor(F.col("idx") / segment).cast("long").alias("part"))
    composed = cut_up.groupBy(*KEYS, "part").applyInPandas(pieces, PIECE).groupBy(*KEYS).applyInPandas(compose, PIECE)
    first = composed.where("kind = 'trip'").select(*KEYS, "sign", "entry_index", "exit_index", F.col("asked").alias("exit_reason"))
    entered = composed.where("kind = 'state'").select(*KEYS, "part", "sign", "entry_index", "asked", "waiting")
    # first segments come along for nothing, but so both sides read one exchange, and signals are computed once
    later = cut_up.groupBy(*KEYS, "part").cogroup(entered.groupBy(*KEYS, "part")).applyInPandas(fold, "pair_id string, label string, sign bigint, entry_index bigint, exit_index bigint, exit_reason string")
    trips = numbered(first.unionByName(later), KEYS, "trade", "entry_index")
    return trips.select(*KEYS, "trade", F.when(F.col("sign") == 1, "long_spread").otherwise("short_spread").alias("direction"), "entry_index", "exit_index", "exit_reason")


def executed(intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(round trips, events) of intents that come from anywhere: per bar of a series (pair_id, label, idx, intent) what it asks for at
    the next one: ``enter:<direction>``, ``exit:<reason>``, ``flip:<direction>``, or anything else to hold.

    An entry while a position is open is ignored, and shown as such; an exit while flat does nothing. A flip closes what is open, with the
    reason reversion, and opens the other at the same fill; while flat it is an entry. What is open at the last bar is closed there.

    Exits and flips leave a state that doesn't hang on the one before, so they cut a series into runs. A run starts flat or, after a
    flip, in its direction; one that starts flat is entered by its first entry. So positions are running counts and firsts of runs,
    without a fold.
    """
    w = Window.partitionBy(*KEYS).orderBy("idx")
    asked = F.coalesce(F.lag("intent").over(w), F.lit("hold"))
    kind, side = F.split_part("asked", F.lit(":"), F.lit(1)), F.split_part("asked", F.lit(":"), F.lit(2))
    rows = intents.select(*KEYS, "idx", asked.alias("asked")).withColumns({"kind": kind, "side": side})
    rows = rows.withColumn("run", F.count_if(F.col("kind").isin("exit", "flip")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy(*KEYS, "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    # the direction that the run starts in, or else that of its first entry
    opened = F.first(F.when(F.col("kind").isin("enter", "flip"), F.col("side")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("position", F.coalesce(opened, F.lit("flat")))
    rows = rows.withColumn("before", F.coalesce(F.lag("position").over(w), F.lit("flat")))
    flat = F.col("before") == "flat"
    entered = flat & F.col("kind").isin("enter", "flip")
    event = F.when(entered, F.concat(F.lit("entry:"), "side")).when(~flat & (F.col("kind") == "enter"), "ignored_enter_while_open").when(~flat & (F.col("kind") == "flip"), F.concat(F.lit("flip:"), "side")).when(~flat & (F.col("kind") == "exit"), F.col("asked"))
    rows = rows.withColumns({"event": event, "opens": entered | (~flat & (F.col("kind") == "flip")), "closes": ~flat & F.col("kind").isin("exit", "flip")})
    reason = F.when(F.col("kind") == "flip", "reversion").otherwise(F.col("side"))
    # fills alternate: the fill after one that opens closes it
    fills = rows.where("opens or closes").withColumns({"exit_index": F.lead("idx").over(w), "exit_reason": F.lead(reason).over(w)}).where("opens")
    last = intents.groupBy(*KEYS).agg(F.max("idx").alias("last"))
    trips = numbered(fills.select(*KEYS, F.col("side").alias("direction"), F.col("idx").alias("entry_index"), "exit_index", "exit_reason").join(last, [*KEYS]), KEYS, "trade", "entry_index")
    trips = trips.select(*KEYS, "trade", "direction", "entry_index", F.coalesce("exit_index", "last").alias("exit_index"), F.coalesce("exit_reason", F.lit("end_of_data")).alias("exit_reason"))
    ends = trips.where("exit_reason = 'end_of_data'").select(*KEYS, F.col("exit_index").alias("idx"), F.lit("exit:end_of_data").alias("closing"))
    happened = rows.join(ends, [*KEYS, "idx"], "left").withColumn("trade_event", F.concat_ws(";", "event", "closing")).where("trade_event != ''")
    return trips, happened.select(*KEYS, "idx", "trade_event")


def run_intents(rows: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, trades, audit) where the decisions are the column ``intent`` of ``rows`` (bars with beta, z, pair_id and label)."""
    placed = rows.join(config_table(rows.sparkSession, [config.row("")]).drop("label"))
    trips, happened = executed(placed)
    done = cut(trades(trips, placed))
    return placed, done, audit(placed, done, config).drop("trade_event").join(happened, [*KEYS, "idx"], "left").fillna("", ["trade_event"])


def trades(trips: DataFrame, rows: DataFrame) -> DataFrame:
    """Round trips with sizes, prices, z and results. ``rows``: bars with beta, z and parameters by pair and label.

    Leg B is sized by the hedge ratio of the bar that decided, at the prices of the bar that fills. The four bars that matter to
    a trip are looked up in one join, by their numbers.
    """
    rate = (F.col("commission_bps") + F.col("slippage_bps")) / 10_000
    wanted = F.array(*(F.struct(F.lit(k).alias("at"), i.alias("idx")) for k, i in (("entry", F.col("entry_index")), ("asked", F.col("entry_index") - 1), ("exit", F.col("exit_index")), ("left", F.col("exit_index") - 1))))
    looked = trips.select(*KEYS, "trade", F.explode(wanted).alias("w")).select(*KEYS, "trade", "w.*")
    values = ("date", "price_a", "price_b", "beta", "z", "capital", "fraction")
    met = looked.join(rows.select(*KEYS, "idx", *values, rate.alias("rate")), [*KEYS, "idx"])
    of = lambda at, c: F.max(F.when(F.col("at") == at, F.col(c)))
    names = {"entry_date": ("entry", "date"), "exit_date": ("exit", "date"), "a0": ("entry", "price_a"), "b0": ("entry", "price_b"), "a1": ("exit", "price_a"), "b1": ("exit", "price_b"), "hedge": ("asked", "beta"), "z_asked": ("asked", "z"), "z_left": ("left", "z"), "z_last": ("exit", "z"), "capital": ("entry", "capital"), "fraction": ("entry", "fraction"), "rate": ("entry", "rate")}
    both = trips.join(met.groupBy(*KEYS, "trade").agg(*(of(*v).alias(k) for k, v in names.items())), [*KEYS, "trade"])
    size_a, size_b = quantities(F.col("capital"), F.col("fraction"), F.col("hedge"), F.col("a0"), F.col("b0"))
    sign = F.when(F.col("direction") == "long_spread", 1.0).otherwise(-1.0)
    both = both.withColumns({"qty_a": sign * size_a, "qty_b": -sign * size_b})
    value: dict[str, Column] = {f"value{k}": F.col("qty_a") * F.col(f"a{k}") + F.col("qty_b") * F.col(f"b{k}") for k in (0, 1)}
    value |= {f"notional{k}": F.abs(F.col("qty_a") * F.col(f"a{k}")) + F.abs(F.col("qty_b") * F.col(f"b{k}")) for k in (0, 1)}
    both = both.withColumns(value).withColumns({f"cost{k}": F.col(f"notional{k}") * F.col("rate") for k in (0, 1)})
    gross, costs = F.col("value1") - F.col("value0"), F.col("cost0") + F.col("cost1")
    z_out = F.coalesce(F.when(F.col("exit_reason") == "end_of_data", F.col("z_last")).otherwise(F.col("z_left")), F.lit(0.0))
    return both.select(
        *KEYS, "trade", "direction", "entry_index", "exit_index", "entry_date", "exit_date", F.coalesce("z_asked", F.lit(0.0)).alias("entry_z"), z_out.alias("exit_z"), gross.alias("pnl_gross"), costs.alias("costs"),
        (gross - costs).alias("pnl_net"), "exit_reason", (F.col("exit_index") - F.col("entry_index")).alias("holding_bars"), "qty_a", "qty_b", "value0", "value1", "cost0", "cost1", "notional0", "notional1",
    )


#: Bars over which cash is summed in closed form.
BLOCK = 1024


def with_cash(rows: DataFrame, accrual: float, block: int = BLOCK) -> DataFrame:
    """``rows`` (capital, flow by pair, label and idx) with cash after each bar: that of the bar before with interest, and the flow.

    A block of bars turns the cash it starts with into growth * cash + sum; these pairs are carried through in order, a row for
    each block, and inside a block running sums do. So powers stay small, however long a series is.
    """
    placed = rows.withColumn("_block", F.floor(F.col("idx") / block).cast("long"))
    # bars since the cash that a block starts with: of the last bar before it, or of the first bar, which earns nothing yet
    since = F.col("idx") - F.greatest(F.col("_block") * block - 1, F.lit(0))
    grown = lambda n: F.pow(F.lit(1 + accrual), n)
    sums = placed.groupBy(*KEYS, "_block").agg(F.sum(F.col("flow") * grown(F.col("_block") * block + (block - 1) - F.col("idx"))).alias("total"), F.max("capital").alias("capital"))

    def carry(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out, cash, last = [], None, -1
        for number, total, capital in group.sort_values("_block")[["_block", "total", "capital"]].itertuples(index=False):
            # a series may begin late, or lack whole blocks
            cash = capital if cash is None else cash * (1 + accrual) ** ((number - last - 1) * block)
            out.append((*key, number, cash))
            cash = cash * (1 + accrual) ** (block - (number == 0)) + total
            last = number
        return pd.DataFrame(out, columns=[*KEYS, "_block", "_start"])

    starts = sums.groupBy(*KEYS).applyInPandas(carry, "pair_id string, label string, _block bigint, _start double")
    w = Window.partitionBy(*KEYS, "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    within = F.col("idx") - F.col("_block") * block
    cash = F.col("_start") * grown(since) + grown(within) * F.sum(F.col("flow") * grown(-within)).over(w)
    return placed.join(starts, [*KEYS, "_block"]).withColumn("cash", cash).drop("_block", "_start")


def audit(rows: DataFrame, done: DataFrame, config: Config) -> DataFrame:
    """One row per bar: position, cash, value, costs, interest and events. Interest accrues on the cash of the bar before, ahead of
    fills. A bar whose value doesn't follow from the one before raises when its value is read."""
    at = lambda end, flow, cost, event: done.select(*KEYS, F.col(end).alias("idx"), flow.alias("flow"), cost.alias("cost"), event.alias("event"), F.lit(end).alias("kind"))
    opened = at("entry_index", -F.col("value0") - F.col("cost0"), F.col("cost0"), F.concat(F.lit("entry:"), "direction"))
    closed = at("exit_index", F.col("value1") - F.col("cost1"), F.col("cost1"), F.concat(F.lit("exit:"), "exit_reason"))
    # at most an exit and an entry per bar; events in the order in which they happen
    events = opened.unionByName(closed).groupBy(*KEYS, "idx").agg(F.sum("flow").alias("flow"), F.sum("cost").alias("costs_this_bar"), F.array_join(F.array_sort(F.collect_list("event")), ";").alias("trade_event"))
    held = done.where("exit_index > entry_index").select(*KEYS, "direction", "qty_a", "qty_b", F.explode(F.sequence("entry_index", F.col("exit_index") - 1)).alias("idx"))
    out = rows.select(*KEYS, "idx", "date", "price_a", "price_b", "beta", "spread", "z", "capital").join(events, [*KEYS, "idx"], "left").join(held, [*KEYS, "idx"], "left")
    out = out.fillna(0.0, ["flow", "costs_this_bar", "qty_a", "qty_b"]).fillna("", ["trade_event"]).fillna("flat", ["direction"])
    out = with_cash(out, config.accrual)
    before = F.when(F.col("idx") > 0, (F.col("cash") - F.col("flow")) / (1 + config.accrual))
    value = F.col("qty_a") * F.col("price_a") + F.col("qty_b") * F.col("price_b")
    return reconciled(out.select(
        *KEYS, "idx", "date", "price_a", "price_b", F.col("beta").alias("hedge_ratio"), "spread", F.col("z").alias("zscore"), F.col("direction").alias("position"), "qty_a", "qty_b", "cash", value.alias("position_value"),
        (F.col("cash") + value).alias("nav"), "costs_this_bar", F.coalesce(before * F.lit(config.accrual), F.lit(0.0)).alias("interest_this_bar"), "trade_event",
    ))


def with_gap(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """``bars`` with ``gap``: by how much the value of a bar differs from that of the one before and what came of positions held into
    it, interest and costs; 0 at the first. Blocks of bars are looked at apart, each with the last bar of the one before."""
    number = F.floor(F.col("idx") / block).cast("long")
    twice = bars.withColumn("_block", F.explode(F.when(F.pmod(F.col("idx"), F.lit(block)) == block - 1, F.array(number, number + 1)).otherwise(F.array(number))))
    w = Window.partitionBy(*KEYS, "_block").orderBy("idx")
    moved = F.lag("qty_a").over(w) * (F.col("price_a") - F.lag("price_a").over(w)) + F.lag("qty_b").over(w) * (F.col("price_b") - F.lag("price_b").over(w))
    gap = F.col("nav") - F.lag("nav").over(w) - moved - F.col("interest_this_bar") + F.col("costs_this_bar")
    return twice.withColumn("gap", F.coalesce(gap, F.lit(0.0))).where(F.col("_block") == number).drop("_block")


def broken(tolerance: float = 1e-6) -> Column:
    """Whether a bar's accounts don't add up; large values are allowed their last digits."""
    allowed = F.greatest(F.lit(tolerance), F.abs("nav") * 1e-12)
    return (F.abs("gap") > allowed) | (F.abs(F.col("nav") - F.col("cash") - F.col("position_value")) > allowed)


def reconciled(bars: DataFrame) -> DataFrame:
    """``bars`` whose value raises where the accounts don't add up: a part of the plan that reads or writes them, not a job of its own."""
    message = F.format_string("accounts of %s %s don't add up at bar %d: %.6f too much", "pair_id", "label", "idx", "gap")
    return with_gap(bars).withColumn("nav", F.when(broken(), F.raise_error(message).cast("double")).otherwise(F.col("nav"))).drop("gap")


def run(signal_rows: DataFrame, config: Config, label: str = "base", keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, trades, audit) of one parameter set over all pairs of ``signal_rows``. Only the trades are computed at once; with ``keep``
    also the audit, for those who read it several times."""
    rows = with_config(signal_rows, [config.row(label)])
    done = cut(trades(path(rows), rows))
    bars = audit(rows, done, config)
    return rows, done, cut(bars) if keep else bars


def identity_violations(bars: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Bars whose value isn't cash plus position, or doesn't follow from the bar before."""
    return with_gap(bars).where(broken(tolerance)).select(*KEYS, "idx", "gap")


def next_bar_violations(bars: DataFrame, done: DataFrame, entry: float) -> DataFrame:
    """Entries whose bar before didn't ask for them."""
    z = bars.select(*KEYS, (F.col("idx") + 1).alias("entry_index"), F.col("zscore").alias("asked"))
    return done.join(z, [*KEYS, "entry_index"], "left").where(F.col("asked").isNull() | (F.abs("asked") < entry)).select(*KEYS, "entry_index", "asked")
