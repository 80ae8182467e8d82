"""Causal windows: trailing row frames only, full or null, and a check of plans for the contrary."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Collection, Iterator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MIN_STDDEV = 1e-10
MIN_VARIANCE = 1e-12


def trailing(k: int, *keys: str, lag: int = 0) -> WindowSpec:
    """The k rows that end ``lag`` rows before the current one."""
    if k < 1 or lag < 0:
        raise ValueError("a causal window has rows and ends at the current one at the latest")
    return Window.partitionBy(*(keys or ("pair_id",))).orderBy("idx").rowsBetween(-(k - 1) - lag, -lag)


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("pair_id",))).orderBy("idx")


def so_far(*keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)


def visible(x: str, *keys: str, k: int | None = None) -> Column:
    """The values up to the current row, oldest first, all or the last k; an array, so it grows with the series unless k is given."""
    return F.collect_list(x).over(trailing(k, *keys) if k else so_far(*keys))


def full(x: Column | str, value: Column, k: int, w: WindowSpec) -> Column:
    """``value`` where the frame holds k values of x, else null."""
    return F.when(F.count(x).over(w) == k, value)


def mean(x: str, k: int, *keys: str) -> Column:
    w = trailing(k, *keys)
    return full(x, F.avg(x).over(w), k, w)


def variance(x: str, k: int, *keys: str) -> Column:
    w = trailing(k, *keys)
    return full(x, F.var_samp(x).over(w), k, w)


def zscore(x: str, k: int, *keys: str, lag: int = 0) -> Column:
    """The frame's last value in standard deviations from its mean; null where it's flat."""
    w = trailing(k, *keys, lag=lag)
    last = F.lag(x, lag).over(ordered(*keys)) if lag else F.col(x)
    sd = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) == k) & (sd >= MIN_STDDEV), (last - F.avg(x).over(w)) / sd)


def correlation(x: str, y: str, k: int, *keys: str) -> Column:
    """Pearson; null where either side is flat. ``corr`` would raise on such a frame under ANSI rules."""
    w = trailing(k, *keys)
    scale = F.sqrt(F.var_pop(x).over(w) * F.var_pop(y).over(w))
    return F.when((F.count(F.col(x) + F.col(y)).over(w) == k) & (scale * k >= MIN_STDDEV), F.covar_pop(x, y).over(w) / scale)


def regression(y: str, x: str, k: int, *keys: str) -> dict[str, Column]:
    """alpha, beta and r2 of y on x over k rows; null where x is flat, r2 0 where y is."""
    w = trailing(k, *keys)
    ok = (F.count(F.col(x) + F.col(y)).over(w) == k) & (F.var_pop(x).over(w) >= MIN_VARIANCE)
    flat = F.var_pop(y).over(w) * k < MIN_VARIANCE
    return {
        "alpha": F.when(ok, F.regr_intercept(y, x).over(w)),
        "beta": F.when(ok, F.regr_slope(y, x).over(w)),
        "r2": F.when(ok, F.when(flat, F.lit(0.0)).otherwise(F.regr_r2(y, x).over(w))),
    }


class LookaheadError(ValueError):
    """A plan that reads rows after the current one."""


#: Columns that put rows in the order of time.
TIMES = frozenset({"idx", "date", "place"})
#: Checkpoints by the number of their RDD, and what their plans read ahead ('' for nothing): a checkpoint hides its plan.
CHECKPOINTS: dict[int, str] = {}


def tree(flat: list[dict], at: int = 0) -> tuple[dict, list, int]:
    """(node, children, place after them) of a node in a list of nodes in prefix order."""
    children, after = [], at + 1
    for _ in range(flat[at]["num-children"]):
        node, own, after = tree(flat, after)
        children.append((node, own))
    return flat[at], children, after


def trees(value) -> Iterator[list[dict]]:
    """All lists of nodes, plans and their expressions, in a plan's JSON."""
    if isinstance(value, list):
        if value and isinstance(value[0], dict) and "class" in value[0]:
            yield value
        for x in value:
            yield from trees(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from trees(x)


def name_of(node: dict) -> str:
    return node["class"].rpartition(".")[2].rstrip("$")


def bound(node: dict, children: list) -> float:
    """A frame's bound in rows after the current one."""
    kind = name_of(node)
    if kind == "UnaryMinus":
        return -bound(*children[0])
    fixed = {"UnboundedPreceding": -math.inf, "CurrentRow": 0.0, "UnboundedFollowing": math.inf}
    return fixed[kind] if kind in fixed else float(node["value"]) if kind == "Literal" else math.inf


def window_fault(children: list) -> str:
    """Why a window, given its partition and order columns and its frame, isn't causal; '' if it is."""
    orders = [(node, own) for node, own in children if name_of(node) == "SortOrder"]
    frame, bounds = children[-1]
    if name_of(frame) != "SpecifiedWindowFrame" or not orders:
        return "a window over rows in no order"
    by, column = orders[0][0], orders[0][1][0][0]
    if column.get("name") not in TIMES:
        return f"a window in the order of {column.get('name', name_of(column))}, which isn't a time"
    if name_of({"class": frame["frameType"]["object"]}) != "RowFrame":
        return "a frame by range, as rows of one time share it"
    lower, upper = (bound(*b) for b in bounds)
    descending = "Descending" in by["direction"]["object"]
    last = -lower if descending else upper
    return f"a frame that ends {last:g} rows after the current one" if last > 0 else ""


def lookahead(df: DataFrame, trusted: Collection[str] = ()) -> str:
    """What in the analysed plan of ``df`` reads rows after the current one; '' if nothing does.

    Every node of the plan's tree is looked at. Windows have frames of rows in ascending order of a time (TIMES) that end at the
    current row at the latest. Python functions over whole groups can't be looked into and count as reading ahead unless their
    name is ``trusted``; so does a checkpoint that :func:`tandem.functions.cut.cut` hasn't made. What joins and
    aggregates bring together isn't judged.
    """
    plan = df._jdf.queryExecution().analyzed()
    for flat in trees(json.loads(plan.toJSON())):
        for at, node in enumerate(flat):
            kind = name_of(node)
            if kind == "WindowSpecDefinition" and (fault := window_fault(tree(flat, at)[1])):
                return fault
            if re.match("FlatMap(Co)?Groups", kind):
                names = {n["name"] for x in trees(node.get("functionExpr")) for n in x if name_of(n) == "PythonUDF"}
                if not names or names - set(trusted):
                    return f"a Python function over groups, {', '.join(sorted(names)) or kind}"
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            rdd = leaf.rdd()
            if fault := CHECKPOINTS.get(rdd.id(), "a checkpoint of an unknown plan" if rdd.isCheckpointed() else ""):
                return fault
    return ""


def assert_causal(df: DataFrame, trusted: Collection[str] = ()) -> DataFrame:
    """``df``, if its plan doesn't read ahead; see :func:`lookahead`."""
    if fault := lookahead(df, trusted):
        raise LookaheadError(fault)
    return df
