"""Row numbers, running sums and previous rows inside groups of any size.

A window puts a whole group into one task. That is fine until one group holds a
large part of the table. Here the group sizes are estimated first; a group above
`rows_per_task` is cut into slices of its order, the window runs per slice, and
what the earlier slices contribute (a count, a sum or their last row) is added
from a table of one row per slice. Results are the same as those of the plain
window. Sizes and cut points come from samples, collected once: they decide the
balance of the work only, and being constants they are the same in every retry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import Sql, let

ROWS_PER_TASK = 4_000_000
# Bounds what is sampled, collected and broadcast: at most this many large groups,
# and at most twice as many slices of them.
MAX_SLICES = 20_000
SAMPLE_PER_SLICE = 20
SAMPLE_PER_GROUP = 400

_CUTS = "__cuts"
_SLICE = "__slice"
_KEY = "__group_"


@dataclass(frozen=True)
class Ordering:
    """Groups and a total order inside them (the last order column breaks all ties).

    With rows_per_task=None, for callers who know that every group fits a task, nothing is measured.
    """

    groups: tuple[str, ...]
    order: tuple[str, ...]
    rows_per_task: int | None = ROWS_PER_TASK

    @property
    def position(self) -> Sql:
        return f"struct({', '.join(self.order)})"

    @property
    def keys(self) -> list[str]:
        return [_KEY + c for c in self.groups]

    @property
    def same_group(self) -> Sql:
        return " AND ".join(f"{c} <=> {_KEY}{c}" for c in self.groups)

    def over(self, *more_keys: str, frame: str = "") -> Sql:
        keys, order = ", ".join(self.groups + more_keys), ", ".join(self.order)
        return f"OVER (PARTITION BY {keys} ORDER BY {order} {frame})"

    def over_slices(self, frame: str = "") -> Sql:
        return f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {_SLICE} {frame})"


def large_groups(df: DataFrame, by: Ordering) -> tuple[DataFrame, int] | None:
    """(keys of the large groups with rows and slices of each, number of slices), or None.

    Sizes are estimated from a sample of the keys, in which a group at the threshold
    has about SAMPLE_PER_GROUP rows; that spares a shuffle of all keys. At most
    MAX_SLICES rows, the largest groups first, reach the driver; the threshold is
    raised where needed to keep the number of slices near that too.
    """
    fraction = min(1.0, SAMPLE_PER_GROUP / by.rows_per_task)
    keys = df.select(*by.groups)
    if fraction < 1.0:
        keys = keys.sample(fraction=fraction, seed=7)
    counts = keys.groupBy(*by.groups).agg(F.expr(f"CAST(count(1) / {fraction!r}D AS BIGINT) AS __n"))
    over = counts.filter(f"__n > {by.rows_per_task}")
    largest = over.orderBy(F.desc("__n")).limit(MAX_SLICES).collect()
    if not largest:
        return None
    limit = max(by.rows_per_task, -(-sum(r["__n"] for r in largest) // MAX_SLICES))
    rows = [r for r in largest if r["__n"] > limit]
    if not rows:
        return None
    keyed = df.sparkSession.createDataFrame(rows, over.schema).selectExpr(
        *[f"{c} AS {_KEY}{c}" for c in by.groups], "__n", f"CAST(ceil(__n / {limit}) AS INT) AS __slices")
    return keyed, sum(-(-r["__n"] // limit) for r in rows)


def _cut_points(df: DataFrame, by: Ordering, keyed: DataFrame, slices: int) -> DataFrame:
    """Large group -> sorted array of order structs at which a new slice starts."""
    total = keyed.agg(F.sum("__n")).first()[0]
    sampled = (
        df.select(*dict.fromkeys(by.groups + by.order))
        .join(F.broadcast(keyed), F.expr(by.same_group), "inner")
        .sample(fraction=min(1.0, SAMPLE_PER_SLICE * slices / total), seed=11)
        .groupBy(*by.keys, "__slices")
        .agg(F.expr(f"sort_array(collect_list({by.position})) AS s"))
    )
    cuts = ("transform(sequence(1, greatest(__slices - 1, 1)), "
            "i -> get(s, CAST(floor(i * size(s) / __slices) AS INT)))")
    picked = sampled.selectExpr(*by.keys, f"filter({cuts}, cut -> cut IS NOT NULL) AS {_CUTS}")
    return df.sparkSession.createDataFrame(picked.collect(), picked.schema)


def _slice_of(position: Sql) -> Sql:
    """Number of cut points at or below the position, found by bisection."""
    middle = "CAST(floor((b.lo + b.hi) / 2) AS INT)"
    right = f"get({_CUTS}, {middle}) <= {position}"
    halve = (f"named_struct('lo', IF(b.lo < b.hi AND {right}, {middle} + 1, b.lo), "
             f"'hi', IF(b.lo < b.hi AND NOT {right}, {middle}, b.hi))")
    rounds = f"sequence(1, {MAX_SLICES.bit_length() + 1})"
    found = f"aggregate({rounds}, named_struct('lo', 0, 'hi', size({_CUTS})), (b, step) -> {halve})"
    return f"IF({_CUTS} IS NULL, 0, {let('at', found, 'at.lo')})"


def sliced(df: DataFrame, by: Ordering, measured: DataFrame | None = None) -> DataFrame | None:
    """`df` with a slice number per row, or None when every group fits one task.

    `measured` is what group sizes and cut points are taken from, where a cheaper
    DataFrame holds at least the same groups and positions.
    """
    if by.rows_per_task is None:
        return None
    source = df if measured is None else measured
    large = large_groups(source, by)
    if large is None:
        return None
    cuts = _cut_points(source, by, *large)
    return (
        df.join(F.broadcast(cuts), F.expr(by.same_group), "left")
        .withColumn(_SLICE, F.expr(_slice_of(by.position)))
    )


def _earlier(parts: DataFrame, by: Ordering, summary: Sql, of_earlier: Sql) -> DataFrame:
    """What the slices before each slice contribute; at most 2 * MAX_SLICES rows."""
    per_slice = parts.filter(f"{_CUTS} IS NOT NULL").groupBy(*by.keys, _SLICE).agg(
        F.expr(f"{summary} AS __summary"))
    return per_slice.selectExpr(*by.keys, f"{_SLICE} AS __right_slice", f"{of_earlier} AS __before")


def _attach(parts: DataFrame, by: Ordering, earlier: DataFrame) -> DataFrame:
    return parts.drop(*by.keys, _CUTS).join(
        F.broadcast(earlier), F.expr(f"{by.same_group} AND {_SLICE} = __right_slice"), "left")


def with_running_sum(df: DataFrame, by: Ordering, value: Sql, name: str,
                     inclusive: bool = True, measured: DataFrame | None = None) -> DataFrame:
    """Sum of an integer `value` over the rows up to this one (or up to the one before)."""
    frame = f"ROWS BETWEEN UNBOUNDED PRECEDING AND {'CURRENT ROW' if inclusive else '1 PRECEDING'}"
    parts = sliced(df, by, measured)
    if parts is None:
        return df.withColumn(name, F.expr(f"coalesce(sum({value}) {by.over(frame=frame)}, 0L)"))
    earlier = _earlier(
        parts, by, f"sum({value})",
        f"sum(__summary) {by.over_slices('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}")
    local = parts.withColumn("__local", F.expr(f"sum({value}) {by.over(_SLICE, frame=frame)}"))
    return _attach(local, by, earlier).selectExpr(
        *df.columns, f"coalesce(__local, 0L) + coalesce(__before, 0L) AS {name}")


def with_row_number(df: DataFrame, by: Ordering, name: str, measured: DataFrame | None = None) -> DataFrame:
    """1, 2, 3, ... inside each group."""
    return with_running_sum(df, by, "1L", name, measured=measured)


def with_previous(df: DataFrame, by: Ordering, columns: list[str], name: str, measured: DataFrame | None = None) -> DataFrame:
    """Struct of `columns` of the row before this one in its group, NULL on the first row."""
    kept = f"struct({', '.join(columns)})"
    parts = sliced(df, by, measured)
    if parts is None:
        return df.withColumn(name, F.expr(f"lag({kept}) {by.over()}"))
    earlier = _earlier(parts, by, f"max_by({kept}, {by.position})", f"lag(__summary) {by.over_slices()}")
    local = parts.withColumn("__local", F.expr(f"lag({kept}) {by.over(_SLICE)}"))
    return _attach(local, by, earlier).selectExpr(*df.columns, f"coalesce(__local, __before) AS {name}")
