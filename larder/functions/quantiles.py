"""Exact, linearly interpolated quantiles by splitters, for all columns at once.

The built-in exact `percentile` keeps every distinct value of a group in one buffer, and
`percentile_approx` is not exact. Here three passes over the rows find all wanted quantiles of all columns:

1. a mergeable sketch per column gives, for each wanted rank, a value below and a value above it;
2. one wide aggregate counts what lies below and between each such pair of splitters, and so
   proves that the rank lies between them;
3. the distinct values between the splitters are counted, and the two wanted ones picked.

A task of the last pass sorts at most MOST_VALUES distinct values per rank. Where more lie between two
splitters (from about 2 * 10**9 rows on, if all are different), they are split again by passes 1 and 2 over what
lies between, which leaves three or four of 64 parts; many equal values need no more room than one.

Without keys the splitters are literals in the plan, so no join is made; with keys they are one row per
group, joined on the keys, which adaptive execution broadcasts or splits by size. The passes run when the
function is called. Counts do not depend on the order of rows; splitters may, but the result does not.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from larder.session import durable

ACCURACY = 4000  # a sketch's rank is off by at most its rows / ACCURACY
MOST_VALUES = 1 << 20
ROUNDS = 12
STEPS = 64  # of the ladder that narrows splitters
STATE = {"lo": "array<double>", "hi": "array<double>", "n": "array<bigint>", "below": "array<bigint>",
         "inside": "array<bigint>", "distinct": "array<bigint>"}


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                    most_values: int = MOST_VALUES, accuracy: int = ACCURACY) -> DataFrame:
    """Columns keys, n, quantiles (array in the order of probs); NULL, NaN and NULL keys are ignored."""
    found = _quantiles(df, [value], probs, list(keys), most_values, accuracy)
    return found.select(*keys, "n", "quantiles")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     most_values: int = MOST_VALUES, accuracy: int = ACCURACY) -> DataFrame:
    """Columns column_name, n, quantiles for the numeric columns of a table that have a value."""
    return _quantiles(df, list(columns), probs, [], most_values, accuracy)


def quantile(df: DataFrame, value: str, p: float) -> float | None:
    """A quantile of a whole table as a number; None where there is no value."""
    row = exact_quantiles(df, value, [p]).first()
    return row.quantiles[0] if row else None


def _quantiles(df: DataFrame, columns: list[str], probs: Sequence[float], keys: list[str],
               most_values: int, accuracy: int) -> DataFrame:
    """column_name, keys, n, quantiles."""
    most_values = max(most_values, 4 * STEPS)  # splitters of one step have a few values between
    wanted = [(k, float(p)) for k in range(len(columns)) for p in probs]  # one splitter pair for each
    kinds = dict(df.dtypes)
    rows = df.select(*keys, *[_number(c, kinds[c]).alias(f"v{k}") for k, c in enumerate(columns)])
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    if len(columns) == 1:
        rows = rows.where("v0 IS NOT NULL")
    state = _kept(_sketched(rows, wanted, keys, accuracy), keys)
    for _ in range(ROUNDS):
        state = _kept(_counted(rows, state, wanted, keys), keys)
        if not _many(state, most_values):
            break
        state = _kept(_narrowed(rows, state, wanted, keys, accuracy, most_values), keys)
    else:
        raise RuntimeError("the splitters have not come close enough")
    return _picked(rows, state, wanted, keys, columns, len(probs))


def _number(column: str, kind: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value) if kind in ("double", "float") else value


# The state is one row per group: a table with keys, and without keys a Row, whose numbers become literals.
State = DataFrame | Row


def _kept(state: DataFrame, keys: list[str]) -> State:
    typed = state.select(*keys, *[F.col(c).cast(kind).alias(c) for c, kind in STATE.items()])
    return durable(typed, "splitters") if keys else typed.first()


def _beside(rows: DataFrame, state: State, keys: list[str]) -> DataFrame:
    return rows.join(state, keys) if keys else rows


def _ref(state: State, name: str, j: int) -> str:
    """A number of the state as SQL text."""
    if isinstance(state, DataFrame):
        return f"get({name}, {j})"
    return _literal(state[name][j], STATE[name])


def _literal(value: float | int | None, kind: str) -> str:
    if value is None:
        return f"cast(NULL AS {'double' if 'double' in kind else 'bigint'})"
    return f"double('{value!r}')" if "double" in kind else f"{value}L"


def _array(items: Iterable[str], name: str) -> Column:
    return F.expr(f"array({', '.join(items)})").alias(name)


def _whole(state: State, name: str) -> str:
    """A list of the state as SQL text, within an aggregate by its keys."""
    if isinstance(state, DataFrame):
        return f"first({name})"
    return f"array({', '.join(_literal(x, STATE[name]) for x in state[name])})"


def _sketched(rows: DataFrame, wanted: list, keys: list[str], accuracy: int) -> DataFrame:
    """Pass 1: for each wanted rank a value at most at it and one at least at it."""
    slack = 2.0 / accuracy
    shares: dict[int, list[float]] = {}
    for k, p in wanted:
        shares.setdefault(k, []).extend([max(0.0, p - slack), min(1.0, p + slack)])
    drawn = rows.groupBy(*keys).agg(*[
        x for k, of in shares.items()
        for x in (F.percentile_approx(f"v{k}", of, accuracy).alias(f"s{k}"), F.count(f"v{k}").alias(f"n{k}"))])
    each = len(wanted) // len(shares)  # all columns have the same ranks
    zeros = ["0L" for _ in wanted]
    return drawn.select(
        *keys, _array((f"get(s{k}, {2 * (j % each)})" for j, (k, _) in enumerate(wanted)), "lo"),
        _array((f"get(s{k}, {2 * (j % each) + 1})" for j, (k, _) in enumerate(wanted)), "hi"),
        _array((f"n{k}" for k, _ in wanted), "n"), *[_array(zeros, c) for c in ("below", "inside", "distinct")])


def _counted(rows: DataFrame, state: State, wanted: list, keys: list[str]) -> DataFrame:
    """Pass 2: rows below and between the splitters; splitters that miss their rank are drawn out to the ends."""
    ends = [(f"v{k}", _ref(state, "lo", j), _ref(state, "hi", j)) for j, (k, _) in enumerate(wanted)]
    counts = _beside(rows, state, keys).groupBy(*keys).agg(
        *[F.expr(_whole(state, c)).alias(c) for c in ("lo", "hi", "n")],
        _array((f"count_if({v} < {lo})" for v, lo, _ in ends), "below"),
        _array((f"count_if({v} BETWEEN {lo} AND {hi})" for v, lo, hi in ends), "inside"),
        _array((f"approx_count_distinct(CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {v} END)" for v, lo, hi in ends), "distinct"))
    met = [f"floor((n[{j}] - 1) * double('{p}')) >= below[{j}] AND ceil((n[{j}] - 1) * double('{p}')) < below[{j}] + inside[{j}]"
           for j, (_, p) in enumerate(wanted)]

    def otherwise(name: str, value: str) -> Column:
        return _array((f"CASE WHEN {met[j]} THEN {name}[{j}] ELSE {value.format(j)} END" for j in range(len(wanted))), name)

    return counts.select(
        *keys, otherwise("lo", "double('-inf')"), otherwise("hi", "double('inf')"), "n", otherwise("below", "0L"),
        otherwise("inside", "n[{0}]"), otherwise("distinct", f"{1 << 62}L"))


def _settled(most_values: int, j: int) -> str:
    return f"(n[{j}] = 0 OR lo[{j}] = hi[{j}] OR distinct[{j}] <= {most_values})"


def _many(state: State, most_values: int) -> bool:
    """Whether some splitters have too many values between."""
    if isinstance(state, Row):
        return any(n and lo != hi and d > most_values for n, lo, hi, d in zip(state.n, state.lo, state.hi, state.distinct))
    several = "exists(arrays_zip(lo, hi, n, distinct), s -> s.n > 0 AND s.lo <> s.hi AND s.distinct > {})"
    return not state.where(several.format(most_values)).isEmpty()


def _narrowed(rows: DataFrame, state: State, wanted: list, keys: list[str], accuracy: int, most_values: int) -> DataFrame:
    """Pass 1 again over what lies between splitters that are too far apart: a ladder of ranks, of which the steps around
    the wanted ones are taken."""
    shares = ", ".join(f"double('{i / STEPS}')" for i in range(STEPS + 1))
    between = [f"CASE WHEN v{k} BETWEEN {_ref(state, 'lo', j)} AND {_ref(state, 'hi', j)} THEN v{k} END"
               for j, (k, _) in enumerate(wanted)]
    drawn = _beside(rows, state, keys).groupBy(*keys).agg(
        *[F.expr(_whole(state, c)).alias(c) for c in STATE],
        *[F.expr(f"percentile_approx({x}, array({shares}), {accuracy})").alias(f"ladder{j}") for j, x in enumerate(between)])
    lo, hi = [], []
    for j, (_, p) in enumerate(wanted):
        place = f"double({STEPS}) * ({{}}((n[{j}] - 1) * double('{p}')) - below[{j}]) / greatest(inside[{j}] - 1, 1)"
        lower, upper = f"greatest(floor({place.format('floor')}) - 1, 0)", f"least(ceil({place.format('ceil')}) + 1, {STEPS})"
        for out, name, step in ((lo, "lo", lower), (hi, "hi", upper)):
            out.append(f"CASE WHEN {_settled(most_values, j)} THEN {name}[{j}] ELSE get(ladder{j}, int({step})) END")
    return drawn.select(*keys, _array(lo, "lo"), _array(hi, "hi"), "n", "below", "inside", "distinct")


def _picked(rows: DataFrame, state: State, wanted: list, keys: list[str], columns: list[str], n_probs: int) -> DataFrame:
    """Pass 3: the values at the wanted ranks. Splitters that are equal are the answer themselves."""
    hits = ", ".join(
        f"struct({j} AS j, CASE WHEN {lo} < {hi} AND v{k} BETWEEN {lo} AND {hi} THEN v{k} END AS v)"
        for j, (k, _) in enumerate(wanted) for lo, hi in [(_ref(state, "lo", j), _ref(state, "hi", j))])
    met = _beside(rows, state, keys).select(*keys, F.expr(f"inline(filter(array({hits}), h -> h.v IS NOT NULL))"))
    values = met.groupBy(*keys, "j", "v").agg(F.count("*").alias("rows"))
    order = Window.partitionBy(*keys, "j").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lists = {c: c if keys else _whole(state, c) for c in ("n", "below")}
    placed = _beside(values, state, keys).withColumn("place", F.expr(
        f"(get({lists['n']}, j) - 1) * get(array({', '.join(repr(p) + 'D' for _, p in wanted)}), j)"
    )).withColumn("before", F.expr(f"get({lists['below']}, j)") + F.coalesce(F.sum("rows").over(order), F.lit(0)))
    ends = placed.groupBy(*keys, "j").agg(*[
        F.expr(f"max(CASE WHEN {f}(place) >= before AND {f}(place) < before + rows THEN v END)").alias(name)
        for f, name in (("floor", "a"), ("ceil", "b"))])
    if not keys:  # two numbers for each wanted rank
        return _interpolated(state, {r.j: (r.a, r.b) for r in ends.collect()}, wanted, columns, n_probs, rows.sparkSession)
    one = ends.groupBy(*keys).agg(F.expr("map_from_entries(collect_list(struct(j, struct(a, b))))").alias("found"))
    parts = ", ".join(f"""CASE WHEN lo[{j}] = hi[{j}] THEN lo[{j}] WHEN found[{j}].a = found[{j}].b THEN found[{j}].a
        ELSE found[{j}].a + (found[{j}].b - found[{j}].a) * ((n[{j}] - 1) * double('{p}') - floor((n[{j}] - 1) * double('{p}'))) END"""
                      for j, (_, p) in enumerate(wanted))
    return state.join(one, keys, "left").where("n[0] > 0").select(
        *keys, F.expr("n[0]").alias("n"), F.expr(f"array({parts})").alias("quantiles"))


def _interpolated(state: Row, found: dict, wanted: list, columns: list[str], n_probs: int, spark: SparkSession) -> DataFrame:
    """The result of a table without keys: a row per column that has a value."""
    rows = []
    for k, c in enumerate(columns):
        quantiles = []
        for j in range(k * n_probs, (k + 1) * n_probs):
            low, high = (state.lo[j],) * 2 if state.lo[j] == state.hi[j] else found.get(j, (None, None))
            place = (state.n[j] - 1) * wanted[j][1]
            quantiles.append(low if low == high else low + (high - low) * (place - math.floor(place)))
        if state.n[k * n_probs]:
            listed = ", ".join(_literal(q, "double") for q in quantiles)
            rows.append(f"struct('{c}' AS column_name, {state.n[k * n_probs]}L AS n, array({listed}) AS quantiles)")
    none = "struct('' AS column_name, 0L AS n, array(double(0)) AS quantiles)"
    return spark.range(1).select(F.expr(f"inline(array({', '.join(rows) or none}))")).where("n > 0")
