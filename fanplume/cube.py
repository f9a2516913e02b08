"""A labelled array as a tidy DataFrame: one row per cell, one column per dimension and per value."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanplume.functions import clock
from fanplume.functions.missing import modulo, num, power, sqrt, where
from fanplume.functions.units import HOURS, product, quotient
from fanplume.functions.units import power as unit_power
from fanplume.operators.reduce import BY_NAME, DT, Aggregate

#: Dimensions in the order that results show them.
ORDER = ("model", "member", "time", "hour", "route", "lat", "lon", "point", "distance_bin", "quantile")
#: Values that a sum over time makes little sense of, and those that are compass directions, by the names that tables
#: give them; from there on they are known by the trait of their column, whatever it is called.
STATES = {"t2m", "td2m", "rh", "feels_like", "wind", "gust", "cloud", "cape"}
DIRECTIONS = {"wind_dir"}
STATE, DIRECTION = "state", "direction"
#: Aggregates of a state that are a state of the same kind.
LINEAR = {"mean", "min", "max", "quantile"}
#: Cells that a cube may have to be repeated over another.
SMALL = 10_000
#: Samples that a rolling window may span, and cells that a ranking may name.
LONGEST, MOST_RANKED = 384, 100


@dataclass(frozen=True)
class Cube:
    """`df` has the columns `dims`, `values`, and `dt` (hours per sample) while time is a dimension.

    Labels are in their natural order, unless a dimension is `placed`: then `<dim>_pos` holds their positions.
    It is dense: there is a row for each combination of labels, and a missing value is NULL. Everything is lazy;
    elementwise work on one cube adds columns to one DataFrame and never joins it with itself.
    """

    df: DataFrame
    dims: tuple[str, ...]
    values: tuple[str, ...]
    units: dict[str, str] = field(default_factory=dict)
    notes: tuple[str, ...] = ()
    #: Of a cube whose scan can be bounded: the same for the samples from a time and before another, which the scan then
    #: reads alone. Windows and buckets ask for as much more as they need.
    within: Callable[[datetime | None, datetime | None], Cube] | None = None
    #: What is known of values besides their units: STATE, DIRECTION. Both also go along as metadata of the columns, so
    #: a value that is selected, joined or given another name keeps them; what is computed from it has none.
    traits: dict[str, frozenset[str]] = field(default_factory=dict)
    #: One row with an array of the labels of each dimension in `known`, in any order.
    labels: DataFrame | None = None
    known: tuple[str, ...] = ()
    #: Dimensions in an order of their own.
    placed: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        schema, told = self.df.schema, {}
        units, traits = ({v: x for v, x in own.items() if v in self.values} for own in (self.units, self.traits))
        for f in (f for f in schema if f.name in self.values):
            own = f.metadata or {}
            if "unit" in own:
                units.setdefault(f.name, own["unit"])
            traits.setdefault(f.name, frozenset(own.get("traits", ())))
            known = ({"unit": units[f.name]} if f.name in units else {}) | ({"traits": sorted(traits[f.name])} if traits[f.name] else {})
            if known != {k: own[k] for k in ("unit", "traits") if k in own}:
                told[f.name] = {k: v for k, v in own.items() if k not in ("unit", "traits")} | known
        object.__setattr__(self, "units", units)
        object.__setattr__(self, "traits", traits)
        if told:
            object.__setattr__(self, "df", self.df.select(*(F.col(f"`{c}`").alias(c, metadata=told[c]) if c in told else F.col(f"`{c}`") for c in schema.names)))

    @classmethod
    def dense(cls, cells: DataFrame, dims: Iterable[str], values: Iterable[str], hours: float = 1.0, **units: str) -> Cube:
        """A cube of all combinations of the labels that occur in `cells`."""
        return cls.over(cls.grid(cells, dims), cells, dims, values, hours, **units)

    @staticmethod
    def grid(cells: DataFrame, dims: Iterable[str]) -> DataFrame:
        """All combinations of the labels that occur in `cells`.

        The labels of each dimension, which are few, are gathered in one row by partial aggregates.
        """
        return Cube.unfolded(cells.agg(*(F.collect_set(d).alias(d) for d in dims)), dims)

    @staticmethod
    def unfolded(labels: DataFrame, dims: Iterable[str]) -> DataFrame:
        """All combinations of the labels in a row of arrays: time is unfolded first, or two dimensions where there is
        none, so that the rest unfolds in parallel."""
        dims = sorted(dims, key=lambda d: d != "time")
        first = dims[:1] if "time" in dims else dims[:2]
        grid = labels.select(*dims)
        for d in dims:
            grid = grid.withColumn(d, F.explode(d))
            if d == first[-1]:
                grid = grid.repartition(*first)
        return grid

    @classmethod
    def over(cls, grid: DataFrame, cells: DataFrame, dims: Iterable[str], values: Iterable[str], hours: float = 1.0, **units: str) -> Cube:
        """A cube of the combinations of `grid`, with the values that `cells` has for them."""
        dims, values = tuple(dims), tuple(values)
        df = grid.join(cells.select(*dims, *values), list(dims), "left").select(*dims, *values)
        df = df.withColumn(DT, F.lit(hours)) if "time" in dims else df
        traits = {v: frozenset([STATE] * (v in STATES) + [DIRECTION] * (v in DIRECTIONS)) for v in values}
        return cls(df, tuple(sorted(dims, key=ORDER.index)), values, units, traits=traits)

    def _with(self, df: DataFrame, **changes) -> Cube:
        out = dataclasses.replace(self, df=df, **({"within": None} | changes))
        return dataclasses.replace(out, placed=tuple(d for d in out.placed if d in out.dims), known=tuple(d for d in out.known if d in out.dims))

    def _bounded(self, made: Cube, again: Callable[[Cube], Cube], widened: Callable | None = None) -> Cube:
        """`made` of this cube, with bounds of time that go through to this cube's scan."""
        if not self.within or "time" not in made.dims or "time" in made.placed:
            return made
        return dataclasses.replace(made, within=lambda a, b: again(self.within(*(widened(a, b) if widened else (a, b)))))

    def _aux(self) -> list[str]:
        return [*([DT] if "time" in self.dims else []), *(f"{d}_pos" for d in self.placed)]

    def at(self, dim: str) -> Column:
        """What the labels of a dimension are ordered by."""
        return F.col(f"{dim}_pos" if dim in self.placed else dim)

    def _kept(self, dims: Iterable[str]) -> list[Column]:
        """Aggregates that keep the positions of these dimensions."""
        return [F.first(f"{d}_pos").alias(f"{d}_pos") for d in dims if d in self.placed]

    def _without(self, dim: str) -> list[str]:
        """The columns that go with a dimension."""
        return [dim, f"{dim}_pos", *([DT] if dim == "time" else [])]

    # elementwise

    def let(self, **columns: Column) -> Cube:
        """Add values computed from others of the same cell. Another name for a value keeps its unit and traits; of what is
        computed they aren't known (`combine`, `raised`, `root`, `scaled`, `turned` and `wave` do know), and a replaced
        value loses its own."""
        units, traits = ({v: x for v, x in own.items() if v not in columns} for own in (self.units, self.traits))
        out = self._with(self.df.withColumns(columns), values=tuple(dict.fromkeys([*self.values, *columns])), units=units, traits=traits)
        return self._bounded(out, lambda c: c.let(**columns))

    def only(self, *values: str) -> Cube:
        out = self._with(self.df.select(*self.dims, *values, *self._aux()), values=values)
        return self._bounded(out, lambda c: c.only(*values))

    def where(self, condition: Column, other: float | None = None) -> Cube:
        """Mask all values; cells stay."""
        masked = {v: where(condition, F.col(v), other) for v in self.values}
        return self._bounded(self._with(self.df.withColumns(masked)), lambda c: c.where(condition, other))

    # selections

    def axis(self, dim: str) -> DataFrame:
        """The labels of a dimension in order, and their positions."""
        if dim in self.known and dim not in self.placed:
            return self.labels.select(F.posexplode(F.sort_array(dim)).alias("pos", dim)).select(dim, "pos")
        labels = self.df.select(dim, self.at(dim).alias("__at")).distinct()
        return labels.select(dim, (F.row_number().over(Window.orderBy("__at")) - 1).alias("pos"))

    def _place(self, df: DataFrame, dim: str) -> Cube:
        """This cube with the rows `df`, which hold new positions of a dimension as `__new`."""
        return self._with(df.withColumn(f"{dim}_pos", F.col("__new")).drop("__new"), placed=tuple(dict.fromkeys([*self.placed, dim])), known=tuple(d for d in self.known if d != dim))

    def sortby(self, key: Cube, ascending: bool = True) -> Cube:
        """The labels of the one dimension of `key` in the order of its value: missing ones last, ties as they were.

        What follows goes by that order: rolling windows, positions, ties of ranks and the rows of sinks. Labels that
        `key` doesn't have go. The key is an axis with a value, so few rows, and Spark sees that when it joins them.
        """
        if len(key.dims) != 1 or key.dims[0] not in self.dims or len(key.values) != 1:
            raise ValueError("a sort key has one value and one dimension, which the cube has too")
        dim = key.dims[0]
        own = key.sorted_positions(dim, key.values[0], ascending).select(dim, F.col("pos").alias("__new"))
        return self._place(self.df.join(own, dim), dim)

    def require(self, dim: str, labels: list) -> None:
        """An error that names the labels which the dimension doesn't have; reads the axis once."""
        own = self.axis(dim) if dim in self.known else self.df
        own = own.select(F.col(dim).alias("x")).distinct().filter(F.col("x").isin(labels))
        absent = set(labels) - {r["x"] for r in own.collect()}  # as many as were asked for
        if absent:
            raise ValueError(f"{dim} has no {', '.join(map(str, sorted(absent)))}")

    def sel(self, zone: str = "UTC", strict: bool = False, **labels) -> Cube:
        """By label. A scalar drops its dimension, a list keeps it in the order of the list; a slice of times is half-open, other slices include
        both ends; the text of a date is the whole local day. Labels are local to `zone` unless they have an offset.

        A stretch of time that is selected of a cube that was read, or that elementwise work, reductions over other
        dimensions, windows or buckets of time made of such a one, is all that the scan reads, and what these need
        around it. Labels that aren't there select nothing; with `strict` they are an error, and so is a slice that
        nothing lies in.
        """
        base = self
        if self.within and "time" in labels:
            span = _span(labels["time"], zone)
            base = dataclasses.replace(self.within(*span), units=self.units, notes=self.notes) if span else self
        df, dims, placed = base.df, self.dims, self.placed
        known = tuple(d for d in base.known if d not in labels)
        if strict:
            for dim, want in labels.items():
                day = dim == "time" and isinstance(want, str) and len(want) == 10
                if isinstance(want, slice) or day:
                    if not self.sel(zone, **{dim: want}).df.limit(1).count():
                        raise ValueError(f"nothing in this range of {dim}")
                else:
                    self.require(dim, [datetime.fromisoformat(str(clock.utc(x, zone))) if dim == "time" and isinstance(x, str) else x for x in (want if isinstance(want, list) else [want])])
        for dim, want in labels.items():
            c = F.col(dim)
            if dim == "time" and isinstance(want, str) and len(want) == 10:
                a, b = clock.local_day(want, zone)
                df = df.filter((c >= F.lit(a).cast("timestamp_ntz")) & (c < F.lit(b).cast("timestamp_ntz")))
            elif isinstance(want, slice):
                at = lambda x: _time(x, zone) if dim == "time" else F.lit(x)  # noqa: B023, E731
                if want.start is not None:
                    df = df.filter(c >= at(want.start))
                if want.stop is not None:
                    df = df.filter(c < at(want.stop) if dim == "time" else c <= at(want.stop))
            elif isinstance(want, list):
                asked = [_time(x, zone) if dim == "time" else F.lit(x) for x in want]
                df = df.filter(c.isin(asked))
                if len(want) > 1:
                    df = df.withColumn(f"{dim}_pos", F.array_position(F.array(*asked), c).cast("int") - 1)
                    placed = tuple(dict.fromkeys([*placed, dim]))
            else:
                df = df.filter(c == (_time(want, zone) if dim == "time" else want)).drop(*self._without(dim))
                dims = tuple(d for d in dims if d != dim)
        out = base._with(df, dims=dims, placed=placed, known=known)
        rest = {d: x for d, x in labels.items() if d != "time"}
        return out if "time" in labels else self._bounded(out, lambda c: c.sel(zone, **rest))

    def isel(self, strict: bool = False, **positions: int | list[int] | slice) -> Cube:
        """By position on the dimension's axis, which is small and broadcast; negative ones count from the end, and a
        list keeps its own order.

        Positions that aren't there select nothing; with `strict` they are an error.
        """
        out = self
        for dim, want in positions.items():
            if strict and not isinstance(want, slice):
                size = out.axis(dim).count()
                if wrong := [k for k in (want if isinstance(want, list) else [want]) if not -size <= k < size]:
                    raise ValueError(f"{dim} has {size} labels; no position {wrong[0]}")
            axis = out.axis(dim).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))
            pos, size = F.col("pos"), F.col("size")
            if isinstance(want, slice):
                low, high = (None if x is None else F.lit(x) if x >= 0 else size + x for x in (want.start, want.stop))
                low = F.lit(0) if low is None else low
                axis = axis.filter((pos >= low) & (pos < (size if high is None else high)) & ((pos - low) % (want.step or 1) == 0))
            else:
                axis = axis.filter(pos.isin(*([want] if isinstance(want, int) else want)) | (pos - size).isin(*([want] if isinstance(want, int) else want)))
            if isinstance(want, list) and want:
                listed = lambda p: F.nullif(F.array_position(F.array(*map(F.lit, want)), p.cast("int")), F.lit(0))
                axis = axis.select(dim, (F.coalesce(listed(pos), listed(pos - size)).cast("int") - 1).alias("__new"))
                out = out._place(out.df.join(F.broadcast(axis), dim), dim)
                continue
            df = out.df.join(F.broadcast(axis.select(dim)), dim, "left_semi")
            out = dataclasses.replace(out, known=tuple(d for d in out.known if d != dim))
            if isinstance(want, int):
                out = out._with(df.drop(*self._without(dim)), dims=tuple(d for d in out.dims if d != dim))
            else:
                out = out._with(df)
        if set(positions) <= {*self.known} - {"time", *self.placed}:  # the same labels of whatever stretch of time
            return self._bounded(out, lambda c: c.isel(**positions))
        return out

    # reductions

    def reduce(self, over: str | Iterable[str], **aggregates: Aggregate) -> Cube:
        """Aggregate over dimensions, all values in one pass."""
        gone = {over} if isinstance(over, str) else set(over)
        keep = tuple(d for d in self.dims if d not in gone)
        timed = "time" in gone
        columns = [a(timed).alias(n) for n, a in aggregates.items()]
        df = self.df.groupBy(*keep).agg(*columns, *self._kept(keep), *([F.first(DT).alias(DT)] if "time" in keep else []))
        units, notes, traits = self._described({n: (a.kind, a.of) for n, a in aggregates.items()}, timed)
        if {"model", "member"} <= gone:
            notes.append("members of all models are pooled, so models count by their numbers of members")
        elif "model" in gone and "member" in keep:
            notes.append("members of different models are put together by number, though they have nothing in common; reduce member first")
        made = Cube(df, keep, tuple(aggregates), units, tuple(dict.fromkeys(notes)), placed=tuple(d for d in self.placed if d in keep), traits=traits, labels=self.labels, known=tuple(d for d in self.known if d in keep))
        return self._bounded(made, lambda c: c.reduce(over, **aggregates))

    def _described(self, made: dict[str, tuple[str, str]], timed: bool) -> tuple[dict[str, str], list[str], dict[str, frozenset[str]]]:
        """Units, notes and traits of values made by an aggregate (kind) of a value, over time or not."""
        units, notes, traits = {}, list(self.notes), {}
        for name, (kind, of) in made.items():
            unit = "" if kind in ("count", "any", "all") else self.units.get(of)
            if kind == "sum" and timed and unit is not None:
                unit = product(unit, HOURS)
            if unit is not None:
                units[name] = unit
            own = self.traits.get(of, frozenset())
            traits[name] = own & {STATE} if kind in LINEAR or kind == "sum" and not timed else frozenset()
            if kind == "sum" and timed and STATE in own:
                notes.append(f"{name}: a sum over time of {of}, which is a state and not a rate")
            if DIRECTION in own and kind != "count":
                notes.append(f"{name}: {kind} of a direction; average its sine and cosine instead")
        return units, notes, traits

    def _over_time(self, df: DataFrame, how: str, made: tuple[str, ...], **changes) -> Cube:
        """This cube with values made by `how` over samples of time, and with their units and notes."""
        units, notes, traits = self._described({v: (how, v) for v in made}, True)
        kept, known = ({v: x for v, x in own.items() if v not in made and v in changes.get("values", self.values)} for own in (self.units, self.traits))
        return self._with(df, units=kept | units, traits=known | traits, notes=tuple(dict.fromkeys(notes)), **changes)

    def with_coverage(self, value: str) -> Cube:
        """This cube with a note on each model that has the value for a part of the time only. A job of its own, which
        brings one row a model to the driver."""
        has = self.df.groupBy("model", "time").agg((F.count(value) > 0).alias("has"))
        first, last = (f(F.when(F.col("has"), F.col("time"))).alias(n) for f, n in ((F.min, "first"), (F.max, "last")))
        parts = has.groupBy("model").agg(first, last, F.bool_and("has").alias("whole")).filter("NOT whole").orderBy("model").collect()
        notes = [f"{r['model']} covers only {r['first']} to {r['last']} of the selected time" if r["first"] else f"{r['model']} covers none of the selected time" for r in parts]
        return dataclasses.replace(self, notes=tuple(dict.fromkeys([*self.notes, *notes])))

    def unfold_quantiles(self, name: str, levels: list[float]) -> Cube:
        """Turn an array of quantiles into a dimension."""
        df = self.df.select(*self.dims, *self._aux(), F.posexplode_outer(name).alias("pos", name))
        df = df.withColumn("quantile", F.element_at(F.array(*map(F.lit, levels)), F.col("pos") + 1)).drop("pos")
        return self._with(df, dims=(*self.dims, "quantile"), values=(name,))

    # windows and groups of time

    def rolling(self, n: int, how: str, *values: str) -> Cube:
        """Over the last `n` samples in the order of time that the cube has; missing unless all of them are there.
        Sums and means are weighted by hours."""
        if not 1 <= n <= LONGEST:
            raise ValueError(f"a window spans 1 to {LONGEST} samples")
        w = Window.partitionBy(*(d for d in self.dims if d != "time")).orderBy(self.at("time")).rowsBetween(1 - n, 0)
        out = {}
        values = values or self.values
        for v in values:
            x = num(F.col(v))
            full = F.count(x).over(w) == n
            made = {
                "sum": lambda x=x: F.sum(x * F.col(DT)).over(w),
                "mean": lambda x=x: F.sum(x * F.col(DT)).over(w) / F.nullif(F.sum(DT).over(w), F.lit(0.0)),
                "max": lambda x=x: F.max(x).over(w),
                "min": lambda x=x: F.min(x).over(w),
            }[how]()
            out[v] = F.when(full, made)
        return self._bounded(self._over_time(self.df.withColumns(out), how, values), lambda c: c.rolling(n, how, *values), lambda a, b: (self._back(a, n - 1), b))

    def _back(self, at: datetime | None, n: int) -> datetime | None:
        """The label of time `n` samples before the first one from a time on; no bound if the axis isn't known."""
        if at is None or n == 0 or "time" not in self.known:
            return at if n == 0 else None
        earlier = F.filter(F.sort_array("time"), lambda x: x < F.lit(at).cast("timestamp_ntz"))
        found = self.labels.select(F.when(F.size(earlier) >= n, F.element_at(earlier, -n)).alias("at")).first()  # one value
        return found["at"] if found else None

    def rolling_between(self, n: int, how: str, start: str, stop: str, zone: str = "UTC", hours: float = 1.0) -> Cube:
        """`rolling` and then `.sel(time=slice(start, stop))`, reading only n - 1 samples more than asked for.

        Spark keeps a filter on time above the window, so the wider one is set below it, where it reaches the scan.
        """
        if self.within and "time" in self.known:
            return self.rolling(n, how).sel(zone, time=slice(start, stop))
        wide = clock.utc(start, zone) - timedelta(hours=hours * (n - 1))
        near = self.sel(time=slice(wide, clock.utc(stop, zone)))
        return near.rolling(n, how).sel(zone, time=slice(start, stop))

    def resample(self, hours: int, how: str, *values: str, zone: str = "UTC") -> Cube:
        """Over local buckets of `hours` (24 for days), labelled by their first sample."""
        keep = [d for d in self.dims if d != "time"]
        values = tuple(values or self.values)
        columns = [BY_NAME[how](v)(True).alias(v) for v in values]
        df = self.df.withColumn("__bucket", clock.bucket(F.col("time"), hours, zone)).groupBy(*keep, "__bucket")
        df = df.agg(F.min("time").alias("time"), *columns, *self._kept(keep), F.sum(DT).alias(DT)).drop("__bucket")
        made = self._over_time(df, how, values, values=values, placed=tuple(d for d in self.placed if d in keep), known=tuple(d for d in self.known if d != "time"))
        # A bucket is an hour longer than its hours at most, where clocks go back; those that the bounds cut lie outside.
        more = timedelta(hours=hours + 1)
        return self._bounded(made, lambda c: c.resample(hours, how, *values, zone=zone), lambda a, b: (a and a - more, b and b + more))

    def by_hour(self, how: str, *values: str, zone: str = "UTC") -> Cube:
        """Over all samples of the same local hour of day."""
        keep = [d for d in self.dims if d != "time"]
        values = tuple(values or self.values)
        columns = [BY_NAME[how](v)(True).alias(v) for v in values]
        df = self.df.groupBy(*keep, F.hour(clock.local(F.col("time"), zone)).alias("hour")).agg(*columns, *self._kept(keep))
        return self._over_time(df, how, values, dims=tuple(sorted([*keep, "hour"], key=ORDER.index)), values=values)

    # ranks

    def extreme_label(self, dim: str, value: str, largest: bool = True, name: str = "label") -> Cube:
        """The label of the greatest (or least) value along a dimension: the first one of several in the dimension's order,
        missing if all are."""
        keep = tuple(d for d in self.dims if d != dim)
        x = num(F.col(value))
        rank = F.struct((-x if largest else x).alias("x"), self.at(dim).alias("at"), F.col(dim).alias("label"))
        df = self.df.groupBy(*keep).agg(F.min(F.when(x.isNotNull(), rank))["label"].alias(name), *self._kept(keep))
        return Cube(df, keep, (name,), {}, self.notes, placed=tuple(d for d in self.placed if d in keep))

    def top(self, n: int, by: str, ascending: bool = False) -> DataFrame:
        """The first n cells by a value, MOST_RANKED at most, missing ones last, ties in the order of the dimensions."""
        if not 1 <= n <= MOST_RANKED:
            raise ValueError(f"a ranking names 1 to {MOST_RANKED} cells")
        key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
        return self.df.orderBy(key, *map(self.at, self.dims)).limit(n).select(*self.dims, *self.values)

    def sorted_positions(self, dim: str, by: str, ascending: bool = True) -> DataFrame:
        """A one-dimensional cube with the positions its labels take when sorted by a value; missing ones come last."""
        key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
        return self.df.select(dim, by, (F.row_number().over(Window.orderBy(key, self.at(dim))) - 1).alias("pos"))

    def rows(self) -> DataFrame:
        """Dimensions and values, row by row in the order of the dimensions."""
        return self.df.orderBy(*map(self.at, self.dims)).select(*self.dims, *self.values)

    # alignment

    def align(self, *others: Cube, suffixes: str = "_b _c _d _e _f _g _h", strict: bool = False) -> Cube:
        """All cubes on the labels that they share, one after the other as `_aligned` has it. Values of the first, second ...
        other cube whose names are taken get the first, second ... suffix. With `strict` it is an error, found by a
        small job, if no label is common to all."""
        out = self
        for other, suffix in zip(others, suffixes.split(), strict=False):
            out = out._aligned(other, suffix)
        if len(others) > len(suffixes.split()):
            raise ValueError("more cubes than suffixes")
        if strict and not out.df.limit(1).count():
            raise ValueError("no label in common")
        return out

    def _aligned(self, other: Cube, suffix: str) -> Cube:
        """Both cubes on the labels that they share; dimensions that only one has are repeated over the other.

        Values of `other` whose names are taken get the suffix. Without a dimension in common, as with a constant, all
        of `other` is repeated; it is counted first, and more than SMALL cells are an error.
        """
        shared = [d for d in self.dims if d in other.dims]
        renamed = {v: v + suffix for v in other.values if v in self.values}
        right = other.df.select(*other.dims, *(F.col(v).alias(renamed.get(v, v)) for v in other.values), *([DT] if "time" in other.dims and "time" not in self.dims else []), *(f"{d}_pos" for d in other.placed if d not in self.dims))
        if not shared and right.limit(SMALL + 1).count() > SMALL:
            raise ValueError(f"no dimension in common, and more than {SMALL} cells to repeat")
        df = self.df.join(right, shared, "inner") if shared else self.df.join(F.broadcast(right))
        dims = tuple(sorted(dict.fromkeys([*self.dims, *other.dims]), key=ORDER.index))
        units = self.units | {renamed.get(v, v): u for v, u in other.units.items()}
        placed = (*self.placed, *(d for d in other.placed if d not in self.dims))
        return Cube(df, dims, (*self.values, *(renamed.get(v, v) for v in other.values)), units, tuple(dict.fromkeys([*self.notes, *other.notes])), placed=placed)

    def combine(self, name: str, a: str, sign: str, b: str) -> Cube:
        """Add a value a + b, a - b, a * b or a / b with its unit; differing units of a sum are noted."""
        from fanplume.functions.missing import divide

        x, y, ua, ub = num(F.col(a)), num(F.col(b)), self.units.get(a), self.units.get(b)
        column = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide(x, y)}[sign]()
        notes, unit = list(self.notes), ua
        if sign in "+-":
            if ua is not None and ub is not None and ua != ub:
                notes.append(f"{name}: combining values in {ua} and {ub}")
        elif ua is not None and ub is not None:
            unit = product(ua, ub) if sign == "*" else quotient(ua, ub)
        else:
            unit = None
        state = (self.traits.get(a, frozenset()) | self.traits.get(b, frozenset())) & {STATE} if sign in "+-" else frozenset()
        return self._told(name, column, unit, state, notes)

    def _told(self, name: str, column: Column, unit: str | None, traits: Iterable[str] = (), notes: Iterable[str] = ()) -> Cube:
        """`let` of one value whose unit and traits are known."""

        def tell(c: Cube) -> Cube:
            out = c.let(**{name: column})
            units = {v: u for v, u in out.units.items() if v != name} | ({name: unit} if unit is not None else {})
            return dataclasses.replace(out, units=units, traits=out.traits | {name: frozenset(traits)}, notes=tuple(dict.fromkeys([*c.notes, *notes])), within=None)

        return self._bounded(tell(self), tell)

    def raised(self, name: str, of: str, n: float) -> Cube:
        """Add a power of a value, with its unit; the unit of a power that isn't whole is unknown."""
        unit = self.units.get(of)
        return self._told(name, power(F.col(of), n), None if unit is None else unit_power(unit, n))

    def root(self, name: str, of: str) -> Cube:
        """Add the square root of a value, with its unit."""
        unit = self.units.get(of)
        return self._told(name, sqrt(F.col(of)), None if unit is None else unit_power(unit, 0.5))

    def scaled(self, name: str, of: str, factor: float = 1.0, plus: float = 0.0) -> Cube:
        """Add a value times a constant and plus another one: its unit stays, and a state is still one."""
        return self._told(name, num(F.col(of)) * factor + plus, self.units.get(of), self.traits.get(of, frozenset()) & {STATE})

    def turned(self, name: str, of: str, plus: float = 0.0, full: float = 360.0) -> Cube:
        """Add the remainder of a value (and a constant) by a full turn: of degrees, it is a direction."""
        degrees = self.units.get(of) == "°" and full == 360
        return self._told(name, modulo(num(F.col(of)) + plus, full), self.units.get(of), [DIRECTION] if degrees else ())

    def wave(self, name: str, how: str, of: str) -> Cube:
        """Add the sine or cosine ("sin", "cos") of a value in radians; a value in degrees is noted and taken as it is."""
        made = {"sin": F.sin, "cos": F.cos}[how](num(F.col(of)))
        return self._told(name, made, "", (), [f"{name}: {how} takes radians, and {of} is in degrees"] if self.units.get(of) == "°" else [])

    def anomaly(self, over: str, value: str, name: str = "anomaly") -> Cube:
        """The value less its mean over a dimension (over time weighted by hours): a window instead of a join with the
        coarser array."""
        x, w = num(F.col(value)), Window.partitionBy(*(d for d in self.dims if d != over))
        average = F.avg(x).over(w)
        if over == "time":
            average = F.sum(x * F.col(DT)).over(w) / F.nullif(F.sum(F.when(x.isNotNull(), F.col(DT))).over(w), F.lit(0.0))
        made = x - average
        if over == "time":  # a part of time has another mean
            self = dataclasses.replace(self, within=None)
        return self._told(name, made, self.units.get(value), self.traits.get(value, frozenset()) & {STATE})


def _time(x: str | datetime, zone: str) -> Column:
    return F.lit(clock.utc(x, zone) if isinstance(x, str) else x).cast("timestamp_ntz")


def _span(want, zone: str) -> tuple[datetime | None, datetime | None] | None:
    """The stretch of time (from, before) that a selection lies in, or None if it isn't one stretch."""
    at = lambda x: clock.utc(x, zone) if isinstance(x, str) else x
    if isinstance(want, slice):
        return at(want.start), at(want.stop)
    if isinstance(want, str) and len(want) == 10:
        return clock.local_day(want, zone)
    labels = [at(x) for x in (want if isinstance(want, list) else [want])]
    return (min(labels), max(labels) + timedelta(microseconds=1)) if labels else None
