"""Recurrences over time whose bouts don't fit one task: time is cut into slices of whole days that run side by side.

The first round starts every slice from nothing. Each further round starts it from what the fighters' earlier slices ended
with, and only slices whose start changed run again. After n rounds the first n slices are exact, so as many rounds as
there are slices give what one pass in order gives; ratings forget where they started, so far fewer do (each round shrinks
the error by what a slice forgets). Ratings that only have a meaning relative to each other forget no common shift: it is
summed over the slices, one number a slice, and added to the starts of the next round.

A slice holds ``span`` bouts a fighter on average, so the number of slices and rounds doesn't grow with the number of
fighters. Bouts are ordered once, by tasks of bounded size, and packed as numbers, some thousands in a row; only these
packed rows (about 20 bytes a bout) go to the tasks of slices. Such a task plays waves of bouts without a common fighter
and holds the numbers of its fighters; what it tells is packed too and meets the bouts' names by packed row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.operators.tables import delete, written

c = F.col
KEY = ["_part", "_slice"]
ENDS = "_part string, _slice int, fighter int, begun array<double>, ended array<double>"
# (state of red, of blue, bouts scored before, further columns) to (results, new state of red, of blue), a row a bout
Step = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def waves(red: list[int], blue: list[int]) -> list[np.ndarray]:
    """Places of matches such that nobody fights twice in a wave, and everybody's matches keep their order."""
    last: dict[int, int] = {}
    level = []
    for a, b in zip(red, blue, strict=True):
        here = max(last.get(a, 0), last.get(b, 0)) + 1
        last[a] = last[b] = here
        level.append(here)
    by = np.argsort(level, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(np.asarray(level)[by])) + 1)


class _Slice:
    """The states of a slice's fighters by code: what each began with, if told, and has now."""

    def __init__(self, step: Step, first: list[float], before: int) -> None:
        self.step, self.first, self.seen = step, np.array(first), before
        self.now, self.given = np.zeros((0, len(first))), np.zeros((0, len(first)))
        self.told, self.met = np.zeros(0, bool), np.zeros(0, bool)

    def reach(self, code: int) -> None:
        more = max(code + 1, 2 * len(self.now)) - len(self.now)
        if code >= len(self.now):
            self.now, self.given = (np.vstack([x, np.tile(self.first, (more, 1))]) for x in (self.now, self.given))
            self.told, self.met = (np.concatenate([x, np.zeros(more, bool)]) for x in (self.told, self.met))

    def load(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.reach(int(codes.max()))
        self.now[codes] = self.given[codes] = values
        self.told[codes] = True

    def play(self, red: np.ndarray, blue: np.ndarray, scored: np.ndarray, rest: list[np.ndarray], width: int) -> np.ndarray:
        self.reach(int(max(red.max(), blue.max())))
        self.met[red] = self.met[blue] = True
        seen = self.seen + np.cumsum(scored, dtype=np.int64) - scored
        self.seen += int(scored.sum(dtype=np.int64))
        out = np.empty((len(red), width))
        for i in waves(red.tolist(), blue.tolist()):
            r, b = red[i], blue[i]
            out[i], own, other = self.step(self.now[r], self.now[b], seen[i], *[x[i] for x in rest])
            self.now[r] = own
            self.now[b] = other
        return out

    def ends(self, key: tuple, most: int = 50_000) -> Iterator[pd.DataFrame]:
        met = np.flatnonzero(self.met)
        for x in range(0, len(met), most):
            i = met[x : x + most]
            begun = [v if t else None for v, t in zip(self.given[i], self.told[i], strict=True)]
            yield pd.DataFrame({"_part": key[0], "_slice": np.int32(key[1]), "fighter": i.astype(np.int32), "begun": begun, "ended": list(self.now[i])})


class _Stream:
    """Passes rows in order: of each slice first the states, then the packed bouts."""

    def __init__(self, step: Step, first: list[float], more: int, width: int) -> None:
        self.step, self.first, self.width = step, first, width
        self.more, self.values = [f"_c{i}" for i in range(more)], [f"_v{i}" for i in range(len(first))]

    def passed(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, _Slice, int | None, np.ndarray | None]]:
        """(key, slice, chunk, results) for each packed row; at the end of a slice (key, slice, None, None)."""
        now, table = None, None
        for b in batches:
            part, piece, chunk = (b[x].to_numpy() for x in (*KEY, "chunk"))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (piece[1:] != piece[:-1]) | ((chunk[1:] < 0) != (chunk[:-1] < 0))) + 1
            for a, z in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if a == z:
                    continue
                key, rows = (part[a], int(piece[a])), b.iloc[a:z]
                if key != now:
                    if table is not None:
                        yield now, table, None, None
                    now, table = key, _Slice(self.step, self.first, int(rows["_before"].iloc[0]) if chunk[a] >= 0 else 0)
                if chunk[a] < 0:
                    table.load(rows["fighter"].to_numpy(dtype=np.int64), rows[self.values].to_numpy(dtype=float))
                    continue
                if not table.met.any():
                    table.seen = int(rows["_before"].iloc[0])
                for at, red, blue, scored, *rest in rows[["chunk", "red", "blue", "scored", *self.more]].itertuples(index=False):
                    red, blue, scored = (np.frombuffer(x, dtype=t) for x, t in ((red, np.int32), (blue, np.int32), (scored, np.int8)))
                    yield key, table, int(at), table.play(red, blue, scored, [np.frombuffer(x) for x in rest], self.width)
        if table is not None:
            yield now, table, None, None

    def states(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, table, at, _ in self.passed(batches):
            if at is None:
                yield from table.ends(key)

    def results(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, at, told in self.passed(batches):
            if at is not None:
                yield pd.DataFrame({"chunk": [at], "told": [told.tobytes()]})


def _packed(placed: DataFrame, codes: DataFrame, columns: list[str], tasks: int) -> DataFrame:
    """Bouts in time order, some thousands a row: ``chunk`` orders the rows, the columns are numbers in binary. A row is of one slice."""
    more = {x: f"_c{i}" for i, x in enumerate(columns[2:])}
    line = placed.select("bout_id", "dt", *KEY, "_before", "_scored", *columns[:2], *[c(x).cast("double").alias(n) for x, n in more.items()])
    for x, name in zip(columns[:2], ("red", "blue"), strict=True):
        of = codes.select(c("_part").alias("_of"), c("f").alias("_f"), c("code").alias(name))
        line = line.join(of, (c("_part") == c("_of")) & c(x).eqNullSafe(c("_f"))).drop("_of", "_f", x)
    order = [*KEY, "dt", "bout_id"]
    kinds = {"red": np.int32, "blue": np.int32, "_scored": np.int8} | dict.fromkeys(more.values(), np.float64)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, k = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            part, piece = (b[x].to_numpy() for x in KEY)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (piece[1:] != piece[:-1])) + 1
            for x, y in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if x < y:
                    some = b.iloc[x:y]
                    head = {"_part": [part[x]], "_slice": [piece[x]], "_before": [some["_before"].iloc[0]], "chunk": [at + k], "bout_id": [some["bout_id"].tolist()]}
                    yield pd.DataFrame(head | {("scored" if n == "_scored" else n): [some[n].to_numpy(dtype=t).tobytes()] for n, t in kinds.items()})
                    k += 1

    schema = ", ".join([f"_part string, _slice int, _before long, chunk long, bout_id array<{placed.schema["bout_id"].dataType.simpleString()}>, red binary, blue binary, scored binary", *[f"{n} binary" for n in more.values()]])
    ordered = line.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return written(ordered.select("bout_id", *KEY, "_before", *kinds).mapInPandas(pack, schema))[0]


def _placed(told: DataFrame, days: DataFrame, slices: int, n: int) -> DataFrame:
    """Bouts with the slice of their day, and how many bouts of their part were scored before it."""
    through = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)  # over one row a day
    size = max(1, math.ceil(n / slices))
    cut = days.groupBy("dt").agg(F.sum("n").alias("n")).select("dt", F.floor(F.coalesce(F.sum("n").over(through), F.lit(0)) / size).cast("int").alias("_slice"))
    cut = cut.select(c("dt").alias("day"), "_slice")
    past = Window.partitionBy("_part").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = days.join(cut, c("dt").eqNullSafe(c("day"))).groupBy(*KEY).agg(F.sum("scored").alias("scored"))
    before = before.select(*KEY, F.coalesce(F.sum("scored").over(past), F.lit(0)).alias("_before"))
    return told.join(F.broadcast(cut), c("dt").eqNullSafe(c("day"))).drop("day").join(F.broadcast(before), KEY)  # one row a day, a slice


def _starts(known: DataFrame, first: list[float], drift: int | None) -> DataFrame:
    """The state that each slice should start from, and how far that is from what it started with."""
    last = Window.partitionBy("_part", "fighter").orderBy("_slice")
    begun = F.coalesce("begun", F.array(*map(F.lit, first)))
    rows = known.select(*KEY, "fighter", begun.alias("begun"), F.lag("ended").over(last).alias("values"), F.lag("_slice").over(last).alias("from")).filter("values is not null")
    if drift is not None:
        jump = rows.groupBy(*KEY).agg(F.avg(c("values")[drift] - c("begun")[drift]).alias("jump"))
        shift = jump.select("_part", c("_slice").alias("from"), F.sum("jump").over(Window.partitionBy("_part").orderBy("_slice")).alias("shift"))
        moved = F.transform("values", lambda x, i: F.when(i == drift, x + F.coalesce("shift", F.lit(0.0))).otherwise(x))
        rows = rows.join(shift, ["_part", "from"], "left").withColumn("values", moved)
    return rows.select(*KEY, "fighter", "values", F.array_max(F.zip_with("values", "begun", lambda a, b: F.abs(a - b))).alias("change"))


def in_slices(
    bouts: DataFrame, part: str | None, columns: list[str], step: Step, first: list[float], schema: str, names: list[str],
    scored: Column | None = None, drift: int | None = None, span: int = 256, tolerance: float = 0.0, most: int = 1_000_000,
) -> DataFrame:
    """Run a recurrence over the bouts (of each ``part`` by itself, if one is named) and give what its step gives.

    columns: both fighters, and the numbers that the step takes. first: a fighter's state before the first bout. drift: the
    place in the state that a common shift doesn't change the results of. Slices whose start changed by no more than
    ``tolerance`` are settled. A task orders about ``most`` bouts. No bouts give no rows; bouts without a date come first; a
    day is never cut. Bouts are in order of (dt, bout_id).
    """
    spark = bouts.sparkSession
    key = F.coalesce(F.concat(F.lit("="), c(part).cast("string")), F.lit("")) if part else F.lit("all")
    counted = F.lit(1) if scored is None else scored.cast("int")
    told, _ = written(bouts.select("bout_id", "dt", key.alias("_part"), F.coalesce(counted, F.lit(0)).alias("_scored"), *[c(x) for x in columns]))
    days, _ = written(told.groupBy("dt", "_part").agg(F.count("*").alias("n"), F.sum("_scored").alias("scored")))
    n = days.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = told.select("_part", F.explode(F.array(*columns[:2])).alias("f")).distinct()
    codes, _ = written(known.select("_part", "f", (F.row_number().over(Window.partitionBy("_part").orderBy("f")) - 1).alias("code")))  # one row a fighter
    fighters = codes.select("f").distinct().count()
    slices = max(1, math.ceil(2 * n / (span * max(1, fighters))))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = max(1, min(shuffles, math.ceil(n / 50_000)), math.ceil(n / most))
    packed = _packed(_placed(told, days, slices, n), codes, columns, many)
    stream = _Stream(step, first, len(columns) - 2, len(names))
    tasks = slices if part is None else max(slices, shuffles)
    pieces = packed.drop("bout_id")

    def ordered(rows: DataFrame, states: DataFrame | None) -> DataFrame:
        """Packed bouts behind the states of their slice."""
        if states is not None:
            values = [c("values")[i].alias(v) for i, v in enumerate(stream.values)]
            rows = rows.unionByName(states.select(*KEY, "fighter", *values, F.lit(-1).cast("long").alias("chunk")), allowMissingColumns=True)
        at = F.pmod(c("_slice") + F.crc32("_part"), F.lit(tasks)).cast("int")
        return rows.withColumn("_task", at).repartitionById(tasks, "_task").sortWithinPartitions(*KEY, "chunk").drop("_task")

    states = None
    if slices > 1:
        known, path = written(ordered(pieces, None).mapInPandas(stream.states, ENDS))
        for _ in range(slices):
            wanted, wanted_path = written(_starts(known, first, drift))
            again = wanted.groupBy(*KEY).agg(F.max("change").alias("change")).filter(c("change") > tolerance).select(*KEY)
            if again.isEmpty():
                delete(spark, wanted_path)
                break
            of = lambda t: t.join(F.broadcast(again), KEY, "left_semi")  # noqa: B023, E731  # one row a slice
            run = ordered(of(pieces), of(wanted)).mapInPandas(stream.states, ENDS)
            old = path
            known, path = written(known.join(F.broadcast(again), KEY, "left_anti").unionByName(run))
            delete(spark, old, wanted_path)
        states = known.filter("begun is not null").select(*KEY, "fighter", c("begun").alias("values"))

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for one, ids, values in zip(b["_part"], b["bout_id"], b["told"], strict=True):
                rows = pd.DataFrame(np.frombuffer(values).reshape(-1, len(names)), columns=names)
                rows.insert(0, "bout_id", ids)
                yield rows.assign(_part=one)

    told_of = ordered(pieces, states).mapInPandas(stream.results, "chunk long, told binary").repartition(many, "chunk")
    named = packed.select("chunk", "_part", "bout_id").repartition(many, "chunk")
    done = named.join(told_of, "chunk").mapInPandas(unpacked, f"bout_id {bouts.schema['bout_id'].dataType.simpleString()}, {schema}, _part string")
    return done.withColumn(part, F.when(c("_part") != "", F.expr("substring(_part, 2)"))).drop("_part") if part else done.drop("_part")
