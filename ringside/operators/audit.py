"""Relational verbs: profiles, duplicates, unions, first appearances, splits, prediction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, n_null, n_rows: one pass, then one row a column."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(c(x).isNull()).alias(x) for x in df.columns])
    return one.unpivot(["n_rows"], df.columns, "column_name", "n_null").select("column_name", "n_null", "n_rows")


def over_null_threshold(df: DataFrame, share: float) -> DataFrame:
    return null_profile(df).filter(c("n_null") > share * c("n_rows"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def rows_with_duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(duplicate_keys(df, keys).drop("n"), keys, "left_semi")


def marked_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key stands more than once, by a window instead of a join."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def differing_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each key with several rows, the columns in which they differ."""
    others = [x for x in df.columns if x not in keys]
    # one exchange by the keys: values differ if the smallest isn't the largest, so that no row is repeated for a column
    counts = df.repartition(*keys).groupBy(*keys).agg(F.count("*").alias("n"), *[(F.min(x) < F.max(x)).alias(x) for x in others]).filter("n > 1")
    named = F.filter(F.array(*[F.when(c(x), F.lit(x)) for x in others]), lambda x: x.isNotNull())
    return counts.select(*keys, "n", F.array_join(named, ",").alias("differing")).filter("differing <> ''")


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[set[str], set[str]]:
    return set(a.columns) - set(b.columns), set(b.columns) - set(a.columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_all(a, b).dropDuplicates()


def contains_text(column: str, part: str) -> Column:
    """Case-insensitive; NULL is false."""
    return F.coalesce(F.lower(column).contains(part.lower()), F.lit(False))


def most_recent(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*[c(x).desc() for x in order]).limit(n)


def first_appearance_ids(bouts: DataFrame) -> DataFrame:
    """Dense ids from 0 in order of first appearance, the red corners of all bouts standing before the blue ones.

    The window sorts one row a competitor, not the bouts.
    """
    seen = bouts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("side"), c("moment").alias("moment"), c(f"fighter_{x}").alias("fighter")) for k, x in ((0, "red"), (1, "blue"))])))
    first = seen.groupBy("fighter").agg(F.min(F.struct("side", "moment", "fighter")).alias("first"))
    return first.select("fighter", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("fighter_id"))


def chronological_split(bouts: DataFrame, share: float = 0.85) -> DataFrame:
    """Add ``is_train``: the first ``share`` of rows by (dt, bout_id).

    The row at the cut is found from counts by day and then inside one day, so that no task sorts all rows and only that
    day's rows are shuffled; every other row is compared with it where it lies. Rows of the same dt and bout_id are on one side.
    """
    days = bouts.groupBy("dt").agg(F.count("*").alias("n"))  # one row a day
    line = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).withColumn("left", F.floor(F.sum("n").over(Window.partitionBy()) * share) - c("before"))
    day = days.filter((c("left") >= 0) & (c("left") < c("n"))).select(c("dt").alias("day"), "left")  # one row: the day of the first row behind the cut
    place = F.row_number().over(Window.partitionBy("dt").orderBy("bout_id"))
    of_day = bouts.join(F.broadcast(day), c("dt") == c("day")).select("dt", "bout_id", "left").withColumn("place", place)
    cut = of_day.filter(c("place") == c("left") + 1).select(c("dt").alias("_day"), c("bout_id").alias("_first"))  # one row
    cut = cut.agg(F.max("_day").alias("_day"), F.max("_first").alias("_first"))  # NULLs if no row is behind the cut
    before = (c("dt") < c("_day")) | ((c("dt") == c("_day")) & (c("bout_id") < c("_first")))
    return bouts.filter("dt is not null").join(F.broadcast(cut)).withColumn("is_train", c("_day").isNull() | before).drop("_day", "_first")


def swap_corners(df: DataFrame) -> DataFrame:
    """Every red column under its blue name and the other way round; differences change sign."""

    def other(name: str) -> str:
        return f"{name[:-4]}_blue" if name.endswith("_red") else f"{name[:-5]}_red" if name.endswith("_blue") else name

    return df.select(*[(-c(x) if x.endswith("_diff") else c(other(x)) if other(x) in df.columns else c(x)).alias(x) for x in df.columns])


def corner_views(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The red view (its own columns and differences) and the blue view with negated differences."""
    own = lambda k: [x for x in df.columns if x.endswith(f"_{k}")]
    diff = [x for x in df.columns if x.endswith("_diff")]
    return df.select("bout_id", *own("red"), *diff), df.select("bout_id", *own("blue"), *[(-c(x)).alias(x) for x in diff])


def favourite_view(bouts: DataFrame, names: list[str]) -> DataFrame:
    """Columns by role: <name>_fav, <name>_dog, label fav_won (bouts with a winner only); differences point to the favourite."""
    red = F.coalesce(c("open_red") <= c("open_blue"), F.lit(False))
    role = lambda n, a, b: F.when(red, c(f"{n}_{a}")).otherwise(c(f"{n}_{b}"))
    diffs = [x for x in bouts.columns if x.endswith("_diff")]
    return bouts.filter("winner in (0, 1)").select(
        "bout_id", *[role(n, "red", "blue").alias(f"{n}_fav") for n in names], *[role(n, "blue", "red").alias(f"{n}_dog") for n in names],
        *[F.when(red, c(x)).otherwise(-c(x)).alias(x) for x in diffs], (red.cast("int") == c("winner")).cast("int").alias("fav_won"),
    )


def predicted_winner(correct: Column, winner: Column) -> Column:
    """The pick that a right/wrong flag implies."""
    return F.when(correct == 1, winner).otherwise(F.abs(1 - winner))
