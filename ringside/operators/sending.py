"""How rows are sent between tasks: in as many parts as the input needs, with small numbers side by side in words.

A row of Spark gives every number eight bytes, and a session may have few parts for a shuffle, so that its tasks hold more than
their memory and write it to disk once more. Here the parts grow with the files that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
PART = 4 << 20  # bytes of input files a part
CODES = {"corner": ("red", "blue"), "res": ("W", "L", "D")}  # fixed values
WHOLE = ("tinyint", "smallint", "int", "bigint", "date", "boolean")


def parts(df: DataFrame, size: int = PART) -> int:
    """Parts for a shuffle of this table's rows: one for every ``size`` bytes of what it is made from, the session's number at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation":
            read += int(str(leaf.stats().sizeInBytes()))
        elif kind == "InMemoryRelation":  # 0 until it is filled
            read += leaf.cacheBuilder().sizeInBytesStats().value()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-read // size), 20_000))


def packed(df: DataFrame, keep: tuple[str, ...], bits: dict[str, int], usual: int) -> tuple[DataFrame, list[Column]]:
    """The table with its whole numbers, dates and codes in words of 63 bits (those of ``keep`` as they are), and the columns that get the
    table back. A column has ``usual`` bits, or those named. A row with a number that doesn't fit carries all of them in full."""
    kinds = dict(df.dtypes)
    coded = [x for x, t in df.dtypes if x not in keep and t == "string" and x in CODES]
    whole = [x for x, t in df.dtypes if x not in keep and t in WHOLE]
    if not coded + whole:
        return df, [c(x) for x in df.columns]
    room = {x: 3 if x in coded else 2 if kinds[x] == "boolean" else bits.get(x, usual) for x in (*coded, *whole)}
    code = lambda x: F.when(c(x) == CODES[x][0], 0).otherwise(F.when(c(x) == CODES[x][1], 1).otherwise(F.when(c(x).isNotNull(), 2)))
    number = lambda x: (code(x) if x in coded else F.unix_date(x) if kinds[x] == "date" else c(x).cast("int") if kinds[x] == "boolean" else c(x)).cast("long")
    out = df.select(*[x for x in df.columns if x not in room], *[number(x).alias(x) for x in room])
    place, words, over, used = {}, [], F.lit(0).cast("long"), 63
    for x, n in room.items():  # the lowest bit tells whether there is a number
        if used + n > 63:
            words, used = [*words, F.lit(0).cast("long")], 0
        v = F.coalesce(x, F.lit(0).cast("long"))
        words[-1] = words[-1].bitwiseOR(F.shiftleft(F.shiftleft(v, 1).bitwiseOR(c(x).isNotNull().cast("long")), used))
        over = over.bitwiseOR(F.shiftright(v, n - 1))
        place[x], used = (len(words) - 1, used), used + n
    out = out.select(*[x for x in df.columns if x not in room], *[w.alias(f"_w{i}") for i, w in enumerate(words)], F.when(over != 0, F.array(*room)).alias("_far"))

    def back(x: str) -> Column:
        word, shift = place[x]
        v = F.shiftrightunsigned(f"_w{word}", shift)
        v = F.when(c("_far").isNotNull(), F.get("_far", F.lit(list(room).index(x)))).when(v.bitwiseAND(F.lit(1).cast("long")) == 1, F.shiftright(v, 1).bitwiseAND(F.lit((1 << (room[x] - 1)) - 1).cast("long")))
        if x in coded:
            return F.when(v == 0, CODES[x][0]).when(v == 1, CODES[x][1]).when(v == 2, CODES[x][-1])
        return F.date_from_unix_date(v.cast("int")) if kinds[x] == "date" else v.cast("int").cast("boolean") if kinds[x] == "boolean" else v.cast(kinds[x])

    return out, [back(x).alias(x) if x in room else c(x) for x in df.columns]


def sent(df: DataFrame, n: int, *keys: str, bits: dict[str, int] | None = None, usual: int = 13) -> DataFrame:
    """The table's rows dealt by the keys to ``n`` parts; what isn't a key travels packed."""
    out, back = packed(df, keys, {"dt": 17} | (bits or {}), usual)
    return out.repartition(n, *keys).select(*back)
