"""Exact k nearest neighbours of any number of queries: boxes, and two rounds.

A tree of splits, learned from a hash sample of history, deals history to cells of about ``chunk`` rows; so the cells grow in number with
the rows, not in size. In the first round a query meets the cell whose box is nearest; the k-th distance found bounds the answer.
In the second round it meets those other cells whose boxes lie within the bound. Every meeting of a cell is cut into groups of at most
about ``block`` queries and ``chunk`` rows, so that a cell of any size (equal rows can't be split), or one that all queries ask, is spread
over many tasks. In a group the rows are split once more into small boxes, and queries meet those within their bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
SLACK = 1e-9  # distances may round
SAMPLE = 32  # rows a cell that the splits are learned from
BOX = 128  # rows of a small box


class Splits:
    """A tree of splits on one coordinate each, into about ``leaves`` leaves of as many of the rows it was made from."""

    def __init__(self, z: np.ndarray, leaves: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # coordinate, value, what is up to it, what is above; leaves are -1 - leaf
        self.leaves = 0
        self.root = self._grow(z, leaves)
        self.at = np.array(self.nodes or [(0, 0.0, -1, -1)])

    def _grow(self, z: np.ndarray, leaves: int) -> int:
        wide = z.max(axis=0) - z.min(axis=0) if len(z) else np.zeros(1)
        k = int(wide.argmax())
        if leaves <= 1 or not wide[k] > 0:
            self.leaves += 1
            return -self.leaves
        x = np.sort(z[:, k])
        v = x[len(x) * (leaves // 2) // leaves - 1] if len(x) >= leaves else x[(len(x) - 1) // 2]
        v = v if v < x[-1] else x[np.searchsorted(x, x[-1]) - 1]
        here = len(self.nodes)
        self.nodes.append((k, float(v), 0, 0))
        low = z[:, k] <= v
        self.nodes[here] = (k, float(v), self._grow(z[low], leaves // 2), self._grow(z[~low], leaves - leaves // 2))
        return here

    def leaf(self, z: np.ndarray) -> np.ndarray:
        node = np.full(len(z), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            of = self.at[node[inner]]
            up = z[inner, of[:, 0].astype(int)] <= of[:, 1]
            node[inner] = np.where(up, of[:, 2], of[:, 3])
        return (-1 - node).astype(np.int32)


def _reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries to boxes."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        x = q[:, k, None]
        out += np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0) ** 2
    return out


def _squares(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(v)))
    for k in range(q.shape[1]):
        out += (q[:, k, None] - v[None, :, k]) ** 2
    return out


def _nearest(v: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k rows that are nearest to each query, within its bound; ties to the earlier row."""
    boxes = Splits(v, max(1, len(v) // BOX))
    leaf = boxes.leaf(v)
    order = np.argsort(leaf, kind="stable")
    edges = np.searchsorted(leaf[order], np.arange(boxes.leaves + 1))
    members = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    low, high = (np.stack([f(v[m], axis=0) for m in members]) for f in (np.min, np.max))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), 2048):
        some, limit = q[start : start + 2048], bound[start : start + 2048] ** 2
        far = _reach(some, low, high)
        home = far.argmin(axis=1)
        for b in np.unique(home):  # the k-th distance in the nearest box bounds the answer
            if len(members[b]) >= k:
                mine = np.flatnonzero(home == b)
                limit[mine] = np.minimum(limit[mine], np.partition(_squares(some[mine], v[members[b]]), k - 1, axis=1)[:, k - 1])
        limit = limit * (1 + SLACK) + SLACK * SLACK
        hits = []
        for b in range(len(members)):
            mine = np.flatnonzero(far[:, b] <= limit)
            if len(mine):
                x, y = np.nonzero(_squares(some[mine], v[members[b]]) <= limit[mine, None])
                hits.append((mine[x], members[b][y]))
        if hits:
            x, y = (np.concatenate(h) for h in zip(*hits, strict=True))
            d = np.sqrt(((v[y] - some[x]) ** 2).sum(axis=1))
            by = np.lexsort((y, d, x))
            x, y, d = x[by], y[by], d[by]
            first = np.searchsorted(x, x)
            top = np.arange(len(x)) - first < k
            found.append((x[top] + start, y[top], d[top]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _meet(placed: DataFrame, asked: DataFrame, k: int, block: int, chunk: int) -> DataFrame:
    """The k best rows of each group in which some queries (id, z, part, cell, bound) meet some rows of their cell."""
    at = ["part", "cell"]
    many = placed.groupBy(*at).agg(F.ceil(F.count("*") / (2 * chunk)).alias("chunks"))
    sizes = F.broadcast(many.join(asked.groupBy(*at).agg(F.ceil(F.count("*") / block).alias("blocks")), at))  # at most one row a cell and part
    own = lambda n: F.pmod(F.xxhash64("id"), c(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (c(n) - 1).cast("int")))
    a = asked.join(sizes, at).withColumn("block", own("blocks")).withColumn("chunk", every("chunks")).withColumn("asks", F.lit(True))
    b = placed.join(sizes, at).withColumn("chunk", own("chunks")).withColumn("block", every("blocks")).withColumn("asks", F.lit(False)).withColumn("bound", F.lit(0.0))
    columns = [*at, "block", "chunk", "asks", "id", "z", "bound"]

    def best(met: pd.DataFrame) -> pd.DataFrame:
        some, rows = met[met["asks"]], met[~met["asks"]].sort_values("id")
        if not len(some) or not len(rows):
            return pd.DataFrame({"part": [], "id": [], "near_id": [], "distance": []}).astype({"part": str, "id": str, "near_id": str})
        x, y, d = _nearest(np.stack(rows["z"]), np.stack(some["z"]), some["bound"].to_numpy(), k)
        return pd.DataFrame({"part": met["part"].iloc[0], "id": some["id"].to_numpy()[x], "near_id": rows["id"].to_numpy()[y], "distance": d})

    met = a.select(columns).unionByName(b.select(columns))
    return met.groupBy(*at, "block", "chunk").applyInPandas(best, "part string, id string, near_id string, distance double")


def exact_nearest(history: DataFrame, queries: DataFrame, k: int = 5, block: int = 20_000, chunk: int = 20_000) -> DataFrame:
    """(part, id, rank, near_id, distance): for each query the k nearest rows of history of the same part, ties to the
    smaller id. Both sides are (id string, z array<double>, part string). About ``SAMPLE`` rows a cell, and one a cell and part, reach the
    driver. Both sides and the first round are kept (in memory or on disk) until the session's cache is cleared."""
    kept = history.select("id", "z", "part").persist()
    n = kept.count()
    if not n:
        return queries.sparkSession.createDataFrame([], "part string, id string, rank int, near_id string, distance double")
    leaves = max(1, -(-n // chunk))
    drawn = kept.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < leaves * SAMPLE).select("z").collect() or kept.select("z").limit(1).collect()
    tree = Splits(np.array([r["z"] for r in drawn], dtype=float), leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=tree.leaf(np.stack(b["z"])))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = np.stack(b["z"])
                of = pd.DataFrame({"part": b["part"].to_numpy(), "cell": tree.leaf(z), **{f"z{i}": z[:, i] for i in range(z.shape[1])}}).groupby(["part", "cell"])
                low, high = of.min(), of.max()
                yield pd.DataFrame({"part": low.index.get_level_values(0), "cell": low.index.get_level_values(1), "low": list(low.to_numpy()), "high": list(high.to_numpy())})

    placed = kept.mapInPandas(place, "id string, z array<double>, part string, cell int")
    width = len(drawn[0]["z"])
    told = kept.mapInPandas(ends, "part string, cell int, low array<double>, high array<double>").groupBy("part", "cell")
    cells = told.agg(F.array(*[F.min(c("low")[i]) for i in range(width)]).alias("low"), F.array(*[F.max(c("high")[i]) for i in range(width)]).alias("high")).collect()  # one row a cell and part
    boxes: dict[str, list] = {}
    for r in sorted(cells, key=lambda r: (r["part"], r["cell"])):
        boxes.setdefault(r["part"], []).append((r["cell"], r["low"], r["high"]))
    reach = {part: tuple(np.array(x) for x in zip(*of, strict=True)) for part, of in boxes.items()}
    asked = "id string, z array<double>, part string, cell int, bound double"

    def visits(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, some in b.groupby("part"):
                if part not in reach:
                    continue
                cell, low, high = reach[part]
                for start in range(0, len(some), 1024):
                    rows = some.iloc[start : start + 1024]
                    far = _reach(np.stack(rows["z"]), low, high)
                    home = far.argmin(axis=1)
                    if first:
                        row, to = np.arange(len(rows)), home
                        bound = np.full(len(rows), np.inf)
                    else:
                        bound = rows["bound"].fillna(np.inf).to_numpy()
                        bound = bound * (1 + SLACK) + SLACK
                        inside = far <= (bound * bound)[:, None]
                        inside[np.arange(len(rows)), home] = False
                        row, to = np.nonzero(inside)
                        bound = bound[row]
                    got = rows.iloc[row]
                    yield pd.DataFrame({"id": got["id"].to_numpy(), "z": got["z"].to_numpy(), "part": part, "cell": cell[to].astype(np.int32), "bound": bound})

    wanted = queries.select("id", "z", "part").persist()
    near = _meet(placed, wanted.mapInPandas(lambda x: visits(x, True), asked), k, block, chunk).persist()
    bounds = near.groupBy("part", "id").agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1)).alias("bound"))
    second = wanted.join(bounds, ["part", "id"], "left").mapInPandas(lambda x: visits(x, False), asked)
    place_ = F.row_number().over(Window.partitionBy("part", "id").orderBy("distance", "near_id"))
    every = near.unionByName(_meet(placed, second, k, block, chunk))
    return every.withColumn("rank", place_).filter(c("rank") <= k).select("part", "id", "rank", "near_id", "distance")
