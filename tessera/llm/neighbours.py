"""k most similar vectors for every vector: several shifted Hilbert orderings.

Each ordering rotates the unit vectors at random, keeps a few coordinates, shifts them and sorts by
the Hilbert index of the grid cell.  Vectors close in angle are close in at least one ordering with
high probability, so every vector is compared exactly with a window of its neighbours in each, and the
lists of all orderings are merged.  Orderings are range-partitioned at quantiles of a bounded sample
and read in order with a sliding window, so a range may hold any number of rows; rows near a bound are
also neighbours of the rows beyond it.  Every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize

#: Orderings, neighbours compared on each side in one ordering, and rows of one range of an ordering.
CURVES, WINDOW, BLOCK = 10, 256, 6144
#: Vectors per collection from which scales and range bounds are taken: the bound of the fitted sample.
SAMPLE = 20_000
_DIMS, _BITS, _TIE_BITS = 12, 4, 15
#: Similarities are compared after rounding to 1 / UNIT.
UNIT = 1_000_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (uint64) of grid cells, rows of ``bits``-bit coordinates; at most 64 bits in all."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        low = q - one
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    q = one << np.uint64(bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key


class Curves:
    """The random rotations and shifts of all orderings, with scales and bounds per collection."""

    def __init__(self, dim: int, curves: int, seed: int):
        rng = np.random.default_rng(seed)
        kept = min(_DIMS, dim)
        self.axes = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :kept].astype(np.float32) for _ in range(curves)]
        self.shift = rng.uniform(-0.5, 0.5, (curves, kept))
        self.scale: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.bounds: dict[str, list[np.ndarray]] = {}
        #: Where the rows begin and end that lie within a window of each bound.
        self.near: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def learn(self, name: str, unit: np.ndarray, ties: np.ndarray, blocks: int, window: float) -> None:
        """Scales and range bounds of one collection from a sample; ``window`` in rows of the sample."""
        projected = [unit @ a for a in self.axes]
        self.scale[name] = [(y.mean(0), np.maximum(y.std(0), 1e-6)) for y in projected]
        blocks = max(1, min(blocks, len(unit) // 8))
        keys = [np.sort(self.key(name, k, unit, ties)) for k in range(len(self.axes))]
        cut = (np.arange(1, blocks) * len(unit)) // blocks
        self.bounds[name] = [k[cut] for k in keys]
        # Half as many again, since a sample tells the place of a row only roughly.
        wide = int(np.ceil(1.5 * window)) + 1
        self.near[name] = [(k[np.maximum(cut - wide, 0)], k[np.minimum(cut + wide, len(k) - 1)]) for k in keys]

    def key(self, name: str, curve: int, unit: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Position on one curve; equal cells are spread by a hash so that no range can be too full."""
        mean, std = self.scale[name][curve]
        y = (unit @ self.axes[curve] - mean) / std + self.shift[curve]
        cells = np.clip((y + 3.25) / 6.5 * (1 << _BITS), 0, (1 << _BITS) - 1).astype(np.uint64)
        return ((hilbert_index(cells, _BITS) << np.uint64(_TIE_BITS)) | (ties.astype(np.uint64) & np.uint64((1 << _TIE_BITS) - 1))).astype(np.int64)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vectors(df: DataFrame, id_col: str, columns: list[str], dim: int) -> DataFrame:
    """(name, id, vec, dir): one row per id and vector column that can take part: of length ``dim``,
    without nulls and not all zero.  ``vec`` is float32 bytes, ``dir`` a hash of the direction."""
    parts = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("array<double>").alias("v")) for c in columns])
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(parts).alias("p")).select("id", "p.*")
    rows = rows.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                u = np.round(_unit(v), 7) + 0.0
                yield pd.DataFrame({"name": pdf["name"], "id": pdf["id"], "vec": [r.tobytes() for r in v.astype(np.float32)], "raw": [r.tobytes() for r in u.astype(np.float32)]})

    encoded = rows.mapInPandas(encode, "name string, id string, vec binary, raw binary")
    return encoded.groupBy("name", "id").agg(F.min("vec").alias("vec"), F.min("raw").alias("raw")).select("name", "id", "vec", F.xxhash64("raw").alias("dir"))


def _window_lists(v: np.ndarray, ids: list[list[str]], own: range, k: int, window: int) -> pa.ListArray:
    """The k best of each of the rows ``own`` among its window; rows stand in the order of one curve."""
    unit = _unit(v.astype(np.float64))
    small = unit.astype(np.float32)
    n, step = len(v), 512
    wide = min(k + 3, max(n - 1, 0))
    first = np.array([x[0] for x in ids], dtype=object)
    rank = pd.factorize(first, sort=True)[0].astype(np.int64)
    several = np.array([len(x) > 1 for x in ids])
    sizes, scores, others = [], [], []
    for a in range(own.start, own.stop, step):
        b = min(own.stop, a + step)
        lo, hi = max(0, a - window), min(n, b + window)
        s = small[a:b] @ small[lo:hi].T
        s[np.arange(b - a), np.arange(a - lo, b - lo)] = -2
        w = min(wide, hi - lo)
        best = lo + (np.argpartition(s, hi - lo - w, axis=1)[:, hi - lo - w :] if w else np.empty((b - a, 0), dtype=int))
        units = np.rint(np.einsum("ijd,id->ij", unit[best], unit[a:b]) * UNIT).astype(np.int64)
        itself = best == np.arange(a, b)[:, None]
        # Highest similarity first, ties by the smaller id; a row itself comes last.
        order = np.argsort((UNIT - units) * n + rank[best] + itself * (4 * UNIT * n), axis=1)
        best, units, itself = (np.take_along_axis(x, order, axis=1) for x in (best, units, itself))
        mixed = several[best].any(axis=1)
        kept = ~itself
        kept[:, k:] = False
        for i in np.flatnonzero(mixed):
            # Rows that stand for copies bring all their ids.
            found = sorted((-c, x) for j, c in zip(best[i], units[i].tolist(), strict=True) if j != a + i for x in ids[j])[:k]
            kept[i] = False
            sizes.append((a + i, len(found)))
            scores.append((a + i, np.array([f[0] for f in found], dtype=np.int64)))
            others.append((a + i, np.array([f[1] for f in found], dtype=object)))
        plain = np.flatnonzero(~mixed)
        sizes += [(a + int(i), int(c)) for i, c in zip(plain, kept[plain].sum(axis=1), strict=True)]
        scores += [(a + int(i), -units[i][kept[i]]) for i in plain]
        others += [(a + int(i), first[best[i][kept[i]]]) for i in plain]
    in_order = lambda parts: [x for _, x in sorted(parts, key=lambda p: p[0])]
    offsets = np.concatenate(([0], np.cumsum(in_order(sizes), dtype=np.int64))).astype(np.int32)
    flat = lambda parts, kind: pa.array(np.concatenate(in_order(parts)) if parts else [], type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([flat(scores, pa.int64()), flat(others, pa.string())], ["score", "other"]))


def _slide(batches, dim: int, k: int, window: int, chunk: int = 4096):
    """Lists of rows that come in the order of (name, curve, block, key); a row is done once its window
    has come, so that only a chunk of rows is held.  Guests are neighbours without a list of their own."""
    held: list[pd.DataFrame] = []
    group, done = None, 0

    def flush(last: bool):
        nonlocal held, done
        rows = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        stop = len(rows) if last else max(done, len(rows) - window)
        lists = _window_lists(_matrix(rows["vec"], dim), [list(x) for x in rows["ids"]], range(done, stop), k, window)
        part = rows.iloc[done:stop]
        out = pa.RecordBatch.from_arrays([pa.array(part["name"], pa.string()), pa.array(part["id"], pa.string()), lists], ["name", "id", "found"])
        out = out.filter(pa.array(~part["guest"].to_numpy(bool)))
        cut = max(0, stop - window)
        held, done = [rows.iloc[cut:].reset_index(drop=True)], stop - cut
        return out

    for batch in batches:
        for key, part in batch.to_pandas().groupby(["name", "curve", "block"], sort=False):
            if key != group:
                if held:
                    yield flush(True)
                held, group, done = [], key, 0
            held.append(part)
            if sum(map(len, held)) - done >= chunk + window:
                yield flush(False)
    if held:
        yield flush(True)


_FOUND = "array<struct<score:bigint,other:string>>"


def nearest(vecs: DataFrame, dim: int, k: int, curves: int = CURVES, window: int = WINDOW, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """(name, id, other, score): the k nearest others of each row of ``vectors`` by cosine in units of
    1 / UNIT, ties to the smaller id.

    Copies of one direction enter the index once; each copy then gets the smallest other ids of its
    group and the group's neighbours, so a group of any size costs its own rows only.  A collection of
    fewer than k + 1 rows gives all there are; an empty one gives nothing.
    """
    spark = vecs.sparkSession
    stored = materialize(vecs, "vectors")
    several = materialize(stored.groupBy("name", "dir").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"), "copies")
    members = stored.join(several.select("name", "dir", "first"), ["name", "dir"]).select("name", "dir", "first", "id")
    least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    salted = members.groupBy("name", "dir", "first", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("salt")).agg(least(F.collect_list("id")).alias("ids"))
    groups = salted.groupBy("name", "dir", "first").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    indexed = stored.join(groups.select("name", F.col("first").alias("id"), "ids"), ["name", "id"], "left")
    skipped = members.where("id <> first").select("name", "id")
    index = indexed.join(skipped, ["name", "id"], "left_anti").select("name", "id", "vec", F.coalesce("ids", F.array("id")).alias("ids"))
    index = materialize(index, "index")

    model = Curves(dim, curves, seed)
    for name, n in [(r["name"], r["n"]) for r in index.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()]:
        part = index.where(F.col("name") == name).select("vec", F.xxhash64("id").alias("tie"))
        drawn = (part.where(F.col("tie") % 1_000_003 < int(1_000_003 * SAMPLE * 1.1 / n)).limit(SAMPLE) if n > SAMPLE else part).toPandas()
        if len(drawn):
            model.learn(name, _unit(_matrix(drawn["vec"], dim)), drawn["tie"].to_numpy(), -(-n // block), window * len(drawn) / n)
    shared = spark.sparkContext.broadcast(model)

    def place(batches):
        for pdf in batches:
            for name, part in pdf.groupby("name", sort=False):
                unit = _unit(_matrix(part["vec"], dim))
                for c in range(curves):
                    key = shared.value.key(name, c, unit, part["tie"].to_numpy())
                    bounds, (low, high) = shared.value.bounds[name][c], shared.value.near[name][c]
                    at = np.searchsorted(bounds, key, side="right")
                    after = np.flatnonzero((at < len(bounds)) & (key >= low[np.minimum(at, len(low) - 1)])) if len(low) else np.empty(0, int)
                    before = np.flatnonzero((at > 0) & (key <= high[np.maximum(at - 1, 0)])) if len(high) else np.empty(0, int)
                    rows = np.concatenate((np.arange(len(part)), after, before))
                    block_of = np.concatenate((at, at[after] + 1, at[before] - 1)).astype(np.int32)
                    guest = np.arange(len(rows)) >= len(part)
                    taken = part.iloc[rows]
                    yield pd.DataFrame({"name": taken["name"].to_numpy(), "curve": np.int32(c), "block": block_of, "key": key[rows], "guest": guest, "id": taken["id"].to_numpy(), "ids": taken["ids"].to_numpy(), "vec": taken["vec"].to_numpy()})

    placed = index.withColumn("tie", F.xxhash64("id")).mapInPandas(place, "name string, curve int, block int, key bigint, guest boolean, id string, ids array<string>, vec binary")
    ordered = placed.repartition("name", "curve", "block").sortWithinPartitions("name", "curve", "block", "key", "id")
    lists = ordered.mapInArrow(lambda batches: _slide(batches, dim, k, window), f"name string, id string, found {_FOUND}")
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k)
    merged = materialize(lists.groupBy("name", "id").agg(best.alias("found")), "lists")

    single = merged.join(several.select("name", F.col("first").alias("id")), ["name", "id"], "left_anti").select("name", "id", "found")
    owned = groups.select("name", "first", "dir", F.transform("ids", lambda x: F.struct(F.lit(-UNIT).cast("bigint").alias("score"), x.alias("other"))).alias("own"))
    around = owned.join(merged.withColumnRenamed("id", "first"), ["name", "first"]).select("name", "first", F.concat("own", "found").alias("pool"))
    copied = members.join(around, ["name", "first"]).select(
        "name", "id", F.slice(F.array_sort(F.filter("pool", lambda f: f["other"] != F.col("id"))), 1, k).alias("found")
    )
    rows = single.unionByName(copied).select("name", "id", F.explode("found").alias("f"))
    return rows.select("name", "id", F.col("f.other").alias("other"), (-F.col("f.score")).alias("score"))


def pairs(near: DataFrame) -> DataFrame:
    """(name, a, b) with a < b: pairs of which either is among the other's nearest."""
    return near.select("name", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
