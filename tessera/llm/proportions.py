"""Sampling that matches target category proportions: one sample per run for two kinds of categories.

A paper that names both a tradition and a language counts for both targets.  Per run the supplies of
all cells (tradition, language, either of them possibly unknown) are raked to the targets, which gives
every cell an acceptance probability and an exact number of papers; papers are then accepted on their
own with slight oversampling and the counts corrected exactly.  Papers are never made into rows: an
entry of any count is one row with the number of its papers that were accepted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.languages import language_code
from tessera.operators.hierarchy import name_key
from tessera.storage import materialize

_BUCKETS = 64
#: Targets that are handed to the runs together.
_CHUNK = 1000
_KINDS = ("tradition", "language")
_RAKINGS = 30
#: Draws of at least this variance follow the normal distribution.
_NORMAL = 60.0


def category_key(kind: Column | str, category: Column) -> Column:
    """Spelling-independent form of a category: the language code, else the normalised name."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(kind == "language", F.coalesce(language_code(category), name_key(category))).otherwise(name_key(category))


def _need() -> Column:
    share = F.ceil(F.col("share_bp").cast("long") * F.col("sample_size") / F.lit(10000).cast("decimal(10,0)"))
    return F.coalesce(F.greatest(F.col("min_rows").cast("long"), share.cast("long")), F.lit(0).cast("bigint"))


def needs_of(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, kind, category, need): one row for every run and target."""
    sizes = runs.select("run_id", "sample_size").where("run_id is not null").groupBy("run_id").agg(F.max("sample_size").alias("sample_size"))
    wanted = targets.select("kind", "category", "share_bp", "min_rows").where("kind is not null and category is not null").distinct()
    chunks = max(1, -(-wanted.count() // _CHUNK))
    grouped = wanted.groupBy(F.pmod(F.xxhash64("kind", "category"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("kind", "category", "share_bp", "min_rows")).alias("all"))
    asked = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rows = asked.join(grouped, "chunk").select("run_id", "sample_size", F.explode("all").alias("t")).select("run_id", "sample_size", "t.*")
    return rows.groupBy("run_id", "kind", "category").agg(F.max(_need()).alias("need"))


def supplies(entries: DataFrame, runs: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, tradition, language, entry_id, n): each entry once with the targets it names.

    Re-delivered entries count once.  Null, zero and negative counts, unknown runs and entries that
    name no target supply nothing; a category without a target is null."""
    keyed = targets.where("category is not null").groupBy("kind", category_key(F.col("kind"), F.col("category")).alias("key")).agg(F.min("category").alias("category"))
    once = entries.where("entry_id is not null and count > 0").groupBy("entry_id").agg(F.min(F.struct("run_id", *_KINDS, "count")).alias("e"))
    rows = once.select("entry_id", "e.run_id", F.col("e.count").cast("bigint").alias("n"), *[category_key(k, F.col(f"e.{k}")).alias(f"{k}_key") for k in _KINDS])
    for k in _KINDS:
        rows = rows.join(keyed.where(F.col("kind") == k).select(F.col("key").alias(f"{k}_key"), F.col("category").alias(k)), f"{k}_key", "left")
    known = runs.where("run_id is not null").select("run_id").distinct()
    return rows.where("tradition is not null or language is not null").join(known, "run_id", "left_semi").select("run_id", *_KINDS, "entry_id", "n")


def quotas(cells: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many papers to take of each cell.

    ``cells``: supplies by first and second category, the last row and column being the unknown ones.
    ``first`` and ``second``: needs.  Papers that name both come first, raked to both needs; what is
    left is filled from those that name one.  A need is missed only where the supply is, even if the
    other kind gets more than it needs.
    """
    supply = cells.astype(np.int64)
    take = np.zeros_like(supply)
    both, inner = supply[:-1, :-1], take[:-1, :-1]
    rows, columns = np.minimum(first, supply[:-1].sum(1)), np.minimum(second, supply[:, :-1].sum(0))
    a, b = np.ones(len(rows)), np.ones(len(columns))
    for _ in range(_RAKINGS if both.any() else 0):
        for factor, goal, axis in ((a, rows, 1), (b, columns, 0)):
            reached = (both * np.minimum(1.0, np.outer(a, b))).sum(axis)
            factor *= np.divide(goal, reached, out=np.ones(len(goal)), where=reached > 0)
            np.clip(factor, 0, 1e6, out=factor)
    raked = both * np.minimum(1.0, np.outer(a, b))
    for axis, goal in ((1, rows), (0, columns)):
        over = np.divide(goal, raked.sum(axis), out=np.ones(len(goal)), where=raked.sum(axis) > goal)
        raked = raked * (over[:, None] if axis else over[None, :])
    inner[:] = np.floor(raked + 1e-9)
    # Whole papers: cells whose row and column still lack one, the largest fractions first.
    for i, j in zip(*np.unravel_index(np.argsort(inner - raked, axis=None, kind="stable"), raked.shape), strict=True) if raked.size else ():
        more = min(rows[i] - inner[i].sum(), columns[j] - inner[:, j].sum(), both[i, j] - inner[i, j])
        inner[i, j] += max(0, more)
    for axis, goal, alone in ((1, rows, np.s_[:-1, -1]), (0, columns, np.s_[-1, :-1])):
        take[alone] = np.minimum(goal - inner.sum(axis), supply[alone])
    for i in np.flatnonzero(take[:-1].sum(1) < rows):
        for j in np.argsort(-(columns - take[:, :-1].sum(0)), kind="stable"):
            inner[i, j] += min(rows[i] - take[i].sum(), both[i, j] - inner[i, j])
    take[-1, :-1] = np.clip(columns - inner.sum(0), 0, take[-1, :-1])
    for j in np.flatnonzero(take[:, :-1].sum(0) < columns):
        for i in np.argsort(take[:-1].sum(1) - rows, kind="stable"):
            inner[i, j] += min(columns[j] - take[:, j].sum(), both[i, j] - inner[i, j])
    take[:-1, -1] = np.clip(rows - inner.sum(1), 0, take[:-1, -1])
    return take


def _run_quotas(key, cells: pd.DataFrame, needs: pd.DataFrame) -> pd.DataFrame:
    names = {k: sorted(needs.loc[needs["kind"] == k, "category"]) for k in _KINDS}
    need = {k: dict(zip(needs.loc[needs["kind"] == k, "category"], needs.loc[needs["kind"] == k, "need"], strict=True)) for k in _KINDS}
    at = [{c: i for i, c in enumerate(names[k])} for k in _KINDS]
    table = np.zeros((len(at[0]) + 1, len(at[1]) + 1), dtype=np.int64)
    places = [(at[0].get(t, len(at[0])), at[1].get(x, len(at[1]))) for t, x in zip(cells["tradition"], cells["language"], strict=True)]
    for (i, j), n in zip(places, cells["supply"], strict=True):
        table[i, j] += n
    take = quotas(table, *(np.array([need[k][c] for c in names[k]], dtype=np.int64) for k in _KINDS))
    cells = cells.assign(quota=[take[p] for p in places])
    return cells[["run_id", "tradition", "language", "supply", "quota"]]


def _binomial(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
    """Accepted of ``n`` papers, each with probability ``p``: the quantile ``u`` of their number."""
    from statistics import NormalDist

    n, p, u = n.to_numpy(float), p.to_numpy(float), u.to_numpy(float)
    k = np.where(p >= 1, n, 0.0)
    spread = n * p * (1 - p)
    wide = np.flatnonzero((p < 1) & (spread >= _NORMAL))
    quantile = NormalDist().inv_cdf
    k[wide] = np.clip(np.rint(n[wide] * p[wide] + np.sqrt(spread[wide]) * np.array([quantile(min(max(x, 1e-12), 1 - 1e-12)) for x in u[wide]])), 0, n[wide])
    # Of many likely papers the unlikely rest is counted.
    rest = np.flatnonzero((p < 1) & (spread < _NORMAL) & (p > 0))
    q = np.where(p[rest] > 0.5, 1 - p[rest], p[rest])
    m, left, step = n[rest], u[rest].copy(), np.zeros(len(rest))
    chance = np.exp(m * np.log1p(-q))
    open_ = np.ones(len(rest), dtype=bool)
    while (open_ := open_ & (left >= chance) & (step < m)).any():
        left[open_] -= chance[open_]
        chance[open_] *= ((m - step) / (step + 1) * q / (1 - q))[open_]
        step[open_] += 1
    k[rest] = np.where(p[rest] > 0.5, m - step, step)
    return pd.Series(k.astype(np.int64))


def sample_to_targets(entries: DataFrame, runs: DataFrame, targets: DataFrame, oversample: float = 0.1, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of the papers behind ``entries``, one sample per run.

    ``sample``: run_id, tradition, language (null where the entry names no target of the kind),
    entry_id, papers.  Every paper of a cell is accepted with the probability quota / supply plus
    ``oversample`` and three standard deviations, by a hash of its entry; a cell that chance left short
    takes all its papers.  Exactly the quota stays, entries of the lowest hash first: counts over hash
    buckets decide whole buckets, only the bucket at the cut is ordered.  ``report``: run_id, kind,
    category, need, supply, drawn, missing, one row for every run and target.  Empty tables give an
    empty sample and nothing but deficits.
    """
    cell = ["run_id", *_KINDS]
    needs = materialize(needs_of(runs, targets), "needs")
    rows = materialize(supplies(entries, runs, targets), "entries")
    cells = rows.groupBy(*cell).agg(F.sum("n").cast("bigint").alias("supply"))
    schema = "run_id string, tradition string, language string, supply bigint, quota bigint"
    planned = materialize(cells.groupBy("run_id").cogroup(needs.groupBy("run_id")).applyInPandas(_run_quotas, schema), "quotas")

    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "run_id", "entry_id"), 11).cast("double") / F.lit(float(1 << 53))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "run_id", "entry_id"), 11).cast("double") / F.lit(float(1 << 53))
    rate = F.least(F.lit(1.0), (F.col("quota") * (1 + oversample) + 3 * F.sqrt(F.col("quota").cast("double")) + 1) / F.col("supply"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in cell]
    rated = rows.alias("x").join(planned.where("quota > 0").alias("y"), same).select("x.*", "quota", rate.alias("p"))
    drawn = materialize(rated.withColumn("k", F.pandas_udf(_binomial, "bigint")("n", "p", uniform)).withColumn("u", order), "drawn")

    totals = drawn.groupBy(*cell).agg((F.sum("k") < F.max("quota")).alias("short"))
    kept = drawn.alias("x").join(totals.alias("y"), same).select("x.*", "short").withColumn("k", F.when(F.col("short"), F.col("n")).otherwise(F.col("k"))).where("k > 0")
    kept = kept.withColumn("bucket", F.floor(F.col("u") * _BUCKETS).cast("int"))
    counts = kept.groupBy(*cell, "bucket").agg(F.sum("k").alias("size"))
    ordered = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.withColumn("before", F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    placed = kept.alias("x").join(cuts.alias("y"), [*same, F.col("x.bucket") == F.col("y.bucket")]).select("x.*", "size", "before").where("before < quota")
    whole = placed.where("before + size <= quota").withColumn("papers", F.col("k"))
    edge = Window.partitionBy(*cell).orderBy("u", "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("before") + F.coalesce(F.sum("k").over(edge), F.lit(0))
    part = placed.where("before + size > quota").withColumn("papers", F.least(F.col("k"), F.col("quota") - earlier)).where("papers > 0")
    columns = [*cell, "entry_id", F.col("papers").cast("bigint").alias("papers")]
    sample = materialize(whole.select(*columns).unionByName(part.select(*columns)), "sample")

    per = lambda df, value, name: _by_target(df, value).withColumnRenamed("n", name)
    report = needs.join(per(cells, "supply", "supply"), ["run_id", "kind", "category"], "left").join(per(sample, "papers", "drawn"), ["run_id", "kind", "category"], "left")
    report = report.select("run_id", "kind", "category", "need", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("supply", "drawn")])
    return sample, report.withColumn("missing", F.greatest(F.col("need") - F.col("drawn"), F.lit(0)))


def _by_target(df: DataFrame, value: str) -> DataFrame:
    """(run_id, kind, category, n): sums of a table of cells."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("category")) for k in _KINDS])
    rows = df.select("run_id", F.explode(kinds).alias("c"), value).where("c.category is not null")
    return rows.groupBy("run_id", "c.kind", "c.category").agg(F.sum(value).alias("n"))
