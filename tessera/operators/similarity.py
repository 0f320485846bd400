"""Vector search, classification and comparison.

Searches compare a stated query set with all rows in blocks: both sides are cut into hash blocks of
bounded size, every pair of blocks is one matrix product, and only the best k or the pairs above a
threshold leave it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_eps

#: Rows of one block of either side.
BLOCK = 20_000


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _match(left: pd.DataFrame, right: pd.DataFrame, k: int | None, threshold: float | None, eps: float) -> pd.DataFrame:
    columns = ["query_id", "other_id", "similarity"]
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "other_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
    a, b = np.stack(left["v"].to_numpy()).astype(float), np.stack(right["v"].to_numpy()).astype(float)
    scale = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    s = a @ b.T / (scale + eps) if eps else np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale > 1e-18)
    x, y = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
    s = np.round(s, 6) + 0.0
    s[x[:, None] == y[None, :]] = -np.inf
    out = []
    for i in range(len(x)):
        good = np.flatnonzero(s[i] > (threshold if threshold is not None else -np.inf))
        if k is not None and len(good) > k:
            good = good[np.lexsort((y[good], -s[i, good]))[:k]]
        out.append(pd.DataFrame({"query_id": x[i], "other_id": y[good], "similarity": s[i, good]}))
    return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame(columns=columns)


def search(queries: DataFrame, base: DataFrame, id_col: str, vec: str, k: int | None = None, threshold: float | None = None, eps: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(query_id, other_id, similarity): for each query the k most similar other rows of ``base`` by
    cosine rounded to 6 digits, or all above ``threshold``, or both; ties to the smaller id.

    Null vectors do not take part; a vector without length has similarity 0 to all.  All vectors must
    be of one length.
    """
    slim = lambda df: df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v")).where("id is not null and v is not null")
    q, b = slim(queries), slim(base)
    nq, nb = _blocks(q, block), _blocks(b, block)
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("bb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint"))))
    b = b.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(nb))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))
    found = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(lambda x, y: _match(x, y, k, threshold, eps), "query_id bigint, other_id bigint, similarity double")
    if k is None or nb == 1:
        return found
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "other_id")))
    return ranked.where(F.col("r") <= k).drop("r")


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, centroid): mean vector of each label at length 1; a zero mean stays zero."""
    cells = df.select(F.col(f"`{label}`").alias("label"), F.posexplode(F.col(f"`{vec}`")).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return whole.select("label", F.transform("c", lambda e: F.when(F.col("n") > 1e-9, e["x"] / F.col("n")).otherwise(e["x"])).alias("centroid"))


#: Labels whose prototypes one task holds.
PROTOTYPES = 10_000


def classify(df: DataFrame, id_col: str, vec: str, prototypes: DataFrame, top: int = 3) -> DataFrame:
    """(id, rank, label, score): the ``top`` labels of each row by inner product with the prototypes,
    ties to the smaller label.

    The prototypes (label, centroid) are one row per label.  Up to ``PROTOTYPES`` of them are broadcast;
    of more, every block of them meets every row and the best of all blocks are kept.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    n = prototypes.count()
    if not n:
        raise ValueError("no examples")
    kind, id_type = prototypes.schema["label"].dataType, df.schema[id_col].dataType
    schema = StructType([StructField("id", id_type), StructField("rank", IntegerType()), StructField("label", kind), StructField("score", DoubleType())])
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v")).where("v is not null")
    blocks = -(-n // PROTOTYPES)
    numbered = prototypes.select("label", "centroid", F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("b"))
    found = []
    for block in range(blocks):
        rows = numbered.where(F.col("b") == block).select("label", "centroid").orderBy("label").collect()
        shared = df.sparkSession.sparkContext.broadcast(([r["label"] for r in rows], np.array([r["centroid"] for r in rows])))

        def score(batches, shared=shared):
            names, m = shared.value
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                s = np.round(np.stack(pdf["v"].to_numpy()).astype(float) @ m.T, 6)
                order = np.argsort(-s, axis=1, kind="stable")[:, :top]
                ids = pdf["id"].tolist()
                yield pd.DataFrame([(ids[i], r + 1, names[j], s[i, j]) for i in range(len(ids)) for r, j in enumerate(order[i])], columns=["id", "rank", "label", "score"])

        found.append(slim.mapInPandas(score, schema))
    if blocks == 1:
        return found[0]
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label")))
    return ranked.where(F.col("rank") <= top).select("id", F.col("rank").cast("int").alias("rank"), "label", "score")


def label_strengths(queries: DataFrame, base: DataFrame, id_col: str, vec: str, label: str, threshold: float, best: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_label, other_label, strength): mean of the ``best`` highest similarities above
    ``threshold`` between rows of two labels.  Every pair of blocks hands on only its own best of each
    pair of labels, so no list of similar pairs is ever made."""
    slim = lambda df: df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vec}`").cast("array<double>").alias("v")).where("id is not null and v is not null")
    q, b = slim(queries), slim(base)
    nq, nb = _blocks(q, block), _blocks(b, block)
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("bb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint"))))
    b = b.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(nb))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p, left in x.groupby("label"):
            for o, right in y.groupby("label"):
                u, w = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
                scale = np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(w, axis=1))
                s = np.round(np.divide(u @ w.T, scale, out=np.zeros_like(scale), where=scale > 1e-18), 6)
                s[left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]] = -np.inf
                some = s[s > threshold]
                out += [(p, o, v) for v in (np.partition(some, len(some) - best)[-best:] if len(some) > best else some)]
        return pd.DataFrame(out, columns=["query_label", "other_label", "similarity"])

    kind = base.schema[label].dataType.simpleString()
    kept = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(meet, f"query_label {kind}, other_label {kind}, similarity double")
    return best_chunk_means(kept, ["query_label", "other_label"], "similarity", best)


def best_chunk_means(pairs: DataFrame, by: list[str], score: str, best: int = 5) -> DataFrame:
    """(by..., strength): mean of the ``best`` highest scores of each group."""
    ranked = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score))))
    return ranked.where(F.col("__r") <= best).groupBy(*by).agg(F.round(F.avg(score), 6).alias("strength"))


def influence_type(strength: Column) -> Column:
    return F.when(strength > 0.9, "direct_citation").when(strength > 0.75, "paraphrase").when(strength > 0.6, "conceptual").otherwise("structural")


def influence_direction(source_date: Column, target_date: Column) -> Column:
    """Likelihood that the first influenced the second, by dates compared as text: 0.9 earlier, 0.1
    later, 0.5 equal or unknown."""
    return F.when(source_date < target_date, 0.9).when(source_date > target_date, 0.1).otherwise(0.5)


def usage_shifts(df: DataFrame, term: str, date: str, seq: str, vec: str, below: float = 0.7) -> DataFrame:
    """(term, seq, previous, similarity, shifted): consecutive usages of each term, regardless of its
    case, in order of date (null first) and seq."""
    ordered = Window.partitionBy("term").orderBy("date", "seq")
    rows = df.select(F.lower(F.col(f"`{term}`")).alias("term"), F.coalesce(F.col(f"`{date}`").cast("string"), F.lit("")).alias("date"), F.col(f"`{seq}`").alias("seq"), F.col(f"`{vec}`").alias("v"))
    lagged = rows.withColumns({"previous": F.lag("seq").over(ordered), "w": F.lag("v").over(ordered)}).where("previous is not null")
    similarity = F.round(cosine_eps(F.col("v"), F.col("w")), 6)
    return lagged.select("term", "seq", "previous", similarity.alias("similarity"), (similarity < below).alias("shifted"))


def _average_linkage(v: np.ndarray, within: float) -> np.ndarray:
    n = len(v)
    labels = np.arange(n)
    if n < 3:
        return np.zeros(n, dtype=int)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, dtype=bool)
    while alive.sum() > 1:
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] > within:
            break
        i, j = min(i, j), max(i, j)
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        labels[labels == j] = i
    return np.unique(labels, return_inverse=True)[1]


def meaning_clusters(df: DataFrame, term: str, seq: str, vec: str, within: float = 0.5, most: int = 5000) -> DataFrame:
    """(term, seq, cluster): average-linkage clusters of each term's usages by cosine distance, in order
    of their first usage; fewer than three usages are one cluster.

    Linkage compares all usages of a term in one task; of a term of more than ``most`` usages, which no
    task could hold, the cluster is null.
    """
    rows = df.select(F.lower(F.col(f"`{term}`")).alias("term"), F.col(f"`{seq}`").cast("bigint").alias("seq"), F.col(f"`{vec}`").cast("array<double>").alias("v")).where("v is not null")
    sizes = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > most).select("term")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        labels = _average_linkage(np.stack(pdf["v"].to_numpy()), within)
        order: dict[int, int] = {}
        return pdf[["term", "seq"]].assign(cluster=[order.setdefault(int(x), len(order)) for x in labels])

    held = rows.join(large, "term", "left_anti").groupBy("term").applyInPandas(link, "term string, seq bigint, cluster bigint")
    return held.unionByName(rows.join(large, "term", "left_semi").select("term", "seq", F.lit(None).cast("bigint").alias("cluster")))


def monotone_align(left: DataFrame, right: DataFrame, by: list[str], seq: str, vec: str, min_score: float = 0.0) -> DataFrame:
    """(by..., left_seq, right_seq, score): greedy alignment of two segment sequences of each key.

    For each left segment in order the best right segment after the last one used is taken, the first
    of equals; the sequence ends when the right side is used up.  Matches under ``min_score`` are
    dropped afterwards, they still advance.  One document pair is one task.
    """
    keep = lambda df: df.select(*by, F.col(f"`{seq}`").cast("bigint").alias("seq"), F.col(f"`{vec}`").cast("array<double>").alias("v"))
    schema = ", ".join([f"`{c}` {left.schema[c].dataType.simpleString()}" for c in by] + ["left_seq bigint", "right_seq bigint", "score double"])

    def align(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(x) and len(y):
            x, y = x.sort_values("seq"), y.sort_values("seq")
            a, b = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
            norm_b = np.linalg.norm(b, axis=1)
            last = -1
            for i in range(len(a)):
                if last + 1 >= len(b):
                    break
                s = b[last + 1 :] @ a[i] / (norm_b[last + 1 :] * np.linalg.norm(a[i]) + 1e-9)
                j = int(s.argmax())
                last += 1 + j
                rows.append((*[x[c].iat[0] for c in by], int(x["seq"].iat[i]), int(y["seq"].iat[last]), round(float(s[j]), 6)))
        return pd.DataFrame([r for r in rows if r[-1] >= min_score], columns=[*by, "left_seq", "right_seq", "score"])

    return keep(left).groupBy(*by).cogroup(keep(right).groupBy(*by)).applyInPandas(align, schema)
