"""Filling containers of fixed capacity with items of varying length: minimum bin slack.

Items meet in groups of bounded size by a hash of their id.  Inside a group only the numbers of items
per length matter, so the fullest bin is found by a subset-sum dynamic program over the lengths left,
kept as bits of one integer per length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import TOKENIZER, token_count
from tessera.storage import materialize

#: Items that are packed together; more of them leave less slack but make longer tasks.
GROUP_ITEMS = 20_000


def fill(lengths: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Yield (items per length of one bin, how many such bins) until all items are used.

    Each bin starts with the longest item left and takes the fullest combination that fits beside it;
    a combination is used as often as the items left allow.  Lengths must be 1 to ``capacity``.
    """
    left = {n: c for n, c in lengths.items() if c > 0}
    order = sorted(left, reverse=True)
    while left:
        order = [n for n in order if n in left]
        seed = order[0]
        room = capacity - seed
        full = 1 << room
        mask = (full << 1) - 1
        reach, steps = 1, []
        for n in order:
            if n > room:
                continue
            many = min(left[n] - (n == seed), room // n)
            take = 1
            while many > 0:
                take = min(take, many)
                steps.append((n, take, reach))
                reach |= (reach << (n * take)) & mask
                many -= take
                take *= 2
            if reach & full:
                break
        at = reach.bit_length() - 1
        bin_ = {seed: 1}
        for n, take, before in reversed(steps):
            if not (before >> at) & 1:
                bin_[n] = bin_.get(n, 0) + take
                at -= n * take
        times = min(left[n] // c for n, c in bin_.items())
        for n, c in bin_.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        yield bin_, times


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "item", "piece"], kind="stable")
    sizes = pdf["size"].to_numpy()
    cut = np.flatnonzero(np.diff(sizes)) + 1
    starts = np.concatenate(([0], cut)) if len(sizes) else np.array([], dtype=int)
    ends = np.concatenate((cut, [len(sizes)])) if len(sizes) else np.array([], dtype=int)
    at = {int(sizes[a]): a for a in starts}
    lengths = {int(sizes[a]): int(b - a) for a, b in zip(starts, ends, strict=True)}
    bins = np.empty(len(sizes), dtype="int64")
    number = 0
    for bin_, times in fill(lengths, capacity):
        for n, c in bin_.items():
            a = at[n]
            bins[a : a + c * times] = number + np.repeat(np.arange(times), c)
            at[n] = a + c * times
        number += times
    return pdf.assign(container=bins)[["grp", "container", "item", "piece", "size"]]


def pieces(docs: DataFrame, item: str, text: str, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(item, piece, size): every text once, or in full pieces and a rest where it alone exceeds
    ``capacity``.  Texts without tokens need no space and give no row; rows without an id neither."""
    sized = docs.select(F.col(f"`{item}`").alias("item"), token_count(F.col(f"`{text}`"), tokenizer).alias("n")).where("n > 0 and item is not null")
    full = F.floor((F.col("n") - 1) / capacity).cast("int")
    cut = sized.select("item", "n", F.posexplode(F.sequence(F.lit(0), full)).alias("piece", "__"))
    return cut.select("item", (F.col("piece") + 1).alias("piece"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(parts: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(grp, container, item, piece, size): ``parts`` of ``pieces`` in containers; a container is
    named by grp and container.  Equal lengths are used in order of item and piece."""
    stored = materialize(parts, "pieces")
    groups = max(1, -(-stored.count() // group_items))
    keyed = stored.withColumn("grp", F.pmod(F.xxhash64("item", "piece"), F.lit(groups)).cast("int"))
    schema = keyed.select("grp", F.lit(0).cast("bigint").alias("container"), "item", "piece", "size").schema
    return keyed.groupBy("grp").applyInPandas(lambda pdf: _pack_group(pdf, capacity), schema)
