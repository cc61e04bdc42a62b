"""Texts of varying length packed into containers of fixed token capacity.

Cost-balanced packing: a document of t tokens costs ``LINEAR * t + QUADRATIC * t ** 2`` (the linear layers, and attention within the
document); a sequence costs what its documents cost together. Documents are taken in descending order, each goes to the sequence
of the lowest cost that has room for it (and for the separator between two items); a new one is opened only if none has. So
sequences with a long document get fewer others, and short documents level the costs. Opening late keeps the gaps small:
0.2 % to 0.8 % of the space is unused on the test data, where sequences opened beforehand and filled evenly left 4.9 %.

Only texts beyond the capacity are cut: into full pieces, each a container of its own, and one rest that is packed.

Scale: the texts are read once and counted in Arrow batches; only (id, tokens) is shuffled. Packing runs in shards of about
``docs_per_shard`` ids by hash, all targets at once, so a group is bounded whatever the applicant or family of a document; each
shard wastes at most a few containers. A container number is ``number within the shard * shards + shard``: unique in its
target without another pass.

Defined results: null and empty texts (no tokens) take no container (null number and position); a repeated id counts once.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.tokens import TOKENIZERS, VOCABULARY, token_count

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
DOCS_PER_SHARD = 8192
SCHEMA = "target_id int, container_no long, position int, doc_id long, piece_no int, n_pieces int, token_start long, token_end long"


def cost(tokens: int) -> float:
    """Estimated cost of a document."""
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def balanced(sizes: list[int], capacity: int, separator: int, cost: Callable[[int], float] = cost) -> list[list[int]]:
    """Containers as lists of indices into ``sizes`` (descending, at most the capacity): each to the cheapest with room."""
    held: list[list[int]] = []
    free: list[int] = []
    # the open sequences by (cost, number), in classes by the power of two of their room: all of a higher class have room
    classes: list[list[tuple[float, int]]] = [[] for _ in range(max(1, capacity).bit_length() + 1)]
    for i, s in enumerate(sizes):
        need, best, where = s + separator, None, -1
        low = need.bit_length()
        for n in range(low, len(classes)):
            if classes[n] and n > low and (best is None or classes[n][0] < best):
                best, where = classes[n][0], n
            elif classes[n] and n == low:
                hit = next((x for x in classes[n] if free[x[1]] >= need), None)
                if hit is not None:
                    best, where = hit, n
        if best is None:
            c, k = 0.0, len(held)
            held.append([])
            free.append(capacity - s)
        else:
            c, k = best
            classes[where].pop(bisect.bisect_left(classes[where], best))
            free[k] -= need
        held[k].append(i)
        bisect.insort(classes[max(0, free[k]).bit_length()], (c + cost(s), k))
    return held


def pack(sizes: list[int], capacity: int, separator: int) -> tuple[list[int], list[int], int]:
    """Container and position (from 1) of each size, given in descending order and at most the capacity; and how many containers."""
    held = balanced(sizes, capacity, separator)
    where, place = [0] * len(sizes), [0] * len(sizes)
    for k, h in enumerate(held):
        for p, i in enumerate(h, 1):
            where[i], place[i] = k, p
    return where, place, len(held)


def pack_shard(ids: np.ndarray, tokens: np.ndarray, targets: list[tuple[int, int, int]], shard: int, shards: int) -> pd.DataFrame:
    """All containers of a shard for all targets."""
    parts = []
    for target, capacity, separator in targets:
        full, rest = np.divmod(tokens, capacity)
        pieces = full + (rest > 0)
        some = np.flatnonzero(rest > 0)
        order = some[np.lexsort((ids[some], -rest[some]))]
        where, place, used = pack(rest[order].tolist(), capacity, separator)
        k = np.repeat(np.arange(len(ids)), full)  # the full pieces
        piece = np.arange(len(k)) - np.repeat(np.cumsum(full) - full, full)
        none = np.flatnonzero(tokens == 0)
        who = np.concatenate([order, k, none]).astype(np.int64)
        no = np.concatenate([np.array(where, dtype=np.int64), used + np.arange(len(k), dtype=np.int64)]) * shards + shard
        at = np.concatenate([np.array(place, dtype=np.int64), np.ones(len(k), dtype=np.int64)])
        first = np.concatenate([full[order], piece, np.zeros(len(none), dtype=np.int64)])
        parts.append(
            pd.DataFrame(
                {
                    "target_id": np.full(len(who), target, dtype=np.int32),
                    "container_no": pd.array(np.concatenate([no, np.zeros(len(none), dtype=np.int64)]), dtype="Int64"),
                    "position": pd.array(np.concatenate([at, np.zeros(len(none), dtype=np.int64)]), dtype="Int32"),
                    "doc_id": ids[who],
                    "piece_no": (first + 1).astype(np.int32),
                    "n_pieces": np.maximum(pieces[who], 1).astype(np.int32),
                    "token_start": first * capacity,
                    "token_end": np.minimum((first + 1) * capacity, tokens[who]),
                }
            )
        )
        if len(none):
            parts[-1].loc[len(who) - len(none) :, ["container_no", "position"]] = pd.NA
    return pd.concat(parts, ignore_index=True)


def packed(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """A row per target and document or piece: ``SCHEMA``. The targets are a short list (one row per container kind)."""
    wanted = sorted((r[0], r[1], r[2] or 0) for r in targets.select("target_id", "capacity_tokens", "separator_tokens").distinct().collect() if r[1] and r[1] > 0)
    shards = max(1, -(-docs.count() // docs_per_shard))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(token_count(F.col(text_col), tokenizers, vocabulary), F.lit(0)).alias("tokens"))
    sized = sized.filter("doc_id is not null").withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id), {shards}) as int)"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"]).drop_duplicates("doc_id")
        return pack_shard(pdf["doc_id"].to_numpy(np.int64), pdf["tokens"].to_numpy(np.int64), wanted, int(pdf["shard"].iloc[0]), shards)

    # by shard, with a number of partitions of its own: small rows would be put together into one task
    return sized.repartition(shards, "shard").groupBy("shard").applyInPandas(run, SCHEMA)


def fill_report(packing: DataFrame, targets: DataFrame) -> DataFrame:
    """Containers, tokens, the share of unused space and the spread of cost (standard deviation over mean) of each target."""
    t = F.col("token_end") - F.col("token_start")
    used = packing.filter("container_no is not null").groupBy("target_id", "container_no").agg(F.sum(t).alias("t"), F.count("*").alias("n"), F.sum(LINEAR * t + QUADRATIC * t * t).alias("cost"))
    df = used.join(targets.select("target_id", "capacity_tokens", "separator_tokens"), "target_id")
    fill = F.col("t") + (F.col("n") - 1) * F.col("separator_tokens")
    return df.groupBy("target_id").agg(
        F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.max(fill).alias("fullest"),
        (1 - F.sum(fill) / F.sum("capacity_tokens")).alias("unused_share"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"),
    )
