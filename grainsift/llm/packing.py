"""Vector best-fit packing of documents into training sequences."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm._common import prepare, renamed, table, token_count


@dataclass(frozen=True)
class Capacity:
    """What a bin holds: tokens, documents, and attention cost (the sum of squared
    piece lengths). ``rule`` picks among the bins with room: ``dot`` the greatest
    weighted dot product of demand and residual, ``norm`` the least weighted norm of
    the residual that would be left."""

    tokens: int = 4096
    docs: int = 64
    attention: int = 4096 * 4096 * 3 // 4
    weights: tuple[float, float, float] = (1.0, 0.25, 0.5)
    rule: str = "norm"

    def __post_init__(self) -> None:
        if min(self.tokens, self.docs, self.attention) < 1 or self.rule not in ("dot", "norm"):
            raise ValueError("capacities must be positive and the rule dot or norm")

    @property
    def piece(self) -> int:
        """The longest piece beside which a second one can fill the bin; where no bin of
        two can be full, the longest one that an empty bin holds."""
        spare = 2 * self.attention - self.tokens * self.tokens
        return min(self.tokens, (self.tokens + math.isqrt(spare)) // 2 if spare >= 0 else math.isqrt(self.attention))


SHARD_DOCS = 20_000
"""Documents that are packed together in one task."""


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The bin of each piece, longest first (ties in the order given). Scores are
    taken over all open bins at once; bins that can hold nothing more are closed."""
    whole = np.array([capacity.tokens, capacity.docs, capacity.attention], np.int64)
    scale = 1.0 / whole
    weights = np.array(capacity.weights)
    bins = np.empty(len(lengths), np.int64)
    residual = np.empty((64, 3), np.int64)
    names = np.empty(64, np.int64)
    n = made = 0
    order = np.argsort(-lengths, kind="stable")
    shortest = int(lengths.min()) if len(lengths) else 0
    least = np.array([shortest, 1, shortest * shortest])
    for i in order:
        size = int(lengths[i])
        demand = np.array([size, 1, size * size])
        room = residual[:n]
        fits = np.flatnonzero((room >= demand).all(axis=1))
        if len(fits):
            if capacity.rule == "dot":
                score = ((room[fits] * scale) * (demand * scale) * weights).sum(axis=1)
            else:
                score = -((((room[fits] - demand) * scale) ** 2) * weights).sum(axis=1)
            at = int(fits[np.argmax(score)])  # ties: the bin opened first
            residual[at] -= demand
        else:
            if n == len(residual):
                residual, names = np.concatenate([residual, np.empty_like(residual)]), np.concatenate([names, np.empty_like(names)])
            residual[n], names[n] = whole - demand, made
            at, made, n = n, made + 1, n + 1
        bins[i] = names[at]
        if (residual[at] < least).any():  # full: closed, order kept
            residual[at : n - 1], names[at : n - 1] = residual[at + 1 : n].copy(), names[at + 1 : n].copy()
            n -= 1
    return bins


def pack(docs: DataFrame, capacity: Capacity = Capacity(), shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``(doc_id, copy, piece, start, tokens, bin_id)``: every document's tokens in
    bins, under all three capacities.

    A document longer than the longest piece is cut into pieces, in order: full ones
    and a rest; ``start`` is the first token of a piece. Tokens are words between
    blanks. Documents are spread over shards by hash and packed within, each shard's
    bins being its own, so a task holds ``shard_docs`` rows of two numbers at every
    size. ``copy`` numbers repeated rows of an id and length. Texts without tokens,
    null ones too, need no bin: one row with a null bin_id. Null ids are packed like
    others. An empty table gives none.
    """
    prepare(docs.sparkSession)
    inner, at = renamed(docs)
    limit, shards = capacity.piece, max(1, math.ceil(docs.count() / shard_docs))
    sized = inner.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), token_count(F.col(at["text"])).alias("n"))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        ids, n = part.column("doc_id").combine_chunks(), part.column("n").to_numpy()
        valid, plain = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        same = np.r_[False, (plain[1:] == plain[:-1]) & (valid[1:] == valid[:-1]) & (n[1:] == n[:-1])] if len(n) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(n))))
        copies = np.arange(len(n)) - begin
        count = np.maximum(1, -(-n // limit))
        row = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * limit
        size = np.minimum(limit, n[row] - start)
        packed = size > 0
        bins = np.zeros(len(row), np.int64)
        shard = int(part.column("shard")[0].as_py()) if len(n) else 0
        bins[packed] = best_fit(size[packed], capacity) + (shard << 32)
        out = [ids.take(pa.array(row)), pa.array(copies[row]), pa.array(piece), pa.array(start), pa.array(size), pa.array(bins, mask=~packed)]
        return pa.table(dict(zip(("doc_id", "copy", "piece", "start", "tokens", "bin_id"), out, strict=True)))

    # an explicit number of tasks: the rows are few bytes, and adaptive execution would put all shards in a task or two
    parts = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sized.repartition(parts, "shard").groupBy("shard").applyInArrow(run, "doc_id long, copy long, piece long, start long, tokens long, bin_id long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
