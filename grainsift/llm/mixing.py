"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainsift.llm._common import WIDE_KEY, cut, renamed, small, table, token_count

MAX_EPOCHS = 1.5
"""No source is repeated more often than this."""
ENTROPY_SHARE = 0.98
"""Target entropy of the mixture as a share of the greatest possible."""
STEPS = 60
_BLOCK_DIGITS = 3


@dataclass(frozen=True)
class Weights:
    exponent: float
    weights: list[float]
    budget: int
    entropy_share: float = 1.0
    """Of the greatest possible entropy, what the weights reach."""
    epochs: float = 0.0
    """How often the most repeated source is taken."""


def _mixture(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    whole = sum(raised)
    return [r / whole for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w)


def _budget(tokens: list[int], weights: list[float], budget: int | None) -> float:
    """Without a budget: the least one that cuts no source below one epoch."""
    return float(budget) if budget is not None else max(t / w for t, w in zip(tokens, weights, strict=True) if t)


def part(weight: float, budget: int) -> int:
    """Whole tokens of a weight, not one less for the rounding of floats."""
    return math.floor(weight * budget * (1 + 1e-12) + 1e-6)


def solve(tokens: list[int], entropy_share: float | None = ENTROPY_SHARE, max_epochs: float | None = MAX_EPOCHS, budget: int | None = None) -> Weights:
    """Bisects the exponent in [0, 1]: the largest whose mixture reaches the entropy
    target, raised as far as the repetition limit asks. At 1 weights are the sources'
    own shares, at 0 all are equal. Without tokens all weights are 0. The repetition
    limit comes before the entropy target: what was reached of either is in the
    result. ValueError for a budget that no weights can spend within the limit."""
    if not sum(tokens):
        return Weights(1.0, [0.0] * len(tokens), 0)
    some = sum(t > 0 for t in tokens)

    def enough(x: float) -> bool:
        return entropy_share is None or entropy(_mixture(tokens, x)) >= entropy_share * math.log(some)

    def within(x: float) -> bool:
        w = _mixture(tokens, x)
        b = _budget(tokens, w, budget)
        return max_epochs is None or max(v * b / t for v, t in zip(w, tokens, strict=True) if t) <= max_epochs

    if budget is not None and max_epochs is not None and budget > max_epochs * sum(tokens) * (1 + 1e-12):
        raise ValueError(f"{budget} tokens can't be drawn from {sum(tokens)} with at most {max_epochs} epochs of a source")
    low, high = 0.0, 1.0
    if enough(1.0):
        low = 1.0
    else:
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if enough(mid) else (low, mid)
    exponent = low
    if not within(exponent):
        low, high = exponent, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if within(mid) else (mid, high)
        exponent = high
    weights = _mixture(tokens, exponent)
    whole = math.ceil(_budget(tokens, weights, budget) * (1 - 1e-12) - 1e-6)
    reached = entropy(weights) / math.log(some) if some > 1 else 1.0
    return Weights(exponent, weights, whole, reached, max(w * _budget(tokens, weights, budget) / t for w, t in zip(weights, tokens, strict=True) if t))


def mix_sources(
    docs: DataFrame, entropy_share: float | None = ENTROPY_SHARE, max_epochs: float | None = MAX_EPOCHS, budget: int | None = None, seed: int = 17, report: bool = False
) -> DataFrame:
    """The mixture: each document once per epoch it is drawn in, with all its columns
    (with ``report`` also ``epoch`` and ``perm_key``).

    Source s gets ``weight * budget`` tokens: whole epochs first, then the first
    documents of one more permutation, as many as fit. Epoch e is ordered by
    ``perm_key``, the MD5 of doc_id, epoch and seed; its first three digits are its
    block. Block totals find the block in which the budget ends and only that block
    is sorted, so no task ever holds a source, however hot; the mixture itself is a
    scan with a broadcast row per source (beyond 192 MB of sources: a join).

    A null source is a source of its own. A null text has no tokens; documents
    without tokens cost nothing and come along. Rows with equal ids (null ones
    too) share their keys: they are in or out together. Sources are rows on the
    driver while weights are solved: domains in their millions are fine, ids are not.
    A budget beyond the repetition limit is a ValueError. Where the largest group
    of a part epoch doesn't fit, the epoch ends before it. A source without
    tokens is taken once. An empty table stays empty.
    """
    inner, at = renamed(docs)
    tokens = token_count(F.col(at["text"]))
    source = F.col(at["source"]).cast("string")
    ident = F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("null"))

    def key(epoch: F.Column | int) -> F.Column:
        return F.md5(F.concat_ws(":", ident, F.lit(epoch).cast("string") if isinstance(epoch, int) else epoch.cast("string"), F.lit(str(seed))))

    # the part epoch has the number -1 here, so its blocks need no second scan
    in_part = key(-1)
    blocks = cut(inner.groupBy(source.alias("s"), F.substring(in_part, 1, _BLOCK_DIGITS).alias("b")).agg(F.sum(tokens).alias("t")))
    running = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = blocks.groupBy("s").agg(F.sum("t").alias("total")).orderBy("s").collect()
    found = solve([r["total"] for r in totals], entropy_share, max_epochs, budget)
    rows = []
    for r, w in zip(totals, found.weights, strict=True):
        share = part(w, found.budget)
        epochs, rest = divmod(share, r["total"]) if r["total"] else (1, 0)
        rows.append((r["s"], epochs, rest))
    spark = docs.sparkSession
    plan = small(spark.createDataFrame(rows, "ps string, epochs long, rest long"), len(rows), WIDE_KEY)
    before = F.sum("t").over(running) - F.col("t")
    ends = blocks.withColumn("before", before).join(plan, F.col("s").eqNullSafe(F.col("ps")))
    ends = ends.where("before <= rest and rest < before + t").select(F.col("s").alias("es"), F.col("b").alias("eb"), (F.col("rest") - F.col("before")).alias("room")).collect()
    end_rows = [tuple(r) for r in ends]
    limit = small(spark.createDataFrame(end_rows, "es string, eb string, room long"), len(end_rows), WIDE_KEY)
    inside = inner.select(source.alias("s"), in_part.alias("k"), tokens.alias("t")).join(limit, F.col("s").eqNullSafe(F.col("es")) & (F.substring("k", 1, _BLOCK_DIGITS) == F.col("eb")))
    total = F.sum("t").over(Window.partitionBy("s").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("sum", total).where("sum <= room").groupBy("s").agg(F.max("k").alias("k")).collect()
    last_key = {r["s"]: r["k"] for r in last}
    end_block = {r["es"]: r["eb"] for r in ends}
    # up to which key the part epoch goes; a source whose rest ends in no block takes all or none
    cuts = [(s, epochs, last_key.get(s) or end_block.get(s) or ("g" if rest else "")) for s, epochs, rest in rows]
    cut_rows = small(spark.createDataFrame(cuts, "ms string, epochs long, upto string"), len(cuts), WIDE_KEY)
    drawn = inner.join(cut_rows, source.eqNullSafe(F.col("ms")))
    drawn = drawn.withColumn("n", F.col("epochs") + F.when(in_part <= F.col("upto"), 1).otherwise(0)).where("n > 0")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = drawn.select(*inner.columns, "epoch", key(F.when(F.col("epoch") < F.col("epochs"), F.col("epoch")).otherwise(F.lit(-1))).alias("perm_key"))
    return out.toDF(*docs.columns, "epoch", "perm_key") if report else out.select(*inner.columns).toDF(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, report=True).drop("text")


SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS t, md5(coalesce(doc_id::VARCHAR, 'null') || ':-1:17') AS k
  FROM documents),
totals AS (SELECT source, sum(t)::BIGINT AS total FROM tokens GROUP BY source),
facts AS (
  SELECT list(total::DOUBLE / s ORDER BY source) FILTER (total > 0) AS p, list(total::DOUBLE ORDER BY source) FILTER (total > 0) AS n, count(*) FILTER (total > 0) AS n_some
  FROM totals, (SELECT sum(total)::DOUBLE AS s FROM totals)),
bisect_entropy(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
      -list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2) / list_sum(list_transform(p, lambda y: pow(y, (low + high) / 2)))
        * ln(pow(x, (low + high) / 2) / list_sum(list_transform(p, lambda y: pow(y, (low + high) / 2)))))) >= {ENTROPY_SHARE}::DOUBLE * ln(n_some) AS ok
    FROM bisect_entropy, facts WHERE i < {STEPS})),
first AS (
  SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= {ENTROPY_SHARE}::DOUBLE * ln(n_some) THEN 1.0::DOUBLE ELSE low END AS a
  FROM bisect_entropy, facts WHERE i = {STEPS}),
bisect_epochs(i, low, high) AS (
  SELECT 0, a, 1.0::DOUBLE FROM first
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
      list_max(list_transform(p, lambda x: pow(x, (low + high) / 2) / x)) * list_max(list_transform(p, lambda x: x / pow(x, (low + high) / 2))) <= {MAX_EPOCHS}::DOUBLE AS ok
    FROM bisect_epochs, facts WHERE i < {STEPS})),
chosen AS (
  SELECT CASE WHEN list_max(list_transform(p, lambda x: pow(x, a) / x)) * list_max(list_transform(p, lambda x: x / pow(x, a))) <= {MAX_EPOCHS}::DOUBLE THEN a ELSE high END AS a
  FROM first, bisect_epochs, facts WHERE i = {STEPS}),
weights AS (
  SELECT source, total, pow(total / list_sum(n), a) / list_sum(list_transform(p, lambda y: pow(y, a))) AS w
  FROM totals, facts, chosen WHERE total > 0),
budget AS (SELECT ceil(max(total / w) * (1 - 1e-12) - 1e-6) AS b FROM weights),
plan AS (
  SELECT source, floor(w * b * (1 + 1e-12) + 1e-6)::BIGINT // total AS epochs, floor(w * b * (1 + 1e-12) + 1e-6)::BIGINT % total AS rest FROM weights, budget
  UNION ALL SELECT source, 1, 0 FROM totals WHERE total = 0),
summed AS (SELECT doc_id, source, k, sum(t) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING) AS sum FROM tokens)
SELECT doc_id, s.source, e AS epoch, CASE WHEN e < epochs THEN md5(coalesce(doc_id::VARCHAR, 'null') || ':' || e || ':17') ELSE k END AS perm_key
FROM summed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source,
  LATERAL (SELECT unnest(range(0, epochs + CASE WHEN rest > 0 AND sum <= rest THEN 1 ELSE 0 END)) AS e)
"""
