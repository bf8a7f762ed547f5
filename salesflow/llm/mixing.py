"""Mixing sources to target weights: Pfair schedule of source blocks, earliest deadline first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.tables import running_totals, table
from salesflow.session import materialize

BLOCK_CHARS = 16_384
QUANTUM = 1000


def tempered_weights(sizes: DataFrame, source: str = "source", power: float = 0.5, quantum: int = QUANTUM) -> DataFrame:
    """Integer weights per source in proportion to size ** power, one at least; their sum is near ``quantum``.

    ``sizes`` has one row per source with ``chars``. A power of 1 keeps the natural shares, 0 makes all
    sources equal.
    """
    share = F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(power))
    total = sizes.agg(F.sum(share)).scalar()
    return sizes.select(source, F.greatest(F.lit(1), F.round(F.lit(quantum) * share / total)).cast("int").alias("weight"))


def hyperperiod(weights: DataFrame, source: str = "source") -> DataFrame:
    """The schedule of one period of Q = sum of weights slots: ``source``, ``turn`` (0-based), ``turn_slot``.

    Block j of a source with weight w is released at floor(j * Q / w) and due at ceil((j + 1) * Q / w).
    Every slot takes the released block that is due first (ties: first source in order). With these
    windows the rule meets every deadline, so after each slot every source has had its share to within
    less than one block. The table has Q rows, a number fixed by the weights and not by the corpus.
    """
    listed = weights.where(F.col("weight") > 0).agg(F.array_sort(F.collect_list(F.struct(
        F.col(source).alias("name"), F.col("weight").cast("bigint").alias("weight")))).alias("w"))
    listed = listed.withColumn("q", F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x["weight"]))
    done0 = F.transform("w", lambda x: F.lit(0).cast("bigint"))

    def step(state, slot):
        due = F.zip_with("w", state["done"], lambda x, n: F.struct(
            F.ceil((n + 1) * F.col("q") / x["weight"]).alias("due"), F.floor(n * F.col("q") / x["weight"]).alias("released")))
        ready = F.filter(F.transform(due, lambda d, i: F.struct(d["due"], i.alias("i"), d["released"])),
                         lambda d: d["released"] <= slot)
        pick = F.array_min(F.transform(ready, lambda d: F.struct(d["due"], d["i"])))["i"]
        return F.struct(F.transform(state["done"], lambda n, i: n + F.when(i == pick, 1).otherwise(0)).alias("done"),
                        F.concat(state["order"], F.array(pick)).alias("order"))

    start = F.struct(done0.alias("done"), F.array().cast("array<int>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("q") - 1), start, step, lambda s: s["order"])
    # a period without slots has nothing to explode
    slots = listed.where(F.col("q") > 0).select("w", order.alias("order")).select(
        "w", F.posexplode("order").alias("turn_slot", "i"))
    slots = slots.select(F.col("w")[F.col("i")]["name"].alias(source), F.col("turn_slot").cast("bigint").alias("turn_slot"))
    turns = F.array_sort(F.collect_list("turn_slot"))
    return slots.groupBy(source).agg(turns.alias("t")).select(source, F.posexplode("t").alias("turn", "turn_slot"))


def schedule(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS, text: str = "text",
             source: str = "source", key: str = "doc_id", power: float = 0.5, quantum: int = QUANTUM) -> DataFrame:
    """The slot of every document in the mix: ``key``, ``source``, chars, block, slot.

    The documents of a source, in the order of ``key`` and then of text, fill its blocks of
    ``block_chars`` characters; a document belongs to the block in which it starts. ``weights`` gives
    integer weights per source (default: tempered by size). Sources with no weight, or weight 0, get no slot (null).
    Every other document gets one: when a source has run out, its later slots stay empty and the others
    keep their order, so the deviation bound holds up to the slot where the first source ends. Null is
    a source of its own, null text has length 0, repeated rows are scheduled one by one.

    Only keys and lengths are shuffled. A hot source is spread over many ranges. Runs jobs when called.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                       F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"),
                       F.xxhash64(F.col(text)).alias("text_hash"))
    placed = materialize(running_totals(rows, ["source"], ["key", "text_hash"], {"before": "chars"}))
    if weights is None:
        sizes = placed.groupBy("source").agg(F.sum("chars").alias("chars"))
        weights = tempered_weights(sizes, power=power, quantum=quantum)
    else:
        weights = weights.select(F.col(source).alias("source"), "weight")
    weights = materialize(weights)
    turns = hyperperiod(weights)
    period = weights.agg(F.sum("weight").cast("bigint")).scalar()
    known = weights.where("weight > 0").select(F.col("source").alias("w_source"), F.col("weight").cast("bigint").alias("w"))
    blocks = placed.withColumn("block", F.floor(F.col("before") / block_chars))
    # weights and turns have a row per source and per slot of the period: Spark broadcasts them by their size
    blocks = blocks.join(known, F.col("source").eqNullSafe(F.col("w_source")), "left")
    blocks = blocks.withColumn("turn", F.pmod(F.col("block"), F.col("w"))).withColumn("cycle", F.floor(F.col("block") / F.col("w")))
    turns = materialize(turns.select(F.col("source").alias("t_source"), F.col("turn").cast("bigint").alias("t_turn"), "turn_slot"))
    out = blocks.join(turns, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("turn") == F.col("t_turn")), "left")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "text_hash", "chars", "block",
                      (F.col("cycle") * period + F.col("turn_slot")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents")).drop("text_hash")


SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, COALESCE(LENGTH(text), 0) AS chars,
         COALESCE(SUM(COALESCE(LENGTH(text), 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM documents),
blocks AS (SELECT doc_id, source, chars, CAST(FLOOR(before / {BLOCK_CHARS}) AS BIGINT) AS block FROM rows_),
sizes AS (SELECT source, SUM(chars) AS chars FROM rows_ GROUP BY source),
weights AS (SELECT source, CAST(GREATEST(1, ROUND({QUANTUM} * SQRT(GREATEST(chars, 1)) / (SELECT SUM(SQRT(GREATEST(chars, 1))) FROM sizes))) AS BIGINT) AS weight FROM sizes),
listed AS (SELECT LIST(source ORDER BY source) AS names, LIST(weight ORDER BY source) AS ws, CAST(SUM(weight) AS BIGINT) AS q FROM weights),
run AS (
  SELECT -1 AS slot, LIST_TRANSFORM(ws, lambda x: CAST(0 AS BIGINT)) AS done, 0 AS pick FROM listed
  UNION ALL
  SELECT slot + 1, LIST_TRANSFORM(RANGE(1, LEN(done) + 1), lambda i: done[i] + CASE WHEN i = best THEN 1 ELSE 0 END), best
  FROM (SELECT slot, done, ws, q, LIST_MIN(LIST_FILTER(LIST_TRANSFORM(RANGE(1, LEN(done) + 1), lambda i:
           CASE WHEN FLOOR(done[i] * q / ws[i]) <= slot + 1 THEN CAST(CEIL((done[i] + 1) * q / ws[i]) AS BIGINT) * 1000000 + i END), lambda v: v IS NOT NULL)) % 1000000 AS best
        FROM run, listed WHERE slot + 1 < q)),
turns AS (SELECT names[pick] AS source, slot, ROW_NUMBER() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM run, listed WHERE slot >= 0)
SELECT b.doc_id, b.source, CAST(b.chars AS BIGINT) AS chars, b.block, CAST((b.block // w.weight) * l.q + t.slot AS BIGINT) AS slot
FROM blocks b JOIN weights w ON b.source IS NOT DISTINCT FROM w.source CROSS JOIN listed l
JOIN turns t ON t.source IS NOT DISTINCT FROM b.source AND t.turn = b.block % w.weight
"""
