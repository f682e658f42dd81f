"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Every source is a periodic task. Its documents, in hash order, form blocks of `block_rows`; block number j (from 0) of
a source of weight w may not start before slot floor(j / w) and is due by slot ceil((j + 1) / w). One block is emitted
per slot, the released block with the earliest deadline first, so at every slot each live source has received its
weight's share to within less than one block.

Every block of the corpus is planned, by default: the driver reads the rows of each source and deals blocks out of a heap,
with weights in units of 2^-36 of the whole. Rounding moves a share by less than (sources + 1) / 2^36, which is far below
one block over all slots. Documents find their slot by their rank within their source; each slice of ranks carries the
slots of its own blocks only. The driver holds a number a block, at most MOST_BLOCKS beside one per source: beyond
MOST_BLOCKS * `block_rows` rows (33 million), blocks have more rows, and the bound of one block with them.

With `units`, weights are rounded to whole units of a hyperperiod of D slots (D = the sum of the units), which repeats;
only one is planned: a fold over D slots on a single row of per-source state. The bound then holds against the rounded
weights, not the given ones.

A source that ends leaves its later slots empty; the others keep their release times. No row is dropped or repeated.

Defined cases: a null source is a source of its own; an empty table gives an empty result; repeated rows are separate
rows, in any order among themselves; null ids and texts are kept, after the hash of the null; ties of deadlines go by the
order of sources; texts aren't read by `schedule`, and the longest is one row of `mix`; columns besides those used are
ignored by `schedule` and kept by `mix`, also ones called `slot` or `block`.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmesh.llm.common import pick, ranked

#: Units of the whole weight in an exact plan, and the part of the whole that a source of no weight gets there.
FINE = 1 << 36
LEAST = 1000
BLOCK_ROWS = 32
MOST_BLOCKS = 1 << 20
TEMPERATURE = 0.5


def source_key(name: str = "source"):
    return F.coalesce(F.concat(F.lit("s:"), F.col(name)), F.lit("null"))


def target_weights(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float) -> DataFrame:
    """source_key, rows, w: the weight as given (0 if absent), or else the row count to the power `temperature`."""
    counts = docs.select(source_key().alias("source_key")).groupBy("source_key").agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        return counts.withColumn("w", F.pow(F.col("rows").cast("double"), F.lit(float(temperature))))
    pairs = [x for k, v in weights.items() for x in (F.lit("null" if k is None else f"s:{k}"), F.lit(float(v)))]
    given = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return counts.withColumn("w", F.coalesce(given[F.col("source_key")], F.lit(0.0)))


def fine_units(weights: list[float]) -> list[int]:
    total = sum(weights)
    return [max(1, round(FINE * w / total)) if w > 0 else FINE // LEAST for w in weights]


def earliest_deadlines(units: list[int], blocks: list[int]) -> list[list[int]]:
    """The slot of each block of each source, earliest deadline first among the released; no slot is visited in vain."""
    d = sum(units)
    due = lambda i, j: -(-(j + 1) * d // units[i])
    slots: list[list[int]] = [[] for _ in units]
    waiting = [(0, i) for i in range(len(units)) if blocks[i]]
    ready: list[tuple[int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (due(i, len(slots[i])), i))
        i = heapq.heappop(ready)[1]
        slots[i].append(slot)
        if len(slots[i]) < blocks[i]:
            heapq.heappush(waiting, (len(slots[i]) * d // units[i], i))
        slot += 1
    return slots


def exact_plan(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """One row per source: source_key, units of weight, their sum D as period, the slots of all its blocks, and their turns,
    which number the slots that are used. Then the rows of a block, more than asked for if there are over most_blocks."""
    rows = sorted(map(tuple, target_weights(docs, weights, temperature).collect()))
    block_rows = max(block_rows, -(-sum(n for _, n, _ in rows) // most_blocks))
    units = fine_units([w for _, _, w in rows])
    slots = earliest_deadlines(units, [-(-n // block_rows) for _, n, _ in rows])
    period, used = sum(units), np.sort(np.concatenate([np.array(s, np.int64) for s in slots])) if slots else np.zeros(0, np.int64)
    planned = [(k, u, period, s, np.searchsorted(used, s).tolist()) for (k, _, _), u, s in zip(rows, units, slots, strict=True)]
    return docs.sparkSession.createDataFrame(planned, "source_key string, units long, period long, slots array<long>, turns array<long>"), block_rows


def plan(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, units: int) -> DataFrame:
    """One row per source: source_key, rows, units of weight, period D, and the slots its blocks take in a period.

    weights: target weight by source (absent sources: 0 units are raised to 1, so that no source starves). Without it,
    the weight of a source is its row count to the power `temperature`. The plan holds D <= units + number of sources
    slots, whatever the number of documents.
    """
    weighted = target_weights(docs, weights, temperature)
    rows = weighted.groupBy().agg(F.array_sort(F.collect_list(F.struct("source_key", "rows", "w"))).alias("t"))
    total = "aggregate(t, 0D, (a, x) -> a + x.w)"
    rows = rows.selectExpr("t", f"transform(t, x -> greatest(1, cast(round({units} * x.w / greatest({total}, 1e-300)) as int))) as u")
    rows = rows.selectExpr("t", "u", "aggregate(u, 0, (a, x) -> a + x) as d").where("d > 0")
    pick_next = """array_min(transform(u, (x, i) ->
        if(acc.done[i] < x and (acc.done[i] * d) div x <= slot,
           named_struct('due', cast(ceil((acc.done[i] + 1) * cast(d as double) / x) as int), 'i', i), null))).i"""
    steps = f"""aggregate(sequence(0, d - 1), named_struct('done', transform(u, x -> 0), 'took', cast(array() as array<int>)),
        (acc, slot) -> aggregate(array({pick_next}), acc,
            (b, p) -> named_struct('done', transform(b.done, (x, i) -> if(i = p, x + 1, x)), 'took', concat(b.took, array(p)))),
        acc -> acc.took)"""
    order = rows.selectExpr("t", "u", "d", f"{steps} as took")
    per_source = "transform(t, (x, i) -> named_struct('source_key', x.source_key, 'rows', x.rows, 'units', u[i], 'period', d, 'slots', filter(transform(took, (s, p) -> if(s = i, p, null)), p -> p is not null)))"
    return order.selectExpr(f"inline({per_source})")


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, *, block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE, units: int | None = None, carry: list[str] | None = None, tie: list[str] | None = None, splits: int = 1024, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Per document: doc_id, source, source_rank, block, units, period, slot, release, deadline (all from 0; the block
    is served within [release, deadline) in slot time), beside the `carry` columns; turn, the block's place among all,
    unless a hyperperiod of `units` is planned. tie: columns besides doc_id that order a source's documents."""
    keep = list(dict.fromkeys(["doc_id", "source", *(tie or []), *(carry or [])]))
    slim = pick(docs, *keep).select(*[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(keep)], "doc_id", "source")
    exact = units is None
    if exact:
        by, block_rows = exact_plan(slim, weights, temperature, block_rows, most_blocks)
    else:
        by = plan(slim, weights, temperature, units).drop("rows")
    # a slice of ranks carries the slots of its blocks
    part = f"slice({{}}, cast(__start div {block_rows} as int) + 1, cast(__n div {block_rows} as int) + 2)"
    own = {"first_block": f"__start div {block_rows}", "slots": part.format("slots"), "turns": part.format("turns")} if exact else {}
    order = [F.col("doc_id"), *[F.col(f"__in{keep.index(c)}") for c in tie or []]]
    rank = ranked(slim, source_key(), order, "source_rank", splits, by.withColumnRenamed("source_key", "__g"), own)
    at = "element_at({}, cast(block - first_block as int) + 1)"
    slot = at.format("slots") if exact else "(block div units) * period + element_at(slots, cast(block % units as int) + 1)"
    block = rank.withColumn("block", F.expr(f"source_rank div {block_rows}"))
    return block.select(
        *[F.col(f"__in{i}").alias(c) for i, c in enumerate(keep) if c in ("doc_id", "source", *(carry or []))], "source_rank", "block", "units", "period",
        F.expr(slot).alias("slot"),
        F.expr("(block * period) div units").alias("release"),
        F.expr("((block + 1) * period + units - 1) div units").alias("deadline"),
        *([F.expr(at.format("turns")).alias("turn")] if exact else []),
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """All rows of docs with the same columns, dealt into ordered partitions by slot: written files follow the mix. The
    order is a function of doc_id, source and text alone (see `TIE`), so that later steps find it again from the rows."""
    columns = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "source", "text") else f"__c{i}") for i, c in enumerate(columns)]).withColumn(TIE, tie_of())
    placed = schedule(flat, weights, carry=flat.columns[:-1], tie=[TIE], **options)
    ordered = placed.repartitionByRange("slot", "source_rank").sortWithinPartitions("slot", "source", "source_rank")
    return ordered.select(*[F.col(x).alias(c) for x, c in zip(flat.columns[:-1], columns, strict=True)])


#: The hash that orders documents of one id, as `mix` and `packing.pack` with windows take it.
TIE = "__text_hash"


def tie_of():
    return F.xxhash64("text")
