"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. Target weights are whole numbers: a source has `units` of the sum of all, U. Its block j is released at
slot floor((j-1)*U/units) and due by slot ceil(j*U/units); in each slot the earliest deadline among the released blocks goes first. That
keeps every source less than one block from units/U of the slots at every slot, for ever: after U slots all have had exactly their
units and the order begins again. The fold finds no more slots than the documents need, and no more than U.

Every document is kept and gets one place; a source that runs out leaves its later slots empty.

Cases: a null source is a source of its own (the name ''); a null doc_id is ordered first and kept; rows that repeat
a doc_id have neighbouring places; an empty table gives an empty one; other columns are neither read nor changed;
empty and very long texts count as one document each. Every source is scheduled by its own weight, however many there are; one
whose share is under half a unit has one unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm.common import bounded_broadcast, written

#: What the units add up to, ten times as much from so many sources on; documents of one block.
PARTS, SOURCES_OF_PARTS, BLOCK = 1_000_000, 10_000, 16
#: The default target: shares in proportion to count ** TEMPERATURE.
TEMPERATURE = 0.5
#: Sources whose names, and slots whose blocks, may be broadcast.
BROADCAST_NAMES = 100_000
#: Slots in one inner fold.
CHUNK = 128
#: Rows of a source that are ranked together.
RANKED_ROWS = 1000


def source_name(source: str = "source") -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def parts_of(sources: int) -> int:
    """What the units add up to: PARTS, or the tenfold again and again until every source can have a hundred."""
    return PARTS if sources <= SOURCES_OF_PARTS else 10 * parts_of(-(-sources // 10))


def source_groups(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """name, n (documents), g (1.., in the order of names), units: the source's share of parts_of(sources) by largest remainders, one at least.

    weights: (source, weight), positive; sources that it lacks, or all without it, weigh their share of the sum of count ** TEMPERATURE."""
    counts = docs.groupBy(source_name().alias("name")).agg(F.count(F.lit(1)).alias("n"))
    if weights is not None:
        given = weights.groupBy(source_name().alias("name")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        counts = counts.join(given, "name", "left")
    else:
        counts = counts.withColumn("weight", F.lit(None).cast("double"))
    named = written(counts, "mix-names")
    parts = parts_of(named.count())
    # One row a source from here.
    whole = Window.partitionBy(F.lit(0))
    plain = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    share = named.withColumn("w", F.greatest(F.lit(0.0), F.coalesce("weight", plain / F.sum(plain).over(whole))))
    share = share.withColumn("exact", F.coalesce(F.try_divide("w", F.sum("w").over(whole)), F.lit(0.0)) * parts)
    share = share.withColumn("base", F.floor(F.col("exact") + 1e-6)).withColumn("left", F.lit(parts) - F.sum("base").over(whole))
    rank = F.row_number().over(whole.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 6)), "name"))
    share = share.withColumn("units", F.greatest(F.lit(1), F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0)).cast("bigint"))
    return share.select("name", "n", F.row_number().over(whole.orderBy("name")).alias("g"), "units")


def schedule(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """g, m, slot: where the m-th block of group g goes, of the slots 0 to U - 1 as many as the documents need. One fold over those slots.

    The fold's state is the pool of released blocks that wait, known by deadline and g; a slot adds what it releases and takes the least."""
    whole = Window.partitionBy(F.lit(0))
    all_units = F.sum("units").over(whole)
    last = F.expr(f"((n + {block - 1}) div {block} * u + units - 1) div units")
    g = groups.withColumn("u", all_units).withColumn("slots", F.least("u", F.max(last).over(whole))).withColumn("width", F.count(F.lit(1)).over(whole) + 1)
    jobs = g.withColumn("j", F.explode(F.expr("sequence(1L, (slots * units + u - 1) div u)")))
    jobs = jobs.select("slots", "width", F.expr("(j - 1) * u div units").alias("t"), F.expr("(j * u + units - 1) div units * width + g").alias("key"))
    # A slot that releases nothing has an empty list.
    every = g.select("slots", "width").distinct().withColumn("t", F.explode(F.expr("sequence(0L, slots - 1)"))).withColumn("key", F.lit(None).cast("bigint"))
    by_slot = jobs.unionByName(every).groupBy("slots", "width", "t").agg(F.collect_list("key").alias("keys"))
    one = by_slot.groupBy("slots", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "keys"))), lambda x: x["keys"]).alias("released"))
    # Stored, so that the fold finds the lists and does not make them again for every slot.
    one = written(one, "mix-released")
    none = "cast(array() as array<bigint>)"
    least = "transform(array(array_min(q)), b -> named_struct('pool', array_remove(q, b), 'order', concat(s.order, array(b))))[0]"
    step = f"transform(array(concat(s.pool, released[cast(t as int)])), q -> {least})[0]"
    chunk = f"aggregate(sequence(k * {CHUNK}, least(k * {CHUNK} + {CHUNK}, slots) - 1), named_struct('pool', o.pool, 'order', {none}), (s, t) -> {step})"
    fold = f"""aggregate(sequence(0L, (slots - 1) div {CHUNK}), named_struct('pool', {none}, 'all', cast(array() as array<array<bigint>>)),
            (o, k) -> transform(array({chunk}), x -> named_struct('pool', x.pool, 'all', concat(o.all, array(x.order))))[0], o -> flatten(o.all))"""
    picked = one.select("width", F.posexplode(F.expr(fold)).alias("slot", "key")).select("slot", F.expr("cast(key % width as int)").alias("g"))
    return picked.select("g", "slot", F.row_number().over(Window.partitionBy("g").orderBy("slot")).alias("m"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """docs with name, block, slot, release, due and place (in the block): their order is that of (slot, place)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    parts = max(1, -(-docs.count() // RANKED_ROWS))
    part = F.expr(f"cast(conv(substring(mix_key, 1, 8), 16, 10) as bigint) * {parts} div 4294967296")
    groups = written(source_groups(docs, weights), "mix-groups")
    plan = written(schedule(groups, block), "mix-plan")
    whole = groups.agg(F.sum("units")).first()[0] or 1
    # A long list of names is joined by a shuffle.
    names = bounded_broadcast(groups.select(F.col("name").alias("mix_name"), F.col("g").alias("mix_g"), F.col("units").alias("mix_units")), BROADCAST_NAMES)
    table = docs.withColumn("mix_name", source_name()).join(names, "mix_name").withColumn("mix_key", key).withColumn("mix_part", part)
    in_part = Window.partitionBy("mix_g", "mix_part")
    ranked = table.withColumn("mix_rank", F.row_number().over(in_part.orderBy("mix_key", "doc_id")))
    counts = table.groupBy("mix_g", "mix_part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.withColumn("before", F.sum("rows").over(Window.partitionBy("mix_g").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1))).select("mix_g", "mix_part", F.coalesce("before", F.lit(0)).alias("before"))
    placed = ranked.join(before, ["mix_g", "mix_part"]).withColumn("mix_at", F.col("before") + F.col("mix_rank") - 1)
    placed = placed.withColumn("mix_block", F.expr(f"mix_at div {block}"))
    placed = placed.withColumn("mix_turn", F.expr("mix_block div mix_units")).withColumn("mix_m", (F.expr("mix_block % mix_units") + 1).cast("int"))
    times = bounded_broadcast(plan.select(F.col("g").alias("mix_g"), F.col("m").alias("mix_m"), F.col("slot").alias("mix_slot")), BROADCAST_NAMES)
    out = placed.join(times, ["mix_g", "mix_m"])
    return out.withColumns(
        {
            "slot": F.col("mix_turn") * whole + F.col("mix_slot"),
            "release": F.col("mix_turn") * whole + F.expr(f"(mix_m - 1L) * {whole} div mix_units"),
            "due": F.col("mix_turn") * whole + F.expr(f"(mix_m * {whole}L + mix_units - 1) div mix_units"),
            "place": F.expr(f"mix_at % {block}"),
            "block": F.col("mix_block"),
            "units": F.col("mix_units"),
            "name": F.col("mix_name"),
        }
    )


def in_mixed_order(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """docs with the columns they had, in order: the parts are ranges of slots, one after the other, each in the order of its slots and places."""
    kept = docs.columns
    packed = docs.select("doc_id", "source", F.struct(*kept).alias("mix_row"))
    out = mixed(packed, weights).select("slot", "place", "mix_row")
    return out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("mix_row.*")
