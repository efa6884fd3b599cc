"""Operator 10: mixing sources to target weights, DataFrame functions only.

Targets.  Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1 ...; they
share the sum of all sizes by weight.  A target stops at three times its source's
size and the excess is reshared by weight: sources sorted by cap over weight are
capped as long as the level of the others stays above (water filling), so one
pass over the table of sources settles it.

Schedule.  Golden-ratio points, as integers of 32 bits, pass through the
cumulated targets: slot n belongs to the source whose stretch holds its point.
Slots are ranked per source.  Slot r of a source takes tokens [r B, (r + 1) B) of
the source's stream: its documents in a keyed random order, epoch after epoch,
three at most.  The stream ends at the source's target, to the nearest word: a
slot beyond it takes nothing, and the few blocks that the points leave over (their
counts differ from the shares by a discrepancy that grows as a logarithm) follow
after the last slot.  So every source meets its target, whatever the size of the
table or of a block; the schedule says in which order.  A document's ``taken``
sums its overlaps with scheduled blocks, by a join on (source, block);
``first_slot`` is the slot that takes its first word.  Blocks grow with the input,
which bounds the schedule's memory only.

Scale.  Prefix sums of sizes run in two levels (source and leading digits of the
random key, then within), ranks too (source and chunk of slots), so no source is
ever in one task.  Only ids, sources and sizes are shuffled.

Sources are a table of their own, a row each, which one task orders: some millions
of sources are its limit, not documents.

Defined cases: null texts have size 0; documents of size 0 take nothing; repeated
rows, and rows without an id, are documents of their own; if all sizes are 0 all targets are 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._shared import cut, spread, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: At most so many slots; a block holds the sum of sizes over this, rounded up.
MAX_SLOTS = 1 << 18
#: 2^32 divided by the golden ratio.
GOLDEN = 2654435769
POINTS = 1 << 32
#: Points fall into this many cells, through which slots find their source.
CELL_BITS = 20
CHUNK = 4096
#: Rows that one (source, leading digits) group should hold at most, roughly.
GROUP_ROWS = 20_000


def sizes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """(id, source, skey, size, rank_key): what mixing needs of each document."""
    name = F.col(source).cast("string")
    # rows without an id are told apart by their texts, so that they are no group of one key
    nameless = F.concat(F.lit("?"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return spread(docs).select(
        F.col(id_col).alias("id"),
        name.alias("source"),
        F.coalesce(F.concat(F.lit("v"), name), F.lit("n")).alias("skey"),
        F.size(words_of(F.col(text))).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), nameless))).alias("rank_key"),
    )


def targets(sized: DataFrame, total: int) -> DataFrame:
    """(skey, source, source_size, weight, target, low, high): one row per source."""
    own = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(place) - 1) % 3 + 1).cast("int"))
    own = own.withColumn("weight", weight)
    # water filling: in order of cap / weight, a source is capped while the level before it is not lower
    cap = MAX_EPOCHS * F.col("source_size")
    own = own.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    own = own.withColumn(
        "level",
        (F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    own = own.withColumn("capped", F.col("ratio") <= F.col("level"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_rows)
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_rows), F.lit(0))
    level = (F.lit(float(total)) - spent) / free
    own = own.withColumn(
        "target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    )
    high = F.sum("target").over(place.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("high", F.round(high / F.lit(float(max(total, 1))) * POINTS).cast("long"))
    own = own.withColumn("low", F.lag("high", 1, 0).over(place))
    return own.select("skey", "source", "source_size", "weight", "target", "low", "high")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(skey, slot, rank): the source of each slot and the slot's rank in it."""
    spark = sources.sparkSession
    # a multiple of the golden ratio under 2^63: slots stay below 2^31
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % F.lit(POINTS)).alias("point")
    )
    points = points.withColumn("cell", F.shiftright("point", CELL_BITS))
    spans = sources.filter("high > low").select(
        "skey", "low", "high",
        F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))).alias("cell"),
    )
    held = points.join(spans, "cell").filter("point >= low AND point < high").select("skey", "slot")
    held = held.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = held.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    gone = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("skey", "chunk", F.coalesce(F.sum("n").over(gone), F.lit(0)).alias("before"))
    within = Window.partitionBy("skey", "chunk").orderBy("slot")
    ranked = held.withColumn("nth", F.row_number().over(within) - 1).join(counts, ["skey", "chunk"])
    return ranked.select("skey", "slot", (F.col("before") + F.col("nth")).alias("rank"))


def streamed(sized: DataFrame, rows: int, known: DataFrame) -> DataFrame:
    """``sized`` with ``start``, the words before a document in its source's shuffled stream, and ``known``.

    What is known of a source joins the table of its groups, not its documents.
    """
    digits = 3
    while 16**digits * GROUP_ROWS < rows:
        digits += 1
    sized = sized.withColumn("lead", F.substring("rank_key", 1, digits))
    sums = sized.groupBy("skey", "lead").agg(F.sum("size").alias("n"))
    gone = Window.partitionBy("skey").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "lead", F.coalesce(F.sum("n").over(gone), F.lit(0)).alias("before"))
    within = (
        Window.partitionBy("skey", "lead").orderBy("rank_key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = sums.join(known, "skey")
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(sums, ["skey", "lead"]).withColumn("start", F.col("before") + F.col("inner"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """(id column, size, source_size, target, taken, first_slot) for every document."""
    sized = cut(sizes(docs, text, id_col, source), "sizes")
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    block = max(1, -(-total // MAX_SLOTS))
    slots = -(-total // block)
    sources = cut(targets(sized, total), "sources")
    plan = schedule(sources, slots)
    counts = plan.groupBy("skey").agg(F.count(F.lit(1)).alias("slots"))
    known = sources.join(counts, "skey", "left").select(
        "skey", "source_size", "target", F.round("target").cast("long").alias("limit"), F.coalesce("slots", F.lit(0)).alias("slots")
    )
    known = known.withColumn("blocks", F.expr(f"(limit + {block - 1}) div {block}"))
    left = known.filter("blocks > slots").select("skey", "slots", F.explode(F.sequence("slots", F.col("blocks") - 1)).alias("rank"))
    plan = plan.unionByName(left.select("skey", (F.lit(slots) + F.col("rank") - F.col("slots")).alias("slot"), "rank"))
    placed = cut(
        streamed(sized, rows, known.drop("slots", "blocks")).select(
            "id", "skey", "size", "start", "source_size", "target", "limit"
        ),
        "placed",
    )
    # every epoch of a document that scheduled blocks may reach
    copies = placed.filter("size > 0").select(
        "skey", "start", "size",
        F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))).alias("epoch"), "source_size", "limit",
    )
    copies = copies.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start"))
    copies = copies.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("limit")))
    copies = copies.filter(F.col("from") < F.col("to"))
    pieces = copies.select(
        "skey", "start", "from", "to",
        F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("rank"),
    )
    joined = pieces.join(plan, ["skey", "rank"])
    words = F.least(F.col("to"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block)
    taken = joined.groupBy("skey", "start").agg(F.sum(words).alias("taken"), F.min_by("slot", "rank").alias("slot"))
    held = placed.join(taken, ["skey", "start"], "left")
    return held.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("slot")).alias("first_slot"),
    )


def apply_mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, to the nearest whole number.

    Only the document at the end of a source's stretch of stream is taken in
    part.  Rows that repeat an id are taken as often as that id on average.
    """
    mixed = mix(docs, text, id_col, source)
    times = mixed.groupBy(id_col).agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share"))
    times = times.select(F.col(id_col).alias("id"), F.round("share").cast("int").alias("times")).filter("times > 0")
    # texts are dealt by id and met there by a table of counts, at every size; they are not sorted
    rows = docs.select(F.col(id_col).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(times.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("id")))
    return rows.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")
