"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations alone.

Words of a source are its documents' words. Targets share all words by the sources' weights, capped at `most` times a source's own
size, the excess reshared (`targets`). A source's documents are dealt by hash to blocks; its quota is every block as often as the
target holds the source whole, and for the rest blocks in permuted order as long as they fit, then documents, by block in that order and
by hash, each that still fits what is left, until no document does. A binary tree splits the vector of block quotas between the output shards, each split a multivariate-hypergeometric draw,
so every shard gets a random share of each source and the quotas stay exact. Each source's drawn blocks, permuted, are then cut
into the shards' runs, which are disjoint, and rows are shuffled within their shard.

A null text has size 0; a source of size 0 has target 0 and nothing is taken from it. The null source comes last. Repeated rows
are rows of their own, taken alike; rows with a null id are taken like others. The same rows give the same mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import checkpointed, fresh, written

#: Weights of the sources in order, repeating; how often a source may be repeated; words of a block and of an output shard.
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 100_000
SHARD_WORDS = 10_000_000
#: Sources up to which their table is broadcast (at most some 100 bytes each); beyond, it is joined by shuffles.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add `place` and `target` to (source, source_size). Sources fill in the order of cap per weight until the rest share freely.

    The list of sources, one row each, is ranked in one task; their documents are not.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long") - 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    ranked = checkpointed(ranked.select(
        "*",
        F.row_number().over(order).alias("turn"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
    ))
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = (F.lit(whole) - F.col("capped")).cast("double") / F.col("open")
    free = ranked.where(level <= F.col("ratio")).orderBy("turn").select("turn", "capped", "open").first()
    if free is None:
        return ranked.select("source", "source_size", "place", F.col("cap").cast("double").alias("target"))
    share = F.lit(float(whole - free["capped"])) * F.col("weight") / F.lit(float(free["open"]))
    return ranked.select("source", "source_size", "place", F.when(
        F.col("turn") >= free["turn"], share).otherwise(F.col("cap").cast("double")).alias("target"))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 2, F.lit(0.0)).when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `drawn` out of `total` are marked: the inverted distribution at `uniform`.

    The support is cut twelve standard deviations from the mean, beyond what a double can tell from nothing.
    """
    mean = drawn.cast("double") * marked / F.greatest(total, F.lit(1))
    reach = 12 * F.sqrt(F.greatest(F.lit(1.0), mean * (total - marked) / F.greatest(total, F.lit(1)))) + 12
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean - reach).cast("long"))
    high = F.least(drawn, marked, F.ceil(mean + reach).cast("long"))

    def chance(i: Column) -> Column:
        return F.exp(_log_choose(marked, i) + _log_choose(total - marked, drawn - i) - _log_choose(total, drawn))

    def step(state: Column, i: Column) -> Column:
        left = state["left"] - chance(i)
        return F.struct(left.alias("left"), F.when(state["left"] > 0, i).otherwise(state["hit"]).alias("hit"))

    return F.aggregate(F.sequence(low, high), F.struct(uniform.alias("left"), low.alias("hit")), step, lambda s: s["hit"])


def _uniform(*keys: Column) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def split(quotas: DataFrame, shards: int) -> DataFrame:
    """(place, quota) -> (shard, place, n): the leaves of the splitting tree.

    A node is one row: its shards [lo, hi) and an array with a quota for each source, however many blocks those stand for.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("place", "quota"))).alias("left")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "left")
    for _ in range((shards - 1).bit_length()):
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("long")
        total = F.aggregate("left", F.lit(0).cast("long"), lambda s, x: s + x["quota"])
        nodes = nodes.withColumn("mid", mid).withColumn("total", total)
        # A side's number of blocks is in proportion to its shards.
        nodes = nodes.withColumn("draw", F.floor(
            F.col("total").cast("decimal(38,0)") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long"))

        def take(state: Column, s: Column) -> Column:
            got = _hypergeometric(state["total"], s["quota"], state["draw"], _uniform(F.col("lo"), F.col("hi"), s["place"]))
            return F.struct(
                (state["total"] - s["quota"]).alias("total"), (state["draw"] - got).alias("draw"),
                F.concat(state["out"], F.array(F.struct(s["place"].alias("place"), got.alias("quota")))).alias("out"))

        start = F.struct("total", "draw", F.expr("filter(left, s -> false)").alias("out"))
        nodes = nodes.withColumn("drawn", F.aggregate("left", start, take, lambda s: s["out"]))
        other = F.zip_with("left", "drawn", lambda a, b: F.struct(a["place"].alias("place"), (a["quota"] - b["quota"]).alias("quota")))
        halves = F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("drawn").alias("left")),
            F.struct(F.col("mid").alias("lo"), "hi", other.alias("left")))
        alone = F.array(F.struct("lo", "hi", "left"))
        nodes = nodes.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(alone)).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("left").alias("s")).select(
        "shard", F.col("s.place").alias("place"), F.col("s.quota").alias("n"))


def _blocks(slim: DataFrame, known: DataFrame, block_words: int, shard_words: int) -> DataFrame:
    """(place, block, whole, part, rules, never): the shards that take a block whole; the shard that takes documents by the rules."""
    permuted = Window.partitionBy("place").orderBy("turn", "block")
    blocks = slim.groupBy("place", "block").agg(F.sum("size").alias("words")).join(known, "place")
    times = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    blocks = blocks.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    blocks = blocks.withColumn("turn", F.xxhash64("place", "block"))
    blocks = blocks.withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    extra = (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("words") > 0)
    some = (F.col("before") < F.col("rest")) & ~extra & (F.col("words") > 0)
    blocks = blocks.withColumn("extra", extra)
    # What whole blocks leave is the first goal; documents of all blocks from there on may fill it.
    blocks = written(blocks.select(
        "place", "block", "turn", "extra", (F.col("times") + extra.cast("long")).alias("copies"), F.when(some, F.col("rest") - F.col("before")).alias("goal")))
    rules = written(_fills(slim, blocks))
    blocks = blocks.select("place", "block", "copies").join(rules, ["place", "block"], "left")
    numbers = F.sequence(F.lit(1).cast("long"), F.col("copies") + F.col("rules").isNotNull().cast("long"))
    drawn = blocks.where("copies > 0 or rules is not null").withColumn("number", F.explode(numbers)).drop("rules", "never")
    drawn = drawn.withColumn("at", F.row_number().over(
        Window.partitionBy("place").orderBy(F.xxhash64("place", "block", "number"), "block", "number")).cast("long") - 1)
    quotas = drawn.groupBy("place").agg(F.count("*").alias("quota"))
    words = known.agg(F.sum("target")).first()[0] or 0
    leaves = split(quotas, max(1, -(-int(words) // shard_words)))
    ends = F.sum("n").over(Window.partitionBy("place").orderBy("shard"))
    runs = leaves.withColumn("end", ends).where("n > 0").select(
        "place", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("at"))
    placed = drawn.join(runs, ["place", "at"])
    part = F.col("number") > F.col("copies")
    dealt = placed.groupBy("place", "block").agg(
        F.sort_array(F.collect_list(F.when(~part, F.col("shard")))).alias("whole"), F.max(F.when(part, F.col("shard"))).alias("part"))
    return dealt.join(rules, ["place", "block"], "left")


def _fills(slim: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, block, rules, never): by which documents of blocks not taken as extra ones fill the source's goal.

    Documents of equal hash are one unit. Units are tried by block in permuted order and by hash: those up to the goal are taken, then,
    further on, those that still fit what is left, and so on until none does. A rule names a stretch of a block's hashes and the largest
    unit taken there; `never` has the hashes of units that are larger than a rule allows though each of their rows is not. A pass sums a
    source by blocks, so only the block where the gap is reached is put in order.
    """
    goals = blocks.where("goal is not null").select(
        "place", F.col("turn").alias("low_turn"), F.col("block").alias("low_block"), F.lit(None).cast("long").alias("low"), F.col("goal").alias("gap"))
    open_ = blocks.where(~F.col("extra")).join(goals, "place").where("(turn, block) >= (low_turn, low_block)").select("place", "block", "turn")
    units = written(slim.join(open_, ["place", "block"]).groupBy("place", "block", "turn", "hash").agg(
        F.sum("size").alias("words"), F.max("size").alias("row_words")))
    left, goals, taken = units.where("words > 0"), checkpointed(goals), []
    by_block, by_hash = Window.partitionBy("place").orderBy("turn", "block"), Window.partitionBy("place", "block").orderBy("hash")
    while True:
        # What no longer fits, or stands before what was taken last, never will be taken.
        later = F.expr("(turn, block) > (low_turn, low_block) or (turn = low_turn and block = low_block and (low is null or hash > low))")
        fits = left.join(F.broadcast(goals) if goals.count() <= BROADCAST_SOURCES else goals, "place").where(F.col("words") <= F.col("gap")).where(later)
        left = written(fits.select(*left.columns, "gap"))
        sums = left.groupBy("place", "block", "turn", "gap").agg(F.sum("words").alias("all"), F.max("hash").alias("last"))
        sums = written(sums.withColumn("before", F.sum("all").over(by_block) - F.col("all")).where("before < gap"))
        if sums.isEmpty():
            break
        whole = sums.where("before + all <= gap").select("place", "block", "turn", F.col("last").alias("high"), "all", "gap")
        cut = left.join(sums.where("before + all > gap").select("place", "block", "before"), ["place", "block"])
        cut = cut.withColumn("upto", F.sum("words").over(by_hash)).where("before + upto <= gap")
        cut = cut.groupBy("place", "block", "turn").agg(F.max("hash").alias("high"), F.max("upto").alias("all"), F.max("gap").alias("gap"))
        now = written(whole.unionByName(cut))
        taken.append(now.select("place", "block", "high", "gap"))
        last = F.max(F.struct("turn", "block", "high")).alias("last")
        goals = checkpointed(now.groupBy("place").agg(last, (F.max("gap") - F.sum("all")).alias("gap")).select(
            "place", F.col("last.turn").alias("low_turn"), F.col("last.block").alias("low_block"), F.col("last.high").alias("low"), "gap"))
        left = left.drop("gap")
    if not taken:
        taken = [left.select("place", "block", F.col("hash").alias("high"), "gap").limit(0)]
    # Passes follow each other: in a block a rule begins where the one before has ended.
    low = F.lag("high").over(Window.partitionBy("place", "block").orderBy("high"))
    stretches = checkpointed(reduce(DataFrame.union, taken).withColumn("low", low))
    never = units.where("words > row_words").join(stretches, ["place", "block"]).where(
        "hash <= high and (low is null or hash > low) and words > gap and row_words <= gap")
    return stretches.groupBy("place", "block").agg(F.collect_list(F.struct("low", "high", "gap")).alias("rules")).join(
        never.groupBy("place", "block").agg(F.collect_set("hash").alias("never")), ["place", "block"], "left")


def allot(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None,
          weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
          shard_words: int = SHARD_WORDS) -> DataFrame:
    """The `keep` columns (all by default) with `mix`: size, source_size, target, hash, and the shards that take the row."""
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*keep), "mix")
    sized = docs.select(
        F.struct(*keep).alias("row"), F.col(source).alias("source"), sizes(text).alias("size"), F.xxhash64(doc_id, source, text).alias("hash"))
    if text not in keep:
        sized = written(sized)
    slim = written(sized.select("source", "size", "hash"))
    known = checkpointed(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    small = F.broadcast if known.count() <= BROADCAST_SOURCES else (lambda df: df)
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words).cast("long"))
    to_block = F.pmod(F.xxhash64("hash"), parts)

    def with_place(df: DataFrame) -> DataFrame:
        named = known.withColumnRenamed("source", "known_source")
        return df.join(small(named), F.col("source").eqNullSafe(F.col("known_source"))).drop("known_source").withColumn("block", to_block)

    dealt = written(_blocks(with_place(slim).select("place", "block", "size", "hash"), known, block_words, shard_words))
    taken = F.concat(
        F.coalesce("whole", F.array().cast("array<bigint>")),
        F.when(F.exists("rules", lambda r: (F.col("size") <= r["gap"]) & (F.col("hash") <= r["high"]) & (
            r["low"].isNull() | (F.col("hash") > r["low"]))) & ~F.coalesce(F.array_contains("never", F.col("hash")), F.lit(False)), F.array("part")).otherwise(F.array().cast("array<bigint>")))
    rows = with_place(sized).join(dealt, ["place", "block"], "left")
    rows = rows.select("row", F.struct("size", "source_size", "target", "hash", taken.alias("shards")).alias("own"))
    return rows.select("row.*", F.col("own").alias(name))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed rows: every document as often as it is taken, with its shard and its place in the shard's own shuffle."""
    shard, order, copy, hashed = fresh(docs, "shard", "shard_order", "copy", "hash")
    dealt = allot(docs, doc_id, text, source, None, weights, most, block_words, shard_words)
    name = dealt.columns[-1]
    rows = dealt.select(*docs.columns, F.posexplode(f"{name}.shards").alias(copy, shard), F.col(f"{name}.hash").alias(hashed))
    rows = rows.withColumn(order, F.xxhash64(hashed, shard, copy))
    return rows.repartition(shard).sortWithinPartitions(shard, order).select(*docs.columns, shard, order)
