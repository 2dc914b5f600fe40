"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets fill up like water: sources share all words by weight, none beyond `MOST` times its size. Words are taken
in blocks of equal length. Blocks are seats: sources get them by the highest quotients target / (2 seats + 1).
Then a source's words are seats of its parts, by their size, so every part knows its integer quota: none is above
its stop, and together they give what the source is to give. Within a part documents stand in a seeded order, and
its quota is the first words of that row, passed as often as needed.

A part has about `SHARD` documents of a source, or a few more words than `PART_BLOCKS` blocks, so few documents are
cut. Documents are dealt into parts by a hash of id, source and text, documents of which more than a fourth of
`SHARD` rows are equal by their place in the input too, so no task meets a whole source or all copies of a row.

Apportionment is distributed: votes are rounded at the mean price, and only the seats that rounding gave too few or
too many are settled by sorting the quotients near that price over all tasks. Targets are found by a few sums over
the sources. Sources and parts never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rill.llm.common import dropped, numbered, saved, words

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 7
#: Documents in a part of a source on average; the longest block; blocks that an average source is to have.
SHARD, BLOCK, FINENESS = 2_000, 64, 4096
#: Tasks over which the rows of one group of an apportionment are spread.
SALTS = 64
#: Blocks of words from which a source is divided although its documents are few.
PART_BLOCKS = 64


def apportioned(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `given`: Sainte-Laguë seats of each row among those of its `group`.

    `rows` have `votes` (not negative), and the same for a whole group `seats`, `all_votes`, their sum, and `voters`,
    the number of rows with votes or more; `order` tells the rows of a group apart and settles ties. Seats of groups
    without votes are not given.
    """
    price = F.when((F.col("all_votes") > 0) & (F.col("seats") > 0), F.col("votes") / (F.col("all_votes") / F.col("seats")))
    rounded = saved(rows.withColumn("rounded", F.coalesce(F.floor(price + 0.5), F.lit(0))))
    lacks = rounded.groupBy(group).agg((F.max("seats") - F.sum("rounded")).alias("lack")).where("lack <> 0")
    mended = saved(rounded.where("all_votes > 0").join(lacks, group))
    if mended.isEmpty():
        return rounded.withColumnRenamed("rounded", "given").drop("all_votes", "voters")
    # at a price that gives half a seat a voter more, or less, there are enough, or few enough
    other = F.col("votes") * (F.col("seats") + F.signum("lack") * (F.col("voters") + 1) / 2) / F.col("all_votes")
    reach = F.greatest(F.floor(other + 0.5), F.lit(0)) - F.col("rounded")
    steps = F.when(F.col("lack") > 0, F.greatest(reach, F.lit(0))).otherwise(F.greatest(-reach, F.lit(0)))
    step = F.explode(F.when(steps > 0, F.sequence(F.lit(1), steps)))
    near = mended.select(group, *order, "lack", "votes", "rounded", step.alias("step"))
    quotient = F.when(F.col("lack") > 0, -F.col("votes") / (2 * (F.col("rounded") + F.col("step")) - 1)).otherwise(
        F.col("votes") / (2 * (F.col("rounded") - F.col("step")) + 1)
    )
    queue = numbered(near.withColumn("quotient", quotient), "place", F.col(group), F.col("quotient"), *map(F.col, order))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # a group's rows meet its first in many tasks
    first = queue.groupBy(group).agg(F.min("place").alias("first")).select(group, "first", salts)
    chosen = queue.withColumn("salt", F.col("place") % SALTS).join(first, [group, "salt"]).where(F.col("place") - F.col("first") < F.abs("lack"))
    changes = saved(chosen.groupBy(group, *order).agg(F.sum(F.signum("lack")).cast("long").alias("change")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (group, *order)]
    given = (F.col("r.rounded") + F.coalesce("c.change", F.lit(0))).alias("given")
    return rounded.alias("r").join(changes.alias("c"), same, "left").select("r.*", given).drop("rounded", "all_votes", "voters")


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """`sources` (source_size, weight) with `target`: shares of all words by weight; what a source cannot take goes
    to the others until none is above its stop. `sources` are to be a saved table; each round is one sum over it."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    stop, level, full = F.col("source_size") * most, 0.0, -1
    while True:
        below = stop <= F.col("weight") * F.lit(level)
        now, stopped, open_ = sources.where("source_size > 0").agg(
            F.count_if(below), F.sum(F.when(below, stop)), F.sum(F.when(~below, F.col("weight")))
        ).first()
        if now == full or not open_:
            break
        full, level = now, (total - (stopped or 0)) / open_
    share = F.least(stop.cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.when((F.col("source_size") > 0) & F.lit(total > 0), share).otherwise(F.lit(0.0)))


def plan_sources(sizes: DataFrame) -> DataFrame:
    """Of (source, source_size, docs): source_no, target, block, the words a source gives, and its number of parts."""
    order = F.col("source").isNull(), F.col("source")
    named = saved(numbered(sizes, "source_no", *order).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))))
    n, total = named.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    block = max(1, min(BLOCK, (total or 0) // (max(1, n) * FINENESS)))
    aimed = saved(with_targets(named))
    votes = {"votes": F.col("target"), "all_votes": F.lit(aimed.agg(F.sum("target")).first()[0] or 0.0), "voters": F.lit(n)}
    seats = aimed.withColumns(votes | {"seats": F.lit(round((total or 0) / block)), "all": F.lit(0)})
    parts = F.greatest(F.lit(1), F.ceil(F.col("docs") / SHARD), F.floor(F.col("source_size") / (PART_BLOCKS * block)))
    gives = F.least(F.col("given") * block, F.col("source_size") * MOST).alias("gives")
    return apportioned(seats, "all", "source_no").select("source", "source_no", "source_size", "target", gives, F.least(parts, F.col("docs")).alias("parts"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """`docs` with rill_size and rill_order, by which rows are dealt and ordered; rows without words, which give and
    change nothing, are dealt by their place."""
    text = F.col("text").cast("string")
    size = F.size(words(text)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source").cast("string"), F.xxhash64(text))
    sized = docs.withColumn("rill_size", size)
    return sized.withColumn("rill_order", F.when(F.col("rill_size") > 0, key).otherwise(F.xxhash64(F.lit(seed), F.monotonically_increasing_id())))


def _narrow(sized: DataFrame) -> DataFrame:
    return saved(sized.select(F.col("source").cast("string").alias("source"), "rill_size", "rill_order"))


def _part(parts: str) -> Column:
    return F.pmod(F.xxhash64("rill_order"), F.col(parts))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` with `rill_mix`: size, source_size, target and taken (words the mix takes) of each row.

    Needs doc_id, text and source; other columns are carried along. Null and blank texts have size 0 and give
    nothing. A null source is a source of its own, the last. Repeated rows are documents of their own. Equal
    tables give equal output: places depend on hashes of id, source and text, and tied rows are alike. No rows give
    no rows.
    """
    sized = _sized(docs, seed)
    narrow = _narrow(sized)
    most = max(1, SHARD // 4)
    crowds = saved(narrow.where("rill_size > 0").groupBy("rill_order").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    if not crowds.isEmpty():  # many equal rows: their place in the input parts them, the same for all that follows
        salted = sized.withColumn("rill_place", F.monotonically_increasing_id()).join(crowds, "rill_order", "left")
        salt = F.pmod(F.xxhash64("rill_place"), F.ceil(F.col("n") / most))
        order = F.when(F.col("n").isNull(), F.col("rill_order")).otherwise(F.xxhash64("rill_order", salt))
        sized = saved(salted.withColumn("rill_order", order).drop("n", "rill_place"))
        dropped(narrow)
        narrow = _narrow(sized)
    planned = saved(plan_sources(narrow.groupBy("source").agg(F.sum("rill_size").alias("source_size"), F.count(F.lit(1)).alias("docs"))))
    same = lambda a, b: F.col(a).cast("string").eqNullSafe(F.col(b))
    dealt = narrow.alias("n").join(planned.alias("p"), same("n.source", "p.source")).withColumn("part", _part("p.parts"))
    once = {"gives": "seats", "source_size": "all_votes", "parts": "voters"}
    sums = dealt.groupBy("p.source_no", "part").agg(F.sum("rill_size").alias("votes"), *(F.max(f"p.{a}").alias(b) for a, b in once.items()))
    quotas = apportioned(sums, "source_no", "part").select(
        F.col("source_no").alias("rill_no"), F.col("part").alias("rill_part"), F.struct(F.col("votes").alias("size"), F.col("given").alias("quota")).alias("rill_quota")
    )
    source = planned.select(F.struct("*").alias("rill_plan"))
    placed = sized.join(source, same("source", "rill_plan.source"))
    placed = placed.withColumn("rill_no", F.col("rill_plan.source_no")).withColumn("rill_part", _part("rill_plan.parts"))
    kept = saved(quotas)
    dropped(narrow)
    met = placed.join(kept, ["rill_no", "rill_part"], "left")  # rows without words may be alone in a part
    ahead = F.sum("rill_size").over(
        Window.partitionBy("rill_no", "rill_part").orderBy("rill_order", "rill_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("rill_size")
    size, quota = (F.coalesce(f"rill_quota.{c}", F.lit(0)) for c in ("size", "quota"))
    passes = F.when(size > 0, F.expr("rill_quota.quota div rill_quota.size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("rill_size"), quota - passes * size - F.col("rill_ahead")))
    taken = (passes * F.col("rill_size") + part).cast("long")
    p = lambda c: F.col(f"rill_plan.{c}").alias(c)
    mixed = F.struct(F.col("rill_size").alias("size"), p("source_size"), p("target"), taken.alias("taken"))
    return met.withColumn("rill_ahead", ahead).select(*(F.col(c) for c in docs.columns), mixed.alias("rill_mix"))


def take_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of `docs`: a row for each whole pass of a document, unchanged, and one
    with its first words, single blanks between and `n_chars` counted anew, for the part of a last pass."""
    mixed = mix(docs, seed)
    size, taken = F.col("rill_mix.size"), F.col("rill_mix.taken")
    passes = F.explode(F.when(taken > 0, F.sequence(F.lit(0), F.expr("(rill_mix.taken - 1) div rill_mix.size"))))
    passed = mixed.withColumn("rill_pass", passes).withColumn("rill_left", taken - F.col("rill_pass") * size)
    whole = F.col("rill_left") >= size
    first = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.least(F.col("rill_left"), size).cast("int")), " ")
    cut = passed.withColumn("rill_text", F.when(whole, F.col("text")).otherwise(first))
    columns = {"text": F.col("rill_text"), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length("rill_text")).cast("long")}
    return cut.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))
