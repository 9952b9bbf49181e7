"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Long documents are likelier in the mix: within a source the expected number of
copies of a document is proportional to the bits of its number of words, up to a
most, at the level at which the expected words are the source's target. The whole
part of that number is certain: every document is taken so often. The fractional
part ``f`` is its inclusion probability for one copy more. A document gets the
random odds ``u / (1 - u)`` divided by the inclusion odds ``f / (1 - f)``, and
documents are taken in this order as long as their words fit: a sample of fixed
size in words, of unequal probabilities.

The order is found without sorting a source in one task: documents are dealt into
ranges of the order, ranges are summed, and only the range that the target falls
into is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dealerflow.llm.common import join_groups, numbered, saved

#: Weights by the sources' order, repeating, and the most copies of a document.
WEIGHTS, MOST = (1, 2, 3), 3
#: Documents in a range of the random order, at most about a quarter of it.
RANGE = 2048
#: Passes that fill what the first left over with documents that still fit.
REFILLS = 3
#: Rows of a table by source that are broadcast, at most.
FEW = 10_000
#: A source: whether it is null, and its name.
SOURCE = ["unnamed", "name"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``SOURCE``, ``source_size``, ``target``: shares of the total by weight; ``sizes`` has a row per source and class.

    Sources in order of code point, null last, take the weights in turn. A
    target stops at ``most`` times the source's size; what it leaves goes to the
    others by weight. The table has one row per source, and so have the windows.
    """
    per = sizes.groupBy(*SOURCE).agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(*SOURCE)
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    per = per.withColumns({"weight": weight, "turn": F.row_number().over(order), "cap": most * F.col("source_size")})
    # Sources fill up in the order of cap by weight, as the common level rises.
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "turn")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    per = per.withColumn("level", (total - before).cast("double") / rest)
    free = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(free, F.struct("rank", "level"))).over(Window.partitionBy(F.lit(0))).getField("level")
    per = per.withColumn("rank", F.row_number().over(rising)).withColumn("common", level)
    target = F.least(F.col("common") * F.col("weight"), F.col("cap").cast("double"))
    return per.select(*SOURCE, "source_size", "n", target.alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``SOURCE``, ``bits``, ``whole``, ``part``, ``room`` and the target of every class of documents.

    ``bits`` is the number of binary digits of the number of words. Copies are
    ``most`` at most; the classes reach that from the longest documents on. ``room``
    is what the whole copies of all classes leave of the source's target.
    """
    per = sizes.join(targets.drop("n"), SOURCE)
    longer = Window.partitionBy(*SOURCE).orderBy(F.desc("bits"))
    full = F.coalesce(F.sum("words").over(longer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("bits") * F.col("words")).over(longer.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(rest > 0, (F.col("target") - most * full) / rest)
    per = per.withColumn("level", level)
    fits = F.col("level") * F.col("bits") <= most
    whole_source = Window.partitionBy(*SOURCE)
    common = F.max(F.when(fits, F.struct("bits", "level"))).over(whole_source).getField("level")
    copies = F.when(F.col("bits") == 0, 0.0).otherwise(F.coalesce(F.least(common * F.col("bits"), F.lit(float(most))), F.lit(float(most))))
    per = per.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    room = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source)
    return per.select(*SOURCE, "bits", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("part"), room.alias("room"))


def _random(id_col: str, seed: str) -> Column:
    """A number between 0 and 1 that depends on the id alone, alike in every run."""
    digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def _with_source(rows: DataFrame, per: DataFrame, few: bool, total: int) -> DataFrame:
    """Rows with what ``per`` has on their source; many sources meet their rows in a shuffle, but for the heavy ones."""
    return rows.join(F.broadcast(per.drop("n")), SOURCE) if few else join_groups(rows, per, SOURCE, total).drop("n")


def _take(left: DataFrame) -> DataFrame:
    """Of ``left`` (id, source, size, q, range, room, n) the first in order of ``q`` that fit into ``room``.

    Ranges that fit as a whole are taken unsorted.
    """
    fit = left.where("size > 0 and size <= room")
    sums = fit.groupBy(*SOURCE, "range").agg(F.sum("size").alias("words"), F.max("room").alias("limit"))
    earlier = Window.partitionBy(*SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).where("before < limit")
    sums = sums.select(*SOURCE, "range", "before", (F.col("before") + F.col("words") <= F.col("limit")).alias("inside"))
    near = fit.join(sums, [*SOURCE, "range"])
    columns = ["id", *SOURCE, "size"]
    inside = Window.partitionBy(*SOURCE, "range").orderBy("q", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = near.where("not inside").withColumn("upto", F.col("before") + F.sum("size").over(inside)).where("upto <= room")
    return near.where("inside").select(*columns).unionByName(edge.select(*columns))


def copies_of(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """``key``, ``SOURCE``, ``size``, ``source_size``, ``target``, ``copies`` of rows (key, source, text) with keys of their own."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")
    source = [F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name")]
    sized = saved(rows.select(F.col("key").alias("id"), *source, words.alias("size")))
    bits = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    sized = sized.withColumn("bits", bits)
    classes = saved(sized.groupBy(*SOURCE, "bits").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    targets = saved(source_targets(classes, weights, most))
    few, total = targets.count() <= FEW, sized.count()
    # All classes of a source as one row: an array, found by the document's bits.
    known = expected_copies(classes, targets, most).groupBy(*SOURCE).agg(
        F.map_from_entries(F.collect_list(F.struct("bits", F.struct("whole", "part")))).alias("classes"),
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("room").alias("room"),
    )
    known = saved(known.join(targets.select(*SOURCE, F.col("n").alias("documents"), "n"), SOURCE))
    drawn = _with_source(sized, known, few, total)
    own = F.col("classes")[F.col("bits")]
    drawn = drawn.withColumns({"whole": own["whole"], "part": own["part"]})
    u = _random("id", seed)
    q = F.when(F.col("part") > 0, (u / (1 - u)) / (F.col("part") / (1 - F.col("part"))))
    drawn = drawn.withColumn("q", q)
    # At most a quarter of the documents of a source lie within one unit of the logarithm.
    part = F.floor(F.log("q") * F.ceil(F.col("documents") / RANGE))
    drawn = saved(drawn.select("id", *SOURCE, "size", "source_size", "target", "whole", "q", part.alias("range"), "room"))
    left = drawn.where("q is not null").select("id", *SOURCE, "size", "q", "range", "room")
    taken = None
    counts = targets.select(*SOURCE, "n")
    for _ in range(1 + REFILLS):
        got = saved(_take(left))
        taken = got if taken is None else taken.unionByName(got)
        used = got.groupBy(*SOURCE).agg(F.sum("size").alias("used"))
        used = counts.join(used, SOURCE, "left").select(*SOURCE, F.coalesce("used", F.lit(0)).alias("used"), "n")
        left = _with_source(left.join(got.select("id"), "id", "left_anti"), used, few, total)
        left = left.select("id", *SOURCE, "size", "q", "range", (F.col("room") - F.col("used")).alias("room"))
        left = left.where("size <= room")
    out = drawn.join(taken.select("id", F.lit(1).alias("extra")), "id", "left")
    copies = (F.when(F.col("size") > 0, F.col("whole")).otherwise(0) + F.coalesce("extra", F.lit(0))).cast("int")
    return out.select(F.col("id").alias("key"), *SOURCE, "size", "source_size", "target", copies.alias("copies"))


def mix_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: id, source, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` is the number of words, ``copies`` how often the mix takes the
    document, ``taken`` its words in the mix. A null text has size 0 and is never
    taken; null is a source of its own. Rows with a null or a repeated id are rows
    like any other. A total of no words gives targets of 0. Reruns agree, because
    the random order comes from the ids, or for rows without an id of their own
    from their place in the order of ids and texts. Other columns are not read.
    """
    known = numbered(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")))
    found = copies_of(known.rows.select("key", "source", "text"), weights, most, seed).withColumnRenamed("key", "_key")
    return known.with_id(found, "_key", id_col).select(
        id_col,
        F.when(~F.col("unnamed"), F.col("name")).alias(source_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
    )
