"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source gets a target in words. Whole copies that are certain come first: as many of each document
as the target holds of the whole source. The rest of the target is drawn once more, with inclusion
probabilities p in proportion to the documents' sizes such that the expected words are the rest; those
that reach one are certain and taken, and the others' are worked out anew. Documents are ranked by the
random odds u / (1 - u) divided by their inclusion odds p / (1 - p) and taken in that order if they fit,
so what is missing in the end is less than any document that could still be taken.

Running sums go over bins of the rank scale, so a source of any size is spread over many tasks; the bin
in which the rest ends is cut into finer ones until some hundred documents are left, which are walked
through one by one. Rounds follow with the documents behind it that still fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, checkpoint, free_name, row_key

#: Documents of a source that are walked through one by one; the result does not depend on it.
WALK = 1024
#: Bits of the rank scale below each level of bins.
LEVELS = (36, 24, 12, 0)
#: Sources up to which their plan is broadcast; more are joined by source and salt.
SMALL = 10_000
SALTS = 64
#: No document is taken more often.
MOST = 2


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = MOST) -> DataFrame:
    """Adds ``target`` to rows of ``source, source_size``.

    Sources ordered by code point, null last, weigh ``weights`` repeating and share ``share`` times
    the sum of all sizes; a target stops at ``most`` times its source's size and the excess is shared
    again by weight. That ends at a level: the target is weight times level, or the stop if that is
    less. The rows are one per source and are numbered in one task.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("stop", F.col("source_size") * float(most))
    s = s.withColumn("at", F.col("stop") / F.col("weight"))
    order = W.orderBy("at", F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    everything = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * float(share))
    # The level if all sources before this one are at their stop: right for the first that is not.
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(everything)
    return s.withColumn("target", F.when(level.isNull(), F.col("stop")).otherwise(F.least("stop", F.col("weight") * level)))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    seed: int = 42,
) -> DataFrame:
    """One row per row of ``df``: id, ``size, source_size, target, copies, taken``.

    ``size`` counts words; null texts have none. ``taken`` is ``copies`` times ``size`` with at most
    two copies. A null source is a source of its own, the last. Random numbers are a hash of seed,
    id, source and text, so reruns agree; rows that repeat in all three are interchangeable. Documents
    without words and documents longer than their source's target take nothing. An empty table gives
    an empty one; other columns are ignored.
    """
    d = _mixed(df, id_col, text, source, weights, share, seed)
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, each once, with ``copies`` and ``taken`` (words).

    Rows that repeat id, source and text are returned as one whose copies are added. If ``df`` has a
    column named ``copies`` or ``taken``, an underscore is put before the new one's name.
    """
    d = _mixed(df, id_col, text, source, **options).where(F.col("copies") > 0)
    key, copies, taken = free_name(df, "row_key"), free_name(df, "copies"), free_name(df, "taken")
    per = d.groupBy("row").agg(F.sum("copies").alias(copies), F.sum(F.col("copies") * F.col("size")).alias(taken))
    keyed = df.withColumn(key, _row(id_col, text, source))
    hit = keyed.join(per.withColumnRenamed("row", key), key)
    return hit.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in df.columns], copies, taken)


def _row(id_col: str, text: str, source: str) -> Column:
    return F.concat_ws("|", row_key(F.col(id_col), F.col(text)), F.hex(F.xxhash64(source)))


def _documents(df: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """Slim rows ``row, id, src, size, u, uid``; ``u`` is a random number between 0 and 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in (id_col, source, text)]), 11) + 0.5) / float(1 << 53)
    docs = df.select(_row(id_col, text, source).alias("row"), F.col(id_col).alias("id"), F.col(source).alias("src"), words_in(F.col(text)).alias("size"), u.alias("u"))
    return docs.withColumn("uid", F.monotonically_increasing_id())


def _mixed(df: DataFrame, id_col: str, text: str, source: str, weights=(5, 2, 1), share: float = 1.5, seed: int = 42) -> DataFrame:
    docs = checkpoint(_documents(df, id_col, text, source, seed))
    sizes = checkpoint(docs.groupBy("src", "size").agg(F.count("*").alias("n")))
    sums = sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sums.withColumnRenamed("src", "source"), weights, share).select(F.col("source").alias("src"), "source_size", "target")
    plan = checkpoint(allocation(sizes, goal))
    d = _with_source(_promoted(docs, plan), plan.drop("lift"))
    base = F.when(F.col("lifted"), F.lit(MOST)).when((F.col("size") > 0) & (F.col("size") <= F.col("target")), F.col("whole")).otherwise(0)
    d = d.withColumn("copies", base.cast("int"))
    may = ~F.col("lifted") & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    sure = may & (F.col("size") > F.col("cut"))
    draw = may & ~sure & (F.col("size") <= F.col("left"))
    keep = ["row", "id", "src", "size", "source_size", "target", "copies"]
    out = [d.where(~draw).withColumn("copies", F.col("copies") + sure.cast("int")).select(*keep)]
    p = F.least(F.greatest(F.col("rate") * F.col("size"), F.lit(1e-15)), F.lit(1 - 1e-15))
    rank = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    # The logarithm of the rank lies within 80; as a number of 48 bits it is cut into bins.
    key = F.floor((F.ln("rank") + 80) / 160 * float(1 << 48))
    d = d.where(draw).withColumn("rank", rank).withColumn("key", key).select(*keep, "uid", "rank", "key", "left")
    d = checkpoint(d)
    while not d.isEmpty():
        passed, walked, later = _round(d)
        now = walked.groupBy("src").agg((F.first("left") - F.sum(F.col("size") * F.col("take"))).alias("now"))
        later = _with_source(later, now)
        fits = F.col("size") <= F.col("now")
        d = checkpoint(later.where(fits).withColumn("left", F.col("now")).drop("now"))
        taken = F.col("copies") + 1
        out += [passed.withColumn("copies", taken).select(*keep), walked.withColumn("copies", F.col("copies") + F.col("take")).select(*keep)]
        out.append(later.where(~fits).select(*keep))
    return reduce(DataFrame.unionByName, out)


def allocation(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """The plan, one row per source: ``src, source_size, target, whole, rest, cut, left, rate, lift``.

    ``sizes`` counts documents by ``src, size``. Every document up to the target's size gets ``whole``
    copies; ``rest`` is what they leave of the target. Of the documents that fit in the rest, those
    longer than ``cut`` are certain; the others share what these leave, ``left``, with a probability of
    ``rate`` times their size. If the documents that fit in the rest do not reach it and a longer one
    taken twice lets the others reach it better, one document of the size ``lift`` is taken twice and the
    others get no certain copy. Distinct sizes of a source are fewer than the root of twice its words.
    """
    h = sizes.join(goal.withColumnRenamed("src", "g_src"), F.col("src").eqNullSafe(F.col("g_src"))).drop("g_src")
    own = W.partitionBy("src")
    words = F.col("n") * F.col("size")
    within = lambda limit: F.coalesce(F.sum(F.when(F.col("size") <= limit, words)).over(own), F.lit(0))
    h = h.withColumn("fit", within(F.col("target")))
    h = h.withColumn("whole", F.when(F.col("fit") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("fit") + 1e-12))).otherwise(0).cast("int"))
    h = h.withColumn("rest", F.when(F.col("whole") < MOST, F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("fit"))).otherwise(F.lit(0.0)))
    h = h.withColumn("miss", F.greatest(F.lit(0.0), F.col("rest") - within(F.col("rest"))))
    longer = F.min(F.when((F.col("size") > F.col("rest")) & (F.col("size") <= F.col("target")), F.col("size"))).over(own)
    h = h.withColumn("m", F.when((F.col("whole") == 1) & (F.col("miss") > 0), longer))
    h = h.withColumn("other", F.col("target") - MOST * F.col("m"))
    reach = within(F.col("other")) - F.when(F.col("m") <= F.col("other"), F.col("m")).otherwise(0)
    h = h.withColumn("better", (F.col("other") >= 0) & (F.greatest(F.lit(0.0), F.col("other") - reach) < F.col("miss")))
    h = h.withColumn("lift", F.when(F.col("better"), F.col("m")))
    h = h.withColumn("whole", F.when(F.col("better"), 0).otherwise(F.col("whole"))).withColumn("rest", F.when(F.col("better"), F.col("other")).otherwise(F.col("rest")))
    # Probabilities in proportion to size: the longest size at which they stay below one ends the certain ones.
    many = (F.col("n") - F.when(F.col("lift") == F.col("size"), 1).otherwise(0)).cast("double")
    many = F.when((F.col("size") > 0) & (F.col("size") <= F.col("rest")), many).otherwise(0.0)
    down = own.orderBy(F.col("size").desc())
    h = h.withColumn("above", F.coalesce(F.sum(many * F.col("size")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    h = h.withColumn("square", F.sum(many * F.col("size") * F.col("size")).over(down.rowsBetween(0, W.unboundedFollowing)))
    h = h.withColumn("rate", F.when(F.col("square") > 0, (F.col("rest") - F.col("above")) / F.col("square")))
    open_ = (many > 0) & (F.col("rate") * F.col("size") < 1)
    first = F.max(F.when(open_, F.struct("size", (F.col("rest") - F.col("above")).alias("left"), "rate"))).alias("first")
    one = [F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest", "lift")]
    plan = h.groupBy("src").agg(*one, first)
    cut = [F.coalesce(F.col("first.size"), F.lit(0)).alias("cut"), F.coalesce(F.col("first.left"), F.lit(0.0)).alias("left"), F.coalesce(F.col("first.rate"), F.lit(0.0)).alias("rate")]
    return plan.select("src", "source_size", "target", "whole", "rest", "lift", *cut)


def _promoted(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``lifted``: true for one document of each source whose plan takes one of a certain size twice."""
    lift = plan.where("lift is not null").select("src", "lift")
    if lift.isEmpty():
        return docs.withColumn("lifted", F.lit(False))
    some = _with_source(docs, lift).where("size = lift")
    chosen = checkpoint(some.groupBy("src").agg(F.min(F.struct("u", "uid")).alias("one")).select("src", F.col("one.uid").alias("one")))
    return _with_source(docs, chosen, "left").withColumn("lifted", F.coalesce(F.col("uid") == F.col("one"), F.lit(False))).drop("one")


def _round(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that come, in rank order, before the place where their source's ``left`` ends and fit whole; rows
    of that place, with ``take``; and rows behind it. Sources that fit whole have no such place."""
    passed, later, open_ = [], [], d
    for shift in LEVELS:
        cell = F.shiftright("key", shift)
        sums = open_.groupBy("src", cell.alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left"))
        own = W.partitionBy("src")
        before = F.coalesce(F.sum("words").over(own.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
        sums = sums.withColumn("before", before).withColumn("all", F.sum("n").over(own))
        ends = sums.where(F.col("before") + F.col("words") > F.col("left"))
        ends = ends.groupBy("src").agg(F.min(F.struct("cell", "before", "n", "all")).alias("e"))
        few = F.col("e.all") <= WALK  # they are walked through as they are
        ends = ends.select("src", F.when(few, F.lit(-1)).otherwise(F.col("e.cell")).alias("lo"), F.when(few, F.lit(1 << 50)).otherwise(F.col("e.cell")).alias("hi"),
                           F.when(few, F.lit(0)).otherwise(F.col("e.before")).alias("gone"), F.when(few, F.col("e.all")).otherwise(F.col("e.n")).alias("n"))
        ends = checkpoint(ends)
        cut = _with_source(open_, ends.drop("n"), "left").withColumn("cell", cell)
        passed.append(cut.where(F.col("lo").isNull() | (F.col("cell") < F.col("lo"))).drop("lo", "hi", "gone", "cell"))
        later.append(cut.where(F.col("cell") > F.col("hi")).drop("lo", "hi", "gone", "cell"))
        open_ = cut.where(F.col("cell").between(F.col("lo"), F.col("hi"))).withColumn("left", F.col("left") - F.col("gone")).drop("lo", "hi", "gone", "cell")
        if ends.where(F.col("n") > WALK).isEmpty():
            break
        open_ = checkpoint(open_)
    return reduce(DataFrame.unionByName, passed), checkpoint(_walk(open_)), reduce(DataFrame.unionByName, later)


def _with_source(d: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """Joins a table with one row per source: broadcast while it is small, else by source and salt."""
    if plan.limit(SMALL + 1).count() <= SMALL:
        right = F.broadcast(plan.withColumnRenamed("src", "p_src"))
        return d.join(right, d.src.eqNullSafe(right.p_src), how).drop("p_src")
    salt = F.pmod(F.hash("row"), F.lit(SALTS))
    right = plan.withColumnRenamed("src", "p_src").withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = d.withColumn("salt", salt)
    return left.join(right, left.src.eqNullSafe(right.p_src) & (left.salt == right.p_salt), how).drop("p_src", "p_salt", "salt")


def _walk(d: DataFrame) -> DataFrame:
    """Walks through the rows of each source in rank order; ``take`` is 1 for what fits in ``left``."""
    one = ["source_size", "target", "left"]
    row = F.struct("rank", "uid", "row", "id", "size", "copies")
    per = d.groupBy("src").agg(*[F.first(c).alias(c) for c in one], F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<int>").alias("take"))

    def step(state: Column, x: Column) -> Column:
        fit = (x["size"] <= state["left"]).cast("int")
        return F.struct((state["left"] - fit * x["size"]).alias("left"), F.concat(state["take"], F.array(fit)).alias("take"))

    per = per.withColumn("take", F.aggregate("rows", start, step)["take"])
    out = per.select("src", *one, F.explode(F.arrays_zip("rows", "take")).alias("z"))
    return out.select("src", *one, "z.rows.*", F.col("z.take").alias("take"))
