"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  The whole part of ``target / size`` is the number of copies that each of its
documents gets for certain.  The words that these leave open are filled by one copy more of some documents: a document's
inclusion probability is in proportion to the length of its size in bits, so that long documents are likelier than scraps, and
where that gives 1 or more the copy is certain.  The others are ranked by random odds divided by inclusion odds (the Pareto
order), and the first ones are taken until the open words are reached, so that the size of the sample is fixed.  The random
number is a digest of the document's id: reruns agree.

The place where a source's sample ends is found by counting, not by sorting the source: words are summed in 1024 bins of the
rank, then in 1024 bins of the bin in which the sample ends, and only the documents of that small bin are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import WORD, materialize

BINS = 1024


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def size_class(size: str) -> Column:
    """The length of the size in bits; at most 63."""
    return F.length(F.bin(size))


def random_unit(id_col: str, seed: str) -> Column:
    """A number over 0 and under 1 from 48 bits of a digest of seed and id; a null id counts as the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size, n) with ``target``: the weights' shares of ``share`` times all words, filled up like
    vessels: none gets over ``most`` times its size, and what is over goes to the others by weight."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    sized = sizes.withColumn("weight", weight).withColumn("full", F.lit(float(most)) * F.col("source_size"))
    by_fill = Window.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = sized.select(
        "*",
        F.row_number().over(by_fill).alias("fill_order"),
        ((F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    fits = F.col("level") * F.col("weight") <= F.col("full")
    found = level.withColumn("first", F.min(F.when(fits, F.struct("fill_order", "level"))).over(every))
    target = F.when(F.col("first").isNotNull() & (F.col("fill_order") >= F.col("first.fill_order")), F.col("first.level") * F.col("weight")).otherwise(F.col("full"))
    return found.select("source", "source_size", target.alias("target"))


def inclusion(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """``sources`` for each size class (source, class, words): with the class's certain copies ``whole``, its inclusion
    probability ``part`` of one more, null where there is none, and the words ``need`` that the source's sample is to hold.

    Probabilities are ``level * class``; from the largest class on, those that come to 1 or more are certain, and the level
    of the rest follows from the words still open.
    """
    own = classes.join(sources, sources["source"].eqNullSafe(classes["class_source"]))
    larger = Window.partitionBy("source_key").orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source_key").orderBy(F.col("class").desc()).rowsBetween(0, Window.unboundedFollowing)
    opened = F.col("open") - F.coalesce(F.sum("words").over(larger), F.lit(0))
    found = own.withColumn("left", opened).withColumn("level", opened / F.nullif(F.sum(F.col("class") * F.col("words")).over(rest), F.lit(0)))
    # the first class that is not certain, and its level, hold for all smaller ones
    found = found.withColumn("first", F.max(F.when(F.col("level") * F.col("class") < 1, F.struct("class", "level", "left"))).over(Window.partitionBy("source_key")))
    certain = F.coalesce(F.col("class") > F.col("first.class"), F.lit(True)) & (F.col("open") > 0)
    part = F.when(~certain & (F.col("open") > 0), F.col("first.level") * F.col("class"))
    return found.select("source", "source_size", "target", "class", (F.col("whole") + certain.cast("long")).alias("whole"), part.alias("part"), F.when(F.col("open") > 0, F.col("first.left")).alias("need"))


def with_ranks(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (having ``source``, ``class`` and ``u``) joined to the plan of its source and class, with the Pareto rank."""
    plan = plan.withColumnRenamed("source", "plan_source").withColumnRenamed("class", "plan_class")
    joined = docs.join(plan, docs["source"].eqNullSafe(plan["plan_source"]) & (docs["class"] == plan["plan_class"]), "left")
    rank = F.when(F.col("part") > 0, F.col("u") / (1 - F.col("u")) / (F.col("part") / (1 - F.col("part"))))
    return joined.withColumn("rank", rank).withColumn("place", F.col("rank") / (1 + F.col("rank")))


def bins(place: Column) -> tuple[Column, Column]:
    fine = F.least(F.floor(place * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    return F.floor(fine / BINS).cast("int"), (fine % BINS).cast("int")


def _crossing(sums: DataFrame, keys: list[str], bin_col: str, start: Column, need: Column) -> DataFrame:
    """The bin of each source in which the words taken pass what is needed, and the words before it."""
    w = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("upto", start + F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
    return run.where((F.col("before") <= need) & (F.col("upto") > need))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source and size class, from a table (source, size, class, u): certain copies, inclusion probability, and
    where the source's sample ends."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    classes = materialize(sized.groupBy("source", "class").agg(F.sum("size").alias("words")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(sizes, weights, share, most).withColumn("whole", F.floor(rate).cast("long")).withColumn("source_key", key)
    targets = targets.withColumn("open", F.col("target") - F.col("whole") * F.col("source_size"))
    base = materialize(inclusion(targets, classes.withColumnRenamed("source", "class_source")), "mix-targets")
    first, second = bins(F.col("place"))
    ranked = with_ranks(sized, base).where("rank is not null").withColumn("bin1", first).withColumn("bin2", second).withColumn("key", key)
    coarse = ranked.groupBy("key", "need", "bin1").agg(F.sum("size").alias("words"))
    coarse = materialize(_crossing(coarse, ["key"], "bin1", F.lit(0), F.col("need")).select("key", F.col("bin1").alias("end1"), F.col("before").alias("before1")), "mix-coarse")
    inner = ranked.join(coarse, "key").where("bin1 = end1")
    fine = inner.groupBy("key", "need", "end1", "before1", "bin2").agg(F.sum("size").alias("words"))
    fine = materialize(_crossing(fine, ["key"], "bin2", F.col("before1"), F.col("need")).select("key", F.col("bin2").alias("end2"), F.col("before").alias("before2")), "mix-fine")
    last = inner.join(fine, "key").where("bin2 = end2")
    ties = last.groupBy("key", "need", "before2", "rank").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before2") + F.sum("words").over(w)
    cut = ties.select("key", "rank", (2 * upto - F.col("words") <= 2 * F.col("need")).alias("fits")).where("fits").groupBy("key").agg(F.max("rank").alias("end_rank"))
    return materialize(base.withColumn("key", key).join(coarse, "key", "left").join(fine, "key", "left").join(cut, "key", "left").drop("key", "before1", "before2", "need"), "mix-plan")


def copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (having ``source``, ``class`` and ``u``) with the plan's columns and the number of ``copies``."""
    ranked = with_ranks(sized, plan)
    first, second = bins(F.col("place"))
    at, end = first * BINS + second, F.col("end1") * BINS + F.coalesce(F.col("end2"), F.lit(0))
    taken = F.col("rank").isNotNull() & (F.col("end1").isNull() | (at < end) | ((at == end) & (F.col("rank") <= F.coalesce(F.col("end_rank"), F.lit(-1.0)))))
    return ranked.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0).cast("long")) + taken.cast("long"))


def sizes_of(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"))
    return sized.withColumn("class", size_class("size")).withColumn("u", random_unit("doc_id", seed))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words that the mix takes of every document: ``doc_id, size, source_size, target, taken``.

    A null text has no words; a null source is a source of its own, the last in order; a null id counts as the empty text
    for the random number; rows with equal ids and sizes have equal ranks and are taken or left together.  Other columns are
    not read.  An empty table gives no rows.
    """
    sized = materialize(sizes_of(docs, seed, id_col, text_col, source_col), "mix-sizes")
    out = copies(sized, mixing_plan(sized, weights, share, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs``, all columns whatever their names, as often as it is taken.

    Null texts, sources and ids as in ``mix``; a document without words is taken as often as the copies of its size class.
    """
    sized = sizes_of(docs, seed, id_col, text_col, source_col)
    plan = mixing_plan(materialize(sized, "mix-sizes"), weights, share, most)
    rows = docs.select(F.struct("*").alias("row"))
    own = rows.select("row", *(F.col("row").getField(c).alias(n) for c, n in ((id_col, "doc_id"), (source_col, "source"), (text_col, "text"))))
    own = own.select("row", "source", words("text").alias("size"), random_unit("doc_id", seed).alias("u")).withColumn("class", size_class("size"))
    return copies(own, plan).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS filled
  FROM sizes),
levels AS (
  SELECT *, row_number() OVER (ORDER BY filled / weight, source NULLS LAST) AS fill_order,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(filled) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY filled / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
firsts AS (SELECT fill_order AS first_order, level AS first_level FROM levels WHERE level * weight <= filled ORDER BY fill_order LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN fill_order >= first_order THEN first_level * weight ELSE filled END AS target
  FROM levels LEFT JOIN firsts ON true),
planned AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole FROM targets),
classes AS (SELECT source, length(bin(size))::INT AS class, sum(size)::BIGINT AS words FROM sized GROUP BY 1, 2),
opened AS (
  SELECT p.*, class, words, target - whole * source_size AS open FROM planned p JOIN classes c ON p.source IS NOT DISTINCT FROM c.source),
lefts AS (
  SELECT *, open - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(class * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM opened),
levels_of AS (SELECT *, lft / nullif(rest, 0) AS lev FROM lefts),
first_of AS (SELECT source, max(class) AS first_class, arg_max(lev, class) AS first_lev, arg_max(lft, class) AS need FROM levels_of WHERE lev * class < 1 GROUP BY source),
included AS (
  SELECT l.source, source_size, target, class, need,
         whole + CASE WHEN open > 0 AND (first_class IS NULL OR class > first_class) THEN 1 ELSE 0 END AS whole,
         CASE WHEN open > 0 AND class <= first_class THEN first_lev * class END AS part
  FROM levels_of l LEFT JOIN first_of f ON l.source IS NOT DISTINCT FROM f.source),
ranked AS (
  SELECT s.*, source_size, target, whole, need, part,
         CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part)) END AS rank
  FROM sized s JOIN included p ON s.source IS NOT DISTINCT FROM p.source AND length(bin(s.size)) = p.class),
cumulated AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST) AS upto, sum(size) OVER (PARTITION BY source, rank) AS tied
  FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND 2 * upto - tied <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cumulated
"""
