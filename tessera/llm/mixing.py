"""Mixing sources to target weights, in DataFrame operations throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, words_column

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken this many times at most.
MAX_REPEAT = 3
SEED = "mix-0"
#: Columns that the mix adds.
OUTPUTS = ("size", "source_size", "target", "copies")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    return F.size(words_column(text)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from a document's id: 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, source_col: str = "source") -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size long, weight int, target double.

    The targets share the total of all sizes by weight, none above ``MAX_REPEAT`` times its source's
    size: the excess is reshared by weight. Sorted by the level at which a source is full
    (``MAX_REPEAT * size / weight``), the sources full at the final water level come first; the level
    that the others share follows from running sums. The sums and the order of names are windows over
    the table of sources, which has one row per source and no document.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    per = materialize(per, "mix-sources")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    full = F.col("source_size") * F.lit(MAX_REPEAT)
    level = full / F.col("weight")
    order = Window.orderBy(level.asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_level", left / open_weight).withColumn("_full", level)
    # The water level: that of the first source, in order of fullness, which is not full at it.
    water = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(every)["_level"]
    target = F.least(full.cast("double"), F.coalesce(water * F.col("weight"), full.cast("double")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with size, source_size, target and copies (long, long, double, int).

    A source's repetition rate is target / source_size; each of its documents is taken floor(rate) times,
    and once more if its hash-seeded draw falls below the fraction. Null text has size 0; null sources
    are one source, last in order; a source without words has rate 0. Rows that repeat an id draw alike.
    Input columns named like the output are replaced. An empty table gives an empty result.

    Only (source, size) is aggregated, with partial sums before the shuffle, so a source with a third of
    the rows costs no more than another. The source table is joined back by the planner's choice: it is
    broadcast only if its written size is below the session's threshold, else sorted, and a hot source
    split by adaptive execution.
    """
    rest = [c for c in docs.columns if c not in OUTPUTS]
    sized = docs.select(*rest, word_count(F.col(text_col)).alias("size"))
    targets = materialize(source_targets(sized.select(F.col(source_col), "size"), source_col), "mix-targets")
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target")
    joined = sized.join(targets, F.col(source_col).eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(draw(F.col(id_col)) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.select(*rest, "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every row ``copies`` times. Rows with none, or null, go; an empty table gives an empty result."""
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).drop("__copy")
