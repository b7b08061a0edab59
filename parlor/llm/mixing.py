"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share is more than ``max_epochs`` times its words
is held there and its excess is dealt to the others in proportion to their weights, until no share is above
its bound. A target of 2.4 times a source's words then takes every document twice and four tenths of the
words once more: documents stand in the order of a seeded hash, and each one is taken again if the middle of
its words lies below the cut. So a source misses its target by half of one document at most.

No source is ever sorted as a whole. Two sums over 4,096 hash ranges each (all, then those inside the range
that holds the cut) leave about one row in 16 million for the ranking, however large the source is.

Results, all cases included:
* words are runs of other characters than ASCII white space; a null or empty text has none and is taken 0 times;
* sources are ordered by code point, null is a source of its own and the last one;
* rows that agree in id, text and source are treated alike; an empty table gives an empty result;
* a document without words follows its source, and a source without any is taken once, with a target of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parlor.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_number(id_col: Column, text: Column, seed: int) -> Column:
    """48 even bits from the digest of seed, id and text."""
    parts = [F.lit(f"{seed}"), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def source_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Deal the weights in turn to the sources by code point, null last.

    Sources are range-partitioned and numbered within their partitions, shifted by the counts of the earlier
    ones, so that even very many sources are not sorted in one task.
    """
    dealt = durable(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    # A row per partition, as many as the session has shuffle partitions.
    counts = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = (F.col("before") + F.col("within")) % len(weights)
    table = F.array(*[F.lit(float(w)) for w in weights])
    return (
        dealt.withColumn("within", within).join(F.broadcast(offsets), "part")
        .select("source", "source_size", table[turn.cast("int")].alias("weight"))
    )


def fill_level(sources: DataFrame, budget: float, max_epochs: float) -> float:
    """The level L at which the targets ``min(max_epochs * source_size, L * weight)`` add up to the budget.

    Each turn holds the sources that are above their bounds and raises the level for the rest; the level only
    rises, and the turns end when no further source is above.
    """
    cap, weight = F.col("source_size") * float(max_epochs), F.col("weight")
    level, held = 0.0, -1
    while True:
        above = cap < F.lit(level) * weight
        row = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)).alias("cap"),
            F.sum(F.when(above, 0.0).otherwise(weight)).alias("weight"),
            F.sum(above.cast("long")).alias("held"),
        ).first()
        if not row["weight"] or row["held"] == held:
            return level
        level, held = (budget - row["cap"]) / row["weight"], row["held"]


class Mix:
    """What decides a mix: the plan of each source, and the documents in the ranges that hold the cuts."""

    def __init__(self, plan: DataFrame, ranked: DataFrame, seed: int):
        self.plan, self.ranked, self.seed = plan, ranked, seed

    def epochs(self, df: DataFrame, id_col: Column, source: Column, at: Column) -> DataFrame:
        """Add ``__mix_epochs``, ``__mix_source_size`` and ``__mix_target`` to the rows.

        The rows stay where they are if both tables are small: Spark broadcasts them by the measured size of
        their files, and splits hot sources where it can't.
        """
        plan = self.plan.select(*[F.col(c).alias(f"__mix_{c}") for c in self.plan.columns])
        ranked = self.ranked.select(*[F.col(c).alias(f"__in_cut_{c}") for c in self.ranked.columns])
        joined = df.withColumn("__mix_at", at).join(plan, source.eqNullSafe(F.col("__mix_source")), "left")
        joined = joined.join(
            ranked,
            source.eqNullSafe(F.col("__in_cut_source")) & id_col.eqNullSafe(F.col("__in_cut_id"))
            & (F.col("__mix_at") == F.col("__in_cut_at")),
            "left",
        )
        place, cut = _low_range(F.col("__mix_at")), F.coalesce("__mix_cut", F.lit(1 << 24))
        again = F.when(place < cut, 1).when(place > cut, 0).otherwise(F.coalesce("__in_cut_again", F.lit(0)))
        return joined.withColumn("__mix_epochs", F.col("__mix_whole") + again).drop(
            "__mix_at", *[f"__in_cut_{c}" for c in self.ranked.columns],
            *[f"__mix_{c}" for c in self.plan.columns if c not in ("source_size", "target")],
        )


def _low_range(at: Column) -> Column:
    return F.shiftright(at, 24)


def _with_plan(df: DataFrame, table: DataFrame) -> DataFrame:
    named = table.withColumnRenamed("source", "_source")
    return df.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _cut(sums: DataFrame, start: str) -> DataFrame:
    """Per source the range ``place`` that holds the rest, and the words before it."""
    earlier = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    running = sums.withColumn("sum", F.col(start) + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    inside = (F.col("sum") <= F.col("rest")) & (F.col("sum") + F.col("words") > F.col("rest"))
    return running.where(inside).groupBy("source").agg(F.min("place").alias("cut"), F.min("sum").alias("before"))


def plan_mix(sized: DataFrame, weights: Sequence[float], max_epochs: float, share: float, seed: int) -> Mix:
    """Targets, cuts and ranked documents from the rows ``id, source, size, at``, which must be durable."""
    ranges = durable(
        sized.groupBy("source", F.shiftright("at", 36).alias("place")).agg(F.sum("size").alias("words")), "ranges"
    )
    weighed = durable(
        source_weights(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights), "weighed"
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = fill_level(weighed, total * float(share), max_epochs)
    target = F.least(F.col("source_size") * float(max_epochs), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = weighed.select("source", "source_size", target.alias("target")).withColumn("whole", whole.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    first = _cut(_with_plan(ranges, plan.select("source", "rest")).withColumn("zero", F.lit(0)), "zero")
    first = durable(_with_plan(plan, first), "first")
    inside = _with_plan(sized, first.select("source", "cut", "before", "rest")).where(F.shiftright("at", 36) == F.col("cut"))
    sums = inside.groupBy("source", "before", "rest", _low_range(F.col("at")).alias("place")).agg(F.sum("size").alias("words"))
    plan = durable(_with_plan(plan, _cut(sums, "before")), "plan")

    cuts = plan.select("source", "cut", "before", "rest").where("cut is not null")
    in_cut = _with_plan(sized, cuts).where(_low_range(F.col("at")) == F.col("cut"))
    alike = in_cut.groupBy("source", "id", "at", "before", "rest").agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.col("before") + F.coalesce(F.sum("words").over(order), F.lit(0))
    again = (2 * earlier + F.col("words") <= 2 * F.col("rest")).cast("int")
    return Mix(plan, durable(alike.select("source", "id", "at", again.alias("again")), "ranked"), seed)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return durable(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            shuffle_number(F.col(id_col), F.col(text_col), seed).alias("at"),
        ),
        "sized",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: float = 3,
    share: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, epochs`` (times the document is taken).

    ``share`` is the budget as a share of all words.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed)
    decided = plan_mix(sized, weights, max_epochs, share, seed)
    return decided.epochs(sized, F.col("id"), F.col("source"), F.col("at")).select(
        "id", "source", "size", F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"), F.col("__mix_epochs").alias("epochs"),
    )


def take_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: float = 3,
    share: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """The documents that the mix takes, all columns, and ``epochs`` (``mix_epochs`` if there is such a column)."""
    decided = plan_mix(_sized(docs, id_col, text_col, source_col, seed), weights, max_epochs, share, seed)
    name = "mix_epochs" if "epochs" in {c.lower() for c in docs.columns} else "epochs"
    at = shuffle_number(docs[id_col], docs[text_col], seed)
    marked = decided.epochs(docs, docs[id_col], docs[source_col], at).where("__mix_epochs > 0")
    return marked.drop("__mix_source_size", "__mix_target").withColumnRenamed("__mix_epochs", name)
