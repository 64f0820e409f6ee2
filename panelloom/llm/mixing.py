"""Mixing sources to target weights by capped water-filling.

Targets are proportional to weights; a source whose target would exceed ``max_epochs``
times its size is clamped there and the excess goes to the others in proportion, until no
target is above its clamp.  A source is then taken in whole repetitions, and the fraction
that is left is taken from its documents in a seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import WORD, running_totals, stored

SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit(""))))


def source_targets(
    sizes: DataFrame, weights: Sequence[float], max_epochs: float
) -> DataFrame:
    """Target of every source of ``sizes`` (source, size): source, source_size, target.

    Sources sorted by code point (null last) take ``weights`` in turn.  Each round of the
    water-filling sends three sums to the driver, whatever the number of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A source counts 1, so that the running total is its place in the order.
    places = running_totals(
        totals.withColumn("_one", F.lit(1).cast("long")),
        [F.col("source").isNull(), F.coalesce("source", F.lit(""))],
        "_one",
        "_place",
    )
    turns = F.array(*[F.lit(float(w)) for w in weights])
    level = stored(
        places.select(
            "source",
            "source_size",
            (F.col("source_size") * float(max_epochs)).alias("_most"),
            F.get(turns, (F.col("_place") % len(weights)).cast("int")).alias("_weight"),
        ),
        "sources",
    )
    total = level.agg(F.sum("source_size")).first()[0] or 0
    fill = None
    while True:
        above = F.lit(False) if fill is None else F.col("_weight") * F.lit(fill) > F.col("_most")
        row = level.agg(
            F.sum(F.when(above, F.col("_most"))).alias("clamped"),
            F.sum(F.when(~above, F.col("_weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        # Clamping only ever raises the level, so what is clamped stays clamped.
        new = (float(total) - (row["clamped"] or 0.0)) / row["weight"]
        if fill is not None and new <= fill:
            break
        fill = new
    share = F.col("_weight") * F.lit(fill or 0.0)
    return level.select(
        "source", "source_size", F.least(share, "_most").alias("target")
    )


def order_key(seed: str) -> Column:
    """Place of a document in the seeded order of its source; equal only for equal id and
    text."""
    return F.concat(seeded(F.col("doc_id"), seed), F.hex(F.xxhash64("text")))


def cuts(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """How far the fractional repetition of each source reaches, stored: source,
    source_size, target, copies (whole repetitions), cut (the key at which it ends; null if
    it takes all), rest (words of each document with that key), all (it takes all).

    ``sizes``: source, size, key of every document, stored.
    """
    targets = stored(source_targets(sizes, weights, max_epochs), "targets")
    order = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    # Documents with one key are equal and count as one.
    units = sizes.where("size > 0").groupBy("source", "key").agg(
        F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_equal")
    )
    ordered = running_totals(units, [*order, F.col("key")], "_words", "_before")
    # Words of all sources that stand before a source in the same order.
    bases = running_totals(targets, order, "source_size", "_base")
    total, target = F.col("source_size"), F.col("target")
    whole = F.when(total > 0, F.floor(target / total)).otherwise(F.lit(0)).cast("long")
    plan = stored(
        bases.withColumn("copies", whole).withColumn(
            "_wanted", F.round("target").cast("long") - F.col("copies") * total
        ),
        "plan",
    )
    named = plan.withColumnRenamed("source", "_source")
    left = F.col("_wanted") - (F.col("_before") - F.col("_base"))
    ends = (
        ordered.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .where((left >= 0) & (left < F.col("_words")))
        .select(
            F.col("source").alias("_source"),
            F.col("key").alias("cut"),
            F.floor(left / F.col("_equal")).cast("long").alias("rest"),
        )
    )
    return stored(
        plan.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", "copies", "cut", "rest",
            (F.col("_wanted") >= F.col("source_size")).alias("all"),
        ),
        "cuts",
    )


def extra_words(key: Column, size: Column) -> Column:
    """Words the fractional repetition takes of a document."""
    return (
        F.when(F.col("all") | (key < F.col("cut")), size)
        .when(key == F.col("cut"), F.col("rest"))
        .otherwise(F.lit(0))
        .cast("long")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: float = 3,
    seed: str = SEED,
) -> DataFrame:
    """What a mix takes of every document: doc_id, source, size, source_size, target,
    copies (whole repetitions of the document), extra (words of one further, partial
    repetition), taken.

    In a seeded order of each source's documents, the words of the fractional repetition
    come from the first documents; only the one where the fraction ends is taken in part
    (documents equal in id and text share that part).  So a source's taken words are its
    target rounded to a word.  Null texts and texts without words have size 0 and give
    nothing.  Null ``source`` is a source of its own; null ``doc_id`` is an id like another.
    Rows that repeat are documents each.
    """
    sizes = _sizes(docs, seed)
    plan = cuts(sizes, weights, max_epochs).withColumnRenamed("source", "_source")
    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "extra", extra_words(F.col("key"), F.col("size"))
    )
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "copies", "extra",
        (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"),
    )


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    return stored(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.coalesce(order_key(seed), seeded(F.col("doc_id"), seed)).alias("key"),
        ),
        "sizes",
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: float = 3,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` as the mix takes them: whole repetitions as repeated rows, the fractional
    one as further rows, the last of them cut after the words it takes.  All columns stay;
    ``n_chars`` follows a cut text.  The texts are not shuffled."""
    plan = cuts(_sizes(docs, seed), weights, max_epochs)
    plan = plan.select(F.struct(*plan.columns).alias("plan"))
    size = word_count(F.col("text"))
    key = F.coalesce(order_key(seed), seeded(F.col("doc_id"), seed))
    # The row goes along as a whole, so that no name of it meets those made here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").alias("source"), size.alias("size"), key.alias("key"),
    ).join(plan, F.col("source").eqNullSafe(F.col("plan.source")))
    extra = (
        F.when(F.col("plan.all") | (F.col("key") < F.col("plan.cut")), F.col("size"))
        .when(F.col("key") == F.col("plan.cut"), F.col("plan.rest"))
        .otherwise(F.lit(0))
    )
    taken = rows.where("size > 0").withColumn("extra", extra)
    times = F.col("plan.copies") + F.when(F.col("extra") > 0, 1).otherwise(0)
    repeated = taken.where(times > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))
    )
    old = F.col("row").getField("text")
    part = (F.col("copy") > F.col("plan.copies")) & (F.col("extra") < F.col("size"))
    words = F.slice(
        F.regexp_extract_all(old, F.lit(f"({WORD})")), F.lit(1), F.col("extra").cast("int")
    )
    cut = F.when(part, F.array_join(words, " ")).otherwise(old)
    out = repeated.select("row", cut.alias("text"), part.alias("part"))

    def column(c: str) -> Column:
        before = F.col("row").getField(c)
        if c == "text":
            return F.col("text").alias(c)
        if c == "n_chars":
            n = F.when(F.col("part"), F.length("text")).otherwise(before)
            return n.cast(docs.schema[c].dataType).alias(c)
        return before.alias(c)

    return out.select(*[column(c) for c in docs.columns])
