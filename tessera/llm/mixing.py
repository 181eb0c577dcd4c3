"""Mixing sources to target weights by hash thresholds.

Each row has a 60-bit hash of its id and text. A source's budget becomes whole copies of all its rows plus the
rows below a threshold in the space of hashes; a larger budget keeps all that a smaller one has. The thresholds
come from histograms of words by source and hash prefix: the bucket in which the budget ends is found by a
running sum over its 4,096 buckets, then that bucket alone is split further, down to single hashes. Rows
are filtered by comparing hashes; they are never sorted or gathered. Only rows that equal each other in id and
text share a hash: if the budget ends among them, as many as it needs are counted off, partition by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, small

#: Hash bits that each level of the histogram splits by; five levels cover the 60 bits.
LEVEL_BITS, LEVELS = 12, 5
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")  # one character a word
    return F.coalesce(F.char_length(marks).cast("long"), F.lit(0).cast("long"))


def row_hash(key: Column, text: Column, seed: int) -> Column:
    """The first 60 bits of md5 of seed, key and text, as a long; null ones hash as empty."""
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (key, text))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def _part(place: str) -> Column:
    """The partition in a number by monotonically_increasing_id."""
    return F.shiftright(F.col(place), 33)


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank``, from 0, of its sources by code point, null last; sorted by ranges, counted by partition."""
    order = F.col("source").asc_nulls_last()
    placed = cut(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()))
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(_part("place").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:  # a row for each partition
        starts.append((p, at))
        at += n
    known = sizes.sparkSession.createDataFrame(starts, "part long, start long")
    joined = placed.join(small(known), _part("place") == F.col("part"))
    return joined.withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place", "part", "start")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``sizes(source, source_size)``, one row a source.

    Sources by code point, null last, take ``weights`` in turn. Targets share ``share`` of all sizes by
    weight; none is above ``most`` times its size, what that leaves over goes to the others by weight
    until none is above. The level at which the targets stand still comes from global sums, a round each.
    """
    listed = F.array(*(F.lit(float(w)) for w in weights))
    ranked = cut(_ranked(sizes).withColumn("weight", F.element_at(listed, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))).drop("rank"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, known = share * total, 0.0, -1
    while True:
        capped = most * F.col("source_size") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(capped, most * F.col("source_size"))),
            F.sum(F.when(~capped, F.col("weight"))),
            F.count(F.when(capped, 1)),
        ).first()
        if row[1] is None or row[2] == known:
            break
        known, level = row[2], (budget - (row[0] or 0.0)) / row[1]
    return ranked.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.lit(level) * F.col("weight")))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, below, more``: the rows of a source with a hash under ``below``, and ``more`` of those with that
    very hash, come nearest to its budget.

    ``rows(source, size, hash)``; ``budgets(source, rest)`` with rest under the source's whole size.
    """
    state = budgets.select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = 60 - LEVEL_BITS * (level + 1)
        own = F.col("r.source").eqNullSafe(F.col("s.source"))
        inside = F.shiftright(F.col("r.hash"), shift + LEVEL_BITS) == F.col("s.prefix")
        counted = (
            rows.alias("r")
            .join(small(state).alias("s"), own & inside)
            .groupBy(F.col("s.source").alias("source"), F.shiftright(F.col("r.hash"), shift).alias("bucket"))
            .agg(F.sum("r.size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("s.left").alias("left"))
        )
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        # the first bucket whose running sum reaches what is left; at most 4,096 buckets a source
        state = cut(
            counted.withColumn("upto", upto)
            .filter(F.col("upto") >= F.col("left"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "words", "n", "left")).alias("b"))
            .select(
                "source", (F.col("b.left") - F.col("b.upto") + F.col("b.words")).alias("left"), F.col("b.bucket").alias("prefix"),
                F.col("b.words").alias("words"), F.col("b.n").alias("n"),
            )
        )
    # the boundary is one hash now, of rows with equal ids and texts: as many of them as come nearest
    some = state.withColumn("k", F.floor((2 * F.col("left") * F.col("n") + F.col("words")) / (2 * F.col("words"))).cast("long"))
    whole = F.col("k") >= F.col("n")
    return some.select("source", (F.col("prefix") + whole.cast("long")).alias("below"), F.when(whole, 0).otherwise(F.col("k")).cast("long").alias("more"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
        weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, size, source, hash, place`` and the plan per source: ``source_size, target, copies, below, more``.

    A row is taken ``copies`` times, and once more if its hash is under ``below`` or it is one of ``more`` rows
    of that hash. Those have equal ids and texts, null ones included, and any of them may be the ones. Null
    texts have size 0; a null source is a source. Empty tables give empty ones; very long texts are hashed and
    counted as they are. The same rows give the same mix on any cluster.
    """
    rows = cut(docs.select(
        F.col(f"`{id_col}`").alias("id"), n_words(F.col(f"`{text_col}`")).alias("size"), F.col(f"`{source_col}`").alias("source"),
        row_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("hash"), F.monotonically_increasing_id().alias("place"),
    ))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goals = cut(goals.withColumn("copies", copies))
    rest = goals.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).filter("rest > 0")
    found = thresholds(rows, rest.select("source", "rest"))
    same = F.col("g.source").eqNullSafe(F.col("t.source"))
    none = F.lit(0).cast("long")
    plan = goals.alias("g").join(found.alias("t"), same, "left").select("g.*", F.coalesce("t.below", none).alias("below"), F.coalesce("t.more", none).alias("more"))
    return rows, cut(plan)


def _counted_off(edge: DataFrame, source: str, place: str, more: str, times: str) -> DataFrame:
    """``edge``, rows of the hash at which their source's budget ends, with one added to ``times`` for ``more`` of each source.

    Rows are numbered within each partition that ``place`` tells, after those of the partitions before.
    """
    part, before, nth = (free_name(edge, c) for c in ("mix_part", "mix_before", "mix_place"))
    edge = cut(edge.withColumn(part, _part(place)))
    upto = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    of = edge.groupBy(source, part).agg(F.count(F.lit(1)).alias(nth))  # a row for each source and partition
    starts = of.select(F.col(source).alias("s"), F.col(part).alias("p"), F.coalesce(F.sum(nth).over(upto), F.lit(0)).alias(before))
    numbered = edge.withColumn(nth, F.row_number().over(Window.partitionBy(source, part).orderBy(place)))
    joined = numbered.join(small(cut(starts)), F.col(source).eqNullSafe(F.col("s")) & (F.col(part) == F.col("p")))
    return joined.withColumn(times, F.col(times) + (F.col(before) + F.col(nth) <= F.col(more)).cast("int")).drop("s", "p", part, before, nth)


def _times(rows: DataFrame, names: dict[str, str], cut_off: bool) -> DataFrame:
    """``rows`` joined to their plan, with the column ``names["times"]``; ``cut_off``: a budget ends among equal rows."""
    col = lambda c: F.col(names[c])
    at_edge = (col("more") > 0) & (col("hash") == col("below"))
    done = rows.withColumn(names["times"], col("copies") + (col("hash") < col("below")).cast("int"))
    if not cut_off:
        return done
    edge = _counted_off(done.filter(at_edge), *(names[c] for c in ("source", "place", "more", "times")))
    return done.filter(~at_edge).unionByName(edge)


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and ``times``, the number of copies that the mix takes."""
    joined = rows.alias("r").join(small(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    wide = joined.select("r.*", "source_size", "target", "copies", "below", "more")
    names = {c: c for c in ("source", "place", "hash", "copies", "below", "more", "times")}
    return _times(wide, names, not plan.filter("more > 0").isEmpty()).drop("copies", "below", "more", "place")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, text_col: str = "text", **args) -> DataFrame:
    """``docs`` as the mix has them: each row once for each copy taken; columns as they were.

    Rows with equal ids, texts and sources are taken without regard to their other columns.
    """
    _, plan = mix(docs, id_col=id_col, source_col=source_col, seed=seed, text_col=text_col, **args)
    names = {c: free_name(docs, f"mix_{c}") for c in ("source", "place", "hash", "copies", "below", "more", "times")}
    own = plan.select(*(F.col(c).alias(names[c]) for c in ("source", "copies", "below", "more")))
    joined = docs.join(small(own), F.col(f"`{source_col}`").eqNullSafe(F.col(names["source"])))
    hashed = joined.withColumn(names["hash"], row_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed)).withColumn(names["place"], F.monotonically_increasing_id())
    wide = _times(hashed, names, not plan.filter("more > 0").isEmpty())
    nth = free_name(wide, "mix_nth")
    repeated = wide.filter(F.col(names["times"]) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(names["times"]))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
