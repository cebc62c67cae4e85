"""Which labels of a link table reach each other.

Every function here needs few rounds on long thin tables too. Stars of neighbours shrink weakly
connected parts to one label in a logarithmic number of rounds. Labels with a single source are
passed over by pointer doubling, so a chain of n links takes log2(n) rounds; what is left after
that is walked hop by hop.

``links`` has columns src, dst; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.plans.joins import fits_broadcast
from rippleflow.plans.rounds import rounds
from rippleflow.session import cut_lineage

#: Fewer labels with a single source are walked like others: a few rounds cost less than pointers.
DOUBLED_FROM = 16


def ends_of(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("src", "dst")).alias("label")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(label, system): the least label of each weakly connected part of ``links``.

    A large star hangs every greater neighbour of a label on the label's least neighbour, a small
    star does so with the lesser ones. Both keep the parts, and a logarithmic number of rounds
    leaves stars. Minima are combined before the shuffle and joined back, so no neighbourhood is
    gathered.
    """
    labels = ends_of(links)
    pairs = cut_lineage(links.where("src <> dst").select(
        F.greatest("src", "dst").alias("far"), F.least("src", "dst").alias("near")).distinct())
    before = None
    while True:
        both = pairs.union(pairs.select("near", "far")).toDF("far", "near")
        least = both.groupBy("far").agg(F.least(F.min("near"), F.col("far")).alias("least"))
        large = both.where("near > far").join(least, "far").select(
            F.col("near").alias("far"), F.col("least").alias("near")).distinct()
        least = large.groupBy("far").agg(F.min("near").alias("least"))
        small = large.join(least, "far")
        pairs = cut_lineage(
            small.select("far", F.col("least").alias("near")).union(
                small.where("near <> least").select(F.col("near").alias("far"),
                                                    F.col("least").alias("near"))).distinct())
        state = tuple(pairs.agg(F.count("*"), F.sum(
            F.xxhash64("far", "near").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return labels.join(pairs.withColumnRenamed("far", "label"), "label", "left").select(
        "label", F.coalesce("near", "label").alias("system"))


def single_sources(links: DataFrame) -> DataFrame:
    """(label, up): labels with exactly one source other than themselves, and that source."""
    return links.where("src <> dst").groupBy(F.col("dst").alias("label")).agg(
        F.min("src").alias("up"), F.max("src").alias("other")).where("up = other").drop("other")


def passed(links: DataFrame, vector: DataFrame | None = None, keys=(), how: str = "max"):
    """Pointer doubling over the labels with a single source.

    Returns (label, up, cyclic) of these labels, ``up`` being the nearest ancestor with another
    number of sources, ``cyclic`` true where there is none since the label hangs on a loop of such
    labels; and ``vector`` with the extreme value of the passed ancestors taken in.
    """
    keys = list(keys)
    up = cut_lineage(single_sources(links))
    left = up.count()
    if left < DOUBLED_FROM:
        return None, vector
    alone = up.select(F.col("label").alias("up")).withColumn("more", F.lit(True))
    pick = F.greatest if how == "max" else F.least
    while left > 0:
        if vector is not None:
            above = vector.select(*keys, F.col("label").alias("up"), F.col("value").alias("above"))
            vector = cut_lineage(vector.join(up, "label", "left").join(
                above, [*keys, "up"], "left").select(
                *keys, "label", pick("value", "above").alias("value")))
        onward = up.select(F.col("label").alias("up"), F.col("up").alias("next"))
        up = cut_lineage(up.join(onward, "up", "left").select(
            "label", F.coalesce("next", "up").alias("up")))
        left //= 2
    return up.join(alone, "up", "left").select(
        "label", "up", F.coalesce("more", F.lit(False)).alias("cyclic")), vector


def chained(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links with a row of its own for each of ``labels``, marked ``own``."""
    own = labels.select(F.col("label").alias("src"), F.col("label").alias("dst"))
    return links.select("src", "dst").distinct().withColumn("own", F.lit(False)).unionByName(
        own.withColumn("own", F.lit(True))).repartition("src").persist()


def spread(links: DataFrame, vector: DataFrame, keys=(), *, how: str = "max",
           hops: int = 3) -> DataFrame:
    """Smallest or largest value reachable upstream, including a label's own value.

    ``links(src, dst)``; ``vector(keys..., label, value)`` has a row for every label. Labels with a
    single source are passed over; the walk over the others stops when a round changes nothing.
    """
    keys = list(keys)
    if how not in ("max", "min"):
        raise ValueError(f"how must be 'max' or 'min', got {how!r}")
    pick, fold = (F.greatest, F.max) if how == "max" else (F.least, F.min)
    links = links.select("src", "dst").where("src <> dst").distinct()
    up, state = passed(links, cut_lineage(vector.select(*keys, "label", "value")), keys, how)
    if up is not None:
        up = cut_lineage(up)
        inner = up.select("label")
        kept = links.join(inner.withColumnRenamed("label", "dst"), "dst", "left_anti")
        kept = cut_lineage(kept.join(up.withColumnRenamed("label", "src"), "src", "left"))
        # what passed labels bring along is taken in at once; the way to them starts further up
        brought = kept.where("up IS NOT NULL").select(F.col("src").alias("label"), "dst").join(
            state, "label").groupBy(*keys, F.col("dst").alias("label")).agg(fold("value").alias("v"))
        whole = state
        state = cut_lineage(state.join(inner, "label", "left_anti").join(
            brought, [*keys, "label"], "left").select(*keys, "label", pick("value", "v").alias("value")))
        links = kept.where("NOT coalesce(cyclic, false)").select(
            F.coalesce("up", "src").alias("src"), "dst").where("src <> dst")
    chain = chained(links, state.select("label").distinct())
    small = fits_broadcast(chain)
    try:
        while True:
            state = cut_lineage(rounds(
                chain, state, keys, [], hops,
                f"{how}(value) AS value, max(if(own, value, null)) AS before", small))
            if state.where(F.col("value") != F.col("before")).isEmpty():
                break
    finally:
        chain.unpersist()
    state = state.select(*keys, "label", "value")
    if up is None:
        return state
    top = state.select(*keys, F.col("label").alias("up"), F.col("value").alias("v"))
    return state.unionByName(whole.join(up, "label").join(top, [*keys, "up"], "left").select(
        *keys, "label", pick("value", "v").alias("value")))


def fed_by_loops(links: DataFrame, hops: int = 4) -> DataFrame:
    """(label): labels that walks of any length lead to, which are those downstream of a loop."""
    links = links.select("src", "dst").where("src <> dst").distinct()
    up, _ = passed(links)
    labels, always = ends_of(links), None
    if up is not None:
        up = cut_lineage(up)
        kept = links.join(up.select(F.col("label").alias("dst")), "dst", "left_anti")
        kept = cut_lineage(kept.join(up.withColumnRenamed("label", "src"), "src", "left"))
        always = kept.where("cyclic").select(F.col("dst").alias("label"), F.lit(1).alias("sure")).distinct()
        labels = labels.join(up, "label", "left_anti")
        links = kept.where("NOT coalesce(cyclic, false)").select(F.coalesce("up", "src").alias("src"), "dst")
    state = labels.select("label", F.lit(1).alias("value"))
    if always is not None:
        state = state.join(always, "label", "left").select(
            "label", "value", F.coalesce("sure", F.lit(0)).alias("sure"))
    else:
        state = state.withColumn("sure", F.lit(0))
    state = cut_lineage(state)
    chain, left = chained(links, labels), state.count()
    small = fits_broadcast(chain)
    try:
        while left:
            state = cut_lineage(rounds(
                chain, state, [], [], hops,
                "greatest(max(if(own, sure, value)), 0) AS value, max(if(own, sure, null)) AS sure",
                small))
            still = state.where("value = 1").count()
            if still == left:
                break
            left = still
    finally:
        chain.unpersist()
    fed = state.where("value = 1").select("label")
    if up is None:
        return fed
    below = up.join(fed.select(F.col("label").alias("up")).withColumn("fed", F.lit(True)), "up", "left")
    return fed.unionByName(below.where("cyclic OR fed").select("label"))


def turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ends(links: DataFrame, labels: DataFrame, how: str = "left_semi") -> DataFrame:
    for end in ("src", "dst"):
        links = links.join(labels.select(F.col("label").alias(end)), end, how)
    return links


def strong_parts(links: DataFrame) -> DataFrame:
    """(label, system): the labels on loops, by the greatest label of their strongly connected part.

    Labels not fed by a loop or not feeding one are cut off first, which also ends most tables that
    have no loop. Then the greatest label upstream colours every label, the labels of a colour that
    lead back to it form a part, and what is left of each colour goes on by itself.
    """
    links = links.select("src", "dst").distinct()
    own = cut_lineage(links.where("src = dst").select(
        F.col("src").alias("label"), F.col("src").alias("system")))
    live, found = cut_lineage(links.where("src <> dst")), []
    while not live.isEmpty():
        live = both_ends(live, fed_by_loops(live))
        live = cut_lineage(both_ends(live, fed_by_loops(turned(live))))
        if live.isEmpty():
            break
        labels = ends_of(live)
        colour = cut_lineage(spread(live, labels.withColumn("value", F.col("label"))).select(
            "label", F.col("value").alias("system")))
        same = live.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "d"), "dst").where("c = d")
        same = cut_lineage(same.select("src", "dst"))
        back = spread(turned(same), colour.select(
            "label", (F.col("label") == F.col("system")).cast("int").alias("value")))
        part = cut_lineage(colour.join(back.where("value = 1").select("label"), "label"))
        found.append(part)
        live = cut_lineage(both_ends(same, part, "left_anti"))
    if not found:
        return own
    parts = found[0]
    for part in found[1:]:
        parts = parts.unionByName(part)
    return parts.unionByName(own.join(parts, "label", "left_anti"))
