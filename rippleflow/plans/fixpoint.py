"""Fixed points over link tables.

A link table has columns ``src, dst, w``: a value at ``src`` contributes ``w`` times itself to
``dst``. All operators that walk the supply chain (output, prices, exposure) are sums over powers
of such a link table, and all keys of the right-hand sides (scenario, year, band, service) are
solved in the same pass.

Two strategies, chosen by a measured cost:

* ``Propagator`` squares the link table, so log2(rounds) jobs give the full sum of powers, which
  every later right-hand side reuses with a single join. Squaring fills the table in, so it is used
  at once only while the cube of the number of labels stays under a budget, and up to a larger one
  for tables whose terms are seen to fall so slowly that walking would take hundreds of rounds.
* ``iterate`` keeps the link table as it is and moves only the vector. This is the way for tables
  with many thousands of labels.

The budgets decide the plan alone. Both go on until what is missing from every value is below the
tolerance, however many rounds that takes, and both raise ``NotProductive`` for the same tables.

The vector trick of ``iterate``: the link table carries one extra row per label pointing at itself.
It hands the running total (and any per-label constants) to the next round inside the same join, so
one round is one join and one aggregation, and the plan stays a chain that can be unrolled a few
rounds between checkpoints. A link table that is measured to be small is broadcast: then a round
moves only the state, by all its keys, and thousands of scenarios spread over all tasks. A larger
one is joined by shuffle, where adaptive execution splits labels with many scenarios.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.plans.graphs import ends_of, strong_parts
from rippleflow.plans.joins import BROADCAST_ROWS, fits_broadcast
from rippleflow.plans.rounds import names, rounds
from rippleflow.session import cut_lineage

SQUARING_BUDGET = 1_000_000
#: Cube of the labels up to which a slowly converging table is squared after all.
SLOW_BUDGET = 1_000_000_000
#: Rounds still to come from which a table counts as slow.
PATIENCE = 256
#: What power steps add to the diagonal so that periodic tables settle.
SHIFT = 0.25
#: 2 ** 50 rounds: no table with a radius below 1 in double precision needs more.
MAX_LEVELS = 50
TOLERANCE = 1e-13
OVERFLOW = 1e300
#: Terms that still grow after so many rounds call for a bound of the spectral radius.
GROWTH_ROUNDS = 64


class NotProductive(ValueError):
    """The sum of powers of a link table does not converge."""


class NotConverged(RuntimeError):
    """An iteration used up its rounds."""


def _maybe_broadcast(df: DataFrame, rows: float | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


class Propagator:
    """Sum of all powers of a link table, ready to be applied to any number of vectors.

    ``keys`` are columns of the link table that separate independent systems (for example one
    system per ecosystem service). Vectors may carry more key columns than the links.
    """

    def __init__(self, links: DataFrame, keys=(), tol: float = TOLERANCE,
                 squaring_budget: float = SQUARING_BUDGET):
        self.keys = list(keys)
        self.tol = tol
        self.squaring_budget = squaring_budget
        self.links = cut_lineage(
            links.groupBy(*self.keys, "src", "dst").agg(F.sum("w").alias("w"))
        )
        self.cells = self.links.count()
        self._stats = None
        self._total = None

    @property
    def stats(self) -> dict:
        """Labels, cost of squaring and the norms of the link table, measured once."""
        if self._stats is None:
            ends = self.links.select(*self.keys, F.explode(F.array(
                F.struct(F.col("src").alias("label"), F.abs("w").alias("out"),
                         F.lit(0.0).alias("into")),
                F.struct(F.col("dst").alias("label"), F.lit(0.0).alias("out"),
                         F.abs("w").alias("into")),
            )).alias("e")).select(*self.keys, "e.*")
            per_label = ends.groupBy(*self.keys, "label").agg(
                F.sum("out").alias("out"), F.sum("into").alias("into"))
            per_system = per_label.groupBy(*self.keys).agg(
                F.count("*").cast("double").alias("n"), F.max("out").alias("out"),
                F.max("into").alias("into"))
            row = per_system.agg(
                F.sum(F.pow("n", 3)).alias("cubes"), F.sum(F.pow("n", 2)).alias("squares"),
                F.max(F.least("out", "into")).alias("norm")).first()
            self._stats = {k: (row[k] or 0.0) for k in ("cubes", "squares", "norm")}
        return self._stats

    @property
    def is_small(self) -> bool:
        """Whether squaring is affordable: sum over systems of (labels cubed) within budget."""
        return self.stats["cubes"] <= self.squaring_budget

    def nodes(self) -> DataFrame:
        return self.links.select(
            *self.keys, F.explode(F.array("src", "dst")).alias("label")).distinct()

    def _levels_needed(self) -> int | None:
        """Squarings that provably reach the tolerance, or None when the norm does not tell."""
        norm = self.stats["norm"]
        if norm <= 0.0:
            return 0
        if norm > 0.9:
            return None
        return max(0, math.ceil(math.log2(math.log(self.tol) / math.log(norm))))

    def _square(self) -> DataFrame:
        """The sum of powers by repeated squaring; both halves of a step share one join."""
        if self._total is not None:
            return self._total
        keys, cells = self.keys, self.stats["squares"]
        levels = self._levels_needed()
        eye = self.nodes().select(
            *keys, F.lit("sum").alias("part"), F.col("label").alias("src"),
            F.col("label").alias("dst"), F.lit(1.0).alias("w"))
        power = self.links.select(*keys, F.lit("power").alias("part"), "src", "dst", "w")
        state = cut_lineage(eye.unionByName(power))
        level = 0
        while levels is None or level < levels:
            if levels is None:
                size = self._norm(state)
                if size < self.tol:
                    break
                if not size < OVERFLOW or level >= MAX_LEVELS:
                    plain = marked_links(self.links, keys) if keys else self.links
                    if radius_below_one(plain):
                        raise OverflowError(f"powers of the link table beyond {OVERFLOW:g}")
                    raise NotProductive(
                        f"powers of the link table do not vanish (norm {size:.3e} after "
                        f"{2 ** level} rounds): spectral radius >= 1")
            hint = "/*+ BROADCAST(p) */ " if cells <= BROADCAST_ROWS else ""
            on = "".join(f" AND l.`{k}` = p.`{k}`" for k in keys)
            state = cut_lineage(self.links.sparkSession.sql(
                f"SELECT {names(keys)}part, src, dst, sum(w) AS w FROM ("
                f"SELECT {names(keys)}part, src, dst, w FROM {{s}} WHERE part = 'sum' "
                f"UNION ALL SELECT {hint}{names(keys, 'l.')}l.part, l.src, p.dst, l.w * p.w "
                f"FROM {{s}} l JOIN {{s}} p ON l.dst = p.src{on} AND p.part = 'power'"
                f") GROUP BY {names(keys)}part, src, dst", s=state))
            level += 1
        self._total = cut_lineage(
            state.where("part = 'sum'").select(*keys, "src", "dst", "w"))
        return self._total

    def _norm(self, state: DataFrame) -> float:
        """Largest absolute inflow of a label: the row-sum norm of the current power."""
        return (
            state.where("part = 'power'").groupBy(*self.keys, "dst")
            .agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s").alias("m")).first()["m"]
        ) or 0.0

    def apply(self, vector: DataFrame, keys=()) -> DataFrame:
        """Sum over t of links^t applied to ``vector(keys..., label, value)``.

        Labels without links keep their own value.
        """
        keys = list(keys)
        if not self.is_small and self._total is None:
            slow = self.stats["cubes"] <= SLOW_BUDGET and self.squaring_budget > 0
            walked = iterate(self.links, vector, keys, link_keys=self.keys,
                             patience=PATIENCE if slow else None)
            if walked is not None:
                return walked
        on = [*self.keys, "label"]
        total = self._square().withColumnRenamed("src", "label")
        reached = (
            vector.join(_maybe_broadcast(total, self.stats["squares"]), on)
            .groupBy(*keys, "dst").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
            .withColumnRenamed("dst", "label")
        )
        alone = vector.join(self.nodes(), on, "left_anti").select(*keys, "label", "value")
        return reached.unionByName(alone)

    def step(self, vector: DataFrame, keys=()) -> DataFrame:
        """One application of the link table (labels without inflow are absent)."""
        return step(self.links, vector, keys, self.keys)


def step(links: DataFrame, vector: DataFrame, keys=(), link_keys=()) -> DataFrame:
    """One hop: the value each label receives from its sources."""
    return (
        links.join(vector.withColumnRenamed("label", "src"), [*link_keys, "src"])
        .groupBy(*keys, "dst").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
        .withColumnRenamed("dst", "label")
    )


def iterate(
    links: DataFrame,
    vector: DataFrame,
    keys=(),
    *,
    link_keys=(),
    damp: str | None = None,
    tol: float = 1e-12,
    hops: int = 8,
    patience: int | None = None,
) -> DataFrame | None:
    """Sum of powers applied to ``vector`` by moving the vector only; None if ``patience`` is given
    and the measured ratio says that more rounds than that are to come.

    ``damp`` names a column of ``vector`` that scales what a label receives in every round (0 pins
    the label to its own value). Every ``hops`` rounds the state is written to the checkpoint
    directory, so a lost executor costs at most that many rounds.

    It ends when for every key, and every label of it, the rest of the sum is below ``tol`` times
    the label's own sum of absolute terms. The rest is bounded by the last term times q / (1 - q),
    where q is the key's ratio of successive terms, measured over the last ``hops`` rounds. A key
    whose terms are large neither ends nor prolongs another one.
    """
    keys, link_keys = list(keys), list(link_keys)
    if taken := {"label", "term", "total", "scale", "mass", "past"} & set(keys):
        raise ValueError(f"key columns need other names than {sorted(taken)}")
    seed = cut_lineage(vector.select(
        *keys, "label", F.col("value").alias("term"), F.col("value").alias("total"),
        (F.col(damp) if damp else F.lit(1.0)).alias("scale"),
    ))
    # Every label of the links needs a state row for every key of the vector.
    nodes = links.select(*link_keys, F.explode(F.array("src", "dst")).alias("label")).distinct()
    frame = nodes
    if keys:
        wanted = seed.select(*keys).distinct()
        if not link_keys:
            frame = nodes.crossJoin(wanted)
        elif set(keys) - set(link_keys):
            frame = nodes.join(wanted, link_keys)
        else:
            frame = nodes.join(wanted, link_keys, "left_semi")
    blank = frame.select(*keys, "label", *[
        F.lit(None).cast("double").alias(c) for c in ("term", "total", "scale")])
    state = cut_lineage(seed.unionByName(blank).groupBy(*keys, "label").agg(
        F.coalesce(F.sum("term"), F.lit(0.0)).alias("term"),
        F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"),
        F.coalesce(F.max("scale"), F.lit(1.0)).alias("scale"))
        .withColumn("mass", F.abs("total")))
    loops = state.select(
        *link_keys, F.col("label").alias("src"), F.col("label").alias("dst"),
        F.lit(0.0).alias("w"), F.lit(True).alias("own")).distinct()
    chain = (
        links.select(*link_keys, "src", "dst", "w", F.lit(False).alias("own"))
        .unionByName(loops).repartition("src").persist()
    )
    small = fits_broadcast(chain)
    before = F.pow(F.when(F.col("past") > 0, F.col("now") / F.col("past")).otherwise(0.0),
                   1.0 / hops)
    rest = F.when(F.col("share") <= 0, 0.0).when(
        F.col("ratio") < 1, F.col("share") * F.col("ratio") / (1 - F.col("ratio"))
    ).otherwise(float("inf"))
    done, growing, proven = 0, 0, False
    try:
        while True:
            state = cut_lineage(rounds(
                chain, state.withColumn("past", F.abs("term")), keys, link_keys, hops,
                "max(if(own, scale, null)) * sum(w * term) AS term, "
                "max(if(own, total, null)) + max(if(own, scale, null)) * sum(w * term) AS total, "
                "max(if(own, scale, null)) AS scale, "
                "max(if(own, mass, null)) + abs(max(if(own, scale, null)) * sum(w * term)) AS mass, "
                "max(if(own, past, null)) AS past", small))
            done += hops
            got = (state.groupBy(*keys).agg(
                F.sum(F.abs("term")).alias("now"), F.sum("past").alias("past"),
                F.max(F.when(F.col("mass") > 0, F.abs("term") / F.col("mass"))
                      .otherwise(0.0)).alias("share"))
                .withColumn("ratio", before).select("ratio", "now", rest.alias("rest"))
                .agg(F.max("rest").alias("rest"), F.max("ratio").alias("ratio"),
                     F.max("now").alias("now"))).first()
            if got["rest"] is None or got["rest"] <= tol:
                return state.select(*keys, "label", F.col("total").alias("value"))
            if patience is not None and done >= GROWTH_ROUNDS // 2 and (
                    got["ratio"] >= 1.0 or math.log(tol / got["rest"]) < patience * math.log(
                        max(got["ratio"], 1e-300))):
                return None
            growing = growing + 1 if got["ratio"] >= 1.0 else 0
            if growing and not proven and (done >= GROWTH_ROUNDS or not got["now"] < OVERFLOW):
                # growth may pass; only a bound of the table tells
                if not productive(links, state, keys, link_keys, damp is not None):
                    raise NotProductive(
                        f"spectral radius >= 1 (terms grow by {got['ratio']:.6f} after {done} rounds)")
                proven = True
            if not got["now"] < OVERFLOW:
                raise OverflowError(f"terms beyond {OVERFLOW:g} after {done} rounds")
    finally:
        chain.unpersist()


def productive(links: DataFrame, state: DataFrame, keys, link_keys, damped: bool) -> bool:
    """Whether the system of every key vanishes, by bounds of the table as its ``scale`` leaves it.

    The table itself is tried first, as a scale of at most 1 takes away. Otherwise each key has a
    table of its own: what a label receives is scaled, and labels with scale 0 receive nothing.
    """
    plain = marked_links(links, link_keys) if link_keys else links.select("src", "dst", "w")
    worst = state.agg(F.max(F.abs("scale")).alias("s")).first()["s"]
    if worst is None or worst <= 1.0:
        if radius_below_one(plain):
            return True
    if not damped:
        return False
    scales = state.where("scale <> 0").select(*keys, F.col("label").alias("dst"), "scale")
    own = links.join(scales, [*link_keys, "dst"]).select(
        *keys, "src", "dst", (F.col("w") * F.col("scale")).alias("w"))
    return radius_below_one(marked_links(own, keys) if keys else own)


class Undecided(NotConverged):
    """The bounds of a spectral radius enclose 1 and do not close in."""


def spectral_bounds(links: DataFrame, tol: float = 1e-10, hops: int = 8, settle_rounds: int = 200,
                    decide: float | None = 1.0, squaring_budget: float = SLOW_BUDGET) -> DataFrame:
    """Bounds (system, lo, hi) of the spectral radius of |links|, by strongly connected parts.

    The radius of a table is the largest of those of its strongly connected parts; labels on no loop
    have radius 0 and no row. Within a part, Collatz-Wielandt quotients of power steps with the part
    plus a multiple of the identity, which makes periodic parts settle, close in on the radius from
    both sides, and hold at every step. Ends when all parts are within ``tol`` or, after
    ``settle_rounds``, each lies on one side of ``decide``. Parts that close in slowly are squared
    where the cube of their labels allows, which doubles the steps of a round; beyond that ``Undecided``
    is raised rather than an open bound returned.
    """
    table = links.groupBy("src", "dst").agg(F.sum(F.abs("w")).alias("w")).where("w > 0")
    systems = cut_lineage(strong_parts(table))
    inner = table.join(systems.toDF("src", "system"), "src").join(
        systems.toDF("dst", "other"), "dst").where("system = other")
    chain = (
        inner.select("src", "dst", "w").withColumn("own", F.lit(False))
        .unionByName(systems.select(F.col("label").alias("src"), F.col("label").alias("dst"),
                                    F.lit(SHIFT).alias("w"), F.lit(True).alias("own")))
        .repartition("src").persist()
    )
    small = fits_broadcast(chain)
    state = systems.select("system", "label", F.lit(1.0).alias("value"))
    done = 0
    try:
        while True:
            state = cut_lineage(rounds(
                chain, state, ["system"], [], hops,
                "sum(w * value) AS value, max(if(own, value, null)) AS before", small))
            done += hops
            bounds = _quotients(state)
            got = _closeness(bounds, decide)
            if got["gap"] is None or got["gap"] <= tol or done >= settle_rounds and not got["open"]:
                return bounds.select("system", "lo", "hi")
            if done >= settle_rounds // 4 and got["cubes"] <= squaring_budget:
                return _squared_bounds(chain, systems, tol, decide)
            if done >= 20 * settle_rounds:
                raise Undecided(f"a spectral radius lies between {got['lo']:.9f} and {got['hi']:.9f}")
            if got["top"] > 1e60 or got["low_top"] < 1e-60:
                state = state.join(bounds, "system").select(
                    "system", "label", (F.col("value") / F.col("top")).alias("value"))
    finally:
        chain.unpersist()


def _quotients(state: DataFrame) -> DataFrame:
    quotient = F.col("value") / F.col("before") - SHIFT
    return state.groupBy("system").agg(
        F.greatest(F.min(quotient), F.lit(0.0)).alias("lo"),
        F.greatest(F.max(quotient), F.lit(0.0)).alias("hi"), F.max("value").alias("top"),
        F.pow(F.count("*").cast("double"), 3).alias("cube"))


def _closeness(bounds: DataFrame, decide: float | None):
    """What is still open: the widest part, and the parts on both sides of ``decide``."""
    sides = F.lit(True) if decide is None else (F.col("lo") < decide) & (F.col("hi") >= decide)
    return bounds.agg(
        F.max(F.col("hi") - F.col("lo")).alias("gap"), F.count_if(sides).alias("open"),
        F.max("top").alias("top"), F.min("top").alias("low_top"), F.sum("cube").alias("cubes"),
        F.max(F.when(sides, F.col("lo"))).alias("lo"), F.max(F.when(sides, F.col("hi"))).alias("hi"),
    ).first()


def _squared_bounds(chain: DataFrame, systems: DataFrame, tol: float, decide: float | None) -> DataFrame:
    """Bounds from the row sums of repeated squares of ``chain``, scaled per part."""
    into = systems.select(F.col("label").alias("src"), "system")
    power = cut_lineage(chain.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(into, "src"))
    for _ in range(MAX_LEVELS):
        largest = power.groupBy("system").agg(F.max("w").alias("top"))
        left = power.join(largest, "system").select(
            "system", "src", F.col("dst").alias("mid"), (F.col("w") / F.col("top")).alias("a"))
        right = left.select("system", F.col("src").alias("mid"), F.col("mid").alias("dst"),
                            F.col("a").alias("b"))
        power = cut_lineage(left.join(right, ["system", "mid"]).groupBy("system", "src", "dst").agg(
            F.sum(F.col("a") * F.col("b")).alias("w")))
        vector = power.groupBy("system", F.col("dst").alias("label")).agg(F.sum("w").alias("value"))
        stepped = rounds(chain, vector, ["system"], [], 1,
                         "sum(w * value) AS value, max(if(own, value, null)) AS before", False)
        bounds = cut_lineage(_quotients(stepped))
        got = _closeness(bounds, decide)
        if got["gap"] <= tol or got["gap"] <= 1e-6 and not got["open"]:
            return bounds.select("system", "lo", "hi")
    raise Undecided(f"a spectral radius lies between {got['lo']:.9f} and {got['hi']:.9f}")


def spectral_radius(links: DataFrame, tol: float = 1e-10, hops: int = 8, steps: int = 4) -> DataFrame:
    """One row (lo, hi): bounds of the spectral radius of |links|.

    Quotients of power steps bound the radius of any table, and close in on it at once where most
    labels lie on loops together. Other tables are taken apart.
    """
    table = links.groupBy("src", "dst").agg(F.sum(F.abs("w")).alias("w")).where("w > 0")
    labels = ends_of(table)
    chain = table.withColumn("own", F.lit(False)).unionByName(labels.select(
        F.col("label").alias("src"), F.col("label").alias("dst"), F.lit(SHIFT).alias("w"),
        F.lit(True).alias("own"))).repartition("src").persist()
    state = labels.select("label", F.lit(1.0).alias("value"))
    try:
        small = fits_broadcast(chain)
        for _ in range(steps):
            state = cut_lineage(rounds(
                chain, state, [], [], hops,
                "sum(w * value) AS value, max(if(own, value, null)) AS before", small))
            bounds = _quotients(state.withColumn("system", F.lit("")))
            got = bounds.first()
            if got is None:
                break
            if got["hi"] - got["lo"] <= tol:
                return bounds.select("lo", "hi")
    finally:
        chain.unpersist()
    return spectral_bounds(table, tol).agg(
        F.coalesce(F.max("lo"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("hi"), F.lit(0.0)).alias("hi"))


def radius_below_one(links: DataFrame) -> bool:
    """Whether powers of the absolute table vanish; raises ``Undecided`` if no bound tells."""
    weights = F.sum(F.abs("w")).alias("s")
    for end in ("dst", "src"):
        norm = links.groupBy(end).agg(weights).agg(F.max("s").alias("s")).first()["s"]
        if norm is None or norm < 1.0:
            return True
    got = spectral_bounds(links, settle_rounds=16).agg(F.max("hi").alias("hi")).first()
    return got["hi"] is None or got["hi"] < 1.0


def marked_links(links: DataFrame, keys) -> DataFrame:
    """The separate systems of ``keys`` as parts of one table."""
    mark = F.to_json(F.struct(*keys))
    return links.select(*[F.concat_ws("\x1f", mark, F.col(c)).alias(c) for c in ("src", "dst")], "w")
