"""Social accounting matrices as long tables (row receives from column)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.operators.quality import check
from rippleflow.plans.fixpoint import NotConverged
from rippleflow.plans.graphs import connected
from rippleflow.plans.joins import union_all
from rippleflow.session import cut_lineage

CAPITAL_SHARE = 0.4
SPLIT_GAP_LIMIT = 0.01
ADJUSTMENT_LIMIT = 0.05
AGGREGATE_TOLERANCE = 1e-6
GOVERNMENT, SAVINGS, HOUSEHOLD, REST = "GOV", "SAVINV", "HOH", "ROW"


def _cells(df: DataFrame, row, col, value="value") -> DataFrame:
    def as_col(x):
        return F.lit(x) if isinstance(x, str) else x
    return df.select(as_col(row).alias("row_acct"), as_col(col).alias("col_acct"),
                     F.col(value).alias("value"))


def _tidy(blocks: list[DataFrame]) -> DataFrame:
    """Blocks added up per cell, zero cells dropped. Written once: every later step reads it often."""
    return cut_lineage(union_all(blocks).groupBy("row_acct", "col_acct").agg(
        F.sum("value").alias("value")).where("value <> 0"))


def _share(capital_share: float) -> None:
    if not 0.0 < capital_share < 1.0:
        raise ValueError(f"capital_share must be in (0,1), got {capital_share}")


def _factor_blocks(va: DataFrame, activity, suffix, household, capital_share: float):
    """Factor payments by activities and factor income of the household."""
    cap = va.withColumn("value", F.col("va") * capital_share)
    lab = va.withColumn("value", F.col("va") * (1.0 - capital_share))
    out = []
    for name, part in (("CAP", cap), ("LAB", lab)):
        acct = F.concat(F.lit(name), suffix)
        out += [_cells(part, acct, activity), _cells(part, household, acct)]
    return out


# -- construction --------------------------------------------------------------------------------

def sector_accounts(flows: DataFrame, final_demand: DataFrame) -> DataFrame:
    """Per sector, regions summed: sales, purchases, final demand, output and value added."""
    rows = union_all([
        flows.select(F.col("i_sector").alias("sector"), F.col("z").alias("sales"),
                     F.lit(0.0).alias("purchases"), F.lit(0.0).alias("fd")),
        flows.select(F.col("j_sector").alias("sector"), F.lit(0.0).alias("sales"),
                     F.col("z").alias("purchases"), F.lit(0.0).alias("fd")),
        final_demand.select("sector", F.lit(0.0).alias("sales"), F.lit(0.0).alias("purchases"),
                            F.col("value").alias("fd")),
    ])
    return rows.groupBy("sector").agg(
        F.sum("sales").alias("sales"), F.sum("purchases").alias("purchases"),
        F.sum("fd").alias("fd"),
    ).withColumn("x", F.col("sales") + F.col("fd")).withColumn(
        "va_raw", F.col("x") - F.col("purchases")).withColumn(
        "va", F.greatest("va_raw", F.lit(0.0)))


def institution_totals(split: DataFrame, accounts: DataFrame) -> DataFrame:
    """Final demand per sector routed to the three institutions, small drift rescaled.

    The household takes what government and investment leave, so the three add up exactly.
    ``gap`` is the relative mismatch of the split before rescaling.
    """
    s = split.groupBy("sector").agg(
        F.sum(F.when(F.col("institution") == "government", F.col("value")).otherwise(0.0))
        .alias("gov"),
        F.sum(F.when(F.col("institution") == "investment", F.col("value")).otherwise(0.0))
        .alias("inv"),
        F.sum("value").alias("total"))
    scale = accounts.agg((F.greatest(F.avg(F.abs("fd")), F.lit(1.0)) * 1e-6).alias("floor"))
    factor = F.when(F.col("total") > 0, F.col("fd") / F.col("total")).otherwise(0.0)
    return (
        accounts.select("sector", "fd").join(s, "sector", "left").fillna(0.0).join(scale)
        .select("sector", "fd",
                (F.col("gov") * factor).alias("gov"), (F.col("inv") * factor).alias("inv"),
                (F.abs(F.col("total") - F.col("fd")) / F.greatest(F.abs("fd"), F.col("floor")))
                .alias("gap"))
        .withColumn("household", F.col("fd") - F.col("gov") - F.col("inv"))
    )


def split_violations(totals: DataFrame) -> DataFrame:
    """Sectors whose institution split misses their final demand by more than 1 %."""
    return totals.where(F.col("gap") > SPLIT_GAP_LIMIT).select(
        F.lit("institution_split").alias("rule"), F.col("sector").alias("item"))


def closed_sam(flows: DataFrame, final_demand: DataFrame, split: DataFrame | None = None,
               capital_share: float = CAPITAL_SHARE) -> DataFrame:
    """Single-region closed SAM: regions summed, value added split, demand to the institutions."""
    _share(capital_share)
    acc = cut_lineage(sector_accounts(flows, final_demand))
    blocks = [
        _cells(flows, F.col("i_sector"), F.col("j_sector"), "z"),
        *_factor_blocks(acc, F.col("sector"), F.lit(""), HOUSEHOLD, capital_share),
    ]
    if split is None:
        return _tidy([*blocks, _cells(acc, F.col("sector"), HOUSEHOLD, "fd")])
    totals = cut_lineage(institution_totals(split, acc))
    _require_empty(split_violations(totals))
    blocks += [
        _cells(totals, F.col("sector"), HOUSEHOLD, "household"),
        _cells(totals, F.col("sector"), GOVERNMENT, "gov"),
        _cells(totals, F.col("sector"), SAVINGS, "inv"),
        _cells(totals, GOVERNMENT, HOUSEHOLD, "gov"),   # imputed direct tax
        _cells(totals, SAVINGS, HOUSEHOLD, "inv"),      # imputed savings
    ]
    return _tidy(blocks)


def open_accounts(flows: DataFrame, final_demand: DataFrame, home: str,
                  measured: bool = True) -> DataFrame:
    """Per sector of the home economy: output, uses, imports, domestic sales, exports, value added.

    Measured imports read final demand by consuming region. Otherwise the final demand for home
    products stands for home consumption and the import ratio of intermediates is applied to it.
    """
    here_i, here_j = F.col("i_region") == home, F.col("j_region") == home

    def part(df, sector, **cols):
        names = ("x", "use", "import_use", "purchases", "fd", "import_fd")
        return df.select(F.col(sector).alias("sector"), *[
            cols.get(n, F.lit(0.0)).alias(n) for n in names])

    z, v = F.col("z"), F.col("value")
    rows = [
        part(flows.where(here_i), "i_sector", x=z),
        part(flows.where(here_j), "i_sector", use=z,
             import_use=F.when(here_i, 0.0).otherwise(z)),
        part(flows.where(here_j), "j_sector", purchases=z),
        part(final_demand.where(F.col("region") == home), "sector", x=v),
    ]
    if measured:
        rows.append(part(final_demand.where(F.col("d_region") == home), "sector", fd=v,
                         import_fd=F.when(F.col("region") == home, 0.0).otherwise(v)))
    else:
        rows.append(part(final_demand.where(F.col("region") == home), "sector", fd=v))
    acc = union_all(rows).groupBy("sector").agg(*[
        F.sum(c).alias(c) for c in ("x", "use", "import_use", "purchases", "fd", "import_fd")])
    home_use = F.col("use") + F.col("fd")
    ratio = F.when(F.col("use") > 0, F.col("import_use") / F.col("use")).otherwise(0.0)
    imports = F.col("import_use") + F.col("import_fd") if measured else ratio * home_use
    return (
        acc.withColumn("imports", imports).withColumn("domestic", home_use - F.col("imports"))
        .withColumn("exports_raw", F.col("x") - F.col("domestic"))
        .withColumn("exports", F.greatest("exports_raw", F.lit(0.0)))
        .withColumn("va_raw", F.col("x") - F.col("purchases"))
        .withColumn("va", F.greatest("va_raw", F.lit(0.0)))
    )


def open_violations(acc: DataFrame) -> DataFrame:
    """Home sectors without output or domestic sales, or using more than they make."""
    top = acc.agg(F.max("x").alias("top"))
    item = F.col("sector").alias("item")
    return union_all([
        acc.where("x <= 0").select(F.lit("no_output").alias("rule"), item),
        acc.where("domestic <= 0").select(F.lit("no_domestic_sales").alias("rule"), item),
        acc.join(top).where(F.col("exports_raw") < -1e-6 * F.col("top")).select(
            F.lit("negative_exports").alias("rule"), item),
    ])


def open_sam(flows: DataFrame, final_demand: DataFrame, home: str, measured: bool = True,
             capital_share: float = CAPITAL_SHARE) -> DataFrame:
    """Home economy plus rest of world, with activities ``a_`` and commodities ``c_``.

    The trade gap is a transfer in its own direction: a deficit flows in, a surplus flows out.
    """
    _share(capital_share)
    acc = cut_lineage(open_accounts(flows, final_demand, home, measured))
    _require_empty(open_violations(acc))
    act, com = F.concat(F.lit("a_"), F.col("sector")), F.concat(F.lit("c_"), F.col("sector"))
    gap = acc.agg((F.sum("imports") - F.sum("exports")).alias("gap"))
    return _tidy([
        _cells(acc, act, com, "domestic"), _cells(acc, act, REST, "exports"),
        _cells(acc, REST, com, "imports"), _cells(acc, com, HOUSEHOLD, "fd"),
        _cells(flows.where(F.col("j_region") == home), F.concat(F.lit("c_"), F.col("i_sector")),
               F.concat(F.lit("a_"), F.col("j_sector")), "z"),
        *_factor_blocks(acc, act, F.lit(""), HOUSEHOLD, capital_share),
        _cells(gap.where("gap > 0"), HOUSEHOLD, REST, "gap"),
        _cells(gap.where("gap < 0").withColumn("gap", -F.col("gap")), REST, HOUSEHOLD, "gap"),
    ])


def trade_cube(flows: DataFrame, final_demand: DataFrame) -> DataFrame:
    """Sales of each origin's sector to each destination, domestic ones included."""
    return union_all([
        flows.select(F.col("i_region").alias("origin"), F.col("i_sector").alias("sector"),
                     F.col("j_region").alias("dest"), F.col("z").alias("value")),
        final_demand.select(F.col("region").alias("origin"), "sector",
                            F.col("d_region").alias("dest"), "value"),
    ]).groupBy("origin", "sector", "dest").agg(F.sum("value").alias("value"))


def region_accounts(flows: DataFrame, final_demand: DataFrame) -> DataFrame:
    """Per region and sector: output, intermediate purchases, value added."""
    rows = union_all([
        trade_cube(flows, final_demand).select(
            F.col("origin").alias("region"), "sector", F.col("value").alias("x"),
            F.lit(0.0).alias("purchases")),
        flows.select(F.col("j_region").alias("region"), F.col("j_sector").alias("sector"),
                     F.lit(0.0).alias("x"), F.col("z").alias("purchases")),
    ])
    return rows.groupBy("region", "sector").agg(
        F.sum("x").alias("x"), F.sum("purchases").alias("purchases"),
    ).withColumn("va_raw", F.col("x") - F.col("purchases")).withColumn(
        "va", F.greatest("va_raw", F.lit(0.0)))


def capital_transfers(trade: DataFrame) -> DataFrame:
    """(lender, borrower, value): surplus regions lend to deficit regions in proportion."""
    balance = trade.where("origin <> dest").select(
        F.explode(F.array(
            F.struct(F.col("origin").alias("region"), F.col("value").alias("ca")),
            F.struct(F.col("dest").alias("region"), (-F.col("value")).alias("ca")))).alias("b")
    ).select("b.*").groupBy("region").agg(F.sum("ca").alias("ca"))
    lend = balance.where("ca > 0")
    surplus = lend.agg(F.sum("ca").alias("surplus"))
    borrow = balance.where("ca < 0").select(F.col("region").alias("borrower"),
                                            (-F.col("ca")).alias("need"))
    # One transfer per lender and borrower is the result itself; both lists are region-sized.
    return lend.select(F.col("region").alias("lender"), "ca").join(borrow).join(surplus).select(
        "lender", "borrower", (F.col("need") * F.col("ca") / F.col("surplus")).alias("value"))


def multi_sam(flows: DataFrame, final_demand: DataFrame,
              capital_share: float = CAPITAL_SHARE) -> DataFrame:
    """Every region with its own activities, commodities, factors and household."""
    _share(capital_share)
    trade = cut_lineage(trade_cube(flows, final_demand))
    acc = cut_lineage(region_accounts(flows, final_demand))

    def account(prefix, region, sector):
        return F.concat(F.lit(prefix), F.col(region), F.lit("_"), F.col(sector))

    suffix = F.concat(F.lit("_"), F.col("region"))
    house = F.concat(F.lit("HOH_"), F.col("region"))
    return _tidy([
        _cells(trade, account("a_", "origin", "sector"), account("c_", "dest", "sector")),
        _cells(final_demand, account("c_", "d_region", "sector"),
               F.concat(F.lit("HOH_"), F.col("d_region"))),
        _cells(flows, account("c_", "j_region", "i_sector"), account("a_", "j_region", "j_sector"),
               "z"),
        *_factor_blocks(acc, account("a_", "region", "sector"), suffix, house, capital_share),
        _cells(capital_transfers(trade), F.concat(F.lit("HOH_"), F.col("borrower")),
               F.concat(F.lit("HOH_"), F.col("lender"))),
    ])


# -- balance -------------------------------------------------------------------------------------

def account_totals(sam: DataFrame) -> DataFrame:
    """(account, receipts, payments) from one pass over the cells."""
    ends = F.explode(F.array(
        F.struct(F.col("row_acct").alias("account"), F.col("value").alias("receipts"),
                 F.lit(0.0).alias("payments")),
        F.struct(F.col("col_acct").alias("account"), F.lit(0.0).alias("receipts"),
                 F.col("value").alias("payments"))))
    return sam.select(ends.alias("e")).select("e.*").groupBy("account").agg(
        F.sum("receipts").alias("receipts"), F.sum("payments").alias("payments"))


def imbalance(sam: DataFrame) -> DataFrame:
    """(account, gap): receipts minus payments."""
    return account_totals(sam).select(
        "account", (F.col("receipts") - F.col("payments")).alias("gap"))


def is_balanced(sam: DataFrame, tol: float = 1e-6) -> bool:
    worst = imbalance(sam).agg(F.max(F.abs("gap")).alias("w")).first()["w"]
    return worst is None or worst <= tol


def _require_empty(violations: DataFrame) -> None:
    from rippleflow.operators.checks import require_empty

    require_empty(violations)


def support_conflicts(sam: DataFrame, targets: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(rule, item): why no scaling of the positive cells can meet ``targets(account, target)``.

    Rows and columns that share positive cells fall into connected parts. Within a part the row
    targets must add up to the column targets, as both are the sum of its cells; and an account with
    a positive target needs a positive cell in its row and in its column.
    """
    cells = sam.where("value > 0").select(
        F.concat(F.lit("r"), "row_acct").alias("src"), F.concat(F.lit("c"), "col_acct").alias("dst"))
    parts = connected(cells)
    sides = targets.select("account", "target", F.explode(F.array(F.lit("r"), F.lit("c"))).alias("side"))
    sides = cut_lineage(sides.withColumn("label", F.concat("side", "account")).join(parts, "label", "left"))
    empty = sides.where("system IS NULL AND target > 0").select(
        F.when(F.col("side") == "r", "row_without_cells").otherwise("column_without_cells").alias("rule"),
        F.col("account").alias("item"))
    sums = sides.where("system IS NOT NULL").groupBy("system").agg(
        F.sum(F.when(F.col("side") == "r", F.col("target")).otherwise(0.0)).alias("rows"),
        F.sum(F.when(F.col("side") == "c", F.col("target")).otherwise(0.0)).alias("columns"))
    apart = sums.where(F.abs(F.col("rows") - F.col("columns"))
                       > tol * F.greatest("rows", "columns", F.lit(1e-300)))
    return union_all([empty, apart.select(F.lit("targets_disagree").alias("rule"),
                                          F.expr("substring(system, 2)").alias("item"))])


def mean_targets(sam: DataFrame) -> DataFrame:
    """(account, target): the mean of receipts and payments."""
    return account_totals(sam).select(
        "account", ((F.col("receipts") + F.col("payments")) / 2.0).alias("target"))


def ras(sam: DataFrame, targets: DataFrame, tol: float = 1e-9, max_rounds: int = 1000,
        rounds_per_step: int = 4) -> DataFrame:
    """Biproportional scaling of rows and columns to ``targets(account, target)``.

    Only the row and column factors move: the cells stay cached and partitioned, each half round
    is one join and one aggregation, and the cells are scaled once at the end. Accounts whose
    current total is not positive keep their factor, so zero cells stay zero.
    """
    if not targets.where("target < 0").isEmpty():
        raise ValueError("RAS targets must be non-negative")
    spark = sam.sparkSession
    # Only accounts with a target take part, like rows of the target's index.
    accts = targets.select("account", F.col("target").cast("double").alias("t"))
    cells = sam.groupBy("row_acct", "col_acct").agg(F.sum("value").alias("v"))
    own = accts.select(F.col("account").alias("row_acct"), F.col("account").alias("col_acct"),
                       F.lit(0.0).alias("v"), F.lit(True).alias("own"))
    chain = cut_lineage(cells.withColumn("own", F.lit(False)).unionByName(own))
    by_col, by_row = chain.repartition("col_acct").persist(), chain.repartition("row_acct").persist()
    state = cut_lineage(accts.select("account", "t", F.lit(1.0).alias("r"),
                                     F.lit(1.0).alias("s"), F.lit(0.0).alias("gap")))
    keep = ("max(if(own, s.t, null)) AS t, max(if(own, s.r, null)) AS r, "
            "max(if(own, s.s, null)) AS s")
    done, worst = 0, None
    try:
        while done < max_rounds:
            parts = ["b0 AS (SELECT * FROM {state})"]
            for k in range(1, rounds_per_step + 1):
                parts.append(
                    f"q{k} AS (SELECT c.row_acct AS account, "
                    f"sum(c.v * s.s) AS q, max(if(own, s.gap, null)) AS gap, {keep} "
                    f"FROM {{by_col}} c JOIN b{k - 1} s ON s.account = c.col_acct "
                    "GROUP BY c.row_acct)")
                parts.append(
                    f"a{k} AS (SELECT account, t, s, if(r * q > 0, t / q, r) AS r, "
                    f"abs(r * q - t) AS gap FROM q{k})")
                parts.append(
                    f"p{k} AS (SELECT c.col_acct AS account, "
                    f"sum(c.v * s.r) AS q, max(if(own, s.gap, null)) AS gap, {keep} "
                    f"FROM {{by_row}} c JOIN a{k} s ON s.account = c.row_acct "
                    "GROUP BY c.col_acct)")
                parts.append(
                    f"b{k} AS (SELECT account, t, r, if(s * q > 0, t / q, s) AS s, "
                    f"greatest(gap, if(s * q > 0, 0.0D, abs(s * q - t))) AS gap FROM p{k})")
            state = cut_lineage(spark.sql(
                "WITH " + ", ".join(parts) + f" SELECT * FROM b{rounds_per_step}",
                state=state, by_col=by_col, by_row=by_row))
            done += rounds_per_step
            # The gap was measured on the factors of the round before the last.
            worst = state.agg(F.max("gap").alias("g")).first()["g"]
            if worst is None or worst < tol:
                break
        else:
            raise NotConverged(f"RAS did not converge in {max_rounds} rounds ({worst:.2e})")
    finally:
        by_col.unpersist()
        by_row.unpersist()
    r = state.select(F.col("account").alias("row_acct"), "r")
    s = state.select(F.col("account").alias("col_acct"), "s")
    return cells.join(r, "row_acct").join(s, "col_acct").select(
    "row_acct", "col_acct", (F.col("v") * F.col("r") * F.col("s")).alias("value"))


def balance(sam: DataFrame, tol: float = 1e-6) -> tuple[DataFrame, DataFrame | None]:
    """The SAM balanced if it needs to be, and the adjustment per cell (None when untouched)."""
    if is_balanced(sam, tol):
        return sam, None
    _require_empty(support_conflicts(sam, mean_targets(sam)))
    balanced = ras(sam, mean_targets(sam), tol=min(tol, 1e-9))
    moved = union_all([sam, balanced.withColumn("value", -F.col("value"))]).groupBy(
        "row_acct", "col_acct").agg(F.sum("value").alias("value"))
    return balanced, moved


# -- reports and topology ------------------------------------------------------------------------

@dataclass
class SamLayout:
    """Which accounts are activities, commodities, factors and final-demand payers."""

    activity: object
    commodity: object
    factor: object
    demand: object

    @classmethod
    def closed(cls, sectors: list[str]):
        is_sector = lambda c: F.col(c).isin(*sectors)
        return cls(is_sector, is_sector, lambda c: F.col(c).isin("CAP", "LAB"),
                   lambda c: F.col(c).isin(HOUSEHOLD, GOVERNMENT, SAVINGS))

    @classmethod
    def open(cls):
        return cls(lambda c: F.col(c).startswith("a_"), lambda c: F.col(c).startswith("c_"),
                   lambda c: F.col(c).isin("CAP", "LAB"),
                   lambda c: F.col(c).isin(HOUSEHOLD, GOVERNMENT, SAVINGS))

    @classmethod
    def multi(cls):
        return cls(lambda c: F.col(c).startswith("a_"), lambda c: F.col(c).startswith("c_"),
                   lambda c: F.col(c).startswith("CAP_") | F.col(c).startswith("LAB_"),
                   lambda c: F.col(c).startswith("HOH_") | F.col(c).startswith("GOV_")
                   | F.col(c).startswith("SAVINV_"))


def sam_aggregates(sam: DataFrame, layout: SamLayout) -> DataFrame:
    """Final demand, value added and gross output read off the cells."""
    v = F.col("value")

    def total(rule):
        return F.sum(F.when(rule, v).otherwise(0.0))

    return sam.agg(
        total(layout.commodity("row_acct") & layout.demand("col_acct")).alias("final_demand"),
        total(layout.factor("row_acct") & layout.activity("col_acct")).alias("value_added"),
        total(layout.activity("row_acct")).alias("gross_output"))


def sam_quality(sam: DataFrame, layout: SamLayout, source: DataFrame,
                adjustment: DataFrame | None = None, attribution: str | None = None,
                capital_share: float = CAPITAL_SHARE) -> DataFrame:
    """Quality rows of a SAM.

    ``source`` is one row (final_demand, value_added, gross_output, clipped) of the build the SAM
    came from.
    """
    rows = []
    worst = imbalance(sam).agg(F.coalesce(F.max(F.abs("gap")), F.lit(0.0)).alias("value"))
    rows.append(check(worst, "sam_balanced", F.col("value") < 1e-6, "fail", tolerance=1e-6))
    have = sam_aggregates(sam, layout)
    for name in ("final_demand", "value_added", "gross_output"):
        pair = have.select(F.col(name).alias("a")).join(source.select(F.col(name).alias("b")))
        rel = pair.select((F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("b"), F.lit(1.0)))
                          .alias("value"))
        rows.append(check(rel, f"preserves_{name}", F.col("value") < AGGREGATE_TOLERANCE, "fail",
                          tolerance=AGGREGATE_TOLERANCE))
    if adjustment is not None:
        totals = sam.groupBy(F.col("row_acct").alias("account")).agg(F.sum("value").alias("t"))
        moved = adjustment.groupBy(F.col("row_acct").alias("account")).agg(
            F.sum(F.abs("value")).alias("m")).join(totals.where("t <> 0"), "account")
        worst = moved.agg(F.coalesce(F.max(F.col("m") / F.col("t")), F.lit(0.0)).alias("value"))
        rows.append(check(worst, "balancing_adjustment", F.col("value") <= ADJUSTMENT_LIMIT,
                          "warn", tolerance=ADJUSTMENT_LIMIT))
    neg = sam.agg(F.count_if(F.col("value") < -1e-9).cast("double").alias("value"))
    rows.append(check(neg, "non_negative_cells", F.col("value") == 0, "fail"))
    clip = source.select((F.col("clipped") / F.greatest("value_added", F.lit(1.0))).alias("value"))
    rows.append(check(clip, "value_added_clip", F.col("value") <= 1e-6, "warn"))
    if attribution is not None:
        one = source.select(F.lit(None).cast("double").alias("value"))
        rows.append(check(one, "open_fd_attribution", F.lit(attribution == "measured"), "warn"))
    one = source.select(F.lit(capital_share).alias("value"))
    rows.append(check(one, "assumed_capital_share", F.lit(True), "warn"))
    return union_all(rows)


def closed_source(acc: DataFrame) -> DataFrame:
    """Source aggregates of a build, from ``sector_accounts`` or ``region_accounts`` plus demand."""
    return acc.agg(
        F.sum("fd").alias("final_demand"), F.sum("va_raw").alias("value_added"),
        F.sum("x").alias("gross_output"),
        F.sum(F.abs(F.least("va_raw", F.lit(0.0)))).alias("clipped"))


def components(routes: DataFrame, regions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(region, component): smallest region name reachable over trade links in either direction.

    ``routes`` is (origin, dest, value); a link counts when any of its routes reaches
    ``threshold`` (and is positive).
    """
    live = routes.where((F.col("value") >= threshold) & (F.col("value") > 0)
                        & (F.col("origin") != F.col("dest"))).select("origin", "dest").distinct()
    found = connected(live.toDF("src", "dst")).toDF("region", "component")
    return regions.select("region").distinct().join(found, "region", "left").select(
        "region", F.coalesce("component", "region").alias("component"))


def active_routes(shares: DataFrame) -> DataFrame:
    """Routes (origin, sector, dest) with a positive import or export share."""
    return shares.where("share > 0").select("origin", "sector", "dest").distinct()


# -- account names -------------------------------------------------------------------------------

def is_multi_region(accounts: DataFrame) -> DataFrame:
    """One row: whether the accounts describe several regions."""
    a = F.col("account")
    return accounts.agg(
        ((F.count_if(a.startswith("HOH_")) >= 2)
         & (F.count_if(a.startswith("a_") & (F.size(F.split(a, "_")) >= 3)) > 0)).alias("multi"))


def multi_axes(accounts: DataFrame) -> DataFrame:
    """(account, region, sector) of every activity, by its longest matching region prefix.

    Region and sector stay null where no region matches.
    """
    regions = accounts.where(F.col("account").startswith("HOH_")).select(
        F.expr("substring(account, 5)").alias("region"))
    act = accounts.where(F.col("account").startswith("a_")).select("account")
    # All underscore prefixes of the name are candidates, so the match is an equi-join.
    parts = F.split(F.expr("substring(account, 3)"), "_")
    tried = act.select("account", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))).alias("region"))
    best = tried.join(regions.distinct(), "region").groupBy("account").agg(
        F.max_by("region", F.length("region")).alias("region"))
    return act.join(best, "account", "left").select(
        "account", "region",
        F.expr("substring(account, length(region) + 4)").alias("sector"))


def ambiguous_regions(accounts: DataFrame) -> DataFrame:
    """Region names that are a prefix of another region name."""
    regions = accounts.where(F.col("account").startswith("HOH_")).select(
        F.expr("substring(account, 5)").alias("region")).distinct()
    parts = F.split("region", "_")
    shorter = regions.where(F.size(parts) > 1).select(
        F.col("region").alias("longer"), F.explode(F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))).alias("region"))
    return shorter.join(regions, "region").select("region", "longer")


def closed_sectors(sam: DataFrame, accounts: DataFrame, factors=("CAP", "LAB")) -> DataFrame:
    """Accounts that are neither factors nor institutions (those receive factor income)."""
    paid = sam.where(F.col("col_acct").isin(*factors) & (F.col("value") != 0)).select(
        F.col("row_acct").alias("account")).distinct()
    return accounts.where(~F.col("account").isin(*factors, GOVERNMENT, SAVINGS)).join(
        paid, "account", "left_anti").select(F.col("account").alias("sector"))
