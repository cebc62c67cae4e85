"""Labels, keyword classifications and code keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(value, bad, message):
    """``value``, or an error with ``message`` where ``bad`` holds; costs no pass of its own."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(message)).otherwise(value)


def label(region: str | Column = "region", sector: str | Column = "sector") -> Column:
    """The display label ``region:sector``."""
    return F.concat_ws(":", region, sector)


def label_region(col: str | Column) -> Column:
    return F.split(col, ":", 2)[0]


def label_sector(col: str | Column) -> Column:
    """Everything after the first colon, so a sector may itself contain colons."""
    return F.split(col, ":", 2)[1]


def split_label(df: DataFrame, col: str = "label") -> DataFrame:
    """Replace a label column by ``region`` and ``sector``."""
    return df.withColumn("region", label_region(col)).withColumn(
        "sector", label_sector(col)).drop(col)


def with_label(df: DataFrame, value: str) -> DataFrame:
    """Replace ``region, sector, <value>`` by ``label, value``; other columns stay."""
    rest = [c for c in df.columns if c not in ("region", "sector", value)]
    return df.select(*rest, label().alias("label"), F.col(value).alias("value"))


def first_match(text: Column, rules, default: str | None = None) -> Column:
    """First rule, in order, one of whose keywords occurs in ``text``."""
    out = None
    for target, keywords in rules:
        hit = F.lit(False)
        for word in keywords:
            hit = hit | text.contains(word)
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return out.otherwise(F.lit(default))


# Keywords that tell which institution a final-demand category belongs to.
DEMAND_EXCLUDED = ("export",)
DEMAND_KEYWORDS = [
    ("government", ("government",)),
    ("household", ("household", "npish", "non-profit")),
    ("investment", ("capital formation", "inventor", "valuable")),
]


def demand_institution(category: str | Column) -> Column:
    """Institution of a demand category; ``export`` for trade, null when unknown."""
    text = F.lower(F.col(category) if isinstance(category, str) else category)
    return first_match(text, [("export", DEMAND_EXCLUDED), *DEMAND_KEYWORDS])


# Ordered keywords of the coarse sectors (the first match wins, else "other").
COARSE_SECTOR_KEYWORDS = [
    ("agriculture", ("oil seed", "seed")),
    ("water_waste", ("manure", "waste", "sewage", "sanitation", "biogasification")),
    ("electricity", ("nuclear", "electricity", "power generation")),
    ("trade", ("retail", "wholesale", "trade")),
    ("energy_coal", ("coal", "lignite", "peat", "anthracite", "coke", "coking", "patent fuel")),
    ("energy_oil_gas", (
        "petroleum", "crude", "natural gas", "gas ", "gasoline", "diesel", "kerosene", "naphtha",
        "refinery", "biogas", "biofuel", "ethanol", "motor spirit", "lubricant", "bitumen",
        "fuel oil", "hydrocarbon", "ethane", "white spirit", "paraffin", "blast furnace gas")),
    ("electricity", ("power", "steam", "hydroelectric", "hydro power", "wind", "solar")),
    ("agriculture", (
        "cattle", "crop", "wheat", "cereal", "vegetable", "fruit", "animal", "farming",
        "agricultur", "forestry", "fishing", "paddy", "sugar", "oil seeds", "plant", "meat",
        "dairy", "food", "beverage", "tobacco", "pig", "poultry", "milk", "rice", "grain",
        "livestock", "fish", "grape")),
    ("mining", ("mining", "ore", "quarry", "extraction", "metal ores")),
    ("chemicals", ("chemical", "plastic", "rubber", "pharmaceutic", "fertiliser")),
    ("metals", ("iron", "steel", "aluminium", "copper", "metal", "foundry")),
    ("minerals", ("cement", "glass", "ceramic", "concrete", "mineral", "stone", "sand and clay")),
    ("manufacturing", (
        "machinery", "equipment", "vehicle", "motor", "transport equipment", "electronic",
        "textile", "wood", "paper", "furniture", "manufactur")),
    ("construction", ("construction", "building")),
    ("transport", (
        "transport", "shipping", "aviation", "logistics", "railway", "pipeline")),
    ("water_waste", ("water", "waste", "sewage", "recycling", "sanitation")),
    ("trade", ("trade", "retail", "wholesale", "sale ")),
    ("services", (
        "service", "financ", "insurance", "real estate", "education", "health", "hotel",
        "communication", "research", "public admin", "recreation")),
]

# Regions kept as they are and the block every other code folds into.
KEY_REGIONS = ["US", "CN", "DE", "GB", "JP", "IN", "FR", "BR", "RU", "IT"]
REGION_BLOCKS = {
    "RoW_Asia": ["WA", "KR", "TW", "ID", "AU"],
    "RoW_America": ["WL", "CA", "MX"],
    "RoW_Europe": [
        "WE", "AT", "BE", "BG", "CY", "CZ", "DK", "EE", "ES", "FI", "GR", "HR", "HU", "IE",
        "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "CH", "TR"],
    "RoW_Africa": ["WF", "ZA"],
    "RoW_MiddleEast": ["WM"],
}


def coarse_sector(name: str | Column) -> Column:
    text = F.lower(F.col(name) if isinstance(name, str) else name)
    return first_match(text, COARSE_SECTOR_KEYWORDS, "other")


def coarse_region(code: str | Column) -> Column:
    col = F.col(code) if isinstance(code, str) else code
    out = F.when(col.isin(KEY_REGIONS), col)
    for block, codes in REGION_BLOCKS.items():
        out = out.when(col.isin(codes), F.lit(block))
    return out.otherwise(F.lit("RoW_Other"))


def is_rest_of_world(region: str | Column) -> Column:
    """Codes starting with W in any case, or the aggregated blocks starting with RoW."""
    col = F.col(region) if isinstance(region, str) else region
    return F.upper(col).startswith("W") | col.startswith("RoW")


def base_code(code: str | Column) -> Column:
    """A classification code without its one-letter marker."""
    return F.expr(f"substring(trim({code}), 2)") if isinstance(code, str) else F.substring(
        F.trim(code), 2, 1_000_000)


def numeric_key(code: str | Column) -> Column:
    """Leading dotted digits of the code, with trailing zeros of multi-digit segments removed."""
    bare = base_code(code)
    digits = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)", 1)
    run = F.when(digits == "", bare).otherwise(digits)
    return F.concat_ws(".", F.transform(
        F.split(run, r"\."),
        lambda s: F.when(F.length(s) > 1, F.regexp_replace(s, "0+$", "")).otherwise(s)))


def prefixes(code: Column, separator: str) -> Column:
    """All prefixes of a separated code with their number of parts, longest first."""
    parts = F.split(code, "\\" + separator if separator == "." else separator)
    return F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
        lambda n: F.struct(
            F.array_join(F.slice(parts, F.lit(1), n), separator).alias("prefix"),
            n.alias("depth")))
