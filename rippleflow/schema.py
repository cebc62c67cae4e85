"""Column layouts of the long tables."""

from pyspark.sql import types as T

S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**cols):
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


FLOWS = _struct(i_region=S, i_sector=S, j_region=S, j_sector=S, z=D)
COEFF = _struct(i_region=S, i_sector=S, j_region=S, j_sector=S, a=D)
FINAL_DEMAND = _struct(region=S, sector=S, d_region=S, value=D)
INSTITUTION_DEMAND = _struct(region=S, sector=S, d_region=S, institution=S, value=D)
OUTPUT = _struct(region=S, sector=S, x=D)
SATELLITE = _struct(stressor=S, region=S, sector=S, intensity=D, unit=S)
SAM = _struct(row_acct=S, col_acct=S, value=D)
CONCORDANCE = _struct(source=S, target=S, weight=D)
RATINGS = _struct(process=S, service=S, materiality=S)
ELASTICITY = _struct(key=S, low=D, central=D, high=D, source=S, confidence=S)
SHOCK = _struct(
    scenario_id=S, shock_id=S, type=S, level=D, gases=T.ArrayType(S), carrier=S, service=S,
    sectors=T.ArrayType(S), regions=T.ArrayType(S), path=T.MapType(I, D),
)
SCENARIO_YEAR = _struct(scenario_id=S, year=I)
RESULTS = _struct(
    scenario_id=S, variable=S, sector=S, region=S, year=I, scenario=S, value=D)
QUALITY = _struct(
    build_id=S, name=S, severity=S, message=S, value=D, tolerance=D,
    detail=T.MapType(S, D))
BUILD_META = _struct(
    build_id=S, generation=S, source=S, source_version=S, reference_year=I, licence=S,
    price_basis=S, currency=S, unit=S, final_demand_kind=S, aggregation=S, retrieved=S,
    n_labels=T.LongType(), quality_worst=S, written=T.TimestampType())
CHANNEL = _struct(
    channel_id=S, mechanism=S, services=T.ArrayType(S), baseline=D, sensitivity=D, threshold=D,
    exponent=D)
PATHWAY = _struct(
    channel_id=S, baseline=D, states=T.MapType(I, D), degradation_rate=D, start_year=I,
    recovery_rate=D)

RESULT_COLUMNS = [f.name for f in RESULTS.fields]
BANDS = ("low", "central", "high")
INSTITUTIONS = ("household", "government", "investment")
ECONOMY = "__economy__"
