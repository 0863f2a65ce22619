"""Queries over signals, the grid, energy and loss operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.alarm_queries import bounds
from checks.registry import query, view
from gustledger.functions import timegrid as tg
from gustledger.functions.nulls import clip_zero, nan_to_null, or_zero, share
from gustledger.functions.numbers import round_numeric
from gustledger.operators import energy as E
from gustledger.operators import grid as G
from gustledger.operators import losses as L
from gustledger.sources import extracts, readers
from gustledger.sources import schemas as S

KEY_SQL = '"StationId", "TimeStamp"'


def rounded(df, digits=6):
    """Round for the comparison of both engines."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def sql_round(columns, digits=6):
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


# ------------------------------------------------------------------- filters

SANE = {
    "grd": '"wtc_ActPower_min" BETWEEN -1000 AND 2600 AND "wtc_ActPower_max" BETWEEN -1000 AND 2600 AND "wtc_ActPower_mean" BETWEEN -1000 AND 2600',
    "cnt": '"wtc_kWG1Tot_accum" BETWEEN -500 AND 500 AND "wtc_kWG1TotE_accum" BETWEEN 0 AND 500',
    "tur": '"wtc_AcWindSp_mean" BETWEEN 0 AND 50 AND "wtc_ActualWindDirection_mean" BETWEEN 0 AND 360',
    "din": '"wtc_PowerRed_timeon" BETWEEN 0 AND 600',
}
for _kind, _where in SANE.items():
    view(f"v_{_kind}_ok", f"SELECT * FROM v_{_kind} WHERE {_where}", f"v_{_kind}")


def sanity(name: str, kind: str):
    @query(name, f"SELECT * FROM v_{kind}_ok", [f"v_{kind}_ok"])
    def run(spark, d):
        return E.sanity_filter(V.v_signal(spark, d, kind), kind)

    return run


for _name, _kind in (("sanity_grid", "grd"), ("sanity_counter", "cnt"), ("sanity_turbine", "tur"), ("sanity_digital", "din")):
    sanity(_name, _kind)


@query(
    "signal_extract",
    f"""SELECT {KEY_SQL}, "wtc_ActPower_min", "wtc_ActPower_max", "wtc_ActPower_mean" FROM v_grd
  WHERE "TimeStamp" >= TIMESTAMP '2024-01-02' AND "TimeStamp" < TIMESTAMP '2024-01-04'""",
    ["v_grd"],
)
def signal_extract(spark, d):
    return extracts.signal_extract(V.v_signal(spark, d, "grd"), "grd", "2024-01-02 00:00:00", "2024-01-04 00:00:00")


# ---------------------------------------------------------------------- grid

@query("period_end", "SELECT period, period_start, period_end FROM v_bounds", ["v_bounds"])
def period_end(spark, d):
    return bounds(spark, d)


view(
    "v_grid",
    """SELECT b.period, s."StationId", unnest(generate_series(b.period_start, b.period_end, INTERVAL 10 MINUTE)) AS "TimeStamp"
  FROM v_bounds b, v_station s""",
    "v_bounds", "v_station",
)


def grid(spark, d):
    return G.make_grid(V.v_station(spark, d), bounds(spark, d))


@query(
    "expand_grid",
    'SELECT g.*, q."wtc_PowerRed_timeon" FROM v_grid g LEFT JOIN v_din q USING (period, "StationId", "TimeStamp")',
    ["v_grid", "v_din"],
)
def expand_grid(spark, d):
    return G.expand_grid(V.v_signal(spark, d, "din"), grid(spark, d))


_JOINED = """SELECT g.*, {columns} FROM v_grid g
  LEFT JOIN v_cnt_ok c USING (period, "StationId", "TimeStamp") LEFT JOIN v_grd_ok r USING (period, "StationId", "TimeStamp")
  LEFT JOIN v_tur_ok t USING (period, "StationId", "TimeStamp") LEFT JOIN v_din_ok n USING (period, "StationId", "TimeStamp")
  LEFT JOIN v_flg f USING (period, "StationId", "TimeStamp")"""
_JOIN_COLUMNS = ["wtc_kWG1TotE_accum", "wtc_ActPower_mean", "wtc_AcWindSp_mean", "wtc_PowerRed_timeon", "wtc_ScInOper_timeon"]


@query(
    "signal_join",
    _JOINED.format(columns=", ".join(f'"{c}"' for c in _JOIN_COLUMNS)),
    ["v_grid", "v_cnt_ok", "v_grd_ok", "v_tur_ok", "v_din_ok", "v_flg"],
)
def signal_join(spark, d):
    frames = [E.sanity_filter(V.v_signal(spark, d, k), k) for k in ("cnt", "grd", "tur", "din")]
    frames.append(V.v_signal(spark, d, "flg"))
    return G.join_signals(grid(spark, d), frames).select(*G.CELL, *_JOIN_COLUMNS)


_MET_NAMES = [f"{s}_{m}" for s in ("met_WindSpeedRot_mean", "met_WinddirectionRot_mean") for m in S.MASTS]
view(
    "v_met_pivot",
    'SELECT period, "TimeStamp", '
    + ", ".join(
        f'avg("{s}") FILTER (WHERE "StationId" = {m}) AS "{s}_{m}"'
        for s in ("met_WindSpeedRot_mean", "met_WinddirectionRot_mean")
        for m in S.MASTS
    )
    + ' FROM v_mast GROUP BY 1, 2',
    "v_mast",
)


@query("load_met_pivot", f'SELECT period, "TimeStamp", {sql_round(_MET_NAMES)} FROM v_met_pivot', ["v_met_pivot"])
def load_met_pivot(spark, d):
    return rounded(readers.pivot_met(V.v_mast(spark, d)))


@query(
    "met_pivot_mean",
    """SELECT period, "TimeStamp", round(avg("met_WindSpeedRot_mean") FILTER (WHERE "StationId" = 38), 6) AS "met_WindSpeedRot_mean_38",
  round(avg("met_WindSpeedRot_mean") FILTER (WHERE "StationId" = 246), 6) AS "met_WindSpeedRot_mean_246" FROM v_mast
  WHERE "StationId" IN (38, 246) GROUP BY 1, 2""",
    ["v_mast"],
)
def met_pivot_mean(spark, d):
    return rounded(readers.pivot_met(V.v_mast(spark, d), masts=(38, 246), sensors=("met_WindSpeedRot_mean",)))


@query(
    "met_join",
    f'SELECT g.*, {sql_round(_MET_NAMES)} FROM v_grid g LEFT JOIN v_met_pivot USING (period, "TimeStamp")',
    ["v_grid", "v_met_pivot"],
)
def met_join(spark, d):
    return rounded(G.join_signals(grid(spark, d), [], readers.pivot_met(V.v_mast(spark, d))))


# ------------------------------------------------------------- counter gaps

GAPS = """SELECT *, CASE WHEN missing THEN count(*) FILTER (WHERE missing) OVER (PARTITION BY period, "StationId", seen) END AS gap_rows
  FROM (SELECT *, "wtc_kWG1TotE_accum" IS NULL AS missing,
    count("wtc_kWG1TotE_accum") OVER (PARTITION BY period, "StationId" ORDER BY "TimeStamp" ROWS UNBOUNDED PRECEDING) AS seen
    FROM {source}) x"""
# A gap is bounded by the rows numbered just before and just after it.
BOUNDED = """SELECT g.*, b.ev AS counter_before, a.ev AS counter_after, a.en AS energy_after FROM ({gaps}) g
  LEFT JOIN (SELECT period AS p, "StationId" AS s, seen AS k, "wtc_kWG1TotE_endvalue" AS ev FROM ({gaps}) WHERE NOT missing) b
    ON g.missing AND b.p = g.period AND b.s = g."StationId" AND b.k = g.seen
  LEFT JOIN (SELECT period AS p, "StationId" AS s, seen AS k, "wtc_kWG1TotE_endvalue" AS ev, "wtc_kWG1TotE_accum" AS en FROM ({gaps}) WHERE NOT missing) a
    ON g.missing AND a.p = g.period AND a.s = g."StationId" AND a.k = g.seen + 1"""
IMPUTED = """SELECT * EXCLUDE ("wtc_kWG1TotE_accum"), CASE WHEN rest IS NULL THEN "wtc_kWG1TotE_accum" WHEN rest > 0 AND is_free THEN round_even(rest / free_rows * 100, 0) / 100 ELSE 0.0 END::DOUBLE AS "wtc_kWG1TotE_accum",
    CASE WHEN rest > 0 AND is_free THEN 'interpolated' ELSE 'actual' END AS "Energy_Source"
  FROM (SELECT *, count(*) FILTER (WHERE is_free) OVER (PARTITION BY period, "StationId", seen) AS free_rows
    FROM (SELECT *, missing AND "EffectiveAlarmTime" < 600 AS is_free,
      CASE WHEN missing AND counter_after - counter_before >= 0 AND counter_after - counter_before <= (gap_rows + 1) * 450
        THEN CASE WHEN counter_after = counter_before THEN 0 ELSE counter_after - counter_before - energy_after END END AS rest
      FROM ({bounded}) y) z) w"""


def imputed_sql(source: str) -> str:
    gaps = GAPS.format(source=source)
    return IMPUTED.format(bounded=BOUNDED.format(gaps=gaps))


@query(
    "energy_gaps",
    f"""SELECT {KEY_SQL}, CASE WHEN missing THEN seen END AS gap, gap_rows, round(counter_before, 4) AS counter_before,
  round(counter_after, 4) AS counter_after, round(energy_after, 4) AS energy_after FROM ({BOUNDED.format(gaps=GAPS.format(source='v_wide'))})""",
    ["v_wide"],
)
def energy_gaps(spark, d):
    out = E.energy_gaps(V.v_wide(spark, d)).select(
        "StationId", "TimeStamp", "gap", "gap_rows", "counter_before", "counter_after", "energy_after"
    )
    return rounded(out, 4)


view("v_imputed", imputed_sql("v_wide"), "v_wide")


@query(
    "impute_energy",
    f'SELECT {KEY_SQL}, round("wtc_kWG1TotE_accum", 2) AS "wtc_kWG1TotE_accum", "Energy_Source" FROM v_imputed',
    ["v_imputed"],
)
def impute_energy(spark, d):
    out = E.impute_energy(V.v_wide(spark, d)).select("StationId", "TimeStamp", "wtc_kWG1TotE_accum", "Energy_Source")
    return rounded(out, 2)


@query(
    "impute_stats",
    """SELECT count(*) FILTER (WHERE missing AND rest IS NOT NULL) AS imputed_intervals,
  round(coalesce(sum(rest / free_rows) FILTER (WHERE rest > 0 AND is_free), 0), 3) AS imputed_energy FROM v_imputed""",
    ["v_imputed"],
)
def impute_stats(spark, d):
    return rounded(E.impute_stats(V.v_wide(spark, d)), 3)


# ---------------------------------------------------------- potential energy

def to_use(spark, d, source="energy"):
    return V.v_wide(spark, d).withColumn("Energy_To_Use", E.energy_to_use(source))


@query(
    "energy_to_use",
    f"""SELECT {KEY_SQL}, round("wtc_kWG1TotE_accum", 6) AS by_counter,
  round(CASE WHEN "wtc_ActPower_mean" < 0 THEN 0 ELSE "wtc_ActPower_mean" / 6 END, 6) AS by_power FROM v_wide""",
    ["v_wide"],
)
def energy_to_use(spark, d):
    return V.v_wide(spark, d).select(
        "StationId", "TimeStamp",
        F.round(E.energy_to_use("energy"), 6).alias("by_counter"), F.round(E.energy_to_use("power"), 6).alias("by_power"),
    )


view(
    "v_use",
    """SELECT *, "wtc_kWG1TotE_accum" AS "Energy_To_Use", coalesce("wtc_kWG1TotE_accum" > 0 AND "EffectiveAlarmTime" = 0 AND "wtc_ScInOper_timeon" > 0
   AND "Duration 2006(s)" = 0 AND (coalesce("wtc_PowerRed_timeon" = 0, false)
     OR (("wtc_PowerRed_timeon" <> 0 OR "wtc_PowerRed_timeon" IS NULL) AND coalesce("wtc_ActPower_max" > 2200, false))), false) AS running FROM v_wide""",
    "v_wide",
)


@query("operational_mask", f"SELECT {KEY_SQL}, running FROM v_use", ["v_use"])
def operational_mask(spark, d):
    return to_use(spark, d).select("StationId", "TimeStamp", E.operational().alias("running"))


CF = "(0.92e0 / (1.0e0 - 0.08e0 * ({n} - 1) / 130.0e0))"


@query("correction_factor", f"SELECT n, round({CF.format(n='n')}, 9) AS factor FROM (SELECT DISTINCT l_quantity AS n FROM lineitem)")
def correction_factor(spark, d):
    counts = V.table(spark, d, "lineitem").select(F.col("l_quantity").alias("n")).distinct()
    return counts.select("n", F.round(E.correction_factor(F.col("n")), 9).alias("factor"))


view(
    "v_potential",
    f"""SELECT period, "TimeStamp", round_even(mean * {CF.format(n='n')} * 100, 0) / 100 AS "Epot", {CF.format(n='n')} AS "Correction Factor", n AS "Available Turbines"
  FROM (SELECT period, "TimeStamp", avg("Energy_To_Use") AS mean, count(*) AS n FROM v_use WHERE running GROUP BY 1, 2) x""",
    "v_use",
)


@query(
    "potential_energy",
    'SELECT period, "TimeStamp", "Epot", round("Correction Factor", 9) AS "Correction Factor", "Available Turbines" FROM v_potential',
    ["v_potential"],
)
def potential_energy(spark, d):
    return rounded(E.potential_energy(to_use(spark, d)), 9)


@query(
    "epot_backjoin",
    f'SELECT {KEY_SQL}, "Epot" FROM v_use LEFT JOIN v_potential USING (period, "TimeStamp")',
    ["v_use", "v_potential"],
)
def epot_backjoin(spark, d):
    rows = to_use(spark, d)
    return rows.join(E.potential_energy(rows).select("period", "TimeStamp", "Epot"), ["period", "TimeStamp"], "left").select(
        "StationId", "TimeStamp", "Epot"
    )


# Straight pieces between knots; the first and last piece reach to infinity.
view(
    "v_piece",
    """SELECT "Wind" AS w0, "Power" AS p0, w1, p1, row_number() OVER (ORDER BY "Wind") = 1 AS is_first, w2 IS NULL AS is_last
  FROM (SELECT *, lead("Wind") OVER (ORDER BY "Wind") AS w1, lead("Power") OVER (ORDER BY "Wind") AS p1,
    lead("Wind", 2) OVER (ORDER BY "Wind") AS w2 FROM v_curve) x WHERE w1 IS NOT NULL""",
    "v_curve",
)
ON_PIECE = "({w} >= w0 OR is_first) AND ({w} < w1 OR is_last)"
LINE = "(p0 + (p1 - p0) / CAST(w1 - w0 AS DOUBLE) * ({w} - w0))"
view(
    "v_by_wind",
    f"""SELECT u.*, {LINE.format(w='"wtc_AcWindSp_mean"')} / 6 AS by_wind FROM v_use u
  LEFT JOIN v_piece ON {ON_PIECE.format(w='"wtc_AcWindSp_mean"')}""",
    "v_use", "v_piece",
)


def curve(spark, d):
    return readers.power_curve(V.v_curve(spark, d))


@query(
    "power_curve_join",
    f'SELECT {KEY_SQL}, round("wtc_AcWindSp_mean", 6) AS "wtc_AcWindSp_mean", round(by_wind, 6) AS wind_energy FROM v_by_wind',
    ["v_by_wind"],
)
def power_curve_join(spark, d):
    out = E.energy_from_wind(V.v_wide(spark, d), curve(spark, d))
    return rounded(out.select("StationId", "TimeStamp", "wtc_AcWindSp_mean", "wind_energy"))


@query(
    "linear_interp",
    f"""SELECT p_partkey, w, round({LINE.format(w='w')}, 6) AS power FROM (SELECT p_partkey, (p_retailprice - 900) / 10 - 3 AS w FROM part) q
  LEFT JOIN v_piece ON {ON_PIECE.format(w='w')}""",
    ["v_piece"],
)
def linear_interp(spark, d):
    rows = V.table(spark, d, "part").select("p_partkey", ((F.col("p_retailprice") - 900) / 10 - 3).alias("w"))
    return E.curve_power(rows, curve(spark, d), "w", "power").select("p_partkey", "w", F.round("power", 6).alias("power"))


view(
    "v_stat",
    f"""SELECT s.month, t.total * 0.92e0 / 8760 / 6 * s.value AS energy FROM v_season s,
  (SELECT sum({LINE.format(w='d.bin')} * d.value) AS total FROM v_distribution d JOIN v_piece ON {ON_PIECE.format(w='d.bin')}
   WHERE d.bin BETWEEN 1 AND 25) t""",
    "v_season", "v_distribution", "v_piece",
)


def stat(spark, d):
    return E.statistical_energy(
        curve(spark, d), readers.wind_distribution(V.v_distribution(spark, d)), readers.season_factor(V.v_season(spark, d))
    )


@query("statistical_energy", "SELECT month, round(energy, 5) AS statistical_energy FROM v_stat", ["v_stat"])
def statistical_energy(spark, d):
    return rounded(stat(spark, d), 5)


CASCADE = """SELECT * EXCLUDE ("Epot"), CASE WHEN running THEN "Energy_To_Use" WHEN "Epot" IS NOT NULL THEN greatest("Epot", "Energy_To_Use")
    WHEN by_wind IS NOT NULL THEN greatest(by_wind, coalesce("Energy_To_Use", 0)) ELSE greatest(energy, coalesce("Energy_To_Use", 0)) END AS "Epot",
  CASE WHEN running OR coalesce("Epot" < "Energy_To_Use", false) THEN 'Epot=EnergyProduced' WHEN "Epot" IS NOT NULL THEN 'AverageWithWakeLossAdjustments'
    WHEN by_wind IS NOT NULL THEN 'Anemometer' ELSE 'SWE' END AS "Epot_Method"
  FROM {wind} LEFT JOIN {potential} USING (period, "TimeStamp") LEFT JOIN v_stat ON v_stat.month = month("TimeStamp")"""
view("v_epot", CASCADE.format(wind="v_by_wind", potential="v_potential"), "v_by_wind", "v_potential", "v_stat")


@query(
    "epot_cascade",
    f'SELECT {KEY_SQL}, round("Epot", 4) AS "Epot", "Epot_Method", "Available Turbines", round("Correction Factor", 9) AS "Correction Factor" FROM v_epot',
    ["v_epot"],
)
def epot_cascade(spark, d):
    out = E.potential_cascade(to_use(spark, d), curve(spark, d), stat(spark, d))
    return out.select(
        "StationId", "TimeStamp", F.round("Epot", 4).alias("Epot"), "Epot_Method", "Available Turbines",
        F.round("Correction Factor", 9).alias("Correction Factor"),
    )


# -------------------------------------------------------------------- losses

# The loss queries read a potential that is plain arithmetic on the cell.
view("v_lossy", 'SELECT *, "wtc_kWG1TotE_accum" AS "Energy_To_Use", CASE WHEN "wtc_AcWindSp_mean" IS NOT NULL THEN "wtc_AcWindSp_mean" * 30 END AS "Epot" FROM v_wide', "v_wide")


def lossy(spark, d):
    return to_use(spark, d).withColumn("Epot", F.col("wtc_AcWindSp_mean") * 30)


SPLIT = """SELECT *, r1 - "EL_2006" AS rest FROM (SELECT *, CASE WHEN r1 > 0 AND "Duration 2006(s)" > 0 THEN r1 ELSE 0.0 END::DOUBLE AS "EL_2006"
  FROM (SELECT *, r0 - "EL_PowerRed" AS r1 FROM (SELECT *, CASE WHEN r0 > 0 AND "wtc_PowerRed_timeon" > 0 AND "wtc_ActPower_max" > 2300 THEN r0 ELSE 0.0 END::DOUBLE AS "EL_PowerRed"
  FROM (SELECT *, "EL" - ("ELX" + "ELNX") AS r0 FROM (SELECT *, coalesce("Period 0(s)" / nullif("Period 0(s)" + "Period 1(s)", 0) * "EL", 0) AS "ELX",
    coalesce("Period 1(s)" / nullif("Period 0(s)" + "Period 1(s)", 0) * "EL", 0) AS "ELNX"
  FROM (SELECT *, greatest(coalesce("Epot", 0) - coalesce("Energy_To_Use", 0), 0) AS "EL" FROM {source}) a) b) c) e) f) g"""
view("v_split", SPLIT.format(source="v_lossy"), "v_lossy")


@query("energy_loss", f'SELECT {KEY_SQL}, round("EL", 4) AS "EL" FROM v_split', ["v_split"])
def energy_loss(spark, d):
    return lossy(spark, d).select("StationId", "TimeStamp", F.round(L.energy_loss(), 4).alias("EL"))


@query(
    "clip_non_negative",
    f'SELECT {KEY_SQL}, CASE WHEN "wtc_ActPower_min" IS NOT NULL THEN greatest("wtc_ActPower_min", 0.0) END::DOUBLE AS clipped FROM v_wide',
    ["v_wide"],
)
def clip_non_negative(spark, d):
    return V.v_wide(spark, d).select("StationId", "TimeStamp", clip_zero(F.col("wtc_ActPower_min")).alias("clipped"))


@query(
    "fill_zero",
    f'SELECT {KEY_SQL}, coalesce("wtc_PowerRed_timeon", 0)::DOUBLE AS curtailed FROM v_wide',
    ["v_wide"],
)
def fill_zero(spark, d):
    return V.v_wide(spark, d).select("StationId", "TimeStamp", or_zero(F.col("wtc_PowerRed_timeon")).alias("curtailed"))


@query(
    "share_split",
    f'SELECT {KEY_SQL}, round(coalesce("Period 0(s)" / nullif("Period 0(s)" + "Period 1(s)", 0) * 90, 0), 6) AS part FROM v_wide',
    ["v_wide"],
)
def share_split(spark, d):
    part = share(F.col("`Period 0(s)`"), F.col("`Period 1(s)`"), F.lit(90.0))
    return V.v_wide(spark, d).select("StationId", "TimeStamp", F.round(part, 6).alias("part"))


@query(
    "loss_share",
    f'SELECT {KEY_SQL}, round("EL", 4) AS "EL", round("ELX", 4) AS "ELX", round("ELNX", 4) AS "ELNX", round(r0, 4) AS "EL_indefini" FROM v_split',
    ["v_split"],
)
def loss_share(spark, d):
    return rounded(L.loss_by_party(lossy(spark, d)).select("StationId", "TimeStamp", "EL", "ELX", "ELNX", "EL_indefini"), 4)


@query(
    "loss_curtailment",
    f'SELECT {KEY_SQL}, round("EL_PowerRed", 4) AS "EL_PowerRed", round(r1, 4) AS "EL_indefini" FROM v_split',
    ["v_split"],
)
def loss_curtailment(spark, d):
    out = L.loss_curtailment(L.loss_by_party(lossy(spark, d)))
    return rounded(out.select("StationId", "TimeStamp", "EL_PowerRed", "EL_indefini"), 4)


@query(
    "loss_2006",
    f'SELECT {KEY_SQL}, round("EL_2006", 4) AS "EL_2006", round(rest, 4) AS "EL_indefini" FROM v_split',
    ["v_split"],
)
def loss_2006(spark, d):
    return rounded(L.split_losses(lossy(spark, d)).select("StationId", "TimeStamp", "EL_2006", "EL_indefini"), 4)


NEIGHBOURS = """SELECT *, wind_speed_prev_turbine - "wtc_AcWindSp_mean" AS wind_speed_diff_prev_turbine, wind_speed_next_turbine - "wtc_AcWindSp_mean" AS wind_speed_diff_next_turbine
  FROM (SELECT *, lag("wtc_AcWindSp_mean") OVER w AS wind_speed_prev_turbine, lead("wtc_AcWindSp_mean") OVER w AS wind_speed_next_turbine,
    lag("wtc_ActPower_min") OVER w AS min_power_prev_turbine, lead("wtc_ActPower_min") OVER w AS min_power_next_turbine,
    lag("EffectiveAlarmTime") OVER w AS alarm_period_prev_turbine, lead("EffectiveAlarmTime") OVER w AS alarm_period_next_turbine
    FROM {source} WINDOW w AS (PARTITION BY period, "TimeStamp" ORDER BY "StationId")) n"""
view("v_neighbours", NEIGHBOURS.format(source="v_split"), "v_split")
_NEAR = [f"{n}_{s}_turbine" for n in ("wind_speed", "min_power", "alarm_period", "wind_speed_diff") for s in ("prev", "next")]


@query("neighbour_values", f"SELECT {KEY_SQL}, {sql_round(_NEAR)} FROM v_neighbours", ["v_neighbours"])
def neighbour_values(spark, d):
    return rounded(L.neighbour_values(V.v_wide(spark, d)).select("StationId", "TimeStamp", *_NEAR))


NBR = """(coalesce(min_power_prev_turbine > 0 AND min_power_next_turbine > 0, false) OR coalesce(min_power_prev_turbine > 0 AND alarm_period_next_turbine > 0, false)
  OR coalesce(min_power_next_turbine > 0 AND alarm_period_prev_turbine > 0, false))"""
PATTERNS = f"""SELECT *, CASE WHEN low THEN coalesce(rest, 0) END AS "EL_wind", CASE WHEN low THEN 600.0::DOUBLE END AS "Duration lowind(s)",
    CASE WHEN post AND NOT low THEN coalesce(rest, 0) END AS "EL_wind_start", CASE WHEN post AND NOT low THEN 600.0::DOUBLE END AS "Duration lowind_start(s)",
    CASE WHEN NOT low AND NOT post AND recover THEN coalesce(rest, 0) END AS "EL_alarm_start", CASE WHEN NOT low AND NOT post AND recover THEN 600.0::DOUBLE END AS "Duration alarm_start(s)",
    CASE WHEN contains("UK Text", 'low wind') AND nbr THEN "ELX" ELSE 0.0 END::DOUBLE AS "EL_Misassigned"
  FROM (SELECT *, coalesce(lag(low) OVER s, low) AS post, coalesce(lag("EffectiveAlarmTime" > 0) OVER s, false) AND rest > 0 AND "EffectiveAlarmTime" = 0 AS recover
    FROM (SELECT *, NOT (drop_here AND nbr) AND rest > 0 AS low FROM (SELECT *, {NBR} AS nbr,
      coalesce(wind_speed_diff_prev_turbine > 1 AND wind_speed_diff_next_turbine > 1 AND
        (coalesce(wind_speed_prev_turbine >= 5, false) OR coalesce(wind_speed_next_turbine >= 5, false) OR coalesce("wtc_AcWindSp_mean" >= 5, false)), false) AS drop_here
      FROM {{source}}) k) l WINDOW s AS (PARTITION BY period, "StationId" ORDER BY "TimeStamp")) m"""
view("v_patterns", PATTERNS.format(source="v_neighbours"), "v_neighbours")


def patterns(spark, d):
    return L.wind_patterns(L.neighbour_values(L.split_losses(lossy(spark, d))))


def pattern_query(name: str, columns: list[str]):
    @query(name, f"SELECT {KEY_SQL}, {sql_round(columns, 4)} FROM v_patterns", ["v_patterns"])
    def run(spark, d):
        return rounded(patterns(spark, d).select("StationId", "TimeStamp", *columns), 4)

    return run


pattern_query("low_wind", ["EL_wind", "Duration lowind(s)"])
pattern_query("post_low_wind", ["EL_wind_start", "Duration lowind_start(s)"])
pattern_query("post_alarm", ["EL_alarm_start", "Duration alarm_start(s)"])


@query(
    "loss_left",
    f'SELECT {KEY_SQL}, round(rest - coalesce("EL_wind", 0) - coalesce("EL_wind_start", 0) - coalesce("EL_alarm_start", 0), 4) + 0.0 AS "EL_indefini_left" FROM v_patterns',
    ["v_patterns"],
)
def loss_left(spark, d):
    return patterns(spark, d).select("StationId", "TimeStamp", (F.round("EL_indefini_left", 4) + 0.0).alias("EL_indefini_left"))


@query("misassigned", f'SELECT {KEY_SQL}, round("EL_Misassigned", 4) AS "EL_Misassigned" FROM v_patterns', ["v_patterns"])
def misassigned(spark, d):
    out = L.misassigned(L.neighbour_values(L.split_losses(lossy(spark, d))))
    return rounded(out.select("StationId", "TimeStamp", "EL_Misassigned"), 4)


@query("text_contains", f"""SELECT {KEY_SQL}, coalesce(contains("UK Text", 'low wind'), false) AS hit FROM v_wide""", ["v_wide"])
def text_contains(spark, d):
    hit = F.coalesce(F.contains(F.col("UK Text"), F.lit("low wind")), F.lit(False))
    return V.v_wide(spark, d).select("StationId", "TimeStamp", hit.alias("hit"))


@query(
    "round_results",
    f'''SELECT period, {KEY_SQL}, round_even("wtc_AcWindSp_mean" * 100, 0) / 100 AS "wtc_AcWindSp_mean",
  round_even("wtc_ActPower_mean" * 100, 0) / 100 AS "wtc_ActPower_mean" FROM v_wide''',
    ["v_wide"],
)
def round_results(spark, d):
    return round_numeric(V.v_wide(spark, d).select("period", "StationId", "TimeStamp", "wtc_AcWindSp_mean", "wtc_ActPower_mean"))


@query(
    "result_order",
    f'SELECT {KEY_SQL}, "EffectiveAlarmTime" FROM v_wide ORDER BY "StationId", "TimeStamp"',
    ["v_wide"],
)
def result_order(spark, d):
    return V.v_wide(spark, d).select("StationId", "TimeStamp", "EffectiveAlarmTime").orderBy("StationId", "TimeStamp")


@query(
    "union_operational",
    f"""SELECT {KEY_SQL}, "Epot_Method", round("Epot", 4) AS "Epot" FROM v_epot WHERE running
  UNION ALL SELECT {KEY_SQL}, "Epot_Method", round("Epot", 4) FROM v_epot WHERE NOT running""",
    ["v_epot"],
)
def union_operational(spark, d):
    out = E.potential_cascade(to_use(spark, d), curve(spark, d), stat(spark, d))
    return out.select("StationId", "TimeStamp", "Epot_Method", F.round("Epot", 4).alias("Epot"))


@query(
    "nan_to_null",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0.05 THEN l_tax END AS tax FROM lineitem",
)
def nan_rows(spark, d):
    li = V.table(spark, d, "lineitem")
    tax = F.when(F.col("l_discount") != 0.05, F.col("l_tax")).otherwise(F.lit(float("nan")))
    return nan_to_null(li.select("l_orderkey", "l_linenumber", "l_partkey", tax.alias("tax")))
