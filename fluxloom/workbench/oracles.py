"""DuckDB SQL for every query that SQL can express."""

from __future__ import annotations

from fluxloom import schema as S
from fluxloom.functions.hybrid import BY_CODE, HYBRIDS, MODELS, PURE
from fluxloom.operators.caps import RATIO_TARGETS
from fluxloom.functions.labels import MODEL_MARKUP
from fluxloom.workbench.queries import BROKEN_REGION, CARD_COLUMNS, LIMITS, PHYSICS_COLUMNS, START
from fluxloom.workbench.views import FILLED, METADATA_SQL, r6, split_sql, with_sql

ORACLES: dict[str, str] = {}


def _columns(*names: str) -> str:
    return ", ".join(r6(name) for name in names)


def _daily(upto: str, *names: str, where: str = "", source: str | None = None) -> str:
    condition = f" WHERE {where}" if where else ""
    return with_sql(upto, f"SELECT site, obs_date, {_columns(*names)} FROM {source or upto}{condition}")


def _rmse(model: str, observed: str = "LE_CORR") -> str:
    return f"sqrt(avg(({observed} - {model}) * ({observed} - {model})))"


def _excess() -> str:
    return ", ".join(
        f"{_rmse(model.estimate)} - {_rmse('LE_CORR_RF')} AS {code}" for code, model in BY_CODE.items()
    )


BALANCE = """abs(NETRAD - G_F_MDS - LE_CORR - H_CORR) < 100
  AND NETRAD - G_F_MDS < 280 AND NETRAD - G_F_MDS > -50"""
QUALITY = "LE_F_MDS_QC >= 0.8 AND rha > 0"

ORACLES["site_potential_error"] = with_sql("phys", f"""
SELECT site, count(*) AS n, {', '.join(r6(_rmse(c), f'{c}_rmse') for c in ('PET_Penman', 'PET_PT', 'PET_PM'))}
FROM phys WHERE {QUALITY} AND USTAR IS NOT NULL AND {BALANCE} GROUP BY site""")

# ---------------------------------------------------------------- sources and sinks

_KEPT_SITES = f"""site NOT IN (SELECT concat('S', CAST(s_suppkey AS VARCHAR))
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = {BROKEN_REGION})"""
ORACLES["scan_multi_file"] = with_sql(
    "clean", f"SELECT site, obs_date, TA_F, NETRAD, LE_CORR, WS_F, USTAR FROM clean WHERE {_KEPT_SITES}"
)
ORACLES["schema_gate"] = with_sql(
    "clean",
    f"SELECT site, count(*) AS n, min(obs_date) AS first_day FROM clean WHERE {_KEPT_SITES} GROUP BY site",
)
ORACLES["scan_csv"] = with_sql("clean", "SELECT site, obs_date, TA_F, H_CORR, LE_CORR, USTAR FROM clean")
ORACLES["scan_satellite"] = with_sql("sat", " UNION ALL ".join(
    f"SELECT site, '{c}' AS product, count({c}) AS n, {r6(f'sum({c})', 'total')}, max(obs_date) AS last_day "
    f"FROM sat WHERE {c} IS NOT NULL GROUP BY site" for c in FILLED
))
ORACLES["scan_parquet"] = with_sql(
    "analysed", f"SELECT site, obs_date, LE_CORR, {r6('PET_PM')} FROM analysed"
)
ORACLES["sink_roundtrip"] = with_sql("clean", "SELECT site, obs_date, USTAR, P_F FROM clean")
ORACLES["versioned_rewrite"] = with_sql("clean", """
SELECT 1 AS version, site, obs_date, USTAR, P_F FROM clean
UNION ALL SELECT 2, site, obs_date, USTAR, P_F + 1 FROM clean WHERE USTAR IS NOT NULL
UNION ALL SELECT 3, site, obs_date, USTAR, (P_F + 1) * 2 FROM clean WHERE USTAR IS NOT NULL AND k % 2 = 0""")
ORACLES["numbered_rows"] = with_sql(
    "flux", 'SELECT row_number() OVER (ORDER BY site, obs_date) AS "row", site, obs_date, k FROM flux'
)
ORACLES["derive_site_id"] = """
SELECT substr(regexp_extract(path, '[^/]*$'), 5, 6) AS site_id, count(*) AS n
FROM (SELECT concat('hdfs:///flux/AMF_', lpad(CAST(l_suppkey AS VARCHAR), 6, '0'),
        '_FLUXNET_FULLSET_DD_1995-2001_3-5.csv') AS path FROM lineitem)
GROUP BY 1"""
ORACLES["stack_sites"] = with_sql("flux", """
SELECT site, obs_date, TA_F, LE_CORR, USTAR, k FROM flux WHERE obs_date < DATE '1999-01-01'
UNION
SELECT site, obs_date, TA_F, LE_CORR, USTAR, k FROM flux WHERE obs_date >= DATE '1998-01-01'""")

_GROUP = """CASE WHEN IGBP IS NULL THEN NULL WHEN IGBP IN ('OSH', 'CSH') THEN 'OSH/CSH' WHEN IGBP = 'CRO' THEN 'CRO'
    WHEN IGBP IN ('DBF', 'ENF') THEN 'DBF/ENF' WHEN IGBP = 'GRA' THEN 'GRA' ELSE 'WET' END"""
ORACLES["igbp_lookup"] = with_sql("flux", f"""
SELECT f.site, obs_date, IGBP, {_GROUP} AS IGBP2
FROM flux f LEFT JOIN metadata m ON f.site = m.site""", METADATA_SQL)

# ---------------------------------------------------------------- columns

ORACLES["sentinel_to_null"] = with_sql(
    "flux", "SELECT site, obs_date, k, CASE WHEN USTAR <> -9999 THEN USTAR END AS USTAR FROM flux"
)
ORACLES["project_required"] = with_sql("clean", f"SELECT site, obs_date, {', '.join(S.MEASURED)} FROM clean")
ORACLES["satellite_rename"] = with_sql("sat", f"SELECT site, obs_date AS DATE, {r6('VegWC')} FROM sat")
ORACLES["unit_scale"] = with_sql("clean", f"""
SELECT site, obs_date, {r6('CAST(k % 101 AS DOUBLE) * 0.01', 'Fpar')}, {r6('VPD_F / 10', 'vpd_kpa')} FROM clean""")
ORACLES["decode_yyyymmdd"] = with_sql("flux", """
SELECT site, stamp, day, CASE WHEN day IS NOT NULL THEN CAST(12 AS INTEGER) END AS hour
FROM (SELECT site, stamp, TRY_CAST(concat(CAST(stamp // 10000 AS VARCHAR), '-',
        lpad(CAST(stamp // 100 % 100 AS VARCHAR), 2, '0'), '-',
        lpad(CAST(stamp % 100 AS VARCHAR), 2, '0')) AS DATE) AS day
      FROM (SELECT site, CAST(year(obs_date) * 10000 + month(obs_date) * 100 + day(obs_date) + 3 AS INTEGER) AS stamp
            FROM flux))""")
ORACLES["date_parts"] = """
SELECT CAST(o_orderdate AS DATE) AS DATE, CAST(year(o_orderdate) AS INTEGER) AS YEAR, count(*) AS n
FROM orders GROUP BY 1, 2"""
ORACLES["available_energy"] = with_sql("clean", "SELECT site, obs_date, NETRAD - G_F_MDS AS AE FROM clean")
ORACLES["clamp_range"] = with_sql(
    "clean", "SELECT site, obs_date, CASE WHEN WS_F < 0.2 THEN 0.2 ELSE WS_F END AS WS_F FROM clean"
)
ORACLES |= {name: _daily("phys", *columns) for name, columns in PHYSICS_COLUMNS.items()}
ORACLES["stress_ratio_capped"] = _daily("targets", "PT_stress_cor", "Penman_stress_cor", "PM_stress_cor")
ORACLES["gs_impute_log"] = _daily("targets", "Gs_cor", "Gs_log_cor")
ORACLES["hybrid_forward"] = with_sql("phys", f"""
SELECT site, obs_date, LE_CORR, {', '.join(f'CAST(0 AS DOUBLE) AS {m.estimate}' for m in HYBRIDS)}
FROM phys WHERE Gs_cor_raw IS NOT NULL AND LE_CORR > 0 AND AE > 0""")
ORACLES["hybrid_estimates"] = with_sql(
    "scored", f"SELECT site, obs_date, LE_CORR_RF, {_columns(*[m.estimate for m in HYBRIDS])} FROM scored"
)
ORACLES["igbp_class"] = with_sql("flux", f"""
SELECT IGBP2, count(DISTINCT site) AS sites, count(*) AS n,
       concat(IGBP2, ' (n = ', CAST(count(DISTINCT site) AS VARCHAR), ')') AS label
FROM (SELECT f.site, {_GROUP} AS IGBP2 FROM flux f LEFT JOIN metadata m ON f.site = m.site)
GROUP BY IGBP2""", METADATA_SQL)


# Long form of the scored rows: one row per model.
_SENSITIVITY = {
    "Pure-ML": "1.0",
    "H-PT": "PET_PT",
    "H-Penman": "PET_Penman",
    "H-PM-Kc": "PET_PM",
    "H-PM-gs": """(Delta * AE + density * 1004.834 * (VPD_F / 10) / ra_H) * gamma / ra_H
        / pow(Delta + gamma + gamma / exp(Gs_log_cor_RF) / ra_H, 2) / exp(Gs_log_cor_RF)""",
    "H-PMRH-Frh": "gamma / (rha * Delta + gamma) * density * 1004.834 * esat_air / gamma",
    "H-PMRH-drh": "gamma / (rha * Delta + gamma) * density * 1004.834 * esat_air / gamma / ra_H",
}


def _long(source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m.name}' AS models, LE_CORR AS observed, {m.estimate} AS estimate, {m.target} AS theta, "
        f"{m.learned} AS theta_hat, {_SENSITIVITY[m.name]} AS sens FROM {source}" for m in MODELS
    )
    return f"\nlong AS ({rows})"


_CARD = """
card AS (
  SELECT models,
         stddev_samp(theta_hat) * CASE WHEN models IN ('H-PMRH-Frh', 'H-PMRH-drh') THEN abs(avg(sens))
           ELSE sqrt(avg(sens * sens)) END AS partial_stdev,
         stddev_samp(estimate) / stddev_samp(observed) AS stdev_ratio,
         avg(estimate - observed) AS mean_bias,
         sqrt(avg((estimate - observed) * (estimate - observed))) AS rmse,
         pow(corr(theta, theta_hat), 2) AS parameter_R2
  FROM long GROUP BY models)"""
_TEST = "\ntest AS (SELECT * FROM parted WHERE split = 'test')"

_MARKUP = " ".join(
    "WHEN models = '{}' THEN '{}'".format(name, text.replace("'", "''")) for name, text in MODEL_MARKUP.items()
)
ORACLES["model_label"] = with_sql(
    "scored",
    f"SELECT models, count(estimate) AS n, CASE {_MARKUP} END AS markup FROM long GROUP BY models",
    _long("scored"),
)
ORACLES["metric_label"] = with_sql("scored", """
SELECT models, printf('RMSE = %.2f', rmse) AS rmse_text,
       printf('sigma[m]/sigma[o] == %.3f', stdev_ratio) AS ratio_text FROM card""", _long("scored"), _CARD)

# ---------------------------------------------------------------- filters

ORACLES["filter_date_from"] = with_sql(
    "flux", f"SELECT site, obs_date, k FROM flux WHERE obs_date >= DATE '{START}'"
)
ORACLES["qc_filter"] = _daily("phys", "rha", "LE_F_MDS_QC", where=QUALITY)
ORACLES["drop_null_rows"] = with_sql(
    "sat", "SELECT site, obs_date, k FROM sat WHERE USTAR IS NOT NULL AND soil_moisture IS NOT NULL"
)
ORACLES["energy_balance_filter"] = with_sql(
    "clean", f"SELECT site, obs_date, NETRAD, LE_CORR, H_CORR FROM clean WHERE {BALANCE}"
)
ORACLES["quality_control"] = with_sql(
    "analysed", f"SELECT site, obs_date, LE_CORR, {_columns(*FILLED)} FROM analysed"
)

# ---------------------------------------------------------------- joins and splits

ORACLES["join_satellite"] = with_sql("sat", f"""
SELECT c.site, c.obs_date, c.LE_CORR, {', '.join(r6(f'{c}.{c}', c) for c in FILLED)}
FROM clean c
{' '.join(f'LEFT JOIN (SELECT site, obs_date, {c} FROM sat WHERE {c} IS NOT NULL) {c} ON c.site = {c}.site '
          f'AND c.obs_date = {c}.obs_date' for c in FILLED)}""")
ORACLES["split_train_test"] = with_sql(
    "clean", "SELECT site, obs_date, split FROM parted", split_sql("parted", "clean")
)
ORACLES["split_anti"] = with_sql(
    "clean", "SELECT site, obs_date, k FROM parted WHERE split = 'test'", split_sql("parted", "clean")
)
ORACLES["split_by_target_quantile"] = with_sql("clean", "SELECT site, obs_date, split FROM parted", """
edges AS (SELECT quantile_cont(LE_CORR, 0.25) AS q1, quantile_cont(LE_CORR, 0.5) AS q2,
                 quantile_cont(LE_CORR, 0.75) AS q3 FROM clean),
binned AS (
  SELECT site, obs_date, 1 + CAST(LE_CORR > q1 AS INTEGER) + CAST(LE_CORR > q2 AS INTEGER)
         + CAST(LE_CORR > q3 AS INTEGER) AS stratum
  FROM clean CROSS JOIN edges)""", split_sql("parted", "binned", "stratum"))

# ---------------------------------------------------------------- windows

ORACLES["gap_fill_nocb"] = with_sql("sat", f"""
SELECT site, obs_date, {', '.join(r6(f'first_value({c} IGNORE NULLS) OVER ahead', c) for c in FILLED)},
       {', '.join(r6(c, f'{c}_raw') for c in FILLED)}
FROM sat WINDOW ahead AS (PARTITION BY site ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
ORACLES["lead_default"] = with_sql("sat", f"""
SELECT site, obs_date, lead(k, 1, last_k) OVER w AS next_k, last_k,
       {r6('lead(soil_moisture, 1, last_sm) OVER w', 'next_sm')}
FROM (SELECT *, last_value(k) OVER full_site AS last_k, last_value(soil_moisture) OVER full_site AS last_sm
      FROM sat WINDOW full_site AS (PARTITION BY site ORDER BY obs_date
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WINDOW w AS (PARTITION BY site ORDER BY obs_date)""")

# ---------------------------------------------------------------- caps

_GRID = """
grid AS (SELECT round(99 + 0.05 * CAST(step AS DOUBLE), 2) AS percentile, CAST(step AS INTEGER) AS step
         FROM range(20) t(step))"""
_UP = "[" + ", ".join(repr(p / 100) for p in S.CAP_PERCENTILES) + "]"
_DOWN = "[" + ", ".join(repr(1 - p / 100) for p in S.CAP_PERCENTILES) + "]"
_CAPS = f"""
ratio_caps AS (
  SELECT unnest(range(20)) AS step, {', '.join(f"unnest(quantile_cont(LE_CORR / {potential}, {_UP})) AS {name}_max"
                                               for name, (potential, _, _) in RATIO_TARGETS.items())}
  FROM analysed WHERE AE > 30),
conductance_caps AS (
  SELECT unnest(range(20)) AS step, unnest(quantile_cont(Gs_cor_raw, {_UP})) AS PMgs_max,
         unnest(quantile_cont(Gs_cor_raw, {_DOWN})) AS PMgs_min
  FROM analysed),
caps AS (
  SELECT grid.percentile, grid.step, PT_max, Penman_max, PMKc_max, PMgs_max, PMgs_min
  FROM grid JOIN ratio_caps ON grid.step = ratio_caps.step
  JOIN conductance_caps ON grid.step = conductance_caps.step)"""
ORACLES["percentile_caps"] = with_sql(
    "analysed", f"SELECT percentile, {_columns('PT_max', 'Penman_max', 'PMKc_max')} FROM caps", _GRID, _CAPS
)
ORACLES["gs_caps"] = with_sql(
    "analysed", f"SELECT percentile, {_columns('PMgs_max', 'PMgs_min')} FROM caps", _GRID, _CAPS
)
ORACLES["cap_grid"] = with_sql(
    "analysed",
    f"SELECT percentile, {_columns('PT_max', 'Penman_max', 'PMKc_max', 'PMgs_max', 'PMgs_min')} FROM caps",
    _GRID, _CAPS,
)


def _capped(potential: str, cap: str) -> str:
    ratio = f"LE_CORR / {potential}"
    return f"CASE WHEN {ratio} < 0 THEN 0 WHEN {ratio} > {cap} THEN {cap} ELSE {ratio} END"


_CAP_ERRORS = ", ".join(
    r6(_rmse(f"({potential} * (0.9 * ({_capped(potential, f'{name}_max')}) + 0.05))"), f"{name}_rmse")
    for name, (potential, _, _) in RATIO_TARGETS.items()
)
_IMPUTED = "coalesce(Gs_cor_raw, CASE WHEN LE_CORR <= 0 THEN PMgs_min WHEN LE_CORR > 0 THEN PMgs_max END)"
ORACLES["best_cap"] = with_sql("analysed", f"""
SELECT {', '.join(r6(f'min_by({n}_max, ({n}_rmse, percentile))', f'{n}_max_best') for n in RATIO_TARGETS)},
       {r6('min_by(PMgs_max, (PMgs_rmse, percentile))', 'PMgs_max_best')},
       {r6('min_by(PMgs_min, (PMgs_rmse, percentile))', 'PMgs_min_best')}
FROM errors""", _GRID, _CAPS, f"""
errors AS (
  SELECT percentile, PT_max, Penman_max, PMKc_max, PMgs_max, PMgs_min, {_CAP_ERRORS},
         {r6(_rmse(f'(1000 * {_IMPUTED})'), 'PMgs_rmse')}
  FROM analysed CROSS JOIN caps
  GROUP BY percentile, PT_max, Penman_max, PMKc_max, PMgs_max, PMgs_min)""")

# ---------------------------------------------------------------- evaluation

ORACLES["rows_per_site"] = with_sql("flux", "SELECT site, count(*) AS n FROM flux GROUP BY site")
ORACLES["head_rows"] = with_sql("flux", "SELECT site, obs_date, k FROM flux ORDER BY site, obs_date LIMIT 6")
ORACLES["rmse_by_model"] = with_sql("parted", f"""
SELECT split, {', '.join(r6(_rmse(m.estimate), m.short) for m in MODELS)} FROM parted GROUP BY split""")

_ROLLUP = f"""
rollup_table AS (
  SELECT IGBP2, site, CAST(2 * grouping(IGBP2) + grouping(site) AS BIGINT) AS grain, {_excess()}
  FROM classed GROUP BY ROLLUP (IGBP2, site))"""
ORACLES["rmse_diff_rollup"] = with_sql(
    "classed", f"SELECT IGBP2, site, grain, {_columns(*BY_CODE)} FROM rollup_table", _ROLLUP
)
ORACLES["unpivot_models"] = with_sql("classed", " UNION ALL ".join(
    f"SELECT IGBP2, site, grain, '{code}' AS model, {r6(code, 'rmse')} FROM rollup_table" for code in BY_CODE
), _ROLLUP)
ORACLES["difference_points"] = with_sql("classed", " UNION ALL ".join(
    f"SELECT CASE grain WHEN 3 THEN 'All' ELSE IGBP2 END AS IGBP2, '{code}' AS model, {r6(code, 'rmse')} FROM rollup_table WHERE grain > 0"
    for code in BY_CODE
), _ROLLUP)
_DIFFERENCES = "\ndifferences AS (" + " UNION ALL ".join(
    f"SELECT {group} AS IGBP2, site, '{code}' AS model, {r6(code, 'rmse')} FROM rollup_table WHERE grain = 0"
    for code in BY_CODE for group in ("IGBP2", "'All'")
) + ")"
ORACLES["union_all_class"] = with_sql("classed", "SELECT * FROM differences", _ROLLUP, _DIFFERENCES)
_BOXES = """
quartiles AS (
  SELECT IGBP2, model, quantile_cont(rmse, 0.25) AS lower, quantile_cont(rmse, 0.5) AS middle,
         quantile_cont(rmse, 0.75) AS upper
  FROM differences GROUP BY IGBP2, model),
marked AS (
  SELECT d.*, lower, middle, upper,
         rmse BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower) AS inside
  FROM differences d JOIN quartiles q ON d.IGBP2 IS NOT DISTINCT FROM q.IGBP2 AND d.model = q.model)"""
ORACLES["boxplot_table"] = with_sql("classed", f"""
SELECT IGBP2, model, count(*) AS n, count(*) FILTER (NOT inside) AS outliers,
       {r6('min(rmse) FILTER (inside)', 'ymin', 9)}, {', '.join(r6(c, c, 9) for c in ('lower', 'middle', 'upper'))},
       {r6('max(rmse) FILTER (inside)', 'ymax', 9)}
FROM marked GROUP BY IGBP2, model, lower, middle, upper""", _ROLLUP, _DIFFERENCES, _BOXES)
ORACLES["boxplot_points"] = with_sql(
    "classed", "SELECT IGBP2, site, model, rmse FROM marked WHERE NOT inside", _ROLLUP, _DIFFERENCES, _BOXES
)
ORACLES |= {
    name: with_sql("parted", f"SELECT models, {r6(column)} FROM card", _TEST, _long("test"), _CARD)
    for name, column in CARD_COLUMNS.items()
}
_CARD_COLUMNS = _columns("partial_stdev", "stdev_ratio", "mean_bias", "rmse", "parameter_R2")
ORACLES["model_scorecard"] = with_sql(
    "parted", f"SELECT models, {_CARD_COLUMNS} FROM card", _TEST, _long("test"), _CARD
)
# Six models leave four degrees of freedom: P(|T| > t) = 1 - sin(a) (1 + cos(a)^2 / 2), a = atan(|t| / 2).
ORACLES["model_corr"] = with_sql("parted", f"""
SELECT n, {r6('r')}, {r6('t')},
       {r6('1 - sin(atan(abs(t) / 2)) * (1 + pow(cos(atan(abs(t) / 2)), 2) / 2)', 'p')}
FROM (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t
      FROM (SELECT corr(parameter_R2, rmse) AS r, count(*) AS n FROM card WHERE models <> 'Pure-ML'))""",
    _TEST, _long("test"), _CARD)


def _thresholds(level: float, source: str) -> str:
    cuts = ", ".join(
        f"quantile_cont({column}, {level}) AS {name}_03, quantile_cont({column}, {1 - level}) AS {name}_97"
        for name, column in S.EXTREME_VARIABLES.items()
    )
    return f"\nthresholds AS (SELECT site, {cuts} FROM {source} GROUP BY site)"


ORACLES["extreme_thresholds"] = with_sql("analysed", f"""
SELECT a.site, obs_date, {_columns(*S.EXTREME_NAMES)} FROM analysed a LEFT JOIN thresholds t ON a.site = t.site""",
    _thresholds(0.03, "analysed"))


def _extreme_sql(level: float, exact: bool = False) -> str:
    tests = {}
    for name, column in S.EXTREME_VARIABLES.items():
        tests[f"{name}_03"] = f"{column} < {name}_03"
        tests[f"{name}_97"] = f"{column} > {name}_97"
    rows = []
    for code, model in BY_CODE.items():
        cells = ", ".join(
            r6(
                f"sqrt(avg((LE_CORR - {model.estimate}) * (LE_CORR - {model.estimate})) FILTER ({test}))"
                f" - sqrt(avg((LE_CORR - LE_CORR_RF) * (LE_CORR - LE_CORR_RF)) FILTER ({test}))",
                name, 15 if exact else 6,
            )
            for name, test in tests.items()
        )
        rows.append(f"SELECT '{code}' AS model, {cells} FROM extreme_rows")
    joined = """
extreme_rows AS (
  SELECT p.*, t.* EXCLUDE (site) FROM parted p LEFT JOIN thresholds t ON p.site = t.site
  WHERE split = 'test' AND p.site <> 'S7')"""
    return with_sql("parted", " UNION ALL ".join(rows), _thresholds(level, "parted"), joined)


ORACLES["extreme_eval"] = _extreme_sql(0.03)
ORACLES["extreme_eval_1pct"] = _extreme_sql(0.01)
ORACLES["model_corr_limits"] = with_sql("parted", f"""
SELECT n, {r6('r')}, {r6('t')}
FROM (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (
      SELECT corr(partial_stdev, rmse) AS r, count(*) AS n FROM card
      WHERE partial_stdev BETWEEN {LIMITS['partial_stdev'][0]} AND {LIMITS['partial_stdev'][1]}
        AND rmse BETWEEN {LIMITS['rmse'][0]} AND {LIMITS['rmse'][1]}))""", _TEST, _long("test"), _CARD)


def _boxes_sql(level: float) -> str:
    return f"""
SELECT {level}::DOUBLE AS level, model, count(*) AS n, count(*) FILTER (NOT inside) AS outliers,
       {r6('min(rmse) FILTER (inside)', 'ymin')}, {', '.join(r6(c) for c in ('lower', 'middle', 'upper'))},
       {r6('max(rmse) FILTER (inside)', 'ymax')}
FROM (SELECT *, rmse BETWEEN lower - 1.5 * (upper - lower) AND upper + 1.5 * (upper - lower) AS inside FROM (
      SELECT *, quantile_cont(rmse, 0.25) OVER m AS lower, quantile_cont(rmse, 0.5) OVER m AS middle,
             quantile_cont(rmse, 0.75) OVER m AS upper
      FROM (UNPIVOT ({_extreme_sql(level, exact=True)}) ON {', '.join(S.EXTREME_NAMES)} INTO NAME extreme VALUE rmse)
      WINDOW m AS (PARTITION BY model)))
GROUP BY model, lower, middle, upper"""


ORACLES["extreme_boxes"] = " UNION ALL ".join(f"SELECT * FROM ({_boxes_sql(level)})" for level in (0.01, 0.03))
ORACLES["median_impute"] = with_sql("sat", f"""
SELECT site, obs_date, {', '.join(r6(f'coalesce({c}, {c}_median)', f'{c}_filled') for c in FILLED)}
FROM parted CROSS JOIN medians""", split_sql("parted", "sat"), f"""
medians AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}_median' for c in FILLED)}
            FROM parted WHERE split = 'train')""")


def _damped(column: str, share: float) -> str:
    return _rmse(f"(LE_CORR + ({column} - LE_CORR) * {share!r})")


_MTRY = ", ".join(_damped("LE_CORR_RF", 0.5 + 0.1 * abs(m - 6)) for m in range(1, 10))
_FRH = "LE_CORR_hybrid_PMRH_Frh"
ORACLES["rmse_improvement"] = with_sql("parted", f"""
SELECT 'a' AS ImprovementType, {r6('p500 - p100', 'ImprovementValue')} FROM errors
UNION ALL SELECT 'b', {r6('least_mtry - mtry3', 'ImprovementValue')} FROM errors
UNION ALL SELECT 'c', {r6('h100 - p100', 'ImprovementValue')} FROM errors""", f"""
errors AS (
  SELECT round({_damped('LE_CORR_RF', 1.0)}, 6) AS p100, round({_damped('LE_CORR_RF', 0.9)}, 6) AS p500,
         round({_damped(_FRH, 1.0)}, 6) AS h100,
         round({_damped('LE_CORR_RF', 0.5 + 0.1 * 3)}, 6) AS mtry3, round(least({_MTRY}), 6) AS least_mtry
  FROM parted WHERE split = 'train')""")

# ---------------------------------------------------------------- forests


def _predictors(model) -> list[str]:
    return S.PREDICTORS_WITH_ENERGY if model is PURE else S.PREDICTORS


_TARGETS = [m.target for m in MODELS]
ORACLES["rf_fit"] = with_sql("parted", " UNION ALL ".join(f"""
SELECT '{m.name}' AS models, '{m.target}' AS target, count({m.target}) FILTER (split = 'train') AS n_train,
       count(*) FILTER (split = 'test') AS n_test, {r6(f"stddev_pop({m.target}) FILTER (split = 'train')", 'spread')},
       true AS learns, true AS complete, true AS same_when_loaded
FROM parted""" for m in MODELS))
ORACLES["rf_predict"] = with_sql("parted", f"""
SELECT site, obs_date, split, LE_CORR, true AS learnt, true AS physics_PT, true AS physics_Penman, true AS physics_PMkc
FROM parted""")
ORACLES["fold_sizes"] = with_sql("parted", """
SELECT quarter, fold, ((n * (fold + 1)) // 3 - (n * fold) // 3)::BIGINT AS n FROM (
  SELECT 1 + (LE_CORR > a)::INT + (LE_CORR > b)::INT + (LE_CORR > c)::INT AS quarter, count(*) AS n
  FROM parted, (SELECT quantile_cont(LE_CORR, 0.25) AS a, quantile_cont(LE_CORR, 0.5) AS b, quantile_cont(LE_CORR, 0.75) AS c
                FROM parted WHERE split = 'train')
  WHERE split = 'train' GROUP BY 1), (SELECT unnest([0, 1, 2]) AS fold)""")
ORACLES["rf_cv_mtry"] = with_sql("parted", " UNION ALL ".join(f"""
SELECT '{m.target}' AS target, unnest(range(1, {len(_predictors(m)) + 1}))::INT AS mtry, n, spread, true AS learns
FROM (SELECT count({m.target}) AS n, {r6(f"stddev_pop({m.target})", 'spread')} FROM parted WHERE split = 'train')""" for m in MODELS))
ORACLES["best_mtry"] = with_sql("parted", """
SELECT 'made' AS target, min_by(mtry, (rmse, mtry)) AS mtry, min(rmse) AS rmse, true AS least FROM made
UNION ALL """ + " UNION ALL ".join(f"SELECT '{t}', NULL, NULL, true" for t in _TARGETS), f"""
made AS (""" + " UNION ALL ".join(
    f"SELECT {m} AS mtry, round({_damped('LE_CORR_RF', 0.5 + 0.1 * abs(m - 6))}, 6) AS rmse FROM parted WHERE split = 'train'"
    for m in range(1, 10)) + ")")
ORACLES["cap_sweep"] = (
    f"SELECT row_number() OVER (ORDER BY percentile) AS \"row\", *, true AS scored FROM ({ORACLES['cap_grid']})"
)
ORACLES["rmse_by_ntree"] = (
    f"SELECT unnest([100, 500])::INT AS ntree, {', '.join(f'true AS {m.short}' for m in MODELS)}, true AS learns"
)
ORACLES["permutation_importance"] = " UNION ALL ".join(
    f"SELECT '{m.target}' AS target, unnest({_predictors(m)!r}) AS variable, true AS measured" for m in MODELS
)
_LABELS = ", ".join(f"('{v}', '{n}', '{c}')" for v, (n, c) in S.PREDICTOR_LABELS.items())
ORACLES["importance_ranked"] = with_sql("parted", f"""
SELECT 'made' AS target, variable, varnames, category, row_number() OVER (ORDER BY Overall DESC, varnames)::INT AS place
FROM made JOIN labels USING (variable)
UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{m.target}', variable, varnames, category, NULL FROM labels WHERE variable IN ({', '.join(map(repr, _predictors(m)))})"
    for m in MODELS), f"""
labels(variable, varnames, category) AS (VALUES {_LABELS})""", """
made AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round(avg({c}), 6) AS Overall FROM parted WHERE split = 'train'" for c in S.PREDICTORS_WITH_ENERGY) + ")")

_TRAIN = "FROM parted WHERE split = 'train'"
ORACLES["rf_seeded"] = with_sql("parted", "SELECT split, count(*) AS n, count(*) AS n_equal FROM parted GROUP BY split")
ORACLES["rmse_improvement_fits"] = with_sql("parted", f"""
SELECT ImprovementType, n, spread, true AS within, CASE WHEN ImprovementType = 'b' THEN true END AS no_worse
FROM (SELECT unnest(['a', 'b', 'c']) AS ImprovementType, n, spread
      FROM (SELECT count(LE_CORR) AS n, {r6("stddev_pop(LE_CORR)", "spread")} {_TRAIN}))""")
ORACLES["oob_importance"] = with_sql("parted", f"""
SELECT variable, n, variable <> 'driver' AS below_driver, CASE WHEN variable = 'noise' THEN true END AS noise_is_small
FROM (SELECT unnest({[*S.PREDICTORS_WITH_ENERGY, 'driver', 'noise']!r}) AS variable, count(*) AS n {_TRAIN})""")
