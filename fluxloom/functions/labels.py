"""Class, model and metric labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: land-cover group of each listed class, everything else is wetland ----
LAND_COVER_GROUPS = {"OSH/CSH": ["OSH", "CSH"], "CRO": ["CRO"], "DBF/ENF": ["DBF", "ENF"], "GRA": ["GRA"]}
OTHER_GROUP = "WET"

# ---- fixed values: plot-math text of each model ----
MODEL_MARKUP = {
    "Pure-ML": "italic('Pure-ML ')",
    "H-Penman": "italic('H-Penman ')",
    "H-PT": "italic('H-PT  ')",
    "H-PM-Kc": "italic('H-PM-' * K[c])",
    "H-PM-gs": "italic('H-PM-' * g[s])",
    "H-PMRH-drh": "italic('H-'* PM[RH]*'-'*d[RH])",
    "H-PMRH-Frh": "italic('H-'* PM[RH]*'-'*F[RH])",
}


def land_cover_group(igbp: Column) -> Column:
    """Group label of a land-cover class; a null class stays null."""
    label = F.when(igbp.isNull(), F.lit(None).cast("string"))
    for group, members in LAND_COVER_GROUPS.items():
        label = label.when(igbp.isin(members), F.lit(group))
    return label.otherwise(F.lit(OTHER_GROUP))


def group_with_count(group: Column, sites: Column) -> Column:
    """Label such as ``CRO (n = 7)``."""
    return F.format_string("%s (n = %d)", group, sites)


def model_markup(model: Column) -> Column:
    """Plot-math text of a model name; an unknown name gives null."""
    label = None
    for name, text in MODEL_MARKUP.items():
        condition, value = model == name, F.lit(text)
        label = F.when(condition, value) if label is None else label.when(condition, value)
    return label


def rmse_label(value: Column) -> Column:
    return F.format_string("RMSE = %.2f", value)


def ratio_label(value: Column) -> Column:
    return F.format_string("sigma[m]/sigma[o] == %.3f", value)
