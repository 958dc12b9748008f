"""Column -> Column scalar expressions (all JVM-side, codegen friendly).

Null rules follow the pandas pipeline: a comparison on a missing value
is *false* (not NULL) wherever the result is then counted or averaged,
and every data-dependent division goes through ``try_divide`` because
ANSI mode raises on x/0 even for doubles.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's -------------------------
# Bureau monthly status codes that count as "days past due".
PAST_DUE_STATUSES = ["1", "2", "3", "4", "5"]

# Age bands: (low inclusive, high exclusive, label).
AGE_BANDS = [
    (0, 25, "<25"),
    (25, 35, "25-35"),
    (35, 45, "35-45"),
    (45, 55, "45-55"),
    (55, 65, "55-65"),
    (65, 120, "65+"),
]

# Column-name feature groups; ordered, first regex *search* hit wins.
FEATURE_GROUP_RULES = [
    ("amount", "^AMT_"),
    ("days", "^DAYS_"),
    ("name", "^NAME_"),
    ("code", "^CODE_"),
    ("flag", "^FLAG_"),
    ("count", "^CNT_"),
    ("region", "^REG_"),
    ("ext_source", "^EXT_SOURCE"),
    ("bureau", "BUREAU"),
    ("document", "DOCUMENT"),
    ("other", ".*"),
]

# Importance groups over the upper-cased feature name, checked in this order.
IMPORTANCE_GROUP_RULES = [
    ("External Bureau", "contains", ["EXT_SOURCE"]),
    ("Loan Amounts", "startswith", ["AMT"]),
    ("Temporal / Age", "startswith", ["DAYS"]),
    ("Demographics", "contains", ["NAME_", "CODE_", "GENDER", "EDUCATION", "OCCUPATION",
                                  "FAMILY", "HOUSING", "ORGANIZATION", "TYPE"]),
    ("Geography", "contains", ["REGION", "CITY", "RATING"]),
    ("Flags", "contains", ["FLAG_", "OWN_", "REG_", "LIVE_"]),
]
IMPORTANCE_GROUP_DEFAULT = "Other"

# Missing-rate severity cut points (strictly greater than).
SEVERITY_HIGH = 0.5
SEVERITY_MEDIUM = 0.2
# ---------------------------------------------------------------------------


def rround(x, digits: int = 6) -> Column:
    """Contract rounding: snap to 9 decimals, then half-up to ``digits``.

    The snap removes float summation noise (which depends on partitioning)
    before the decisive rounding, so a value whose exact result sits on a
    half rounds the same way on every cluster layout.
    """
    return F.round(F.round(_c(x), 9), digits)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b) -> Column:
    """A / b, NULL where b is 0 or NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def past_due_flag(status) -> Column:
    """1 when the status (as text) is one of the past-due codes, else 0 (NULL -> 0)."""
    return F.coalesce(_c(status).cast("string").isin(*PAST_DUE_STATUSES), F.lit(False)).cast("int")


def days_past_due(entry, due) -> Column:
    """max(entry - due, 0); NULL if either side is NULL (unlike ``greatest``)."""
    d = _c(entry) - _c(due)
    return F.when(d < 0, F.lit(0)).otherwise(d)


def is_late(dpd) -> Column:
    """1 when days past due > 0; missing counts as on time (0)."""
    return F.coalesce(_c(dpd) > 0, F.lit(False)).cast("int")


def payment_shortfall(paid, due) -> Column:
    """C4: max(1 - paid/due, 0); NULL when due is 0 or NULL."""
    s = F.lit(1.0) - safe_div(paid, due)
    return F.when(s < 0, F.lit(0.0)).otherwise(s)


def utilization(balance, limit) -> Column:
    """Balance / limit via safe_div."""
    return safe_div(balance, limit)


def age_years(days_birth) -> Column:
    """round(-days / 365.25, 1)."""
    return rround(-_c(days_birth) / F.lit(365.25), 1)


def age_band(age) -> Column:
    """Half-open age bands on the (rounded) age; outside or NULL -> NULL."""
    a = _c(age)
    expr = None
    for lo, hi, label in AGE_BANDS:
        cond = (a >= lo) & (a < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def feature_group(name, rules: list[tuple[str, str]] | None = None) -> Column:
    """First matching regex (search semantics) over the column-name column; rules: (group, pattern) in order."""
    rules = FEATURE_GROUP_RULES if rules is None else rules
    for rule in rules:
        if not (isinstance(rule, (tuple, list)) and len(rule) == 2 and all(isinstance(x, str) and x for x in rule)):
            raise ValueError(f"a feature-group rule is a (group, pattern) pair of strings, not {rule!r}")
        try:
            re.compile(rule[1])
        except re.error as exc:
            raise ValueError(f"pattern {rule[1]!r} of feature group {rule[0]!r}: {exc}") from exc
    n, expr = _c(name), F.lit("other")
    for group, pattern in reversed(rules):
        expr = F.when(n.rlike(pattern), F.lit(group)).otherwise(expr)
    return expr


def importance_group(name) -> Column:
    """C11: ordered prefix/substring rules over the upper-cased feature name."""
    u = F.upper(_c(name))
    expr = None
    for group, kind, keys in IMPORTANCE_GROUP_RULES:
        conds = [u.contains(k) if kind == "contains" else u.startswith(k) for k in keys]
        cond = conds[0]
        for c in conds[1:]:
            cond = cond | c
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    return expr.otherwise(F.lit(IMPORTANCE_GROUP_DEFAULT))


def approve(p, threshold: float) -> Column:
    """Approved when score < threshold."""
    return _c(p) < F.lit(float(threshold))


def predicted_default(p, threshold: float) -> Column:
    """Predicted default when score >= threshold (exact complement of approve)."""
    return _c(p) >= F.lit(float(threshold))


def missing_severity(rate) -> Column:
    """C14: >0.5 high, >0.2 medium, else low."""
    r = _c(rate)
    return (F.when(r > SEVERITY_HIGH, F.lit("high"))
             .when(r > SEVERITY_MEDIUM, F.lit("medium")).otherwise(F.lit("low")))


def clean_feature_name(name) -> Column:
    """Strip a leading ``num__`` / ``cat__`` stage prefix."""
    return F.regexp_replace(_c(name), r"^(num__|cat__)", "")


def corr_direction(corr) -> Column:
    """>0 raises risk, otherwise lowers risk."""
    return F.when(_c(corr) > 0, F.lit("raises risk")).otherwise(F.lit("lowers risk"))
