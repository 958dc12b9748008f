"""A1: CSV with types found from the data, and the rows that do not fit them.

Every column is read as a string. One wide aggregate counts, per column, its values and how many of them parse as
long, double or boolean; the counts merge like any sum, so the pass is one scan with map-side combine and one row of
counts reaches the driver. A column takes the narrowest kind that all its values (but for ``tolerance``) fit, and is cast with ``try_cast``.
A row is rejected if its number of fields is wrong, or if a value does not fit its column's type;
rejected rows keep their raw line or values and say why.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: texts read as missing ----
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
           "None", "n/a", "nan", "null")
# ---- end of fixed values ----

_RAW = "_raw_line"
_LONG = r"^[+-]?[0-9]+$"
_DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"^[+-]?[iI]nf(inity)?$"
_BOOLEAN = r"^(true|True|TRUE|false|False|FALSE)$"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def present(column: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """The value without blanks around it, NULL where it is a text for missing."""
    v = F.trim(column)
    return F.when(~v.isin(*missing), v)


def parsed(value: Column, kind: T.DataType) -> Column:
    """A present string as ``kind``, NULL where it does not parse (no truncation, no type suffixes)."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        infinite = F.when(value.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))).cast(kind)
        return F.when(value.rlike(_DOUBLE), value.try_cast(kind)).when(value.rlike(_INFINITE), infinite)
    if isinstance(kind, T.IntegralType):
        return F.when(value.rlike(_LONG), value.try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.when(value.rlike(_BOOLEAN), value.try_cast(kind))
    return value.try_cast(kind)


@dataclass(frozen=True)
class ColumnCounts:
    """What a column's values parse as; counts of two parts of a table add up."""
    values: int
    longs: int
    doubles: int
    booleans: int

    def __add__(self, other: ColumnCounts) -> ColumnCounts:
        return ColumnCounts(self.values + other.values, self.longs + other.longs, self.doubles + other.doubles, self.booleans + other.booleans)

    def kind(self, tolerance: float = 0.0) -> T.DataType:
        """The narrowest type that all values but a share of ``tolerance`` fit; a column without values is double."""
        enough = self.values * (1.0 - tolerance)
        for n, kind in ((self.longs, T.LongType()), (self.doubles, T.DoubleType()), (self.booleans, T.BooleanType())):
            if n >= enough:
                return kind if self.values else T.DoubleType()
        return T.StringType()


def column_counts(strings: DataFrame, missing: tuple[str, ...] = MISSING) -> dict[str, ColumnCounts]:
    """Counts of every column from one aggregate over the table.

    A value is tried as long, double and boolean until one fits: a long is a double too, and no boolean is a number.
    """
    names, aggs = strings.columns, []
    texts = strings.select(*[present(F.col(_quoted(n)), missing).alias(f"t{i}") for i, n in enumerate(names)])

    def fits(i: int) -> Column:
        v = F.col(f"t{i}")
        code = F.when(v.isNull(), F.lit(None))
        for k, kind in enumerate((T.LongType(), T.DoubleType(), T.BooleanType()), 1):
            code = code.when(parsed(v, kind).isNotNull(), F.lit(k))
        return code.otherwise(F.lit(0)).alias(f"k{i}")

    coded = texts.select(*[fits(i) for i in range(len(names))])
    for i in range(len(names)):
        k = F.col(f"k{i}")
        aggs += [F.count(k).alias(f"v{i}"), F.count_if(k == 1).alias(f"l{i}"), F.count_if(k.isin(1, 2)).alias(f"d{i}"), F.count_if(k == 3).alias(f"b{i}")]
    row = coded.agg(*aggs).first() if aggs else None
    return {name: ColumnCounts(row[f"v{i}"], row[f"l{i}"], row[f"d{i}"], row[f"b{i}"]) for i, name in enumerate(names)}


def read_strings(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as strings under the header's names, and the raw line of rows with a wrong number of fields (else NULL).

    Every field is parsed whichever columns are asked for, so that the same rows count as whole in every query. Files whose headers
    differ are refused. A quoted field may hold line ends only with ``multiline``, whose files cannot be split.
    """
    options = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False, "multiLine": multiline,
               "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW, "columnPruning": False}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW]])
    return spark.read.options(**options).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, tolerance: float = 0.0,
             missing: tuple[str, ...] = MISSING, multiline: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): typed rows, and (row, column, value, reason) of rows that do not fit, one for each misfit.

    Types come from ``schema`` for the columns it names and from the data for the rest. ``tolerance`` is the share of a column's values that
    may fail to parse before the column is taken for text; those rows are rejected. ``strict`` rows fail their job on the first row
    that does not fit. The pass that finds types is the only job this starts.
    """
    if not 0.0 <= tolerance < 1.0:
        raise ValueError("tolerance must be in [0, 1)")
    raw = read_strings(spark, path, multiline)
    whole = F.col(_RAW).isNull()
    names = [c for c in raw.columns if c != _RAW]
    declared = _as_struct(spark, schema)
    unknown = [f.name for f in declared.fields if f.name not in names]
    if unknown:
        raise ValueError(f"columns of the schema are not in {path}: {', '.join(unknown)}")
    kinds = {f.name: f.dataType for f in declared.fields}
    free = [n for n in names if n not in kinds]
    counted: set[str] = set()                                # every value was seen to fit
    if free:
        # the raw column stays in the plan: without it the parser would skip the fields nobody asked for, and miss wrong rows
        counts = column_counts(raw.where(whole).select(*[F.col(_quoted(n)) for n in free]), missing)
        kinds |= {n: counts[n].kind(tolerance) for n in free}
        fitting = {T.LongType(): "longs", T.DoubleType(): "doubles", T.BooleanType(): "booleans"}
        counted = {n for n in free if kinds[n] in fitting and getattr(counts[n], fitting[kinds[n]]) == counts[n].values}
    text = {n: present(F.col(_quoted(n)), missing) for n in names}
    cast = {n: text[n] if isinstance(kinds[n], T.StringType) else parsed(text[n], kinds[n]) for n in names}
    misfits = {n: text[n].isNotNull() & cast[n].isNull() for n in names if not isinstance(kinds[n], T.StringType)}
    fits = whole
    for n, misfit in misfits.items():
        # strict rows are not parsed a second time to see what the counts have shown; should the file have changed since, the value itself fails
        fits = fits if strict and n in counted else fits & ~misfit
    line = F.coalesce(F.col(_RAW), F.to_csv(F.struct(*[F.col(_quoted(n)) for n in names])))
    kept = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"row of {path} does not fit: "), line)).cast("boolean")) if strict else fits
    failed = {n: F.when(text[n].isNotNull(), F.raise_error(F.concat(F.lit(f"row of {path} does not fit: "), line))).cast(kinds[n]) for n in counted}
    rows = raw.where(kept).select(*[(F.coalesce(cast[n], failed[n]) if strict and n in counted else cast[n]).alias(n) for n in names])
    reasons = [F.when(~whole, F.struct(F.lit(None).cast("string").alias("column"), F.col(_RAW).alias("value"), F.lit("number of fields").alias("reason")))]
    reasons += [F.when(whole & misfit, F.struct(F.lit(n).alias("column"), F.col(_quoted(n)).alias("value"),
                                                F.lit(f"not a {kinds[n].simpleString()}").alias("reason"))) for n, misfit in misfits.items()]
    rejected = raw.where(~fits).select(line.alias("row"), F.explode(F.array_compact(F.array(*reasons))).alias("r")).select("row", "r.*")
    return rows, rejected


def _as_struct(spark: SparkSession, schema: T.StructType | str | None) -> T.StructType:
    if schema is None:
        return T.StructType([])
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
