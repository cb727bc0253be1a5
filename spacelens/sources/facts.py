"""Sales-fact source: role binding, schema assertion, numeric coercion, text trimming."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_ROLES = (
    "brand", "company", "ingredient_desc", "plain_combination", "segment", "sub_segment",
    "molecule_class", "subgroup", "dosage_form", "ownership",
)
MEASURE_ROLES = (
    "value_t0", "value_t1", "value_t2", "cp_t0", "cp_t1", "cp_t2", "qty_t0", "qty_t1", "qty_t2",
    "month_1", "month_2", "month_3",
)

# Source columns of a sales-audit extract and the role each one plays.
AUDIT_ROLES = {
    "brand": "BRANDS",
    "company": "COMPANY",
    "ingredient_desc": "MOLECULE_DESC",
    "plain_combination": "Plain/Combination",
    "segment": "CARDIAC SEGMENT",
    "sub_segment": "CARDIAC SUB SEGMENTS",
    "molecule_class": "GROUP",
    "subgroup": "SUBGROUP",
    "dosage_form": "FINAL NFC",
    "ownership": "INDIAN_MNC",
    "value_t0": "MAT FEB'24",
    "value_t1": "MAT FEB'25",
    "value_t2": "MAT FEB'26",
    "cp_t0": "MAT CP FEB'24",
    "cp_t1": "MAT CP FEB'25",
    "cp_t2": "MAT CP FEB'26",
    "qty_t0": "QTY MAT FEB'24",
    "qty_t1": "QTY MAT FEB'25",
    "qty_t2": "QTY MAT FEB'26",
    "month_1": "Sales 'DEC'25",
    "month_2": "Sales 'JAN'26",
    "month_3": "Sales 'FEB'26",
}
AUDIT_EXTRA_COLUMNS = (
    "KEY(MS+SG+FINAL NFC)", "STRENGTH (ONLY 1 MOL.)", "PACK_DESC", "SUPERGROUP", "ACUTE_CHRONIC",
    "PR_DEC'25", "PR_JAN'26", "PR_FEB'26",
)
NUMERIC_PREFIXES = ("MAT", "Sales", "QTY", "PR_")
# End of fixed values.
AUDIT_REQUIRED = (*AUDIT_ROLES.values(), *AUDIT_EXTRA_COLUMNS)


class SchemaError(ValueError):
    """The fact source lacks required columns or rows."""


def _q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def assert_columns(df: DataFrame, required) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError("missing required columns: " + ", ".join(missing))
    return df


def assert_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise SchemaError("the fact source has no rows")
    return df


#: What counts as a number in a text cell: digits with an optional point and exponent, or infinity.
#: Suffixed ("1d"), hexadecimal and not-a-number texts do not.
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"


def _number(name: str, dtype: T.DataType):
    """The cell as a number; null where it holds none."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(_q(name), F.lit(None).cast(dtype))
    if isinstance(dtype, T.NumericType):
        return _q(name)
    text = F.trim(_q(name).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Text to double; unparseable, not-a-number and null become 0. Numeric columns keep their type."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    wanted = set(columns)
    return df.select(
        *[
            F.coalesce(_number(c, dtypes[c]), F.lit(0)).alias(c) if c in wanted else _q(c)
            for c in df.columns
        ]
    )


def coercion_report(df: DataFrame, columns) -> DataFrame:
    """One row per column: cells that hold something but not a number."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    counts = df.select(
        *[
            F.count_if(_q(c).isNotNull() & _number(c, dtypes[c]).isNull()).alias(f"n{i}")
            for i, c in enumerate(columns)
        ]
    )
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("unparseable"))
             for i, c in enumerate(columns)]
    return counts.select(F.inline(F.array(*pairs)))


def trim_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            strip(_q(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else _q(f.name)
            for f in df.schema.fields
        ]
    )


def bind_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Rename source columns to roles; measures coerced, text trimmed, a row_id if none is bound."""
    assert_columns(df, roles.values())
    bound = df.select(*[_q(source).alias(role) for role, source in roles.items()])
    bound = trim_text(coerce_numeric(bound, [m for m in MEASURE_ROLES if m in roles]))
    if "row_id" not in roles:
        # Taken right on the scan, where it is stable under task retries; keeps exact duplicates apart.
        bound = bound.withColumn("row_id", F.monotonically_increasing_id())
    return bound


def read_facts(
    spark: SparkSession,
    path: str,
    roles: Mapping[str, str] = AUDIT_ROLES,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    required=None,
) -> DataFrame:
    """Read, check and bind a fact table stored as parquet, csv, orc or json."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    raw = trim_header(reader.load(path))
    assert_columns(raw, list(required if required is not None else roles.values()))
    return bind_roles(assert_rows(raw), roles)


def audit_numeric_columns(df: DataFrame) -> list[str]:
    """Columns of an audit extract that must hold numbers, by their prefix."""
    return [c for c in df.columns if c.startswith(NUMERIC_PREFIXES)]


def read_audit(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An audit extract in its published layout: every published column must be there."""
    return read_facts(spark, path, AUDIT_ROLES, fmt, required=AUDIT_REQUIRED)


def recent_sales():
    return reduce(lambda a, b: a + b, [F.col(f"month_{i}") for i in (1, 2, 3)])
