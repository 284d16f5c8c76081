"""Column roles and analysis parameters, read from the schema without a data pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)


def roles(df: DataFrame) -> Roles:
    found = Roles()
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            found.numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)):
            found.categorical.append(f.name)
        elif isinstance(f.dataType, DATETIME_TYPES):
            found.datetime.append(f.name)
        elif isinstance(f.dataType, T.BooleanType):
            found.boolean.append(f.name)
        else:
            found.other.append(f.name)
    return found


def quoted(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as a double in which NaN counts as missing."""
    c = quoted(name).cast("double")
    return F.when(~F.isnan(c), c)


# Accepted spellings of the parameters (fixed values).
ALIASES = {
    "target": "target_column",
    "features": "feature_columns",
    "groupby": "group_column",
    "focus_column": "group_column",
    "date_col": "date_column",
}


def normalise_params(params: dict | None, columns: list[str]) -> dict:
    """One spelling per parameter; names of columns the table lacks are dropped."""
    out: dict = {}
    for key, value in (params or {}).items():
        name = ALIASES.get(key, key)
        if value is None or name in out:
            continue
        if name == "feature_columns":
            value = [value] if isinstance(value, str) else list(value)
            value = [c for c in value if c in columns]
            if not value:
                continue
        elif name in ("target_column", "group_column", "date_column", "filter_column"):
            if value not in columns:
                continue
        out[name] = value
    return out


def feature_list(df: DataFrame, params: dict) -> list[str]:
    """Chosen features, or every numeric column."""
    return list(params.get("feature_columns") or roles(df).numeric)


# Keywords that name a transaction id and an item (fixed values).
TRANSACTION_WORDS = ["transactionid", "orderid", "basketid", "invoiceno", "invoiceid", "tid"]
ITEM_WORDS = ["item", "product", "productname", "itemname", "description", "stockcode"]


def keyword_columns(columns: list[str], words: list[str]) -> list[str]:
    """Columns whose squeezed lower-case name contains one of the words."""
    squeezed = {c: c.lower().replace("_", "").replace(" ", "") for c in columns}
    return [c for c, flat in squeezed.items() if any(w in flat for w in words)]
