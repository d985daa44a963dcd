"""Tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternfold.errors import EmptyDataError, PatternError

#: An observation. Order within a series is idx; a missing value or label is null.
OBS = "series_id string, idx long, value double, value_str string, label string, ts double, raw string"
#: A pattern as the store holds it.
PATTERN = (
    "id string, series_id string, type string, features map<string,double>, sequence array<string>, relationships map<string,map<string,double>>, frequency long, first_seen long, "
    "last_seen long, occurrences array<long>, confidence double, similarity double, novelty double, context map<string,string>, metadata map<string,string>, state string"
)
#: Strings that stand for a missing value, in lower case.
MISSING = ("", "none", "null", "nan", "na", "n/a", "?", "-")

KEY = "series_id"


def by_series(*order: str) -> Window:
    return Window.partitionBy(KEY).orderBy(*(order or ("idx",)))


def number(value: str | Column = "value") -> Column:
    """A number; NaN counts as missing, infinities stay."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c), c)


def finite(value: str | Column = "value") -> Column:
    """A finite number, else null."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null and NaN become ``low``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(c, F.lit(low)), F.lit(low))))


def observations(df: DataFrame, order: list[str], value: str | None = None, label: str | None = None, series: str | None = None, ts: str | None = None) -> DataFrame:
    """Any table as observations: idx counts rows of a series in the given order, which must be total."""
    key = F.col(series).cast("string") if series else F.lit("all")
    none = F.lit(None)
    v = F.col(value).cast("double") if value else none.cast("double")
    x = F.col(label).cast("string") if label else none.cast("string")
    t = F.col(ts).cast("double") if ts else none.cast("double")
    at = Window.partitionBy(key).orderBy(*order)
    return df.select(key.alias(KEY), (F.row_number().over(at) - 1).cast("long").alias("idx"), F.when(~F.isnan(v), v).alias("value"), none.cast("string").alias("value_str"), x.alias("label"), t.alias("ts"), none.cast("string").alias("raw"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has the columns and a row."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise PatternError(f"columns are missing: {', '.join(missing)}")
    if df.isEmpty():
        raise EmptyDataError("no observations")
    return df


def compressed(obs: DataFrame, column: str = "value", keep: Column | None = None) -> DataFrame:
    """Rows whose column is present, with pos counting them from 0 within their series."""
    rows = obs.where(number(column).isNotNull() if keep is None else keep)
    return rows.withColumn("pos", (F.row_number().over(by_series()) - 1).cast("long"))
