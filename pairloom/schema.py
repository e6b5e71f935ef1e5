"""Column layout of the tables that operators exchange."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One labelled interval, half-open: site_id tells rows apart and breaks ties of the order.
SITE = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("contig", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("strand", T.StringType()),
    ]
)
ANCHORS = ("inner", "outer", "center")


@dataclass(frozen=True)
class Window:
    """Which two sites form a pair, and how pairs are counted."""

    min_dist: int = 0
    max_dist: int = 100
    min_overlap: float = 0
    max_overlap: float = 0
    anchor: str = "inner"
    directional: bool = False
    stranded: bool = False
    binarize: bool = False
    #: Width of the bins of the join, if it is known; any width gives the same pairs.
    width: int | None = None

    def __post_init__(self):
        if self.anchor not in ANCHORS:
            raise ValueError(f"anchor must be one of {', '.join(ANCHORS)}")
        if self.min_dist > self.max_dist:
            raise ValueError("min_dist is larger than max_dist")
        if not 0 <= self.min_overlap <= self.max_overlap <= 1:
            raise ValueError("overlaps must be shares, the least not above the most")

    def but(self, **changes) -> Window:
        return replace(self, **changes)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has all these columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def one_of(value: str, allowed, what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(map(str, allowed))}, not {value!r}")
    return value


def pair_name(a: str | Column = "name1", b: str | Column = "name2") -> Column:
    return F.concat_ws("-", a, b)


def stranded_names(sites: DataFrame) -> DataFrame:
    """Labels become name(strand)."""
    return sites.withColumn("name", F.format_string("%s(%s)", "name", "strand"))
