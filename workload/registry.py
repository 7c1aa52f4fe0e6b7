"""Registration of queries: a Spark function beside the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from workload.oracle import rounded, with_ctes
from workload.tables import Workload

QUERIES: dict[str, Callable[[Workload], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dbl: str = ""):
    """`dbl` names the floating columns of the SQL; both sides round them to six places."""

    def register(fn: Callable[[Workload], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(rounded(sql, dbl))
        return fn

    return register


def finish(df: DataFrame) -> DataFrame:
    """Floating sums differ in the last digits between engines, so results are shown rounded."""

    def shown(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            return F.round(c, 6).alias(field.name)
        if isinstance(field.dataType, (ByteType, ShortType, IntegerType)):
            return c.cast("long").alias(field.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])
