"""Registry of named queries, each with the SQL that computes the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordering import running_sum

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


class Tables:
    """Lazy access to the input tables: ``t.events`` reads ``<dir>/events.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is the check query, if SQL can say it."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.build = fn
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def turn_order(conversations: DataFrame, out: str = "key") -> DataFrame:
    """Place of every turn by conversation and turn, from 0 without gaps."""
    sizes = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    before = running_sum(sizes, "_n", "conv_id", out="_before").select("conv_id", "_before")
    inside = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return conversations.withColumn("_i", inside).join(before, "conv_id").withColumn(out, (F.col("_before") + F.col("_i") - 1).cast("bigint")).drop("_i", "_before")


# ---- helpers that say the same thing to Spark and to the check SQL ------------------------------------


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_rules(expr: str, rules: list[tuple[str, str, str]]) -> str:
    """The clean-up rules as nested SQL calls."""
    for kind, old, new in rules:
        if kind == "=":
            expr = f"replace({expr}, {sql_text(old)}, {sql_text(new)})"
        else:
            expr = f"regexp_replace({expr}, {sql_text(old)}, {sql_text(new.replace('$', chr(92)))}, 'g')"
    return expr


def fill(templates: list[str], which: str, small: str, big: str) -> Column:
    """Pick a template by ``which`` and put column values at ``@`` and ``#``."""
    choice = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col(which) % len(templates) + 1).cast("int"))
    out = F.replace(choice, F.lit("@"), F.col(small).cast("string"))
    return F.replace(out, F.lit("#"), F.col(big).cast("string"))


def sql_fill(templates: list[str], which: str, small: str, big: str) -> str:
    options = ", ".join(sql_text(t) for t in templates)
    picked = f"([{options}])[{which} % {len(templates)} + 1]"
    return f"replace(replace({picked}, '@', {small}::VARCHAR), '#', {big}::VARCHAR)"


def h32(c: Column) -> Column:
    """32-bit digest of a text as bigint."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def sql_h32(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"
