"""Reports over the fact tables: libraries, technology standards, schemas, evaluation, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.numbers import half_even
from weft.operators.capability import library_of

# Which libraries serve which purpose, across ecosystems.
CATEGORIES = {
    "messaging client": ("kafka-python", "confluent-kafka", "aiokafka", "kafkajs", "spring-kafka", "pika", "amqplib"),
    "http client": ("requests", "httpx", "urllib3", "axios", "node-fetch", "got", "spring-web", "okhttp", "feign"),
    "db access": ("psycopg2", "psycopg2-binary", "sqlalchemy", "spring-data-jpa", "hibernate", "pg", "mysql2", "mongoose", "sequelize", "prisma"),
    "test framework": ("pytest", "unittest", "junit", "junit-jupiter", "jest", "mocha", "vitest", "jasmine"),
    "web framework": ("flask", "fastapi", "django", "express", "koa", "nestjs", "react", "react-dom", "angular", "vue", "spring-boot"),
    "serialization": ("jackson", "gson", "pydantic", "marshmallow", "zod"),
    "auth / jwt": ("pyjwt", "python-jose", "jsonwebtoken", "java-jwt", "jose", "passport", "spring-security"),
}


def shared_dependencies(dependencies: DataFrame, owners: DataFrame, min_owners: int = 2) -> DataFrame:
    """(dependency, n_modules, n_owners) for libraries of two or more modules of enough owners, most used first."""
    used = dependencies.select("module_id", library_of(F.col("purl")).alias("dependency")).distinct()
    named = used.join(owners.select("module_id", "owner"), "module_id", "left")
    sums = named.groupBy("dependency").agg(F.count(F.lit(1)).alias("n_modules"), F.countDistinct(F.coalesce("owner", F.lit("unknown"))).alias("n_owners"))
    return sums.filter((F.col("n_modules") >= 2) & (F.col("n_owners") >= min_owners)).orderBy(F.desc("n_modules"), "dependency")


def histogram(modules: DataFrame, column: str) -> DataFrame:
    return modules.filter(F.length(F.coalesce(F.col(column), F.lit(""))) > 0).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def tech_standards(dependencies: DataFrame, categories: DataFrame, normalise: bool = False) -> DataFrame:
    """(category, standard, n_standard, fragmentation, outliers, n_outlier_modules) by fragmentation.

    categories has (category, library). The standard is the library of most modules, by name among equals.
    With normalise, - and _ count as one character."""
    same = lambda c: F.replace(c, F.lit("_"), F.lit("-")) if normalise else c
    used = dependencies.select("module_id", same(F.lower(library_of(F.col("purl")))).alias("library")).distinct()
    held = used.join(F.broadcast(categories.select("category", same(F.col("library")).alias("library"))), "library")
    counts = held.groupBy("category", "library").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("category").orderBy(F.desc("n"), "library")
    ranked = counts.withColumn("nth", F.row_number().over(first))
    standard = ranked.groupBy("category").agg(
        F.max(F.when(F.col("nth") == 1, F.col("library"))).alias("standard"), F.max("n").alias("n_standard"), F.count(F.lit(1)).alias("fragmentation"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.col("library")))), ",").alias("outliers"),
    )
    others = held.join(ranked.filter("nth > 1").select("category", "library"), ["category", "library"]).groupBy("category").agg(F.countDistinct("module_id").alias("n_outlier_modules"))
    return standard.join(others, "category", "left").withColumn("n_outlier_modules", F.coalesce("n_outlier_modules", F.lit(0))).orderBy(F.desc("fragmentation"), "category")


def category_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(x).alias("library")) for c, names in CATEGORIES.items() for x in names])
    return spark.range(1).select(F.inline(rows))


def shared_tables(facts: DataFrame) -> DataFrame:
    """(resource_id, n_modules) of tables that several modules touch."""
    return facts.filter("resource_type = 'SQL_TABLE'").groupBy("resource_id").agg(F.countDistinct("module_id").alias("n_modules")).filter("n_modules > 1")


def orphans(tables: DataFrame, foreign_keys: DataFrame, shared: DataFrame) -> DataFrame:
    """Tables that no foreign key touches and that no two modules share."""
    linked = foreign_keys.select(F.explode(F.array("child", "parent")).alias("table")).distinct()
    return tables.join(linked, "table", "left_anti").join(shared.select(F.col("resource_id").alias("table")), "table", "left_anti")


def evaluation(expected: DataFrame, got: DataFrame, gaps: DataFrame, by: str, *keys: str) -> DataFrame:
    """(by, n_expected, n_got, hits, precision, recall, resolution) over distinct rows of keys."""
    e = expected.select(by, *keys).distinct().withColumn("_e", F.lit(1))
    g = got.select(by, *keys).distinct().withColumn("_g", F.lit(1))
    joined = e.join(g, [by, *keys], "full").groupBy(by).agg(F.count("_e").alias("n_expected"), F.count("_g").alias("n_got"), F.count_if(F.col("_e").isNotNull() & F.col("_g").isNotNull()).alias("hits"))
    missing = gaps.groupBy(by).agg(F.count(F.lit(1)).alias("n_gaps"))
    ratio = lambda a, b, empty: F.when(b == 0, F.lit(empty)).otherwise(half_even(a / b, 2))
    n_gaps = F.coalesce("n_gaps", F.lit(0))
    return joined.join(missing, by, "left").select(
        by, "n_expected", "n_got", "hits", ratio(F.col("hits"), F.col("n_got"), 0.0).alias("precision"), ratio(F.col("hits"), F.col("n_expected"), 1.0).alias("recall"),
        ratio(F.col("n_got"), F.col("n_got") + n_gaps, 1.0).alias("resolution"),
    )


def missed_and_extra(expected: DataFrame, got: DataFrame, *keys: str) -> DataFrame:
    """Rows of one side only, with side `missed` or `extra`."""
    e, g = expected.select(*keys).distinct(), got.select(*keys).distinct()
    return e.join(g, [*keys], "left_anti").withColumn("side", F.lit("missed")).unionByName(g.join(e, [*keys], "left_anti").withColumn("side", F.lit("extra")))


def resolution_rate(n_facts: Column, n_gaps: Column) -> Column:
    """Resolved share in per cent; 100 where there was nothing to resolve."""
    return F.when(n_facts + n_gaps == 0, F.lit(100.0)).otherwise(n_facts / (n_facts + n_gaps) * 100)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def error_log(errors: DataFrame) -> DataFrame:
    """(seq, line): a numbered line for each error, in order of time; made for logs that people read."""
    order = Window.partitionBy(F.to_date("timestamp")).orderBy("timestamp", "source", "message")
    said = F.concat(F.lit("["), "severity", F.lit("] "), "phase", F.lit(" · "), "source", F.lit(": "), "message", F.lit(" ("), "error_type", F.lit(") → "), "remediation")
    return errors.select(F.to_date("timestamp").alias("day"), F.row_number().over(order).alias("seq"), said.alias("line"))


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
