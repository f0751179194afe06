"""The portfolio tables as views of the test tables, in Spark and in SQL.

Suppliers stand for modules, nations for owners (those with a key divisible by 5 are unknown), line items
for facts, parts for resources and libraries, the account balance for the coupling metric (negative: no
metric; in 1024ths, so that sums are exact in any order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, kind = F.col("l_returnflag"), F.col("l_linenumber") % 4
    http = kind == 3
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), "l_suppkey").alias("module_id"),
        F.when(http & flag.isin("A", "R"), "SERVES").when(http, "CALLS").when(flag == "A", "PRODUCES").when(flag == "N", "READS").otherwise("WRITES").alias("direction"),
        F.when(kind == 0, "KAFKA_TOPIC").when(kind == 1, "SQL_TABLE").when(kind == 2, "SQL_COLUMN").otherwise("HTTP_ENDPOINT").alias("resource_type"),
        F.concat(F.lit("r"), "l_partkey").alias("resource_id"), F.when(F.col("l_linestatus") == "F", "HIGH").otherwise("MED").alias("tier"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_seq"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select("n_nationkey", F.col("n_name").alias("owner"))
    return read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("m"), "s_suppkey").alias("module_id"), "owner")


def couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(F.concat(F.lit("m"), "s_suppkey").alias("module_id"), (F.floor(F.least(F.lit(1.0), F.col("s_acctbal") / 10000) * 1024) / 1024).alias("coupling"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("module_id"), F.concat(F.lit("p"), F.col("s_suppkey") % 50).alias("project_id"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = F.concat(F.lit("pkg:npm/lib"), F.col("l_partkey") % 40, F.lit("@1."), F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), "l_suppkey").alias("module_id"), lib.alias("purl"), F.when(F.col("l_returnflag") == "N", "test").otherwise("runtime").alias("scope"), F.lit("HIGH").alias("tier"))


CTES = {
    "facts": """facts AS (SELECT 'm' || l_suppkey AS module_id,
      CASE WHEN l_linenumber % 4 = 3 THEN CASE WHEN l_returnflag IN ('A', 'R') THEN 'SERVES' ELSE 'CALLS' END
           WHEN l_returnflag = 'A' THEN 'PRODUCES' WHEN l_returnflag = 'N' THEN 'READS' ELSE 'WRITES' END AS direction,
      CASE l_linenumber % 4 WHEN 0 THEN 'KAFKA_TOPIC' WHEN 1 THEN 'SQL_TABLE' WHEN 2 THEN 'SQL_COLUMN' ELSE 'HTTP_ENDPOINT' END AS resource_type,
      'r' || l_partkey AS resource_id, CASE l_linestatus WHEN 'F' THEN 'HIGH' ELSE 'MED' END AS tier,
      l_orderkey * 8 + l_linenumber AS fact_seq FROM lineitem)""",
    "owners": "owners AS (SELECT 'm' || s_suppkey AS module_id, n_name AS owner FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0)",
    "couplings": "couplings AS (SELECT 'm' || s_suppkey AS module_id, floor(least(1.0::DOUBLE, s_acctbal / 10000) * 1024) / 1024 AS coupling FROM supplier WHERE s_acctbal >= 0)",
    "modules": "modules AS (SELECT 'm' || s_suppkey AS module_id, 'p' || (s_suppkey % 50) AS project_id FROM supplier)",
    "dependencies": "dependencies AS (SELECT 'm' || l_suppkey AS module_id, 'pkg:npm/lib' || (l_partkey % 40) || '@1.' || l_linenumber AS purl, CASE l_returnflag WHEN 'N' THEN 'test' ELSE 'runtime' END AS scope, 'HIGH' AS tier FROM lineitem)",
    "touch": """touch AS (SELECT * FROM (SELECT *, CASE tier WHEN 'HIGH' THEN 3 WHEN 'MED' THEN 2 ELSE 1 END AS rank,
      row_number() OVER (PARTITION BY resource_type, resource_id, module_id ORDER BY CASE tier WHEN 'HIGH' THEN 3 WHEN 'MED' THEN 2 ELSE 1 END DESC, fact_seq,
        CASE direction WHEN 'PRODUCES' THEN 0 WHEN 'CONSUMES' THEN 1 WHEN 'READS' THEN 2 WHEN 'WRITES' THEN 3 WHEN 'CALLS' THEN 4 ELSE 5 END) AS rn FROM facts) WHERE rn = 1)""",
    "members": "members AS (SELECT t.*, coalesce(o.owner, 'unknown') AS owner, c.coupling FROM touch t LEFT JOIN owners o USING (module_id) LEFT JOIN couplings c USING (module_id))",
    "sums": """sums AS (SELECT resource_type, resource_id, count(*) AS n_members, count(DISTINCT owner) AS n_owners, max(rank) AS rank, round_even(avg(coupling), 3) AS coupling,
      count(*) FILTER (direction = 'PRODUCES') AS produces, count(*) FILTER (direction = 'WRITES') AS writes, count(*) FILTER (direction = 'SERVES') AS serves,
      CASE resource_type WHEN 'KAFKA_TOPIC' THEN 'messaging' WHEN 'SQL_TABLE' THEN 'data' WHEN 'SQL_COLUMN' THEN 'column' ELSE 'api' END AS dimension
      FROM members GROUP BY resource_type, resource_id HAVING count(*) >= 2)""",
    "caps": """caps AS (SELECT dimension || ':' || resource_id AS id, dimension,
      CASE dimension WHEN 'messaging' THEN CASE WHEN produces = n_members THEN 'Publishes ' ELSE 'Topic ' END || resource_id
        WHEN 'data' THEN CASE WHEN writes = n_members THEN 'Writes ' ELSE 'Table ' END || resource_id
        WHEN 'column' THEN 'Column ' || resource_id ELSE CASE WHEN serves = n_members THEN 'Serves ' ELSE 'Endpoint ' END || resource_id END AS label,
      n_members, n_owners, CASE rank WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MED' ELSE 'LOW' END AS tier, coupling,
      CASE WHEN dup AND n_owners = 1 THEN 'RETIRE' WHEN dup THEN 'STANDARDIZE' ELSE 'EXTRACT' END AS play,
      round_even((n_members + CASE WHEN dup THEN 2 ELSE 0 END) * (1 - coalesce(coupling, 0)) * CASE WHEN n_owners > 1 THEN 1.5::DOUBLE ELSE 1::DOUBLE END * (rank / 3), 2) AS opportunity
      FROM (SELECT *, (dimension = 'messaging' AND produces = n_members) OR (dimension IN ('data', 'column') AND writes >= 2) OR (dimension = 'api' AND serves >= 2) AS dup FROM sums))""",
}
CAPS = ("facts", "owners", "couplings", "touch", "members", "sums", "caps")


def sql(needs: tuple[str, ...] | str, body: str) -> str:
    names = needs.split() if isinstance(needs, str) else needs
    return f"WITH {', '.join(CTES[n] for n in names)} {body}"


def even_rounded(text: str) -> str:
    """round_even(x, d) as the scaled rounding of weft.functions.numbers.half_even."""
    out, at = "", 0
    while (i := text.find("round_even(", at)) >= 0:
        start = i + len("round_even(")
        depth, j, comma = 1, start, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            if text[j] == "," and depth == 1:
                comma = j
            j += 1
        scale = 10 ** int(text[comma + 1 : j - 1])
        out += f"{text[at:i]}(round_even(({even_rounded(text[start:comma])}) * {scale}::DOUBLE, 0) / {scale}::DOUBLE)"
        at = j
    return out + text[at:]
