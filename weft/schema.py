"""Tables of the portfolio model, their vocabularies, and the rules that a row must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "0.1"

# The vocabularies of the model.
TIERS = ("HIGH", "MED", "LOW")
DIRECTIONS = ("PRODUCES", "CONSUMES", "READS", "WRITES", "CALLS", "SERVES")
RESOURCE_TYPES = ("KAFKA_TOPIC", "SQL_TABLE", "SQL_COLUMN", "HTTP_ENDPOINT", "JMS_QUEUE", "CACHE_KEY")
MODULE_KINDS = ("service", "library", "job", "batch")
API_KINDS = ("REST", "GRPC", "GRAPHQL")
API_ROLES = ("server", "client")
SCOPES = ("runtime", "test", "build")
PLAYS = ("RETIRE", "STANDARDIZE", "EXTRACT", "LEAVE")
DIMENSIONS = {"KAFKA_TOPIC": "messaging", "JMS_QUEUE": "messaging", "SQL_TABLE": "data", "SQL_COLUMN": "column", "HTTP_ENDPOINT": "api", "CACHE_KEY": "cache"}

_PROV = "provenance struct<file: string, line: int, snippet: string, resolver_notes: string>"
#: Schemas as Spark reads them, in DDL.
TABLES = {
    "projects": "id string, repo_url string, name string, owner_team string, langs array<string>, loc bigint, activity string, deploy_target string",
    "modules": "id string, project_id string, path string, name string, kind string, lang string, build_system string",
    "integration_facts": f"module_id string, direction string, resource_type string, resource_id string, tier string, schema_ref string, {_PROV}, fact_seq bigint",
    "dependencies": "module_id string, purl string, scope string, tier string",
    "api_surfaces": "module_id string, kind string, signature string, role string, tier string",
    "gaps": f"module_id string, kind string, expression string, {_PROV}",
    "capability_summaries": "module_id string, summary string, domain string, operations array<string>, embedding_ref string, tier string",
    "module_metrics": "module_id string, name string, value double",
    "clone_pairs": "module_a string, module_b string, clone_type int, similarity double, tier string",
    "scan_cache": "project_id string, content_hash string, last_scanned timestamp",
    "files": "rel_path string, folder string, suffix string, modified bigint, size bigint, digest string, content string",
    "errors": "timestamp timestamp, phase string, source string, error_type string, message string, details string, remediation string, severity string",
}
KEYS = {"projects": "id", "modules": "id", "scan_cache": "project_id", "files": "rel_path"}


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "HIGH", 3).when(tier == "MED", 2).when(tier == "LOW", 1)


def tier_name(rank: Column) -> Column:
    return F.when(rank == 3, "HIGH").when(rank == 2, "MED").otherwise("LOW")


def dimension(resource_type: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, name in DIMENSIONS.items():
        out = out.when(resource_type == kind, name)
    return out.otherwise("other")


def _given(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.length(F.coalesce(F.col(n), F.lit(""))) > 0)
    return ok


def _among(name: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


#: Whether a row may be stored, by table.
VALID = {
    "integration_facts": lambda: _given("module_id", "resource_id") & _among("direction", DIRECTIONS) & _among("resource_type", RESOURCE_TYPES) & _among("tier", TIERS),
    "dependencies": lambda: _given("module_id", "purl") & _among("scope", SCOPES) & _among("tier", TIERS),
    "api_surfaces": lambda: _given("module_id", "signature") & _among("kind", API_KINDS) & _among("role", API_ROLES) & _among("tier", TIERS),
    "modules": lambda: _given("id", "project_id", "name") & _among("kind", MODULE_KINDS),
}


def split_valid(table: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may be stored, and those that may not."""
    ok = VALID[table]()
    return rows.filter(ok), rows.filter(~ok)


def rejections(table: str, rejected: DataFrame) -> DataFrame:
    """A warning for each rejected row, as an error table has it."""
    return rejected.select(
        F.current_timestamp().alias("timestamp"), F.lit("extract").alias("phase"), F.col("module_id" if "module_id" in rejected.columns else "id").alias("source"),
        F.lit("InvalidRow").alias("error_type"), F.lit(f"row of {table} is not valid").alias("message"), F.to_json(F.struct("*")).alias("details"), F.lit("correct the extractor").alias("remediation"), F.lit("WARNING").alias("severity"),
    )
