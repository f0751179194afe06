"""What SQL texts read and write: tables, columns, foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import clean_identifier, stripped

NAME = r'([`"A-Za-z0-9_.]+)'
#: Statements that write the table they name, then clauses that read one.
WRITES = tuple(rf"(?i)\b{verb}\s+{NAME}" for verb in (r"CREATE\s+(?:TABLE|VIEW)(?:\s+IF\s+NOT\s+EXISTS)?", r"INSERT\s+INTO", "UPDATE", r"DELETE\s+FROM"))
READS = tuple(rf"(?i)\b{clause}\s+{NAME}" for clause in ("FROM", "JOIN"))
#: Words that begin a table constraint and not a column.
CONSTRAINTS = ("PRIMARY", "FOREIGN", "CONSTRAINT", "UNIQUE", "CHECK", "KEY", "INDEX")


def _names(sql: Column, patterns: tuple[str, ...]) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(sql, F.lit(p), F.lit(1)) for p in patterns]))
    return F.filter(F.array_distinct(F.transform(found, clean_identifier)), lambda t: F.length(t) > 0)


def lineage(sql: Column) -> Column:
    """An array of (direction, table); a table that is both read and written counts as written."""
    said = lambda names, d: F.transform(names, lambda t: F.struct(F.lit(d).alias("direction"), t.alias("table")))
    text = F.coalesce(sql, F.lit(""))
    written = _names(text, WRITES)
    return F.concat(said(written, "WRITES"), said(F.array_except(_names(text, READS), written), "READS"))


def insert_columns(sql: Column) -> Column:
    """table.column for the column lists of INSERT statements."""
    pattern = rf"(?i)INSERT\s+INTO\s+{NAME}\s*\(([^)]*)\)"
    tables, lists = (F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(pattern), F.lit(g)) for g in (1, 2))
    return _columns(tables, lists)


def _columns(tables: Column, lists: Column) -> Column:
    def of(table, i):
        names = F.filter(F.transform(F.split(F.get(lists, i), ","), clean_identifier), lambda c: F.length(c) > 0)
        return F.transform(names, lambda c: F.concat_ws(".", clean_identifier(table), c))

    return F.flatten(F.transform(tables, of))


def create_columns(sql: Column) -> Column:
    """table.column for the columns that CREATE TABLE statements define.

    What stands in inner parentheses is blanked, from the inside out, so that the commas left are the ones
    between columns; four levels are more than types and checks have."""
    text = F.coalesce(sql, F.lit(""))
    pattern = rf"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*?)\)\s*;"
    tables, whole = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))

    def flat(body):
        for _ in range(4):
            body = F.regexp_replace(body, r"\([^()]*\)", "")
        return body

    def of(table, i):
        first = F.transform(F.split(flat(F.get(whole, i)), ","), lambda d: clean_identifier(F.regexp_extract(stripped(d), r"^(\S*)", 1)))
        names = F.filter(first, lambda c: (F.length(c) > 0) & ~F.upper(c).isin(*CONSTRAINTS))
        return F.transform(names, lambda c: F.concat_ws(".", clean_identifier(table), c))

    return F.flatten(F.transform(tables, of))


def written_columns(sql: Column) -> Column:
    """Distinct table.column of CREATE TABLE definitions and INSERT lists."""
    return F.array_distinct(F.concat(create_columns(sql), insert_columns(sql)))


def foreign_keys(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table) and (child, parent), both distinct, of scripts with a column sql. Tables do not refer to themselves."""
    statement = scripts.select(F.explode(F.split("sql", ";")).alias("s"))
    child = clean_identifier(F.regexp_extract("s", rf"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}", 1))
    made = statement.select(child.alias("child"), F.regexp_extract_all("s", F.lit(rf"(?i)REFERENCES\s+{NAME}"), F.lit(1)).alias("parents")).filter("child <> ''")
    edges = made.select("child", F.explode("parents").alias("p")).select("child", clean_identifier(F.col("p")).alias("parent")).filter("parent <> '' and parent <> child").distinct()
    return made.select(F.col("child").alias("table")).distinct(), edges
