"""Scalar functions on text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing about what a module is for.
STOP_WORDS = (
    "and", "for", "the", "with", "this", "that", "from", "uses", "into", "some", "plain", "more", "like", "also", "have", "been", "according", "various",
)
GENERIC = (
    "produce", "publish", "consume", "read", "write", "call", "serve", "expose",
    "event", "topic", "table", "column", "endpoint", "queue", "cache", "resource",
    "service", "module", "library", "job", "api", "rest", "grpc", "http", "sql",
    "kafka", "spring", "data", "jpa", "boot", "client", "server", "use", "using",
    "confluent", "psycopg", "sqlalchemy", "requests", "httpx", "axios", "npm",
)


def stripped(x: Column) -> Column:
    """Without white space at its ends. (Not by a pattern, which would stop at each blank between words.)"""
    return F.trim(x, F.lit(" \t\n\x0b\f\r"))


# What a stem is without, how a placeholder is written, and the notes of resolve.
SUFFIX = "(?:ing|ers|er|ed|s)$"
PLACEHOLDER = r"\$\{([^:}]+)(?::([^}]*))?\}"
LITERAL, CONSTANT, KEY, DEFAULT, ENVIRONMENT, UNRESOLVED = "literal at call site", "local constant", "config key ", "config default for ", "env default ", "dynamic / unresolved"


def stem(word: Column) -> Column:
    return F.regexp_replace(word, SUFFIX, "")


def domain_tokens(summary: Column) -> Column:
    """Sorted distinct stems of a text's words of three or more lower-case letters, without stop words and
    without words that are generic as they stand or as stems."""
    words = F.regexp_extract_all(F.lower(summary), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    told = F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(*STOP_WORDS) & ~w.isin(*GENERIC) & ~stem(w).isin(*GENERIC))
    return F.array_sort(F.array_distinct(F.transform(told, stem)))


COMMENT = r"#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def code_lines(content: Column, normalise: bool = False) -> Column:
    """The distinct lines of a source text without comments and blank lines, trimmed; with normalise every
    identifier is ID."""
    some = content.contains("#") | content.contains("//") | content.contains("/*")
    code = F.when(some, F.regexp_replace(content, COMMENT, "")).otherwise(content)
    ended = F.replace(F.replace(code, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.transform(F.split(ended, "\n", -1), stripped), lambda x: x != "")
    if normalise:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, IDENTIFIER, "ID"))
    return F.array_distinct(lines)


def clean_identifier(name: Column) -> Column:
    """A table or column name without quotes, in lower case."""
    return F.lower(F.regexp_replace(stripped(name), "^[`\"]+|[`\"]+$", ""))


def safe_id(x: Column) -> Column:
    """A name that a diagram can use as an id."""
    clean = F.regexp_replace(x, "[^A-Za-z0-9_]", "_")
    return F.when(clean == "", "node").otherwise(clean)


def safe_label(x: Column, most: int = 60) -> Column:
    clean = stripped(F.replace(x, F.lit('"'), F.lit("'")))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 3), F.lit("..."))).otherwise(clean)


def html_escaped(x: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return x


def json_object(raw: Column) -> Column:
    """The JSON object in a model's answer, as a variant: the whole text, or what a code fence holds, or the
    outermost braces; null if none of them is an object."""
    fenced = F.regexp_extract(raw, r"(?i)```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    braces = F.regexp_extract(raw, r"(\{[\s\S]*\})", 1)
    found = [F.try_parse_json(x) for x in (stripped(raw), fenced, braces)]
    return F.coalesce(*[F.when(F.schema_of_variant(x).startswith("OBJECT"), x) for x in found])


def looks_like_sql(x: Column) -> Column:
    head = F.upper(F.substring(F.regexp_replace(x, r"^\s+", ""), 1, 12))
    return F.rlike(head, F.lit("^(?:SELECT|INSERT|UPDATE|DELETE|CREATE|WITH )"))


def resolve(expression: Column, constants: Column, config: Column, env: Column) -> Column:
    """What an expression at a call site stands for: a struct (value, tier, notes).

    A quoted literal, then a constant by full name or last segment, then a ${key:default} placeholder, then
    a configuration key, then an environment default; else null and LOW, which callers record as a gap."""
    e = stripped(F.coalesce(expression, F.lit("")))
    last = F.element_at(F.split(e, r"\."), -1)
    literal = F.regexp_extract(e, "^[\"']([^\"']+)[\"']$", 1)
    key = F.regexp_extract(e, PLACEHOLDER, 1)
    default = F.regexp_extract(e, PLACEHOLDER, 2)
    said = lambda value, tier, notes: F.struct(value.alias("value"), F.lit(tier).alias("tier"), notes.alias("notes"))
    has = F.map_contains_key
    return (
        F.when(literal != "", said(literal, "HIGH", F.lit(LITERAL)))
        .when(has(constants, e), said(F.element_at(constants, e), "HIGH", F.lit(CONSTANT)))
        .when(has(constants, last), said(F.element_at(constants, last), "HIGH", F.lit(CONSTANT)))
        .when((key != "") & has(config, key), said(F.element_at(config, key), "MED", F.concat(F.lit(KEY), key)))
        .when((key != "") & (default != ""), said(default, "MED", F.concat(F.lit(DEFAULT), key)))
        .when(has(config, e), said(F.element_at(config, e), "MED", F.concat(F.lit(KEY), e)))
        .when(has(env, last), said(F.element_at(env, last), "MED", F.concat(F.lit(ENVIRONMENT), last)))
        .otherwise(said(F.lit(None).cast(T.StringType()), "LOW", F.lit(UNRESOLVED)))
    )


def properties(text: Column) -> Column:
    """key=value lines as a map; later lines win, comments and lines without = are passed over."""
    lines = F.transform(F.split(text, "\r\n|\r|\n", -1), stripped)
    kept = F.filter(lines, lambda x: x.contains("=") & ~x.startswith("#"))
    pair = lambda x: F.struct(stripped(F.regexp_extract(x, "^([^=]*)=", 1)).alias("key"), stripped(F.regexp_extract(x, "^[^=]*=([\\s\\S]*)$", 1)).alias("value"))
    pairs = F.transform(kept, pair)
    # the last of equal keys, whatever the session does with repeated map keys
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)
