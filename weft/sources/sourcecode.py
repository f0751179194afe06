"""Facts in source files: Python by its syntax tree, Java and JavaScript by patterns.

A file is a row, and each extractor is a function of one text; rows go to Python in Arrow batches, and what
is found comes back as one nested column."""

from __future__ import annotations

import ast
import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "direction: string, resource_type: string, resource_id: string, tier: string, line: int, snippet: string, notes: string"
FOUND = f"facts: array<struct<{FACT}>>, gaps: array<struct<kind: string, expression: string, line: int>>, names: array<string>"

_WRITE = re.compile(r'\b(?:CREATE\s+(?:TABLE|VIEW)(?:\s+IF\s+NOT\s+EXISTS)?|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+([`"\w.]+)', re.I)
_READ = re.compile(r'\b(?:FROM|JOIN)\s+([`"\w.]+)', re.I)
_INSERT = re.compile(r'INSERT\s+INTO\s+([`"\w.]+)\s*\(([^)]*)\)', re.I)
_SQL = re.compile(r"\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|WITH )", re.I)


class Found:
    """What one file gives."""

    def __init__(self, text: str):
        self.lines, self.facts, self.gaps, self.names = text.splitlines(), [], [], []

    def add(self, direction, kind, resource, tier="HIGH", line=0, notes=""):
        snippet = self.lines[line - 1].strip()[:80] if 0 < line <= len(self.lines) else ""
        self.facts.append({"direction": direction, "resource_type": kind, "resource_id": resource, "tier": tier, "line": line, "snippet": snippet, "notes": notes})

    def sql(self, text: str, line: int = 0):
        tidy = lambda x: x.strip().strip('`"').lower()
        written = dict.fromkeys(map(tidy, _WRITE.findall(text)))
        for t in written:
            self.add("WRITES", "SQL_TABLE", t, line=line)
        for t in dict.fromkeys(map(tidy, _READ.findall(text))):
            if t not in written:
                self.add("READS", "SQL_TABLE", t, line=line)
        columns = [f"{tidy(t)}.{tidy(c)}" for t, cs in _INSERT.findall(text) for c in cs.split(",") if tidy(c)]
        for c in dict.fromkeys(columns):
            self.add("WRITES", "SQL_COLUMN", c, line=line)

    def topic(self, direction, found, expression, line):
        """found: (value, tier, notes), or None for what cannot be told."""
        if found:
            self.add(direction, "KAFKA_TOPIC", found[0], found[1], line, found[2])
        else:
            self.gaps.append({"kind": "KAFKA_TOPIC", "expression": expression, "line": line})


def _literal(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def python_facts(text: str) -> Found:
    """Topics sent and consumed, SQL executed and addresses called; names has what the file imports."""
    found = Found(text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return found
    known: dict[str, tuple[str, str, str]] = {}
    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            name, value = node.targets[0].id, node.value
            if (said := _literal(value)) is not None:
                known[name] = (said, "HIGH", "local constant")
            elif isinstance(value, ast.Call) and ast.unparse(value.func) in ("os.getenv", "os.environ.get") and len(value.args) > 1 and (said := _literal(value.args[1])) is not None:
                known[name] = (said, "MED", f"config key {name}")
    calls = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found.names += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.names += [node.module, *(f"{node.module}.{a.name}" for a in node.names)]
        elif isinstance(node, ast.Call):
            calls.append(node)
    kafka = any("kafka" in n for n in found.names)

    def told(arg):
        if (said := _literal(arg)) is not None:
            return (said, "HIGH", "literal at call site")
        source = ast.unparse(arg)
        return known.get(source) or known.get(source.split(".")[-1])

    for call in sorted(calls, key=lambda c: (c.lineno, c.col_offset)):
        first = call.args[0] if call.args else None
        if isinstance(call.func, ast.Name) and call.func.id == "KafkaConsumer":
            for a in call.args:
                if _literal(a) is not None:
                    found.topic("CONSUMES", told(a), "", call.lineno)
        if not isinstance(call.func, ast.Attribute) or first is None:
            continue
        method, on = call.func.attr, ast.unparse(call.func.value)
        if method in ("send", "produce") and kafka:
            found.topic("PRODUCES", told(first), ast.unparse(first), call.lineno)
        elif method in ("execute", "executemany") and (sql := _literal(first)) and _SQL.match(sql):
            found.sql(sql, call.lineno)
        elif method in ("get", "post", "put", "delete", "patch", "request") and any(h in on for h in ("requests", "httpx", "session", "client")):
            if address := told(first):
                found.add("CALLS", "HTTP_ENDPOINT", address[0], address[1], call.lineno, address[2])
            else:
                found.gaps.append({"kind": "HTTP_ENDPOINT", "expression": ast.unparse(first), "line": call.lineno})
    return found


# How a Java file writes a placeholder, a constant, a call that sends, a query and a REST call. What is
# recognised has to be what the portfolio model's facts are made of, so these are stated, not designed.
_PLACEHOLDER = re.compile(r"\$\{([^:}]+)(?::([^}]*))?\}")
_J_CONST = re.compile(r'static\s+final\s+String\s+(\w+)\s*=\s*"([^"]+)"')
_J_SEND = re.compile(r'\.send\(\s*([A-Za-z_][\w\.]*|"[^"]+")')
_J_QUERY = re.compile(r'@Query\(\s*(?:value\s*=\s*)?"([^"]+)"')
_J_NATIVE = re.compile(r'createNativeQuery\(\s*"([^"]+)"')
_J_REST = re.compile(r'\.(?:getForObject|postForObject|getForEntity|exchange)\(\s*"([^"]+)"')
# What follows is this module's own.
_J_VALUE = re.compile(r'@Value\(\s*"([^"]+)"\s*\)\s*(?:(?:private|public|protected|final)\s+)*String\s+(\w+)')
_J_LISTEN = re.compile(r"@KafkaListener\(([^)]*)\)")
_J_TOPICS = re.compile(r'topics\s*=\s*(\{[^}]*\}|"[^"]*"|[\w.]+)')


def java_facts(text: str, config: dict[str, str] | None = None) -> Found:
    """Topics sent and listened to, queries and addresses; names has imports and declared types."""
    found, config = Found(text), config or {}

    def filled(placeholder):
        if not (m := _PLACEHOLDER.search(placeholder)):
            return (placeholder, "HIGH", "literal at call site")
        value = config.get(m[1]) or m[2]
        return (value, "MED", f"config key {m[1]}" if m[1] in config else f"config default for {m[1]}") if value else None

    known = {name: (value, "HIGH", "local constant") for name, value in _J_CONST.findall(text)} | {name: filled(value) for value, name in _J_VALUE.findall(text)}
    told = lambda x: filled(x.strip('"')) if x.startswith('"') else known.get(x) or known.get(x.split(".")[-1])
    at = lambda m: text.count("\n", 0, m.start()) + 1
    for m in _J_SEND.finditer(text):
        found.topic("PRODUCES", told(m[1]), m[1], at(m))
    for m in _J_LISTEN.finditer(text):
        for topics in _J_TOPICS.findall(m[1]) or ([m[1].strip()] if m[1].strip().startswith('"') else []):
            for x in re.findall(r'"[^"]*"|[\w.]+', topics):
                found.topic("CONSUMES", told(x), x, at(m))
    for m in sorted((*_J_QUERY.finditer(text), *_J_NATIVE.finditer(text)), key=lambda m: m.start()):
        found.sql(m[1], at(m))
    for m in _J_REST.finditer(text):
        found.add("CALLS", "HTTP_ENDPOINT", m[1], line=at(m))
    return found


_N_CONST = re.compile(r"""\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*['"]([^'"]*)['"]""")
# Fixed value: the calls of JavaScript that name an address.
_N_HTTP = re.compile(r"""(?:\bfetch|(?:axios|http|httpClient|client|api)\.(?:get|post|put|delete|patch|request))\s*\(\s*['"]([^'"]+)['"]""", re.I)
_N_CALL = re.compile(r"\.(send|produce|subscribe)\s*\(")
# Fixed value: how a JavaScript call names its topics.
_N_TOPIC = re.compile(r"""\btopics?\s*:\s*(\[[^\]]*\]|['"][^'"]+['"]|[A-Za-z_$][\w$]*)""")
_N_IMPORT = re.compile(r"""(?:import\s[^;]*?from\s+|import\s+|require\s*\(\s*)['"]([^'"]+)['"]""")


def node_facts(text: str, kafka: bool = True) -> Found:
    """kafkajs topics, by literal or constant, and addresses called; names has what the file imports."""
    found, known = Found(text), dict(_N_CONST.findall(text))
    found.names = _N_IMPORT.findall(text)
    at = lambda i: text.count("\n", 0, i) + 1
    for m in _N_HTTP.finditer(text):
        found.add("CALLS", "HTTP_ENDPOINT", m[1], line=at(m.start()))
    if kafka:
        for m in _N_CALL.finditer(text):
            depth, end = 1, m.end()
            while depth and end < len(text):
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            for topics in _N_TOPIC.findall(text[m.end() : end]):
                for literal, name in re.findall(r"""['"]([^'"]+)['"]|([A-Za-z_$][\w$]*)""", topics):
                    if value := literal or known.get(name):
                        found.add("CONSUMES" if m[1] == "subscribe" else "PRODUCES", "KAFKA_TOPIC", value, line=at(m.start()))
    return found


_EXTRACTORS = {"python": python_facts, "java": java_facts, "javascript": node_facts}


def extracted(language: Column, content: Column, config: Column | None = None) -> Column:
    """A struct (facts, gaps, names) for each source text; empty lists for other languages."""

    @F.arrow_udf(FOUND)
    def of(languages, contents, configs):
        import pyarrow as pa

        rows = []
        for lang, text, conf in zip(languages.to_pylist(), contents.to_pylist(), configs.to_pylist(), strict=True):
            one = _EXTRACTORS.get(lang)
            found = Found("") if one is None else one(text or "", dict(conf or [])) if lang == "java" else one(text or "")
            rows.append({"facts": found.facts, "gaps": found.gaps, "names": found.names})
        fact = pa.struct([(n, pa.int32() if n == "line" else pa.string()) for n in ("direction", "resource_type", "resource_id", "tier", "line", "snippet", "notes")])
        gap = pa.struct([("kind", pa.string()), ("expression", pa.string()), ("line", pa.int32())])
        return pa.array(rows, pa.struct([("facts", pa.list_(fact)), ("gaps", pa.list_(gap)), ("names", pa.list_(pa.string()))]))

    return of(language, content, config if config is not None else F.lit(None).cast("map<string,string>"))


def simple_yaml(text: Column) -> Column:
    """Nested keys of an indented document as a map of dotted keys; lists and blocks are passed over."""

    @F.arrow_udf("map<string,string>")
    def of(values):
        import pyarrow as pa

        return pa.array([[*dotted(v.as_py() or "").items()] for v in values], pa.map_(pa.string(), pa.string()))

    return of(text)


def dotted(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    above: list[tuple[int, str]] = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] == "#" or ":" not in line:
            continue
        depth = len(raw) - len(raw.lstrip())
        above = [x for x in above if x[0] < depth]
        key, value = (x.strip() for x in line.split(":", 1))
        if value:
            out[".".join([*(k for _, k in above), key])] = value.strip("\"'")
        else:
            above.append((depth, key))
    return out


def _names(files: DataFrame, language: str) -> Column:
    """What a file imports: from the column `parsed`, if it has been parsed already."""
    return F.col("parsed.names") if "parsed" in files.columns else extracted(F.lit(language), F.col("content"))["names"]


def density(edges: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, coupling): distinct directed edges (key, source, target) of all that a module's n files allow."""
    from weft.functions.numbers import half_even

    counts = edges.filter("source <> target").groupBy(key).agg(F.countDistinct("source", "target").alias("e"))
    n = F.col("n")
    return sizes.join(counts, key, "left").select(key, F.when(n < 2, F.lit(0.0)).otherwise(half_even(F.coalesce("e", F.lit(0)) / (n * (n - 1)), 3)).alias("coupling"))


def python_edges(files: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, source, target): which of a project's own modules a Python module imports, by longest prefix."""
    name = F.regexp_replace(F.replace(F.regexp_replace("in_path", r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")
    rows = files.filter("suffix = '.py'").select(key, name.alias("source"), _names(files, "python").alias("names"))
    wanted = rows.select(key, "source", F.explode(F.array_distinct("names")).alias("wanted"))
    parts = F.split("wanted", r"\.")
    up = wanted.withColumn("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))))
    local = rows.select(key, F.col("source").alias("target"))
    return up.join(local, [key, "target"]).groupBy(key, "source", "wanted").agg(F.max_by("target", F.length("target")).alias("target")).select(key, "source", "target").filter("source <> target").distinct()


def java_edges(files: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, source, target) between Java files: imports by full name, by package, by bare type name, and
    mentions of a type of the same package."""
    src = F.col("content")
    types = F.array_distinct(F.regexp_extract_all(src, F.lit(r"\b(?:class|interface|enum|record)\s+([A-Za-z0-9_]+)\b"), F.lit(1)))
    base = F.regexp_extract("in_path", r"([^/]*)\.java$", 1)
    rows = files.filter("suffix = '.java'").select(
        key, F.col("in_path").alias("file"), F.regexp_extract(src, r"(?m)^\s*package\s+([A-Za-z0-9_.]+)\s*;", 1).alias("pkg"), F.when(F.size(types) > 0, types).otherwise(F.array(base)).alias("types"),
        F.regexp_extract_all(src, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;"), F.lit(1)).alias("imports"), F.array_distinct(F.regexp_extract_all(src, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))).alias("words"),
    )
    declared = rows.select(key, F.col("file").alias("target"), F.col("pkg").alias("tpkg"), F.explode("types").alias("type"))
    full = F.when(F.col("tpkg") == "", F.col("type")).otherwise(F.concat_ws(".", "tpkg", "type"))
    imports = rows.select(key, F.col("file").alias("source"), F.explode("imports").alias("name"))
    named = imports.join(declared.select(key, "target", full.alias("name")), [key, "name"])
    starred = imports.filter("name like '%.*'").withColumn("tpkg", F.expr("substring(name, 1, length(name) - 2)")).join(declared.select(key, "tpkg", "target").distinct(), [key, "tpkg"])
    bare = imports.join(declared.select(key, "target", F.col("type").alias("name")), [key, "name"])
    words = rows.filter("pkg <> ''").select(key, F.col("file").alias("source"), F.col("pkg").alias("tpkg"), F.explode("words").alias("type"))
    near = words.join(declared, [key, "tpkg", "type"])
    out = None
    for df in (named, starred, bare, near):
        one = df.select(key, "source", "target")
        out = one if out is None else out.unionByName(one)
    return out.filter("source <> target").distinct()


def node_edges(files: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, source, target) between JavaScript files: relative imports."""

    @F.arrow_udf("string")
    def joined(folder, target):
        import pyarrow as pa

        return pa.array([posixpath.normpath(posixpath.join(f.as_py() or "", t.as_py())) for f, t in zip(folder, target, strict=True)], pa.string())

    stem = F.regexp_replace("in_path", r"\.[A-Za-z]+$", "")
    rows = files.filter(F.col("suffix").isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")).select(key, stem.alias("source"), F.regexp_extract("in_path", "^(.*)/[^/]*$", 1).alias("folder"), _names(files, "javascript").alias("names"))
    wanted = rows.select(key, "source", "folder", F.explode("names").alias("name")).filter("name like '.%'").select(key, "source", joined("folder", "name").alias("target"))
    return wanted.join(rows.select(key, F.col("source").alias("target")), [key, "target"]).select(key, "source", "target").filter("source <> target").distinct()
