"""One run over a portfolio: ingest, extract, capabilities, findings, views, remediation.

Extractors and reports are registered functions over tables, so others can be added without a change here."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import code_lines, properties
from weft.functions.vectors import trigram_embedding
from weft.operators import capability, graph, judge, reports, similarity
from weft.plans import remediate, tracking, views
from weft.plans.catalog import Catalog, changed
from weft.plans.durable import durable
from weft.schema import dimension, rejections, split_valid
from weft.sources import contracts, files, manifests, sourcecode, sqltext
from weft.sources.webpages import addresses

SUFFIX_OF = {"python": "py", "java": "java", "javascript": "node", "sql": "sql"}

#: Functions (files with module_id) -> facts, and (results) -> a named report.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
REPORTS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}


def extractor(name: str):
    def add(f):
        EXTRACTORS[name] = f
        return f

    return add


def report(name: str):
    def add(f):
        REPORTS[name] = f
        return f

    return add


def shaped(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    want = [("module_id", "string"), ("direction", "string"), ("resource_type", "string"), ("resource_id", "string"), ("tier", "string"), ("rel_path", "string"), ("line", "int"), ("snippet", "string"), ("notes", "string")]
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in want))


@extractor("code")
def _code(rows: DataFrame) -> DataFrame:
    return shaped(rows.select("module_id", "rel_path", F.inline("parsed.facts")))


@extractor("sql")
def _sql(rows: DataFrame) -> DataFrame:
    scripts = rows.filter("suffix = '.sql'")
    tables = scripts.select("module_id", "rel_path", F.inline(sqltext.lineage(F.col("content")))).select("module_id", "rel_path", "direction", F.lit("SQL_TABLE").alias("resource_type"), F.col("table").alias("resource_id"), F.lit("HIGH").alias("tier"))
    columns = scripts.select("module_id", "rel_path", F.explode(sqltext.written_columns(F.col("content"))).alias("resource_id")).select("module_id", "rel_path", F.lit("WRITES").alias("direction"), F.lit("SQL_COLUMN").alias("resource_type"), "resource_id", F.lit("HIGH").alias("tier"))
    return shaped(tables.unionByName(columns))


@extractor("api")
def _api(rows: DataFrame) -> DataFrame:
    return shaped(rows.select("module_id", "rel_path", F.inline("surfaces")).select("module_id", "rel_path", F.lit("SERVES").alias("direction"), F.lit("HTTP_ENDPOINT").alias("resource_type"), F.col("endpoint").alias("resource_id"), F.lit("HIGH").alias("tier"), F.col("signature").alias("snippet")))


@extractor("pages")
def _pages(rows: DataFrame) -> DataFrame:
    found = rows.filter(F.col("suffix").isin(".jsp", ".jspf", ".tag")).select("module_id", "rel_path", F.inline(addresses(F.col("content"))))
    return shaped(found.select("module_id", "rel_path", "line", F.lit("CALLS").alias("direction"), F.lit("HTTP_ENDPOINT").alias("resource_type"), F.col("address").alias("resource_id"), F.lit("HIGH").alias("tier")))


@report("libraries")
def _libraries(r: dict[str, DataFrame]) -> DataFrame:
    return reports.shared_dependencies(r["dependencies"], r["owners"])


@report("standards")
def _standards(r: dict[str, DataFrame]) -> DataFrame:
    return reports.tech_standards(r["dependencies"], reports.category_table(r["dependencies"].sparkSession))


@report("orphans")
def _orphans(r: dict[str, DataFrame]) -> DataFrame:
    tables, keys = sqltext.foreign_keys(r["files"].filter("suffix = '.sql'").select(F.col("content").alias("sql")))
    return reports.orphans(tables, keys, reports.shared_tables(r["facts"]))


@report("bills_of_material")
def _bills(r: dict[str, DataFrame]) -> DataFrame:
    return views.bills_of_material(r["dependencies"], r["modules"])


@dataclass
class Config:
    """What a run may leave out or change."""

    semantic: bool = True
    remediate: bool = False
    functional_max_size: int = 6
    matrix_max_columns: int = 40
    clone_threshold: float = 0.60
    recall_low: float = 0.40
    recall_med: float = 0.75
    judge_threshold: float = judge.THRESHOLD
    summarise: Callable = manifests.summaries
    embed: Callable = trigram_embedding
    judge: Callable = judge.judged


@dataclass
class Run:
    tables: dict[str, DataFrame]
    seconds: dict[str, float] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def modules_of(placed: DataFrame, owners: DataFrame) -> DataFrame:
    """A module for each project and language: (id, project_id, name, lang, build_system, owner)."""
    found = files.detected(placed)
    tag = F.lit("")
    for lang, short in SUFFIX_OF.items():
        tag = F.when(F.col("lang") == lang, short).otherwise(tag)
    return found.join(owners, "project_id", "left").select(F.concat_ws(":", "project_id", tag).alias("id"), "project_id", F.col("project_id").alias("name"), "lang", F.col("build").alias("build_system"), F.coalesce("owner", F.lit("unknown")).alias("owner"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Files dealt out by their paths, if they come in fewer parts than tasks can run: small tables make many files, and what reads files
    has no more tasks than these have parts."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(2 * tasks, "rel_path")


def ingested(spark: SparkSession, source: DataFrame | str, inventory: DataFrame | None = None, stored: bool = False) -> dict[str, DataFrame]:
    """files, dirs (project folders), placed (files in their projects) and owners of projects, for files (rel_path, suffix,
    content) or those under a folder. With an inventory (name, ...) only the projects that it names. Files that are stored
    are not copied: only their paths are placed, and what is read of placed is read from where they are."""
    all_files = source if stored else durable(files.scan(spark, source) if isinstance(source, str) else _dealt(source))
    found = files.named(files.projects(all_files))
    dirs = durable(found if inventory is None else files.from_inventory(inventory, found).select("dir", "project_id").distinct())
    if stored:
        placed = all_files.join(durable(files.in_projects(all_files.select("rel_path"), dirs)), "rel_path")
    else:
        placed = durable(files.in_projects(all_files, dirs))
    return {"files": all_files, "dirs": dirs, "placed": placed, "owned": files.owners(all_files, dirs)}


def extract(placed: DataFrame, owned: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """What files in projects give: modules, projects, rows (files with their module, each parsed once), facts, gaps,
    dependencies, api_surfaces, couplings, and errors. Rows that break a rule are not stored; each is an error."""
    modules = durable(modules_of(placed, owned))
    lang = F.lit(None).cast("string")
    for k, (suffixes, _, _) in files.LANGUAGES.items():
        lang = F.when(F.col("suffix").isin(*suffixes), k).otherwise(lang)
    first = modules.groupBy("project_id").agg(F.min_by("id", "lang").alias("first"))
    # a file of a language belongs to that language's module, any other file to the project's first
    rows = placed.withColumn("lang", lang).join(modules.select("project_id", "lang", F.col("id").alias("own")), ["project_id", "lang"], "left").join(first, "project_id")
    settings = placed.filter(F.col("suffix").isin(".yml", ".yaml", ".properties"))
    said = settings.select("project_id", F.explode(F.when(F.col("suffix") == ".properties", properties(F.col("content"))).otherwise(sourcecode.simple_yaml(F.col("content")))).alias("key", "value"), F.struct(F.col("suffix") == ".properties", F.col("rel_path")).alias("order"))
    merged = said.groupBy("project_id", "key").agg(F.max_by("value", "order").alias("value")).groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("config"))
    rows = rows.join(merged, "project_id", "left").select("project_id", F.coalesce("own", "first").alias("module_id"), "lang", "rel_path", "in_path", "suffix", "content", "config")
    code = F.col("lang").isin("python", "java", "javascript")
    rows = durable(rows.withColumn("parsed", sourcecode.extracted(F.when(code, F.col("lang")), F.when(code, F.col("content")), F.when(code, F.col("config")))).withColumn("surfaces", contracts.surfaces_of(F.col("rel_path"), F.col("content"))))
    found = None
    for of in (EXTRACTORS if extractors is None else extractors).values():
        one = of(rows)
        found = one if found is None else found.unionByName(one)
    surfaces = rows.select("module_id", "rel_path", F.inline("surfaces")).select("module_id", "kind", "signature", F.lit("server").alias("role"), F.lit("HIGH").alias("tier"))
    every = {"integration_facts": durable(found.withColumn("fact_seq", F.row_number().over(_order("rel_path", "line", "direction")).cast("long"))), "dependencies": durable(manifests.dependencies(rows)), "api_surfaces": surfaces}
    good, errors = {}, None
    for name, df in every.items():
        good[name], bad = split_valid(name, df)
        told = rejections(name, bad)
        errors = told if errors is None else errors.unionByName(told)
    claims = placed.filter("in_path = 'package.json'").select("project_id", F.explode(manifests.node_claims(F.col("content"))).alias("lang"))
    langs = modules.select("project_id", "lang").unionByName(claims).groupBy("project_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    projects = langs.join(files.lines_of_code(placed), "project_id", "left").join(owned, "project_id", "left")
    projects = projects.select(F.col("project_id").alias("id"), F.col("project_id").alias("name"), F.coalesce("owner", F.lit("unknown")).alias("owner_team"), "langs", F.coalesce("loc", F.lit(0)).cast("long").alias("loc"))
    gaps = rows.select("module_id", "rel_path", F.inline("parsed.gaps"))
    return {"modules": modules, "projects": projects, "rows": rows, "facts": good["integration_facts"], "gaps": gaps, "dependencies": good["dependencies"], "api_surfaces": good["api_surfaces"], "couplings": durable(_couplings(rows)), "errors": errors}


def analyse(spark: SparkSession, held: dict[str, DataFrame], config: Config, mark: Callable[[str], None] = lambda stage: None) -> dict[str, DataFrame]:
    """Findings over modules, rows, facts, dependencies and couplings: see run."""
    modules, rows, facts, dependencies, couplings = (held[k] for k in ("modules", "rows", "facts", "dependencies", "couplings"))
    owners = modules.select(F.col("id").alias("module_id"), "owner")
    lines = rows.filter(F.col("suffix").isin(*files.CLONE_SUFFIXES)).groupBy("module_id").agg(F.flatten(F.collect_list(code_lines(F.col("content")))).alias("t1"), F.flatten(F.collect_list(code_lines(F.col("content"), normalise=True))).alias("t2"))
    alike, links = similarity.clone_classes(lines.select(F.col("module_id").alias("id"), "t1", "t2"), F.array_distinct("t1"), F.array_distinct("t2"), config.clone_threshold)
    summaries = durable(config.summarise(modules.select(F.col("id").alias("module_id"), "name"), facts, dependencies, rows.filter("in_path not like '%/%'").select("module_id", "rel_path", "content")))
    mark("clones")
    judgements, counts, pairs = None, None, spark.createDataFrame([], "a string, b string, tier string")
    if config.semantic:
        vectors = durable(summaries.join(modules.select(F.col("id").alias("module_id"), "project_id"), "module_id").select(F.col("module_id").alias("id"), config.embed(F.col("summary")).alias("vector"), "summary", "project_id"))
        near = similarity.cosine_pairs(vectors, config.recall_low, group="project_id").withColumn("tier", similarity.recall_tier(F.col("similarity"), config.recall_med))
        if config.judge is judge.judged:
            found = durable(judge.judged_spans(vectors, config.recall_low, config.recall_med, config.judge_threshold))
            pairs = found.filter("b is not null").select("a", "b", "tier")
            counts = found.filter("b is null").groupBy(F.col("a").alias("module_id")).agg(F.sum("n_candidates").alias("n_candidates"), F.sum("n_confirmed").alias("n_confirmed"))
            judgements = config.judge(judge.with_shared_resources(near, facts), summaries, owners, config.judge_threshold)
        else:
            candidates = judge.with_shared_resources(durable(near), facts)
            judgements = durable(config.judge(candidates, summaries, owners, config.judge_threshold))
            pairs = judgements.filter("confirmed").select("a", "b", "tier")
        mark("judgements")
    distinct = durable(similarity.linked_spans(alike, links))
    caps = durable(capability.build_capabilities(facts, distinct, pairs, dependencies, owners, couplings, config.functional_max_size))
    mark("capabilities")
    found = graph.clusters_and_members(facts, distinct, owners, couplings)
    clusters = durable(found[0])
    mark("clusters")

    plays = caps.groupBy("play").agg(F.count(F.lit(1)).alias("n"))
    tables = {"owners": owners, "clone_members": alike.withColumnRenamed("id", "module_id"), "clone_links": links, "clone_counts": similarity.link_counts(alike, links).withColumnRenamed("id", "module_id"), "clone_pairs": similarity.linked_pairs(alike, links), "summaries": summaries, "capabilities": capability.ranked(caps), "clusters": graph.ranked(clusters), "plays": plays}
    if judgements is not None:
        tables |= {"judgements": judgements, "candidates": views.unconfirmed(judgements, modules.select(F.col("id").alias("module_id"), "project_id")), "promoted": graph.promoted(judgements.filter("confirmed"), found[1], couplings)}
    touch = capability.strongest_touch(facts).join(facts.groupBy("resource_type", "resource_id").agg(F.countDistinct("module_id").alias("n")).filter("n >= 2"), ["resource_type", "resource_id"])
    members = touch.select(F.concat_ws(":", dimension(F.col("resource_type")), "resource_id").alias("id"), "module_id", "direction", "resource_type", "resource_id")
    tables |= {"members": members, "matrix": views.matrix_cells(members.select("id", "module_id", "direction"), caps, config.matrix_max_columns), "diagram": views.diagram_lines(views.diagram_edges(facts, members.select("module_id")))}
    if counts is not None:
        tables["judgement_counts"] = counts
    if config.remediate:
        acted = caps.select("id", "label", "play")
        shared = members.select("id", "resource_type", "resource_id").distinct().join(acted.filter(F.col("play").isin(*remediate.ACTED_ON)).select("id"), "id")
        tables |= {"ratchets": remediate.ratchets(acted), "recipes": remediate.recipes(shared)}
    return tables


def totals(held: dict[str, DataFrame]) -> DataFrame:
    """One row: n_projects, n_modules, n_facts, n_gaps, n_errors and the resolution rate in per cent."""
    n = {k: held[k].agg(F.count(F.lit(1)).alias(f"n_{k}")) for k in ("projects", "modules", "facts", "gaps", "errors")}
    out = None
    for one in n.values():  # a row each
        out = one if out is None else out.join(one)
    return out.withColumn("resolution", reports.resolution_rate(F.col("n_facts"), F.col("n_gaps")))


def _finished(spark: SparkSession, held: dict[str, DataFrame], config: Config, seconds: dict[str, float], mark: Callable[[str], None]) -> Run:
    tables = {k: v for k, v in held.items() if k != "rows"} | analyse(spark, held, config, mark)
    tables |= {"totals": totals(held), "error_log": reports.error_log(held["errors"])}
    tables |= {name: make(tables) for name, make in REPORTS.items()}
    mark("views")
    return Run(tables, seconds)


def _clock() -> tuple[dict[str, float], Callable[[str], None]]:
    seconds, began = {}, [time.time()]

    def mark(stage: str) -> None:
        seconds[stage], began[0] = time.time() - began[0], time.time()

    return seconds, mark


def run(spark: SparkSession, source: DataFrame | str, config: Config | None = None, inventory: DataFrame | None = None) -> Run:
    """All tables of a run over files (rel_path, suffix, content), or over those under a folder.

    Tables: files, projects, modules, facts, gaps, dependencies, api_surfaces, couplings, errors, error_log, totals,
    clone_members, clone_links and clone_counts (similarity.clone_classes), clone_pairs, candidates, judgements, promoted, capabilities, clusters, plays, matrix, diagram, and those of the
    registered reports.

    clone_pairs, and with the heuristic judge judgements, candidates and promoted, have a row for each pair, which may be as many as the square
    of the modules: they are made where they are read, and no step of a run reads them. What capabilities and clusters need of pairs are
    clone_links and judge.judged_spans; judgement_counts tells of how many candidates and confirmed pairs each module is one."""
    seconds, mark = _clock()
    got = ingested(spark, source, inventory)
    mark("ingest")
    held = {"files": got["files"]} | extract(got["placed"], got["owned"])
    mark("extract")
    return _finished(spark, held, config or Config(), seconds, mark)


def heal(spark: SparkSession, source: DataFrame | str, config: Config | None = None, inventory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts of files healed of the resources that are acted on, and a report. No file is changed.

    (project_id, rel_path, content, healed) for each file that differs, and (resource_type, resource_id, play, n_modules, n_files,
    n_left) for each resource: how many modules touched it, how many files were changed for their projects, and how many modules a new
    extraction from the healed texts still finds at its old name. A round heals all files at once; as long as modules
    are left and texts still change, another follows."""
    config = config or Config()
    got = ingested(spark, source, inventory)
    held = extract(got["placed"], got["owned"])
    owners = held["modules"].select(F.col("id").alias("module_id"), "owner")
    caps = capability.resource_capabilities(held["facts"], owners, held["couplings"])
    touch = capability.strongest_touch(held["facts"]).withColumn("id", F.concat_ws(":", dimension(F.col("resource_type")), "resource_id"))
    acted = durable(touch.join(caps.filter(F.col("play").isin(*remediate.ACTED_ON)).select("id", "play"), "id").join(held["modules"].select(F.col("id").alias("module_id"), F.col("project_id").alias("project")), "module_id"))
    first = acted.groupBy("resource_type", "resource_id").agg(F.min("project").alias("primary"))
    roles = acted.join(first, ["resource_type", "resource_id"]).select("project", "resource_id", F.when(F.col("project") == F.col("primary"), "primary").otherwise("secondary").alias("role")).distinct()
    roles = durable(roles)
    old = got["placed"].withColumn("project", F.col("project_id"))
    texts, left = old, None
    while left is None or left.count():
        now = durable(remediate.healed(texts, roles).select("rel_path", "healed", (F.col("healed") != F.col("content")).alias("moved")))
        if not now.filter("moved").count():
            break
        texts = durable(texts.join(now.select("rel_path", "healed"), "rel_path", "left").withColumn("content", F.coalesce("healed", "content")).select(*old.columns))
        again = extract(texts.drop("project"), got["owned"])["facts"].select("resource_type", "resource_id", "module_id").distinct()
        left = durable(again.join(acted.select("resource_type", "resource_id", "module_id").distinct(), ["resource_type", "resource_id", "module_id"], "left_semi"))
    changed = durable(old.join(texts.select("rel_path", F.col("content").alias("healed")), "rel_path").filter("healed <> content").select("project_id", "rel_path", "content", "healed"))
    by = ["resource_type", "resource_id"]
    n_files = roles.join(changed.groupBy(F.col("project_id").alias("project")).agg(F.count(F.lit(1)).alias("n")), "project").groupBy("resource_id").agg(F.sum("n").alias("n_files"))
    report = acted.groupBy(*by).agg(F.min("play").alias("play"), F.countDistinct("module_id").alias("n_modules")).join(n_files, "resource_id", "left")
    remain = acted.limit(0).select(*by) if left is None else left
    report = report.join(remain.groupBy(*by).agg(F.count(F.lit(1)).alias("n_left")), by, "left")
    return changed, report.select(*by, "play", "n_modules", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_left", F.lit(0)).alias("n_left"))


#: Tables that a run keeps in its store, under the names that the store has for them.
KEPT = {"projects": "projects", "modules": "modules", "facts": "integration_facts", "gaps": "gaps", "dependencies": "dependencies", "api_surfaces": "api_surfaces", "couplings": "module_metrics", "errors": "errors"}


def _stored(name: str, df: DataFrame) -> DataFrame:
    """A run's table as the store has it."""
    where = lambda *c: F.struct(F.col("rel_path").alias("file"), "line", *c).alias("provenance")
    if name == "facts":
        return df.select("module_id", "direction", "resource_type", "resource_id", "tier", where(F.col("snippet"), F.col("notes").alias("resolver_notes")), "fact_seq")
    if name == "gaps":
        return df.select("module_id", "kind", "expression", where(F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("resolver_notes")))
    if name == "couplings":
        return df.select("module_id", F.lit("coupling").alias("name"), F.col("coupling").alias("value"))
    if name == "modules":
        return df.select("id", "project_id", "name", F.lit("service").alias("kind"), "lang", "build_system")
    return df


def incremental(spark: SparkSession, source: DataFrame | str | None, store: Catalog, config: Config | None = None, inventory: DataFrame | None = None) -> tuple[DataFrame, Run]:
    """(project_id, content_hash, state) for each project, and the tables of a run of which only new and changed
    projects were read again; what the store has of the others is taken from there.

    Of a folder only files that changed are opened (tracking.refreshed): the store has a copy of the others. Without a source the
    store's files are taken as they are. Deleted and changed projects leave the store first, then what was read is added, and the hashes last: a run
    that fails on the way reads the same projects once more."""
    config = config or Config()
    seconds, mark = _clock()
    if isinstance(source, str):
        tracking.refreshed(spark, source, store)
        source = None
    got = ingested(spark, store.read("files") if source is None else source, inventory, stored=source is None)
    hashes = durable(files.content_hashes(got["placed"]))
    states = durable(changed(hashes, store.read("scan_cache")))
    mark("ingest")
    # what the store has of new projects is of a run that failed
    stale = durable(states.filter("state <> 'same'").select("project_id"))
    fresh = states.filter("state in ('new', 'changed')").select("project_id", "content_hash")
    n = stale.count()
    if n:
        store.clear_projects(stale)
        read = extract(got["placed"].join(fresh.select("project_id"), "project_id", "left_semi"), got["owned"])
        for name, table in KEPT.items():
            store.append(table, _stored(name, read[name]))
        store.append("scan_cache", fresh.withColumn("last_scanned", F.current_timestamp()))
    mark("extract")
    owned = got["owned"].withColumn("owner", F.coalesce("owner", F.lit("unknown")))
    held = {name: store.read(table) for name, table in KEPT.items()}
    place = [F.col("provenance.file").alias("rel_path"), F.col("provenance.line").alias("line")]
    held["modules"] = durable(held["modules"].join(owned, "project_id", "left"))
    # an OWNER file may lie above the projects that it names
    held["projects"] = held["projects"].join(owned.select(F.col("project_id").alias("id"), "owner"), "id", "left").withColumn("owner_team", F.coalesce("owner", F.lit("unknown"))).drop("owner")
    held["facts"] = durable(held["facts"].select("module_id", "direction", "resource_type", "resource_id", "tier", *place, F.col("provenance.snippet").alias("snippet"), F.col("provenance.resolver_notes").alias("notes"), "fact_seq"))
    held["gaps"] = held["gaps"].select("module_id", *place, "kind", "expression")
    held["couplings"] = held["couplings"].filter("name = 'coupling'").select("module_id", F.col("value").alias("coupling"))
    lang = F.lit(None).cast("string")
    for k, (suffixes, _, _) in files.LANGUAGES.items():
        lang = F.when(F.col("suffix").isin(*suffixes), k).otherwise(lang)
    own, first = held["modules"].select("project_id", "lang", F.col("id").alias("own")), held["modules"].groupBy("project_id").agg(F.min_by("id", "lang").alias("first"))
    rows = got["placed"].withColumn("lang", lang).join(own, ["project_id", "lang"], "left").join(first, "project_id").withColumn("module_id", F.coalesce("own", "first"))
    held |= {"files": got["files"], "rows": rows}
    return states, _finished(spark, held, config, seconds, mark)


def _order(*columns: str):
    """Facts are numbered within their resource and module: that is where the first of equals is asked for."""
    return Window.partitionBy("resource_type", "resource_id", "module_id").orderBy(*columns)


def _couplings(rows: DataFrame) -> DataFrame:
    out = None
    for lang, suffixes, edges in (("python", (".py",), sourcecode.python_edges), ("java", (".java",), sourcecode.java_edges), ("javascript", (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), sourcecode.node_edges)):
        own = rows.filter((F.col("lang") == lang) & F.col("suffix").isin(*suffixes))
        sizes = own.groupBy("module_id").agg(F.count(F.lit(1)).alias("n"))
        one = sourcecode.density(edges(own, "module_id"), sizes, "module_id")
        out = one if out is None else out.unionByName(one)
    return out
