"""python -m weft: the portfolio's stages from a shell.

    run ROOT --out DIR          everything; tables as Parquet, findings as pages, JSON and logs
    incremental ROOT --out DIR  the same, reading only projects that changed since the last run with DIR
    census ROOT                 the projects found
    eval ROOT --expected FILE   precision and recall against JSON lines {project, direction, resource_type, resource_id}
    judge ROOT                  candidate pairs and verdicts; with --model those of a model
    test-llm ROOT --model URL   whether the model answers
    ratchet | rewrite | heal ROOT --out DIR   rules, recipes, healed copies of files; inputs are never changed

--inventory FILE (JSON of a code host) keeps only the projects that it names."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import judge, reports
from weft.plans import exports, pipeline, remediate
from weft.plans.catalog import Catalog
from weft.sources import files, inventory

#: Rows that a shell shows; files under --out have all.
SHOWN = 500


def _told(rows: DataFrame, path: str) -> None:
    """All rows as JSON lines in a folder, and the first of them in the shell."""
    rows.write.mode("overwrite").json(path)
    rows.show(SHOWN, truncate=False)


def _write_texts(rows: DataFrame, out: Path) -> int:
    """Few and small files, by name and content."""
    out.mkdir(parents=True, exist_ok=True)
    n = 0
    for n, r in enumerate(rows.select("file", "content").toLocalIterator(), 1):
        (out / Path(r["file"]).name).write_text(r["content"])
    return n


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weft", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("run", "incremental", "census", "eval", "judge", "test-llm", "ratchet", "rewrite", "heal"))
    parser.add_argument("root")
    parser.add_argument("--out", default="site")
    parser.add_argument("--expected")
    parser.add_argument("--inventory")
    parser.add_argument("--model", help="address of a chat completion service")
    parser.add_argument("--model-name", default="default")
    parser.add_argument("--key-file", type=Path)
    parser.add_argument("--no-semantic", action="store_true")
    parser.add_argument("--remediate", action="store_true")
    a = parser.parse_args(args)
    client = judge.Client(a.model, a.model_name, a.key_file.read_text().strip() if a.key_file else None) if a.model else None
    if a.command == "test-llm":
        if client is None:
            parser.error("test-llm needs --model")
        ready, said = judge.preflight(client)
        print(said)
        return 0 if ready else 1
    spark = SparkSession.builder.appName("weft").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = Path(a.out)
    if a.command == "census":
        all_files = files.scan(spark, a.root)
        dirs = files.named(files.projects(all_files))
        placed = files.in_projects(all_files, dirs)
        found = dirs.join(files.owners(all_files, dirs), "project_id").join(files.primary(files.detected(placed)), "project_id", "left")
        _told(found.join(files.lines_of_code(placed), "project_id", "left"), f"{a.out}/census")
        return 0
    items = inventory.parse(spark, spark.read.text(a.inventory, wholetext=True)) if a.inventory else None
    config = pipeline.Config(semantic=not a.no_semantic, remediate=a.remediate or a.command in ("ratchet", "rewrite"))
    if client:
        config.judge = judge.by_model(client)
    if a.command == "incremental":
        states, r = pipeline.incremental(spark, a.root, Catalog(spark, f"{a.out}/store"), config, items)
        states.groupBy("state").count().show()
    elif a.command == "heal":
        changed, report = pipeline.heal(spark, a.root, config, items)
        changed.write.mode("overwrite").json(f"{a.out}/healed")
        _told(report.orderBy("resource_type", "resource_id"), f"{a.out}/healing")
        return 0
    else:
        r = pipeline.run(spark, a.root, config, items)
    if a.command in ("run", "incremental"):
        for name, df in r.tables.items():
            if name != "files":
                df.write.mode("overwrite").parquet(f"{a.out}/tables/{name}")
        exports.write_site(r.tables, out)
        r["capabilities"].limit(10).show(truncate=False)
        print({k: round(v, 2) for k, v in r.seconds.items()})
    elif a.command == "eval":
        key = ("direction", "resource_type", "resource_id")
        got = r["facts"].withColumn("project", F.split_part("module_id", F.lit(":"), F.lit(1)))
        gaps = r["gaps"].select(F.split_part("module_id", F.lit(":"), F.lit(1)).alias("project"))
        _told(reports.evaluation(spark.read.json(a.expected), got, gaps, "project", *key), f"{a.out}/eval")
    elif a.command == "judge":
        _told(r["judgements"].select("a", "b", "similarity", "tier", "confirmed", "confidence", "play", "reason").orderBy(F.desc("similarity")), f"{a.out}/judgements")
    elif a.command in ("ratchet", "rewrite"):
        print(_write_texts(r["ratchets" if a.command == "ratchet" else "recipes"], out), "files in", out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
