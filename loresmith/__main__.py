"""Commands: ``python -m loresmith COMMAND --help`` tells what each takes."""

from __future__ import annotations

import argparse

from . import catalogue


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loresmith", description=__doc__)
    parts = top.add_subparsers(dest="command", required=True)

    def add(name: str, told: str, *arguments: str) -> argparse.ArgumentParser:
        made = parts.add_parser(name, help=told, description=told)
        for a in arguments:
            made.add_argument(a)
        return made

    add("list", "Name the queries.")
    add("run", "Run a query over the tables of a folder.", "name", "folder").add_argument("--out")
    add("inventory", "Count words, lines and blocks of the scripts below a folder, by folder and over all.", "folder").add_argument("--out")
    add("encounters", "What the missions of the scripts below a folder can show.", "folder").add_argument("--out")
    add("validate", "Tell the faults of a file of records, or of a whole bundle.", "path").add_argument("--split")
    made = add("view", "Write a page to browse samples (JSON lines with sample_id) with saved runs.", "samples", "page")
    made.add_argument("--manifest", default="", help="hash of the dataset's manifest, which each run must name")
    made.add_argument("--run", action="append", default=[], help="folder of a run; may be repeated")
    return top


def main(arguments: list[str] | None = None) -> None:
    chosen = parser().parse_args(arguments)
    catalogue.load()
    if chosen.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans import narrative, report
    from .sources import bundles, files, scripts

    spark = SparkSession.builder.appName("loresmith").getOrCreate()
    if chosen.command == "view":
        samples = spark.read.json(chosen.samples)
        runs = {}
        for folder in chosen.run:
            info, rows = files.viewer_run(spark, folder, chosen.manifest, samples)
            runs[info["name"]] = rows
        print(report.write_sample_page(samples, chosen.page, runs), "samples")
        return
    if chosen.command == "validate":
        whole = bundles.exists(spark, f"{chosen.path}/manifest")
        faults = bundles.bundle_faults(spark, chosen.path) if whole else bundles.read_records(spark, chosen.path, chosen.split).where("fault IS NOT NULL").select("path", "line", "fault")
        faults.show(1000, truncate=False)
        if not faults.isEmpty():
            raise SystemExit(1)
        return
    if chosen.command == "run":
        found = catalogue.QUERIES[chosen.name](spark, chosen.folder)
    else:
        sources = scripts.read_scripts(spark, chosen.folder)
        found = scripts.inventory_totals(scripts.script_nodes(sources)) if chosen.command == "inventory" else narrative.mission_encounters(sources.select(F.lit("all").alias("corpus"), "path", "text"))
    found.write.mode("errorifexists").parquet(chosen.out) if chosen.out else found.show(50, truncate=80)


if __name__ == "__main__":
    main()
