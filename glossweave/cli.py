"""The command line: annotate texts against a registry folder, rebuild the registry from files, export it as a bundle, serve updates once.

    python -m glossweave.cli --registry FOLDER --text "..." [--json]
    python -m glossweave.cli --registry FOLDER --input FILE_OR_FOLDER
    python -m glossweave.cli --registry FOLDER --update foreign_agents=a.xlsx rosfinmonitoring=b.docx
    python -m glossweave.cli --registry FOLDER --export bundle.zip [--version v]
"""

from __future__ import annotations

import argparse
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, matching, presentation, registry
from .sources import files, settings, snapshots, workbooks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Mark mentions of registry entities in texts.")
    p.add_argument("--registry", required=True, help="folder with current/ and previous/")
    p.add_argument("--text")
    p.add_argument("--input", help="text file, or a folder of them")
    p.add_argument("--json", action="store_true", help="print the matches too")
    p.add_argument("--update", nargs="+", metavar="SOURCE=FILE", help="rebuild from these files")
    p.add_argument("--export", metavar="ZIP")
    p.add_argument("--version", help="of the bundle; by default the time")
    return p


def _imported(spark: SparkSession, source: str, path: str) -> DataFrame:
    if source == "foreign_agents":
        return registry.import_foreign_agents(_sheet(spark, path))
    if source == "undesirable_organizations":
        return registry.import_undesirable_organizations(_sheet(spark, path))
    if source == "rosfinmonitoring":
        return registry.import_listed(files.read_lines(spark, path))
    if source == "extremist_materials":
        return registry.import_materials(files.read_docx(spark, path))
    raise ValueError(f"unknown source: {source}")


def _sheet(spark: SparkSession, path: str) -> DataFrame:
    return files.first_sheet(files.read_xls(spark, path) if path.lower().endswith(".xls") else files.read_xlsx(spark, path))


def update(spark: SparkSession, folder: str, sources: dict[str, str], version: str) -> int:
    """Build a registry from source files and the folder's workbook, make it current, and count its entities."""
    scratch = f"{folder}/scratch-{uuid.uuid4().hex}"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}")

    try:
        manual = workbooks.read_manual(spark, f"{folder}/manual_registry.xlsx")
        built = build.build({s: _imported(spark, s, p) for s, p in sources.items()}, manual, save)
        workbooks.write_manual(built.manual, f"{folder}/manual_registry.xlsx")
        bundle = f"{scratch}/bundle.zip"
        snapshots.export_bundle(built.entities, built.forms, bundle, version)
        snapshots.import_bundle(spark, bundle, folder)
        return built.entities.count()
    finally:
        snapshots._delete(spark, scratch)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if not (args.text or args.input or args.update or args.export):
        _parser().error("give a text, an input, an update or an export")
    if spark is None:
        from .session import local_session

        spark = local_session()
    version = args.version or settings.local_version(datetime.now())
    if args.update:
        n = update(spark, args.registry, dict(x.split("=", 1) for x in args.update), version)
        print(f"{n} entities")
    folder = snapshots.ready_folder(spark, args.registry)
    if args.export:
        snapshots.write_bytes(spark, args.export, snapshots.packed(spark, folder, version))
        print(f"exported {args.export}")
    if args.text or args.input:
        entities = snapshots.read_folder(spark, folder)
        texts = spark.createDataFrame([(0, args.text)], "doc_id long, text string") if args.text else files.read_texts(spark, args.input).select(F.monotonically_increasing_id().alias("doc_id"), "text")
        found = matching.mentions(texts, entities).cache()
        for r in presentation.annotate(presentation.with_entities(found, entities)).select("marked_text").toLocalIterator():
            print(r.marked_text)
        if args.json:
            for r in presentation.matches_json(found, entities).toLocalIterator():
                print(r.json)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
