"""Registry snapshots: tables in a versioned folder with a manifest of SHA-256 sums that is checked on reading."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dictionary import ENTITY
from ..operators.registry import database_summary, with_forms

TABLES = ("agents", "aliases", "forms", "sources")
MANIFEST = "version string, files map<string,string>"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256) of a snapshot's data files, by their path under it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load([f"{folder}/{t}" for t in TABLES])
    return files.select(F.regexp_extract("path", f"/((?:{'|'.join(TABLES)})/[^/]*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(entities: DataFrame, forms: DataFrame, root: str, version: str) -> None:
    """Write ``root/version`` with its manifest, and point ``current`` at it."""
    spark = entities.sparkSession
    folder = f"{root}/{version}"
    full = with_forms(entities, forms)
    full.write.mode("overwrite").json(f"{folder}/agents")
    full.select(F.col("id").alias("entity_id"), F.posexplode("aliases").alias("ord", "alias")).write.mode("overwrite").json(f"{folder}/aliases")
    forms.write.mode("overwrite").json(f"{folder}/forms")
    database_summary(full).write.mode("overwrite").json(f"{folder}/sources")
    sums = checksums(spark, folder).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "sha256")))).alias("files"))
    sums.select(F.lit(version).alias("version"), "files").write.mode("overwrite").json(f"{folder}/manifest")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{root}/current")


def current_version(spark: SparkSession, root: str) -> str:
    """The version that was written last; ``unversioned`` if none was."""
    fs, path = _fs(spark, f"{root}/current")
    if not fs.exists(path):
        return "unversioned"
    row = spark.read.schema("version string").json(f"{root}/current").select("version", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("f")).orderBy(F.desc("t"), F.desc("f")).first()
    return row.version if row else "unversioned"


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(file, expected, found): files whose sums differ, or that only one side has."""
    expected = spark.read.schema(MANIFEST).json(f"{folder}/manifest").select(F.explode("files").alias("file", "expected"))
    return expected.join(checksums(spark, folder), "file", "full_outer").withColumnRenamed("sha256", "found").where(~F.col("expected").eqNullSafe(F.col("found")))


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The entities of a snapshot, after its sums were checked."""
    folder = f"{root}/{version or current_version(spark, root)}"
    fs, path = _fs(spark, f"{folder}/manifest")
    if not fs.exists(path):
        raise FileNotFoundError(f"no registry snapshot at {folder}")
    wrong = [r.file for r in verify(spark, folder).limit(5).collect()]
    if wrong:
        raise ValueError(f"snapshot {folder} doesn't match its manifest: {', '.join(wrong)}")
    entities = spark.read.schema(ENTITY).json(f"{folder}/agents").drop("runtime_forms")
    forms = spark.read.schema("entity_id string, ord int, text string, source_type string").json(f"{folder}/forms")
    return with_forms(entities, forms)


def write_change(changes: DataFrame, root: str) -> None:
    """Changes (timestamp, action, card_id, details) appended to the log."""
    changes.write.mode("append").json(f"{root}/change_log")


# --- bundles -------------------------------------------------------------------------------------------------------

BUNDLE_FILES = ("agents.json", "aliases.json", "forms.json", "sources.json")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, a = _fs(spark, old)
    _, b = _fs(spark, new)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"can't move {old} to {new}")


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def bundle_tables(entities: DataFrame, forms: DataFrame) -> dict[str, DataFrame]:
    """The files of a bundle, each as one column of JSON rows in order."""
    full = with_forms(entities, forms).orderBy("ord")
    source = F.array_join("sources", "; ").alias("source")
    agents = full.select(F.to_json(F.struct("id", "name", "entity_type", "statuses", "aliases", source, "metadata")).alias("json"))
    aliases = full.select("ord", F.col("id").alias("entity_id"), F.posexplode("aliases").alias("no", "alias")).orderBy("ord", "no").select(F.to_json(F.struct("entity_id", "alias")).alias("json"))
    places = entities.select("id", F.col("ord").alias("place"))
    listed = forms.join(places, F.col("entity_id") == F.col("id")).orderBy("place", "ord").select(F.to_json(F.struct("entity_id", "text", "source_type")).alias("json"))
    return {"agents.json": agents, "aliases.json": aliases, "forms.json": listed, "sources.json": database_summary(full).select(F.to_json(F.struct("entity_count", "sources")).alias("json"))}


def export_bundle(entities: DataFrame, forms: DataFrame, path: str, version: str) -> dict[str, str]:
    """A zip of the registry with a manifest of SHA-256 sums, which is returned; a registry is small enough for the driver to pack."""
    contents: dict[str, bytes] = {}
    for name, df in bundle_tables(entities, forms).items():
        rows = [r.json for r in df.toLocalIterator()]
        text = rows[0] if name == "sources.json" else "[" + ",\n".join(rows) + "]"
        contents[name] = text.encode()
    content, sums = _zipped(contents, version)
    write_bytes(entities.sparkSession, path, content)
    return sums


def _zipped(contents: dict[str, bytes], version: str) -> tuple[bytes, dict[str, str]]:
    sums = {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in contents.items():
            z.writestr(name, content)
        z.writestr("manifest.json", json.dumps({"version": version, "files": sums}, ensure_ascii=False))
    return out.getvalue(), sums


def packed(spark: SparkSession, folder: str, version: str) -> bytes:
    """A bundle of the files of an unpacked registry, as they are."""
    return _zipped({name: read_bytes(spark, f"{folder}/{name}") for name in BUNDLE_FILES}, version)[0]


def open_bundle(content: bytes) -> dict[str, bytes]:
    """The files of a bundle, all there, none outside its folder, and with the sums that the manifest gives."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        unsafe = [n for n in names if n.startswith(("/", "\\")) or ":" in n or ".." in n.replace("\\", "/").split("/")]
        if unsafe:
            raise ValueError(f"unsafe names in the bundle: {', '.join(unsafe)}")
        missing = [n for n in (*BUNDLE_FILES, "manifest.json") if n not in names]
        if missing:
            raise ValueError(f"the bundle lacks {', '.join(missing)}")
        files = {n: z.read(n) for n in (*BUNDLE_FILES, "manifest.json")}
    expected = json.loads(files["manifest.json"]).get("files", {})
    wrong = [n for n in BUNDLE_FILES if expected.get(n) != hashlib.sha256(files[n]).hexdigest()]
    if wrong:
        raise ValueError(f"the bundle doesn't match its manifest: {', '.join(wrong)}")
    return files


def import_bundle(spark: SparkSession, bundle: str, root: str) -> str:
    """Unpack a verified bundle as ``root/current``; what was current becomes ``root/previous``."""
    incoming, current, previous = (f"{root}/{n}" for n in ("incoming", "current", "previous"))
    files = open_bundle(read_bytes(spark, bundle))
    _delete(spark, incoming)
    for name, content in files.items():
        write_bytes(spark, f"{incoming}/{name}", content)
    _delete(spark, previous)
    if exists(spark, current):
        _move(spark, current, previous)
    _move(spark, incoming, current)
    return current


def ready_folder(spark: SparkSession, root: str, fetch: Callable[[], str] | None = None) -> str:
    """The first complete registry folder of ``root/current`` and ``root``; else what ``fetch`` (a bundle's path) brings, else an error."""
    for folder in (f"{root}/current", root):
        if all(exists(spark, f"{folder}/{n}") for n in BUNDLE_FILES):
            return folder
    if fetch is None:
        raise FileNotFoundError(f"no registry under {root}")
    return import_bundle(spark, fetch(), root)


def folder_version(spark: SparkSession, folder: str) -> str:
    """The manifest's version; ``unversioned`` without a manifest, ``unknown`` if it names none."""
    path = f"{folder}/manifest.json"
    return str(json.loads(read_bytes(spark, path)).get("version", "unknown")) if exists(spark, path) else "unversioned"


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The entities of an unpacked bundle, with their runtime forms."""
    text = lambda name: spark.read.text(f"{folder}/{name}", wholetext=True)
    entity = "array<struct<id:string,name:string,entity_type:string,statuses:array<string>,aliases:array<string>,source:string,metadata:map<string,string>>>"
    each = text("agents.json").select(F.posexplode(F.from_json("value", entity)).alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.*")
    sources = F.filter(F.transform(F.split("source", ";"), lambda x: F.trim(x)), lambda x: x != "")
    entities = each.select("ord", "id", "name", "entity_type", "statuses", "aliases", sources.alias("sources"), F.map_filter("metadata", lambda k, v: k != "runtime_forms").alias("metadata"))
    form = "array<struct<entity_id:string,text:string,source_type:string>>"
    forms = text("forms.json").select(F.posexplode(F.from_json("value", form)).alias("ord", "f")).select("f.entity_id", "ord", F.trim("f.text").alias("text"), "f.source_type")
    return with_forms(entities, forms)
