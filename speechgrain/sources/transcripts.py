"""Transcript, profile and session files as DataFrames, and their sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechgrain.operators.segments import normalize
from speechgrain.sources.files import as_text, exists, write_files

#: All scalars are read as text, so ids that are numbers in one file and strings in another agree.
SEGMENT = "struct<text:string,start_time:string,start:string,end_time:string,end:string,duration:string,speaker_id:string,speaker:string,source:string,speaker_name:string>"
TRANSCRIPT = f"struct<audio_file:string,backend:string,device:string,model_path:string,text:string,diarised_text:string,duration_seconds:double,segments:array<{SEGMENT}>>"
PROFILE = "id string, displayName string, createdAt string, updatedAt string, embeddingProvider string, embeddingModel string, embedding array<double>, samplePaths array<string>, sampleDurationSeconds double, notes string, _corrupt string"
SESSION = "title string, mode string, status string, session_dir string, started_at string, ended_at string, transcribed_at string, failed_at string, failure_reason string, run_id string, audio_files array<string>, attendees array<struct<name:string,address:string>>, _corrupt string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per JSON file: path, parsed header and segments; both shapes (an object with segments, a bare list) are read.

    ``valid`` is false where the text is neither.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    as_object, as_list = F.from_json("value", TRANSCRIPT), F.from_json("value", f"array<{SEGMENT}>")
    is_list = F.trim("value").startswith("[")
    parsed = raw.withColumn("doc", F.when(~is_list, as_object)).withColumn("items", F.when(is_list, as_list).otherwise(F.col("doc.segments")))
    return parsed.select("path", "doc.audio_file", "doc.backend", "doc.duration_seconds", "doc.text", "items", F.col("items").isNotNull().alias("valid"))


def segments(spark: SparkSession, path: str, drop_blank: bool = False) -> DataFrame:
    """Canonical segments of all transcript files, ``seg_idx`` being the position in the file."""
    rows = documents(spark, path).select("path", F.posexplode("items").alias("seg_idx", "s")).select("path", F.col("seg_idx").cast("long").alias("seg_idx"), "s.*")
    return normalize(rows, drop_blank)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Speaker profiles: every JSON file but the index; unreadable files and those with neither id nor embedding are left out."""
    raw = spark.read.schema(PROFILE).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)
    named = raw.withColumn("_file", F.input_file_name())
    return named.where(~F.col("_file").endswith("/index.json") & F.col("_corrupt").isNull() & (F.col("id").isNotNull() | F.col("embedding").isNotNull())).drop("_corrupt", "_file")


def profile_list(profiles_: DataFrame) -> DataFrame:
    """One JSON document with all profiles: what other programs read as one file, so it must fit in one row."""
    return profiles_.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*profiles_.columns))).alias("profiles"))).alias("json"))


#: What the index of a profile folder has of each profile: enough to list them without their embeddings.
SUMMARY = ("id", "displayName", "createdAt", "updatedAt", "embeddingProvider", "embeddingModel")


def index_of(profiles_: DataFrame) -> DataFrame:
    return profiles_.select(*SUMMARY)


def profile_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a profile folder; without an index file it is empty."""
    summary = ", ".join(f"{c} string" for c in SUMMARY)
    if not exists(f"{folder}/index.json"):
        return spark.createDataFrame([], summary)
    raw = spark.read.schema(f"profiles array<struct<{summary.replace(' string', ':string')}>>").option("multiLine", "true").json(f"{folder}/index.json")
    return raw.select(F.explode("profiles").alias("p")).select("p.*")


def name_order(name: Column) -> Column:
    """A key that sorts names as people do: case aside, and numbers in them by value."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.ltrim(p, F.lit("0")), 24, "0")).otherwise(p)), "")


def list_profiles(index: DataFrame, profiles_: DataFrame | None = None) -> DataFrame:
    """The index in order of names, then ids; with ``profiles_`` the whole profiles that it names."""
    rows = index if profiles_ is None else profiles_.join(index.select("id"), "id", "left_semi")
    return rows.orderBy(name_order(F.col("displayName")), "displayName", "id")


def rename(profiles_: DataFrame, renames: DataFrame, at: Column) -> DataFrame:
    """``profiles_`` with the names of ``renames(id, new_name)``, changed at ``at``."""
    joined = profiles_.join(renames.select("id", "new_name"), "id", "left")
    hit = F.col("new_name").isNotNull()
    return joined.withColumns({"displayName": F.coalesce("new_name", "displayName"), "updatedAt": F.when(hit, at.cast("string")).otherwise(F.col("updatedAt"))}).select(*profiles_.columns)


def remove(profiles_: DataFrame, ids: DataFrame) -> DataFrame:
    """``profiles_`` without those of ``ids(id)``."""
    return profiles_.join(ids.select("id"), "id", "left_anti")


def unknown_ids(profiles_: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids(id)`` that no profile has: what a rename or removal must report."""
    return ids.select("id").distinct().join(profiles_.select("id"), "id", "left_anti")


def save_profiles(profiles_: DataFrame, folder: str) -> DataFrame:
    """A file for each profile and the index of all of them; files of other profiles in the folder stay."""
    files = as_text(profiles_, F.concat(F.col("id"), F.lit(".json")), F.to_json(F.struct(*profiles_.columns)))
    index = profiles_.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*SUMMARY))).alias("profiles"))).alias("j"))
    return write_files(files.unionByName(as_text(index, F.lit("index.json"), F.col("j"))), folder)


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """``*/metadata.json`` below ``root``, unreadable ones left out, newest first."""
    raw = spark.read.schema(SESSION).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*/metadata.json")
    return raw.withColumn("metadata_path", F.input_file_name()).where("_corrupt is null").drop("_corrupt").orderBy(F.desc_nulls_last("started_at"), "metadata_path")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def publish(df: DataFrame, root: str, run_id: str, valid: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Write under ``root/staging/run_id`` with a completion mark; readers use ``read_published``.

    Spark's committer makes the run's files appear together; a run that died leaves no ``_SUCCESS`` and is never read. A run
    whose written rows ``valid`` refuses stays staged, and what was published before stays in place; so does a run during which
    another was published, which may have been made from older data.
    """
    at, spark = f"{root}/staging/{run_id}", df.sparkSession
    seen = _entries(spark, root)
    df.write.mode("errorifexists").parquet(at)
    if valid is not None and not valid(spark.read.parquet(at)):
        raise ValueError(f"run {run_id} isn't valid; it stays in {at}")
    _point(spark, root, seen, run_id, at)
    return spark.read.parquet(at)


def _entries(spark: SparkSession, root: str) -> list[tuple[int, dict | None]]:
    """(number, run) of what was published, in order; None for an entry without content, which a run is just writing or died at."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    numbers = sorted(int(n) for n in names if n.isdigit())
    texts = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").load(f"{root}/published").select("path", "content").collect()} if numbers else {}
    return [(n, json.loads(texts[str(n)]) if texts.get(str(n)) else None) for n in numbers]


def _point(spark: SparkSession, root: str, seen: list[tuple[int, dict | None]], run_id: str, at: str) -> None:
    """Publish by creating the entry after those ``seen``, which only one run can."""
    if seen and seen[-1][1] is None:
        raise RuntimeError(f"{root}/published/{seen[-1][0]} is empty: a run is being published, or died as it was; remove it in that case")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published/{seen[-1][0] + 1 if seen else 1}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    try:
        out = files.create(path, False)
    except Exception as error:
        raise RuntimeError(f"another run was published meanwhile; {run_id} stays in {at}") from error
    out.write(bytearray(json.dumps({"run_id": run_id, "path": at}).encode()))
    out.hsync()
    out.close()


def roll_back(spark: SparkSession, root: str) -> str | None:
    """Publish again what was published before the present run; returns its run id, or None if there is none."""
    seen = _entries(spark, root)
    runs = [run for _, run in seen if run]
    earlier = [run for run in runs if run["path"] != runs[-1]["path"]]
    if not earlier:
        return None
    _point(spark, root, seen, earlier[-1]["run_id"], earlier[-1]["path"])
    return earlier[-1]["run_id"]


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The data of the run that was published last."""
    runs = [run for _, run in _entries(spark, root) if run]
    if not runs:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(runs[-1]["path"])
