"""Small files of sessions: written each under its own name, promoted together or not at all, and kept as artifacts."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = ".promotion.json"


def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which only a local master may leave unset."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="speechgrain-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of the shared one and read from there: what made it isn't run again, whoever is lost."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(path: str) -> bool:
    where, name = file_system(path)
    return where.get_file_info(name).type.name == "File"


def read_bytes(path: str) -> bytes:
    where, name = file_system(path)
    with where.open_input_file(name) as file:
        return file.read()


def write_bytes(path: str, data: bytes) -> None:
    """Write under another name, then move: a reader sees the old file or the new one."""
    where, name = file_system(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(draft) as file:
        file.write(data)
    if where.type_name == "local":
        with open(draft, "rb+") as file:
            os.fsync(file.fileno())
    where.move(draft, name)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each of ``files(path, content binary)`` below ``root``, in tasks; returns path, length and SHA-256 of each.

    A task that is run again writes the same bytes under the same name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                write_bytes(f"{root}/{path}", bytes(content))
            yield pd.DataFrame({"path": batch["path"], "length": [len(c) for c in batch["content"]], "sha256": [hashlib.sha256(bytes(c)).hexdigest() for c in batch["content"]]})

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, length long, sha256 string")


def as_text(rows: DataFrame, path, text) -> DataFrame:
    """``(path, content)`` for ``write_files`` from a path and a text column; texts end with a line end."""
    return rows.select(path.alias("path"), F.encode(F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n")), "UTF-8").alias("content"))


# --- promotion ---------------------------------------------------------------------------------------------------------


def _digest(path: str) -> str | None:
    return hashlib.sha256(read_bytes(path)).hexdigest() if exists(path) else None


def _delete(path: str) -> None:
    if exists(path):
        where, name = file_system(path)
        where.delete_file(name)


def _move(source: str, target: str) -> None:
    (where, a), (_, b) = file_system(source), file_system(target)
    where.move(a, b)


def promote(staging: str, target: str, names: list[str], move: Callable[[str, str], None] = _move) -> list[str]:
    """Replace the files ``names`` of ``target`` by those that ``staging`` has: all of them, or none.

    New contents and backups are written beside their targets and noted in a journal before the first move. What fails
    is rolled back; what is interrupted is settled by ``reconcile``, which also runs first. Returns the names replaced.
    """
    reconcile(target)
    found = [n for n in names if exists(f"{staging}/{n}")]
    if not found:
        return []
    run, entries = uuid.uuid4().hex, []
    for n in found:
        data, had = read_bytes(f"{staging}/{n}"), exists(f"{target}/{n}")
        write_bytes(f"{target}/.{n}.{run}.new", data)
        if had:
            write_bytes(f"{target}/.{n}.{run}.old", read_bytes(f"{target}/{n}"))
        entries.append({"name": n, "existed": had, "replaced": False, "new_sha256": hashlib.sha256(data).hexdigest()})
    journal = {"run_id": run, "entries": entries}
    write_bytes(f"{target}/{JOURNAL}", json.dumps(journal).encode())
    try:
        for e in entries:
            move(f"{target}/.{e['name']}.{run}.new", f"{target}/{e['name']}")
            e["replaced"] = True
            write_bytes(f"{target}/{JOURNAL}", json.dumps(journal).encode())
    except BaseException:
        reconcile(target)
        raise
    _clean(target, journal)
    return found


def journal_rows(spark: SparkSession, target: str) -> DataFrame:
    """The entries of a folder's journal, with the hash of what is there now, as ``catalog.journal_action`` takes them."""
    schema = "journal_id string, name string, existed boolean, replaced boolean, new_sha256 string, found_sha256 string"
    journal = json.loads(read_bytes(f"{target}/{JOURNAL}")) if exists(f"{target}/{JOURNAL}") else {"entries": []}
    return spark.createDataFrame([(journal["run_id"], e["name"], e["existed"], e["replaced"], e["new_sha256"], _digest(f"{target}/{e['name']}")) for e in journal["entries"]], schema)


def reconcile(target: str) -> str:
    """Settle a journal that a dead run left: keep if all files are the new ones, else give back the old ones.

    A journal that can't be read stays, and raises: what it was for isn't known.
    """
    if not exists(f"{target}/{JOURNAL}"):
        return "none"
    try:
        journal = json.loads(read_bytes(f"{target}/{JOURNAL}"))
        entries = [(e["name"], e["existed"], e["replaced"] or _digest(f"{target}/{e['name']}") == e["new_sha256"]) for e in journal["entries"]]
    except (ValueError, KeyError, TypeError) as error:
        raise RuntimeError(f"the journal {target}/{JOURNAL} can't be read; settle it by hand") from error
    keep = all(done for _, _, done in entries)
    if not keep:
        for name, existed, done in entries:
            if done and existed:
                write_bytes(f"{target}/{name}", read_bytes(f"{target}/.{name}.{journal['run_id']}.old"))
            elif done:
                _delete(f"{target}/{name}")
    _clean(target, journal)
    return "kept" if keep else "rolled back"


def _clean(target: str, journal: dict) -> None:
    for e in journal["entries"]:
        for end in ("new", "old"):
            _delete(f"{target}/.{e['name']}.{journal['run_id']}.{end}")
    _delete(f"{target}/{JOURNAL}")


# --- artifacts ---------------------------------------------------------------------------------------------------------


def artifact(path: str, make: Callable[[], dict], settings: dict, force: bool = False) -> dict:
    """The JSON artifact at ``path`` if it was made with the same ``settings``, else a new one, which is written."""
    if not force and exists(path):
        try:
            known = json.loads(read_bytes(path))
            if known.get("settings") == settings:
                return known
        except (ValueError, AttributeError):
            pass
    made = {**make(), "settings": settings}
    write_bytes(path, json.dumps(made, ensure_ascii=False, indent=2, sort_keys=True).encode() + b"\n")
    return made


def write_state(folder: str, state: dict) -> str:
    """A run's state as ``metadata.json`` in its folder."""
    path = f"{folder}/metadata.json"
    write_bytes(path, json.dumps(state, ensure_ascii=False, indent=2, sort_keys=True).encode() + b"\n")
    return path


def read_state(folder: str) -> dict:
    return json.loads(read_bytes(f"{folder}/metadata.json"))


def last_object(text: str) -> dict | None:
    """The JSON object that begins last in a text with other output around it, and is whole; None without any."""
    decoder, at = json.JSONDecoder(), text.rfind("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            found = None
        if isinstance(found, dict):
            return found
        at = text.rfind("{", 0, at)
    return None
