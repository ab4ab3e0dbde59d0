"""A table that grows by numbered batches: one folder for each, merged now and then, with a manifest that says what counts.

Layout: ``batch=N`` holds batch N, ``merged/<name>`` what was merged, ``_manifests/<number>`` the name of the merged
folder and the last batch in it. A manifest is written beside its place and moved there, so a reader sees the old state
or the new one. What a manifest replaced is deleted at the next merge only: readers of the state before still find it.
One stream writes a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.session import delete, file_system


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _manifests(spark: SparkSession, base: str) -> list[str]:
    return [n for n in _names(spark, f"{base}/_manifests") if n.isdigit()]


def _manifest(spark: SparkSession, base: str, name: str) -> dict:
    fs, path = file_system(spark, f"{base}/_manifests/{name}")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, base: str, state: dict) -> None:
    known = _manifests(spark, base)
    name = f"{int(known[-1]) + 1 if known else 0:020d}"
    fs, draft = file_system(spark, f"{base}/_manifests/.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    if not fs.rename(draft, file_system(spark, f"{base}/_manifests/{name}")[1]):
        raise RuntimeError(f"another writer has merged {base}")


def write_batch(rows: DataFrame, base: str, number: int) -> None:
    """Write batch ``number``; a batch that runs again replaces its folder, and one that was merged already stays out."""
    rows.write.mode("overwrite").parquet(f"{base}/batch={number}")


def _state(spark: SparkSession, base: str) -> tuple[dict, list[int]]:
    """The newest manifest, and the batches after it."""
    known = _manifests(spark, base)
    state = _manifest(spark, base, known[-1]) if known else {"merged": None, "upto": -1}
    batches = [int(n.removeprefix("batch=")) for n in _names(spark, base) if n.startswith("batch=")]
    return state, sorted(b for b in batches if b > state["upto"])


def read_batches(spark: SparkSession, base: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows that count: of the merged folder and of the batches after it, up to ``before``, exclusive."""
    state, batches = _state(spark, base)
    paths = ([f"{base}/merged/{state['merged']}"] if state["merged"] else []) + [f"{base}/batch={b}" for b in batches if before is None or b < before]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batches(spark: SparkSession, base: str, schema: str, upto: int, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge all up to batch ``upto`` into one folder. A batch that runs again must be later than ``upto``."""
    state, batches = _state(spark, base)
    if not [b for b in batches if b <= upto]:
        return
    name = uuid.uuid4().hex
    merge(read_batches(spark, base, schema, upto + 1)).write.parquet(f"{base}/merged/{name}")
    # what the manifest before this one replaced is read by nobody any more
    old = [n for n in _names(spark, base) if n.startswith("batch=") and int(n.removeprefix("batch=")) <= state["upto"]]
    stale = [f"{base}/{n}" for n in old] + [f"{base}/merged/{n}" for n in _names(spark, f"{base}/merged") if n not in (name, state["merged"])]
    stale += [f"{base}/_manifests/{n}" for n in _manifests(spark, base)[:-1]]
    _commit(spark, base, {"merged": name, "upto": upto})
    for path in stale:
        delete(spark, path)
