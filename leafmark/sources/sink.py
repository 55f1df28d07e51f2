"""A sink of one file a row, and downloads through it: ``df.write.format("one_file")``.

A row has a ``key`` and ``files``, each with a name and either its content or an address
to copy it from in pieces. A task writes to a folder of its own beside the target, and a
file gets its name by a move once it is whole: there is never half a file. ``publish``
is ``all`` (the driver moves the files of the tasks that count when all are done, and of a
failed job nothing is left) or ``each`` (a row's files are moved as soon as they are all
whole, so that what a broken run got needn't be fetched again). Names come from the rows,
so a task that runs twice, or a job, gives the same files. With ``errors`` of ``report`` a
row that fails is told in the folder ``statuses``, and has no new file.
"""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from leafmark.sources.harvest import Patience, opened
from leafmark.workers import find_us

FILES_TYPE = "key string, files array<struct<name:string,content:binary,url:string>>"
STATUS_TYPE = "key string, status string, error string"
PIECE = 1 << 20
#: Files that the commit moves at a time, and tasks for each core that write files.
MOVES, TASKS = 16, 4


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task whose files count."""

    folder: str


def _names(store: stores.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(stores.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == stores.FileType.File)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.each, self.report = options["path"].rstrip("/"), options.get("publish", "all") == "each", options.get("errors", "fail") == "report"
        self.statuses, self.job = options.get("statuses", "").rstrip("/"), uuid.uuid4().hex
        self.limit = float(options.get("limit", 60))

    def _stage(self, root: str) -> str:
        return f"{root}/_staged-{self.job}"

    def write(self, rows: Iterator[Row]) -> Staged:
        store, root = opened(self.path)
        folder = f"{self._stage(root)}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        told: list[tuple] = []
        for row in rows:
            names = [f["name"] for f in row["files"]]
            try:
                if any("/" in n or not n for n in names):
                    raise ValueError(f"not a file's name: {names}")
                for f in row["files"]:
                    self._put(store, f"{folder}/{f['name']}", f)
                if self.each:
                    for name in names:
                        store.move(f"{folder}/{name}", f"{root}/{name}")
                told.append((row["key"], "ok", None))
            except Exception as why:
                if not self.report:
                    raise
                for name in names:
                    if "/" not in name and store.get_file_info(f"{folder}/{name}").type == stores.FileType.File:
                        store.delete_file(f"{folder}/{name}")
                told.append((row["key"], "error", str(why)))
        if self.statuses and told:
            self._tell(told)
        return Staged(folder)

    def _put(self, store: stores.FileSystem, at: str, f: Row) -> None:
        def once() -> None:
            size = 0
            with store.open_output_stream(at) as out:
                if f["url"] is None:
                    out.write(bytes(f["content"]))
                    return
                request = urllib.request.Request(f["url"], headers={"User-Agent": "leafmark"})
                with urllib.request.urlopen(request, timeout=self.limit) as answer:
                    while piece := answer.read(PIECE):
                        size += out.write(piece) or len(piece)
            if not size:
                raise ValueError("an empty file")

        Patience().attempt(once) if f["url"] is not None else once()

    def _tell(self, told: list[tuple]) -> None:
        store, folder = opened(self.statuses)
        store.create_dir(folder, recursive=True)
        name = f"{self.job}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{folder}/_{name}") as out:
            out.write("".join(json.dumps(dict(zip(("key", "status", "error"), t, strict=True))) + "\n" for t in told).encode())
        store.move(f"{folder}/_{name}", f"{folder}/{name}")

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.path)
        with ThreadPoolExecutor(MOVES) as pool:  # a move is a wait for the store
            for message in messages if not self.each else ():
                names = _names(store, message.folder) if message else []
                for _ in pool.map(lambda some, at=message: [store.move(f"{at.folder}/{n}", f"{root}/{n}") for n in some], (names[i : i + 500] for i in range(0, len(names), 500))):
                    pass
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Nothing of the job is left but what was published."""
        store, root = opened(self.path)
        if store.get_file_info(self._stage(root)).type == stores.FileType.Directory:
            store.delete_dir(self._stage(root))


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file"

    def schema(self) -> str:
        return FILES_TYPE

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def save_files(rows: DataFrame, path: str, publish: str = "all", errors: str = "fail", statuses: str = "") -> None:
    """Write ``rows`` (key, files); see the module."""
    spark = rows.sparkSession
    find_us(spark)
    spark.dataSource.register(OneFile)
    rows.select("key", F.col("files").cast("array<struct<name:string,content:binary,url:string>>").alias("files")).write.format("one_file").options(publish=publish, errors=errors, statuses=statuses).mode("append").save(path)


def save_json(rows: DataFrame, name: str, path: str) -> None:
    """A JSON file for each row, named ``<value of name>.json``, without null fields; all or none.
    Files take far longer than their rows' bytes tell, so rows are dealt to tasks by name."""
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"pretty": "true"}).cast("binary")
    one = F.struct(F.concat(F.col(name), F.lit(".json")).alias("name"), content.alias("content"), F.lit(None).cast("string").alias("url"))
    named = rows.select(F.col(name).cast("string").alias("key"), F.array(one).alias("files"))
    save_files(named.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, "key"), path)


def read_statuses(spark: SparkSession, statuses: str) -> DataFrame:
    """(key, status, error) of every row that was tried."""
    return spark.read.schema(STATUS_TYPE).json(statuses)


def wanted_files(entries: DataFrame, listing: DataFrame, parts: int = 8) -> DataFrame:
    """(key, files) of entries with both links: those of a book's two files that aren't there."""
    links = {".dnb_toc.pdf": "dnb_toc_download_url", ".fulltext.pdf": "oa_pdf_url"}
    asked = entries.filter(" and ".join(f"{c} <> ''" for c in links.values()))
    each = F.explode(F.array(*[F.struct(F.concat("isbn", F.lit(end)).alias("name"), F.lit(None).cast("binary").alias("content"), F.col(c).alias("url")) for end, c in links.items()]))
    rows = asked.select(F.col("isbn").alias("key"), each.alias("f")).withColumn("name", F.col("f.name")).dropDuplicates(["name"])
    left = rows.join(listing.select("name").distinct(), "name", "left_anti")
    return left.groupBy("key").agg(F.sort_array(F.collect_list("f")).alias("files")).repartition(parts, "key")
