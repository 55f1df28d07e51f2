"""A paged OAI-PMH harvest as a Python data source, and HTTP lookups as table operators."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple, TypeVar

import pandas as pd
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from leafmark.functions import catalogue
from leafmark.workers import find_us

T = TypeVar("T")
PAUSE = 0.5


@dataclass(frozen=True)
class Patience:
    """How a request is tried: a wait after each failure but the last, and its time limit."""

    waits: tuple[float, ...] = (2.0, 4.0)
    limit: float = 30
    sleep: Callable[[float], None] = time.sleep

    def attempt(self, call: Callable[[], T]) -> T:
        for wait in self.waits:
            try:
                return call()
            except (urllib.error.URLError, TimeoutError):
                self.sleep(wait)
        return call()


def fetch(url: str, patience: Patience = Patience(), get=urllib.request.urlopen) -> bytes:
    """GET; certificates are always verified."""
    request = urllib.request.Request(url, headers={"User-Agent": "leafmark"})

    def once() -> bytes:
        with get(request, timeout=patience.limit) as answer:
            return answer.read()

    return patience.attempt(once)


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store and the path in it, of an address, or of a path that all machines share."""
    at = path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)
    store, root = stores.FileSystem.from_uri(at)
    return store, root.rstrip("/")


class Page(NamedTuple):
    """An answer of a harvest: its records, and the token of the next (empty on the last)."""

    records: list[str]
    token: str

    @classmethod
    def of(cls, xml: str) -> Page:
        return cls(re.findall(catalogue.RECORD, xml), "".join(re.findall(catalogue.TOKEN, xml)[:1]))


def page_url(base: str, of: str, token: str = "") -> str:
    """The address of a set's first answer, or of the one that a token stands for."""
    asked = {"verb": "ListRecords"} | ({"resumptionToken": token} if token else {"set": of, "metadataPrefix": "oai_dc"})
    return f"{base}?{urllib.parse.urlencode(asked)}"


def pages(base: str, of: str, token: str = "", get: Callable[[str], bytes] = fetch, pause: float = PAUSE) -> Iterator[Page]:
    """The answers from the token on, each asked for only when it is wanted."""
    found = Page.of(get(page_url(base, of, token)).decode("utf-8"))
    yield found
    while found.token:
        time.sleep(pause)
        found = Page.of(get(page_url(base, of, found.token)).decode("utf-8"))
        yield found


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One for each set: answers of a set follow one another by their tokens."""
        return [InputPartition(s) for s in self.options["sets"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        answers = pages(self.options["base"], partition.value, pause=float(self.options.get("pause", PAUSE)))
        for n, record in enumerate(chain.from_iterable(p.records for p in answers)):
            yield partition.value, n, record


class Notes:
    """What is known of a set's answers, in a folder that driver and executors share: for each
    answer that may be asked for, its token (null behind the last) and the records before it.
    A note gets its name once it is whole, and is written alike whoever writes it."""

    def __init__(self, folder: str):
        self.store, self.root = opened(folder)

    def _folder(self, of: str) -> str:
        return f"{self.root}/{urllib.parse.quote(of, safe='')}"

    def put(self, of: str, n: int, token: str | None, at: int) -> None:
        folder = self._folder(of)
        self.store.create_dir(folder, recursive=True)
        draft = f"{folder}/_{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as out:
            out.write(json.dumps({"token": token, "at": at}).encode())
        self.store.move(draft, f"{folder}/{n}.json")

    def get(self, of: str, n: int) -> dict | None:
        """Token and records before answer ``n``; the first needs no note."""
        if not n:
            return {"token": "", "at": 0}
        try:
            with self.store.open_input_stream(f"{self._folder(of)}/{n}.json") as note:
                return json.loads(note.read())
        except FileNotFoundError:
            return None

    def reached(self, of: str, read: int = 0) -> int:
        """The answers that can be asked for without asking for another first. Of a set of which
        ``read`` were read and the next one's note is lost, one more: it is traced again."""
        found = self.store.get_file_info(stores.FileSelector(self._folder(of), allow_not_found=True))
        last = max((int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json")), default=0)
        note = self.get(of, max(last, read))
        return max(last, read) + (note is None or note["token"] is not None)


@dataclass
class _Stretch(InputPartition):
    """Answers ``first`` to ``last`` (not included) of a set."""

    of: str
    first: int
    last: int


class _Stream(DataSourceStreamReader):
    """A partition a set; the offset is each set's number of answers read. An executor that
    asks for an answer notes the token of the next, so each batch takes every set an answer
    further; a batch that is run again reads the same answers by their notes."""

    def __init__(self, options: dict):
        if "notes" not in options:
            raise ValueError("a harvest stream needs the option notes: a folder that the driver and all executors share")
        self.options, self.sets, self.read_so_far = options, options["sets"].split(","), {}

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.sets, 0)

    def latestOffset(self) -> dict:
        notes = Notes(self.options["notes"])
        return {s: notes.reached(s, self.read_so_far.get(s, 0)) for s in self.sets}

    def commit(self, end: dict) -> None:
        self.read_so_far = end

    def partitions(self, start: dict, end: dict) -> list[_Stretch]:
        self.read_so_far = {s: max(n, self.read_so_far.get(s, 0)) for s, n in start.items()}
        return [_Stretch(s, start.get(s, 0), n) for s, n in end.items() if n > start.get(s, 0)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        notes, base = Notes(self.options["notes"]), self.options["base"]
        for n in range(partition.first, partition.last):
            note = notes.get(partition.of, n) or _retraced(notes, base, partition.of, n)
            if note["token"] is None:
                return
            if n:
                time.sleep(float(self.options.get("pause", PAUSE)))
            found = Page.of(fetch(page_url(base, partition.of, note["token"])).decode("utf-8"))
            notes.put(partition.of, n + 1, found.token or None, note["at"] + len(found.records))
            for i, record in enumerate(found.records, note["at"]):
                yield partition.of, i, record


def _retraced(notes: Notes, base: str, of: str, n: int) -> dict:
    """The note of answer ``n`` where it was lost: the answers before it are asked for again."""
    at = 0
    for i, found in enumerate(pages(base, of), 1):
        at += len(found.records)
        notes.put(of, i, found.token or None, at)
        if i == n:
            break
    return notes.get(of, n) or {"token": None, "at": at}


class OaiSource(DataSource):
    """``spark.read.format("oai").option("base", ..).option("sets", "a,b")``; as a stream also
    with ``notes``, a shared folder that belongs to the stream like its checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return "set string, rec_no long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    find_us(spark)
    spark.dataSource.register(OaiSource)


def _looked_up(df: DataFrame, key: str, url_of: Callable[[str], str], pick: Callable[[dict], dict | None], get: Callable[[str], bytes], parts: int) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch[key]:
                try:
                    found = pick(json.loads(get(url_of(value)).decode("utf-8")))
                    out.append((value, json.dumps(found) if found is not None else None, "ok" if found is not None else "none", None))
                except Exception as why:  # reported as a row, so that one lookup can't end the run
                    out.append((value, None, "error", str(why)))
            yield pd.DataFrame(out, columns=[key, "answer", "status", "error"])

    return df.select(key).distinct().repartition(parts).mapInPandas(rows, f"{key} string, answer string, status string, error string")


def search_records(isbns: DataFrame, base: str, get: Callable[[str], bytes] = fetch, parts: int = 4) -> DataFrame:
    """(isbn, answer, status, error): the first member of a catalogue search, as JSON."""
    url = lambda isbn: f"{base}/search?q=isbn:{urllib.parse.quote(isbn)}&format=json"
    return _looked_up(isbns, "isbn", url, lambda answer: (answer.get("member") or [None])[0], get, parts)


def resolve_bitstreams(handles: DataFrame, rest_base: str, get: Callable[[str], bytes] = fetch, parts: int = 4) -> DataFrame:
    """(handle, answer, status, error): the first PDF bitstream (url, size_bytes, license_code)."""

    def pick(answer: dict) -> dict | None:
        for b in answer.get("bitstreams") or []:
            if b.get("mimeType") == "application/pdf":
                return {"url": rest_base + b["retrieveLink"], "size_bytes": b.get("sizeBytes"), "license_code": b.get("code")}
        return None

    return _looked_up(handles, "handle", lambda h: f"{rest_base}/rest/handle/{h}?expand=bitstreams", pick, get, parts)
