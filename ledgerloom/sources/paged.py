"""Documents of a manager that hands them out in pages, as a Python data source.

A partition is a range of pages, so pages are fetched side by side by the executors; the driver asks for the count alone. Filters
that name ids (id = 7, id IN (...)) are answered by lookups of those documents instead of a scan. Pages come over HTTP, or from a
folder of recorded pages that record() has written (for tests, replays and where there is no network).

Options: url (the manager's root) or path (recorded pages; every executor must see the folder under this name), token, page_size,
pages_per_partition, timeout (seconds), tries. A page that fails is asked for again, with longer waits; a partition that gives up fails its
task, which Spark repeats elsewhere. The last partition reads on until no page follows, so documents added since the count are read; a
document that moves between pages meanwhile may come twice (streaming.incremental.latest keeps one).
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id long, content string, tags array<struct<id:int,name:string>>, custom_fields array<struct<field:int,value:string>>"
PAGE_SIZE = 25
#: Ids that one partition looks up, one request each.
LOOKUPS = 50
DEFAULTS = {"page_size": PAGE_SIZE, "pages_per_partition": 40, "timeout": 60, "tries": 3}


class HttpPages:
    """The manager itself."""

    def __init__(self, url: str, token: str = "", page_size: int = PAGE_SIZE, timeout: float = 60, tries: int = 3) -> None:
        self.root, self.token, self.page_size, self.timeout, self.tries = url.rstrip("/"), token, page_size, timeout, tries

    def _get(self, path: str, **query: object) -> dict | None:
        address = f"{self.root}{path}" + ("?" + urllib.parse.urlencode(query) if query else "")
        request = urllib.request.Request(address, headers={"Accept": "application/json"} | ({"Authorization": f"Token {self.token}"} if self.token else {}))
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if attempt + 1 == self.tries or e.code < 500 and e.code != 429:
                    raise
            except OSError:
                if attempt + 1 == self.tries:
                    raise
            time.sleep(0.2 * 4**attempt)
        raise ValueError("tries must be 1 at least")

    def pages(self) -> int:
        first = self._get("/api/documents/", page=1, page_size=self.page_size)
        return -(-first["count"] // self.page_size) if first else 0

    def page(self, number: int) -> tuple[list[dict], bool]:
        """The page's documents, and whether another follows."""
        found = self._get("/api/documents/", page=number, page_size=self.page_size)
        return (found["results"], bool(found.get("next"))) if found else ([], False)

    def document(self, key: int) -> dict | None:
        return self._get(f"/api/documents/{key}/")


class RecordedPages:
    """A folder with a folder page=N for each page that is not empty: ids from (N - 1) * page_size, in files of a JSON object a line."""

    def __init__(self, path: str, page_size: int = PAGE_SIZE) -> None:
        self.root, self.page_size = re.sub(r"^file:(//)?(?=/)", "", path).rstrip("/"), page_size
        self.last: int | None = None

    def pages(self) -> int:
        return max((int(n[5:]) for n in os.listdir(self.root) if n.startswith("page=")), default=0)

    def page(self, number: int) -> tuple[list[dict], bool]:
        folder, found = f"{self.root}/page={number}", []
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if not name.startswith(("_", ".")):
                with open(f"{folder}/{name}", encoding="utf-8") as lines:
                    found += [json.loads(line) for line in lines]
        if self.last is None:
            self.last = self.pages()
        return found, number < self.last

    def document(self, key: int) -> dict | None:
        return next((d for d in self.page(key // self.page_size + 1)[0] if d["id"] == key), None)


def row(doc: dict) -> tuple:
    """A document in the columns of SCHEMA; tags are objects or plain ids."""
    tags = [(t["id"], t.get("name")) if isinstance(t, dict) else (t, None) for t in doc.get("tags") or []]
    fields = [(f["field"], None if f.get("value") is None else str(f["value"])) for f in doc.get("custom_fields") or []]
    return doc["id"], doc.get("content"), tags, fields


class Pages(InputPartition):
    def __init__(self, first: int, last: int | None) -> None:
        self.first, self.last = first, last


class Lookups(InputPartition):
    def __init__(self, ids: list[int]) -> None:
        self.ids = ids


class PagedReader(DataSourceReader):
    def __init__(self, source: HttpPages | RecordedPages, pages_per_partition: int) -> None:
        self.source, self.size = source, pages_per_partition
        self.ids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is None or f.attribute != ("id",):
                yield f
            else:
                self.ids = named if self.ids is None else self.ids & named

    def partitions(self) -> Sequence[InputPartition]:
        if self.ids is not None:
            ids = sorted(i for i in self.ids if i is not None)
            return [Lookups(ids[k : k + LOOKUPS]) for k in range(0, len(ids), LOOKUPS)] or [Lookups([])]
        count = max(1, self.source.pages())
        firsts = range(1, count + 1, self.size)
        return [Pages(a, None if a + self.size > count else a + self.size - 1) for a in firsts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Lookups):
            yield from (row(d) for d in map(self.source.document, partition.ids) if d)
            return
        number, follows = partition.first, True
        while follows if partition.last is None else number <= partition.last:
            docs, follows = self.source.page(number)
            yield from map(row, docs)
            number += 1


class PagedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        option = {k: type(v)(self.options.get(k, v)) for k, v in DEFAULTS.items()}
        size = option["page_size"]
        if url := self.options.get("url"):
            source = HttpPages(url, self.options.get("token", ""), size, option["timeout"], option["tries"])
        elif path := self.options.get("path"):
            source = RecordedPages(path, size)
        else:
            raise ValueError("paged_documents needs the option url or path")
        return PagedReader(source, option["pages_per_partition"])


def documents(spark: SparkSession, **options: object) -> DataFrame:
    """All documents of a manager or of recorded pages. Switches on the session's filter pushdown for Python sources."""
    spark.dataSource.register(PagedDocuments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged_documents").options(**{k: str(v) for k, v in options.items()}).load()


def lookup(docs: DataFrame, *ids: int) -> DataFrame:
    """The documents of these ids, by a request for each and no scan."""
    return docs.where(F.col("id").isin(*ids))


def record(docs: DataFrame, path: str, page_size: int = PAGE_SIZE) -> None:
    """Writes docs (id, content, tags, custom_fields; null ids left out) as recorded pages: a task writes whole pages."""
    page: Column = F.floor(F.col("id") / page_size).cast("long") + 1
    rows = docs.where("id IS NOT NULL").select(F.to_json(F.struct("id", "content", "tags", "custom_fields")).alias("value"), page.alias("page"))
    rows.repartition("page").write.partitionBy("page").text(path)
