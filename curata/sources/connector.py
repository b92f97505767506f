"""A catalogue of files at a far place as a data source: titles in, what the catalogue says of each out, and downloads with a cap on their size.

Titles are asked for in chunks of ``CHUNK``, one chunk a partition. A client spaces its requests, and on 429 and 503 waits as long as it is told, within a bound, before one of a few retries. How bytes are
fetched is a transport, so that tests and repeatable runs read recorded answers from a folder; each task has a client of its own, so the rate at the far end is at most the number of tasks at once over the interval.

Titles come from an acquisition plan, written by people: ``MOST`` at a time, on the driver. Downloads are rows and any number.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curata.plans.storage import ship

CHUNK, MOST = 40, 100_000
#: Status, headers in lower case, body cut after one byte more than the limit.
Answer = tuple[int, dict, bytes]
Transport = Callable[[str, int | None], Answer]
SCHEMA = """title string, found boolean, record_id string, source_url string, file_url string, license string, license_url string, artist string, credit string, description string, usage_terms string, restrictions string,
categories array<string>, mime string, size_bytes long, width int, height int, checksum string"""


class TooLarge(ValueError):
    pass


class Client:
    """Polite requests through a transport."""

    def __init__(self, transport: Transport, interval: float = 1.0, retries: int = 3, longest_wait: float = 900.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.transport, self.interval, self.retries, self.longest_wait, self.sleep, self.clock = transport, interval, retries, longest_wait, sleep, clock
        self.free_at = 0.0

    def pause(self) -> None:
        now = self.clock()
        if now < self.free_at:
            self.sleep(self.free_at - now)
        self.free_at = max(now, self.free_at) + self.interval

    def get(self, url: str, limit: int | None = None) -> bytes:
        """The body; TooLarge beyond limit, by the header if there is one, OSError for any other status than 200."""
        left = self.retries
        while True:
            self.pause()
            status, headers, body = self.transport(url, limit)
            if status in (429, 503) and left:
                left -= 1
                self.sleep(self.told_to_wait(headers))
                continue
            if status != 200:
                raise OSError(f"{url}: status {status}")
            said = headers.get("content-length", "")
            if limit is not None and max(len(body), int(said) if said.isdigit() else 0) > limit:
                raise TooLarge(f"{url}: over {limit} bytes")
            return body

    def told_to_wait(self, headers: dict) -> float:
        said = headers.get("retry-after", "")
        asked = float(said) if re.fullmatch(r"\d+(\.\d+)?", said.strip()) else 60.0
        return min(max(asked, self.interval), self.longest_wait)


def web(agent: str, timeout: float = 60.0) -> Transport:
    """The network."""

    def get(url: str, limit: int | None) -> Answer:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                said = r.headers.get("Content-Length", "")
                skip = limit is not None and said.isdigit() and int(said) > limit
                return r.status, {k.lower(): v for k, v in r.headers.items()}, b"" if skip else r.read() if limit is None else r.read(limit + 1)
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, b""

    return get


def recorded(folder: str) -> Transport:
    """Answers from a folder that every executor reaches: a file for each url, named by its digest, of a line of status and headers as JSON and the body."""

    def get(url: str, limit: int | None) -> Answer:
        try:
            with open(f"{folder}/{recorded_name(url)}", "rb") as f:
                head = json.loads(f.readline())
                return head["status"], head["headers"], f.read() if limit is None else f.read(limit + 1)
        except FileNotFoundError:
            return 404, {}, b""

    return get


def recorded_name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()


# Parameters of a description request.
ASKED = {
    "action": "query", "format": "json", "formatversion": "2", "prop": "imageinfo|categories", "cllimit": "max", "iiprop": "url|size|mime|sha1|extmetadata",
    "iiextmetadatafilter": "LicenseShortName|LicenseUrl|Artist|Credit|ImageDescription|Restrictions|UsageTerms|Copyrighted",
}
SAYS = (("license", "LicenseShortName"), ("license_url", "LicenseUrl"), ("artist", "Artist"), ("credit", "Credit"), ("description", "ImageDescription"), ("usage_terms", "UsageTerms"), ("restrictions", "Restrictions"))


def question(api: str, titles: Sequence[str]) -> str:
    return f"{api}?{urllib.parse.urlencode(ASKED | {'titles': '|'.join(titles)})}"


def plain(html: object) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", str(html))).strip()


def described(titles: Sequence[str], answer: bytes) -> Iterator[tuple]:
    """A row of SCHEMA for each title, in their order; found is false for those that the catalogue has not."""
    said = json.loads(answer).get("query", {})
    asked_as = {n["to"]: n["from"] for n in said.get("normalized", ())}
    pages = {asked_as.get(p.get("title"), p.get("title")): p for p in said.get("pages", ()) if not p.get("missing") and p.get("imageinfo")}
    for title in titles:
        if (page := pages.get(title)) is None:
            yield (title, False, *[None] * 16)
            continue
        info = page["imageinfo"][0]
        meta = info.get("extmetadata", {})
        texts = [plain(meta.get(k, {}).get("value", "")) for _, k in SAYS]
        yield (
            title, True, str(page.get("pageid", "")), info.get("descriptionurl", ""), info.get("url", ""), *texts, [c["title"] for c in page.get("categories", ())], info.get("mime", ""),
            int(info.get("size") or 0), int(info.get("width") or 0), int(info.get("height") or 0), f"sha1:{info['sha1']}" if info.get("sha1") else "",
        )


class Chunk(InputPartition):
    def __init__(self, titles: list[str]) -> None:
        self.titles = titles


def catalogue(client: Callable[[], Client], api: str) -> type[DataSource]:
    """A data source named ``catalogue`` over a client that each task makes; option titles: a JSON array."""

    class Reader(DataSourceReader):
        def __init__(self, titles: list[str]) -> None:
            self.titles = titles

        def partitions(self) -> list[InputPartition]:
            return [Chunk(self.titles[i : i + CHUNK]) for i in range(0, len(self.titles), CHUNK)] or [Chunk([])]

        def read(self, partition: Chunk) -> Iterator[tuple]:
            if partition.titles:
                yield from described(partition.titles, client().get(question(api, partition.titles)))

    class Catalogue(DataSource):
        @classmethod
        def name(cls) -> str:
            return "catalogue"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> DataSourceReader:
            titles = list(dict.fromkeys(json.loads(self.options.get("titles", "[]"))))
            if len(titles) > MOST:
                raise ValueError(f"{len(titles)} titles at once; {MOST} at most")
            return Reader(titles)

    return Catalogue


def describe(spark: SparkSession, titles: Sequence[str], client: Callable[[], Client], api: str) -> DataFrame:
    """SCHEMA, a row for each different title."""
    ship(spark)
    spark.dataSource.register(catalogue(client, api))
    return spark.read.format("catalogue").option("titles", json.dumps(list(titles))).load()


FETCHED = "content binary, sha256 string, n_bytes long, problem string"


def download(files: DataFrame, client: Callable[[], Client], limit: int, url: str = "file_url", checksum: str = "checksum") -> DataFrame:
    """files with content, sha256, n_bytes and problem: null, or why there is no content (too large, a status, another checksum than ``algorithm:digest`` says). A file's failure is its row's, not the job's."""
    ship(files.sparkSession)
    at_url, at_sum = files.columns.index(url), files.columns.index(checksum)
    rows = files.select("*")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), FETCHED])

    def one(c: Client, where: str | None, said: str | None) -> tuple[bytes | None, str | None]:
        if not where:
            return None, "no url"
        try:
            data = c.get(where, limit)
        except (OSError, ValueError) as e:
            return None, str(e)
        kind, _, digest = (said or "").partition(":")
        if kind not in hashlib.algorithms_guaranteed:
            return None, f"no checksum: {said}"
        if (is_now := hashlib.new(kind, data).hexdigest()) != digest:
            return None, f"checksum {kind}:{is_now}, not {said}"
        return data, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = client()
        for b in batches:
            for i in range(b.num_rows):  # one file's bytes at a time
                row = b.slice(i, 1)
                data, problem = one(c, row.column(at_url)[0].as_py(), row.column(at_sum)[0].as_py())
                made = [pa.array([data], pa.binary()), pa.array([data and hashlib.sha256(data).hexdigest()], pa.string()), pa.array([None if data is None else len(data)], pa.int64()), pa.array([problem], pa.string())]
                yield pa.RecordBatch.from_arrays([*row.columns, *made], names=[*b.schema.names, "content", "sha256", "n_bytes", "problem"])

    return rows.mapInArrow(run, schema)


def duplicates(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """fetched with ``duplicate_of``: the title that brought the same bytes first, or the known image of that digest. known: sha256, image_id."""
    first = fetched.where("content IS NOT NULL").groupBy("sha256").agg(F.min("title").alias("__first"))
    there = known.groupBy("sha256").agg(F.min("image_id").alias("__known"))
    j = fetched.join(first, "sha256", "left").join(there, "sha256", "left")
    return j.withColumn("duplicate_of", F.coalesce("__known", F.when(F.col("__first") != F.col("title"), F.col("__first")))).drop("__first", "__known")
