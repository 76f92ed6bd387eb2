"""Paged HTTP/JSON sources as a Spark data source: a partition a page, retried with growing waits where it is read.

    spark.dataSource.register(ApiPages)
    spark.read.format("api_pages").options(action="webinar_registrations", base_url="https://...", secret="...").load()

An answer is an object with ``data`` (a list of objects, or one object, which counts as a list of it) and ``pages`` (how many pages there are; none is one). Page 1 is asked
for at planning to learn that number; each page is then read by a task. Rows are (action, page, place, payload): payload is the JSON of one object, so columns that a source adds
later are not lost, and ``columns_of`` makes columns of it.

With ``fixtures`` pages are files ``<action>_<page>.json`` of that folder instead, on any file system that pyarrow opens. A file ``<action>_<page>.failed<n>`` makes
attempt n of that page fail.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "action string, page int, place int, payload string"


class ApiError(RuntimeError):
    """A source that answers wrongly, or not at all after all attempts."""


def _fixture(options: dict[str, str], page: int, attempt: int) -> bytes:
    from pyarrow import fs

    uri = options["fixtures"]
    files, folder = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")
    name = f"{folder}/{options['action']}_{page}"
    if files.get_file_info(f"{name}.failed{attempt}").type != fs.FileType.NotFound:
        raise OSError(f"attempt {attempt} of page {page} failed")
    with files.open_input_file(f"{name}.json") as f:
        return f.read()


def _http(options: dict[str, str], page: int, attempt: int) -> bytes:
    if not options.get("base_url") or not options.get("secret"):
        raise ApiError("base_url and secret must be set")
    params = json.loads(options.get("params", "{}")) | {"ld_api": options["action"], "secret": options["secret"], "page": page}
    with urllib.request.urlopen(f"{options['base_url']}?{urllib.parse.urlencode(params)}", timeout=float(options.get("timeout", 30))) as answer:
        return answer.read()


def fetch(options: dict[str, str], page: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page; after a failure it is asked for again ``retries`` times, waits doubling from ``wait`` seconds to five. Wrong settings raise at once."""
    back_end = _fixture if options.get("fixtures") else _http
    retries, wait = max(int(options.get("retries", 2)), 0), float(options.get("wait", 1))
    for attempt in range(retries + 1):
        try:
            answer = json.loads(back_end(options, page, attempt))
            if not isinstance(answer, dict):
                raise ValueError(f"an answer of kind {type(answer).__name__}")
            return answer
        except (OSError, ValueError) as e:
            if attempt == retries:
                raise ApiError(f"{options['action']}, page {page}: {e}") from e
            sleep(min(wait * 2**attempt, 5))
    raise AssertionError("unreachable")


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Page]:
        pages = fetch(self.options, 1).get("pages")
        return [_Page(i) for i in range(1, (1 if pages is None else int(pages)) + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        data = fetch(self.options, partition.number).get("data") or []
        for place, item in enumerate(data if isinstance(data, list) else [data]):
            yield self.options["action"], partition.number, place, json.dumps(item, ensure_ascii=False, sort_keys=True)


class ApiPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "api_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        options = dict(self.options)
        if not options.get("action"):
            raise ApiError("action must be set")
        return _Reader(options)


def read_api(spark: SparkSession, action: str, **options) -> DataFrame:
    """The objects of an action, all pages: action, page, place and payload."""
    spark.dataSource.register(ApiPages)
    texts = {k: json.dumps(v) if isinstance(v, dict) else str(v) for k, v in options.items()}
    return spark.read.format("api_pages").options(action=action, **texts).load()


def columns_of(rows: DataFrame, schema: str) -> DataFrame:
    """The payloads as columns of a schema, null where a payload lacks one, with the payload."""
    return rows.select(F.from_json("payload", schema).alias("x"), F.col("payload").alias("payload_json")).select("x.*", "payload_json")


def write_fixtures(pages: DataFrame, folder: str, action: str) -> None:
    """Write rows (page, pages, payload) as fixture files of an action, a task a page."""

    def write(group):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}")
        files.create_dir(path, recursive=True)
        for page, rows in group.sort_values(["page", "payload"]).groupby("page"):
            answer = f'{{"pages": {int(rows["pages"].iloc[0])}, "data": [{", ".join(rows["payload"])}]}}'
            with files.open_output_stream(f"{path}/{action}_{int(page)}.json") as f:
                f.write(answer.encode())
        return group[["page"]].drop_duplicates()

    pages.groupBy("page").applyInPandas(write, "page int").write.format("noop").mode("overwrite").save()
