"""Sources of files: folders, memory, HTTP; and their registry. All give id, path, content, size, last_modified, hash, language."""

from __future__ import annotations

import base64
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import language_of
from ..operators.incremental import snapshot_diff
from . import ignore

FILES = "id string, path string, content string, size long, last_modified timestamp, hash string, language string"
TEXT = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .kt .swift .rb .php .c .h .cpp .hpp .cs .scala .dart .lua .html .css .scss .json .yaml .yml .toml .md .txt .sql".split()
MOST_BYTES = 1_000_000


class FolderSource:
    """All text files below a folder that no rule ignores, up to 1 MB each."""

    def __init__(self, spark: SparkSession, root: str, extensions: list[str] = TEXT, skip: tuple[str, ...] = (".min.js", ".map"), most: int = MOST_BYTES, patterns: list[tuple[str, bool]] | None = None):
        self.spark, self.root, self.extensions, self.skip, self.most = spark, root.rstrip("/"), extensions, skip, most
        if patterns is None:
            patterns = ignore.parse("\n".join(ignore.DEFAULTS))
            for name in ignore.IGNORE_FILES:
                at = Path(self.root.removeprefix("file://"), name)
                if at.is_file():
                    patterns += ignore.parse(at.read_text())
        self.patterns = patterns

    def paths(self) -> DataFrame:
        """(path, length, modificationTime, content): the listing; contents are read only if they are used."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        inside = F.regexp_extract("path", f"{Path(self.root.removeprefix('file://')).name}/(.*)$", 1)
        root = F.lit(len(Path(self.root.removeprefix("file://")).as_posix()) + len("file:") + 2)
        rows = raw.withColumn("path", F.when(F.col("path").startswith("file:" + self.root.removeprefix("file://")), F.substr(F.col("path"), root)).otherwise(inside))
        low = F.lower("path")
        kept = F.greatest(*[low.endswith(e) for e in self.extensions], F.lit(False)) & ~F.greatest(*[low.endswith(e) for e in self.skip], F.lit(False))
        return rows.filter((F.col("length") <= self.most) & kept & ~ignore.ignored("path", self.patterns))

    def list(self) -> DataFrame:
        rows = self.paths().withColumn("content", F.decode("content", "UTF-8"))
        return rows.select(F.col("path").alias("id"), "path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.sha2("content", 256).alias("hash"), language_of("path").alias("language"))

    def fetch(self, ids: list[str]) -> DataFrame:
        rows = self.list().filter(F.col("id").isin(ids))
        missing = set(ids) - {r.id for r in rows.select("id").collect()}
        if missing:
            raise KeyError(f"no such file: {sorted(missing)}")
        return rows

    def changes(self, snapshot: DataFrame) -> DataFrame:
        """(path, status) against an earlier snapshot (path, hash)."""
        return snapshot_diff(snapshot, self.list().select("path", "hash")).filter("status <> 'cached'")


class MemorySource:
    """Files that are given; listeners hear of changes."""

    def __init__(self, spark: SparkSession, files: dict[str, str] | None = None):
        self.spark, self.files, self.listeners = spark, dict(files or {}), []

    def on_change(self, listener: Callable[[str, str], None]) -> None:
        self.listeners.append(listener)

    def _say(self, kind: str, path: str) -> None:
        for f in self.listeners:
            f(kind, path)

    def add(self, path: str, content: str) -> None:
        kind = "modified" if path in self.files else "added"
        self.files[path] = content
        self._say(kind, path)

    update = add

    def remove(self, path: str) -> bool:
        if self.files.pop(path, None) is None:
            return False
        self._say("removed", path)
        return True

    def has(self, path: str) -> bool:
        return path in self.files

    def count(self) -> int:
        return len(self.files)

    def clear(self) -> None:
        self.files.clear()

    def list(self) -> DataFrame:
        rows = self.spark.createDataFrame([(p, c) for p, c in self.files.items()], "path string, content string")
        return rows.select(F.col("path").alias("id"), "path", "content", F.octet_length("content").cast("long").alias("size"), F.current_timestamp().alias("last_modified"), F.sha2("content", 256).alias("hash"), language_of("path").alias("language"))

    def fetch(self, ids: list[str]) -> DataFrame:
        missing = [i for i in ids if i not in self.files]
        if missing:
            raise KeyError(f"no such file: {missing}")
        return self.list().filter(F.col("id").isin(ids))


#: Seconds that a service may take, how often it is asked when it fails, and the pause between.
HTTP_SECONDS, HTTP_TRIES, HTTP_PAUSE = 30, 3, 0.5


def _get(url: str, headers: dict[str, str]) -> object:
    """The JSON at a URL. KeyError if there is nothing there; failures of the service are tried again."""
    for left in range(HTTP_TRIES - 1, -1, -1):
        try:
            with urlopen(Request(url, headers=headers), timeout=HTTP_SECONDS) as answer:  # noqa: S310 - the caller names the service
                return json.loads(answer.read())
        except HTTPError as e:
            if e.code == 404:
                raise KeyError(f"no such file: {url}") from e
            if e.code < 500 or not left:
                raise
        except (URLError, TimeoutError):
            if not left:
                raise
        time.sleep(HTTP_PAUSE)
    raise AssertionError


def file_of(item: dict) -> dict:
    """id, path and content of an item, by the names that services use; base64 is decoded."""
    first = lambda *names: next((item[n] for n in names if item.get(n) is not None), None)
    content = first("content", "text", "body") or ""
    if item.get("encoding") == "base64":
        content = base64.b64decode(content).decode("utf-8", "replace")
    path = first("path", "name", "filename", "id")
    return {"id": str(first("id", "sha", "path")), "path": str(path), "content": content}


class _Page(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def _headers(self) -> dict[str, str]:
        return json.loads(self.o.get("headers", "{}"))

    def partitions(self) -> list[_Page]:
        n = int(self.o.get("batch", 50))
        if "ids" in self.o:  # these alone: the service isn't asked for its list
            ids = json.loads(self.o["ids"])
            return [_Page(ids[i : i + n]) for i in range(0, len(ids), n)]
        listed = _get(self.o["list"], self._headers())
        items = listed if isinstance(listed, list) else listed.get(self.o.get("items", "files")) or listed.get("tree") or []
        kind = self.o.get("kind")
        ids = [str(i.get("path") or i.get("id")) if isinstance(i, dict) else str(i) for i in items if not kind or not isinstance(i, dict) or i.get("type") == kind]
        return [_Page(ids[i : i + n]) for i in range(0, len(ids), n)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for i in partition.ids:
            f = file_of(_get(self.o["fetch"].replace("{id}", quote(i)), self._headers()))
            yield f["id"], f["path"], f["content"]


class HttpFiles(DataSource):
    """spark.read.format("http_files") with options list (URL), fetch (URL with {id}), and items, kind, headers (JSON), batch."""

    @classmethod
    def name(cls) -> str:
        return "http_files"

    def schema(self) -> str:
        return "id string, path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpSource:
    def __init__(self, spark: SparkSession, transform: Callable[[DataFrame], DataFrame] | None = None, **options: str):
        spark.dataSource.register(HttpFiles)
        self.spark, self.options, self.transform = spark, options, transform

    def list(self) -> DataFrame:
        return self._read({})

    def _read(self, more: dict[str, str]) -> DataFrame:
        rows = self.spark.read.format("http_files").options(**self.options, **more).load()
        rows = rows if self.transform is None else self.transform(rows)
        return rows.select("id", "path", "content", F.octet_length("content").cast("long").alias("size"), F.current_timestamp().alias("last_modified"), F.sha2("content", 256).alias("hash"), language_of("path").alias("language"))

    def fetch(self, ids: list[str]) -> DataFrame:
        """These files alone are asked for; reading fails with a KeyError if one isn't there."""
        return self._read({"ids": json.dumps(ids)})

    def changes(self, since: str) -> DataFrame:
        """The service's own list of changes: (path, status)."""
        url = self.options["changes"].replace("{since}", quote(since))
        return self.spark.createDataFrame([(c.get("path") or c.get("id"), c.get("type") or c.get("status")) for c in _get(url, json.loads(self.options.get("headers", "{}")))], "path string, status string")


def git_hosting_source(spark: SparkSession, tree_url: str, blob_url: str, token: str | None = None) -> HttpSource:
    """A hosted repository's tree: blobs only."""
    return HttpSource(spark, list=tree_url, fetch=blob_url, items="tree", kind="blob", headers=json.dumps({"Authorization": f"Bearer {token}"} if token else {}))


class Registry:
    """Sources by name; a name can be taken once."""

    def __init__(self):
        self.sources: dict[str, object] = {}

    def register(self, name: str, source) -> None:
        if name in self.sources:
            raise ValueError(f"source {name} is registered")
        self.sources[name] = source

    def unregister(self, name: str) -> bool:
        return self.sources.pop(name, None) is not None

    def get(self, name: str):
        return self.sources.get(name)

    def by_type(self, kind: type) -> list:
        return [s for s in self.sources.values() if isinstance(s, kind)]

    def clear(self) -> None:
        self.sources.clear()

    def list(self) -> DataFrame:
        """The files of all sources, with the source's name."""
        parts = [s.list().withColumn("source", F.lit(n)) for n, s in self.sources.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def git_branch(root: str) -> dict:
    """branch, commit, detached, dirty from a repository's HEAD."""
    git = Path(root, ".git")
    if not (git / "HEAD").is_file():
        return {"branch": None, "commit": None, "detached": False, "dirty": False}
    head = (git / "HEAD").read_text().strip()
    ref = head.removeprefix("ref: ")
    detached = ref == head
    at = git / ref
    return {"branch": None if detached else ref.removeprefix("refs/heads/"), "commit": head if detached else at.read_text().strip() if at.is_file() else None, "detached": detached, "dirty": (git / "index").exists()}
