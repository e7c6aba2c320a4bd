"""Remote model files: repository listings and bounded ranged reads, one target a partition. Needs only the standard library.

A target that cannot be fetched is a row with `error` and its status bucket; the others go on. A token is sent to the hub's own
host alone and never becomes a column.
"""

from __future__ import annotations

import io
import json
import os
import urllib.error
import urllib.request
import zipfile
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bracken.functions.containers import ROUTES

HUB = "https://huggingface.co"
TIMEOUT = 30
#: What is read of a remote file: of most formats, of a GGUF file first and then at most, and of a member of a zip file.
WINDOW, FIRST, MOST, MEMBER = 2 << 20, 1 << 20, 16 << 20, 10 << 20
TOKENS = ("HF_TOKEN", "HUGGING_FACE_HUB_TOKEN")


def extensions() -> list[str]:
    """Every extension that an inspector claims: the listing cannot differ from the routes."""
    return sorted({x for names in ROUTES.values() for x in names.split()})


def token() -> str | None:
    return next((os.environ[k] for k in TOKENS if os.environ.get(k)), None)


def headers(url: str, hub: str = HUB) -> dict[str, str]:
    """The token's header, for the hub's host alone."""
    own = token()
    return {"Authorization": f"Bearer {own}"} if own and urlsplit(url).hostname == urlsplit(hub).hostname else {}


def _get(url: str, hub: str, span: str | None = None):
    more = {"Range": f"bytes={span}"} if span else {}
    return urllib.request.urlopen(urllib.request.Request(url, headers=more | headers(url, hub)), timeout=TIMEOUT)


def listing(repository: str, hub: str = HUB) -> list[str]:
    """Addresses of the files of a repository that an inspector claims."""
    name = repository.removeprefix("hf://")
    with _get(f"{hub}/api/models/{quote(name)}/tree/main", hub) as got:
        entries = json.load(got)
    claimed = tuple(extensions())
    return [f"{hub}/{name}/resolve/main/{quote(x['path'])}" for x in entries if str(x.get("path", "")).lower().endswith(claimed)]


class RangeFile(io.RawIOBase):
    """A remote file that is read by ranges: readable, seekable, never beyond its size."""

    def __init__(self, url: str, hub: str = HUB):
        self.url, self.hub, self.at = url, hub, 0
        with _get(url, hub, "0-0") as got:
            total = (got.headers.get("Content-Range") or "").rpartition("/")[2]
            self.size = int(total) if total.isdigit() else int(got.headers.get("Content-Length") or 0)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = min(self.size, max(0, offset + (0, self.at, self.size)[whence]))
        return self.at

    def readinto(self, space) -> int:
        want = min(len(space), self.size - self.at)
        if want <= 0:
            return 0
        with _get(self.url, self.hub, f"{self.at}-{self.at + want - 1}") as got:
            if got.status == 200:  # the server sends the whole file
                got.read(self.at)
            data = got.read(want)
        space[: len(data)] = data
        self.at += len(data)
        return len(data)


def content(url: str, hub: str = HUB) -> tuple[int, bytes, bool]:
    """(size, bytes, whether they are only the beginning). Of a large zip file: a small one of the members that matter."""
    from bracken.sources import models

    file = RangeFile(url, hub)
    name = urlsplit(url).path.lower()
    head = file.read(min(file.size, FIRST))
    if len(head) == file.size:
        return file.size, head, False
    if head[:4] == b"PK\x03\x04":
        return file.size, _members(io.BufferedReader(file, 1 << 16)), False
    if name.endswith(".gguf"):
        got = models.gguf(head)
        if got is None or not got["truncated"]:
            return file.size, head, False  # the keys are all read; what follows is weights
        want = MOST
    else:
        want = MOST if name.endswith((".pt", ".pth", ".bin")) else WINDOW
    if name.endswith(".safetensors") and len(head) >= 8 and 8 + int.from_bytes(head[:8], "little") <= len(head):
        return file.size, head, False
    file.seek(len(head))
    while len(head) < min(want, file.size) and (more := file.read(min(want, file.size) - len(head))):
        head += more
    return file.size, head, len(head) < file.size


def _members(file) -> bytes:
    """A zip file of those members that hold pickles, arrays or configurations."""
    out = io.BytesIO()
    with zipfile.ZipFile(file) as z, zipfile.ZipFile(out, "w") as small:
        for info in z.infolist():
            if info.filename.endswith((".pkl", ".json", ".npy")):
                with z.open(info) as f:
                    small.writestr(info.filename, f.read(MEMBER))
    return out.getvalue()


def status(problem: Exception) -> str:
    """The bucket of a failure: an HTTP status, timeout, connection_error or other."""
    if isinstance(problem, urllib.error.HTTPError):
        return str(problem.code)
    reason = getattr(problem, "reason", problem)
    if isinstance(problem, TimeoutError) or isinstance(reason, TimeoutError):
        return "timeout"
    return "connection_error" if isinstance(problem, (urllib.error.URLError, ConnectionError)) else "other"


class _Target(InputPartition):
    def __init__(self, url: str, failure: str | None = None):
        super().__init__(0)
        self.url, self.failure = url, failure


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.targets, self.hub = json.loads(options["targets"]), options.get("hub", HUB)

    def partitions(self):
        out = []
        for target in self.targets:
            if not target.startswith("hf://"):
                out.append(_Target(target))
                continue
            try:
                out += [_Target(u) for u in listing(target, self.hub)]
            except Exception as problem:
                out.append(_Target(target, status(problem)))
        return out or [_Target("", "none")]

    def read(self, partition):
        url, failure = partition.url, partition.failure
        if not url:
            return
        if failure is None:
            try:
                size, data, cut = content(url, self.hub)
                yield url, size, data, cut, None, None
                return
            except Exception as problem:
                failure = status(problem)
        yield url, None, None, None, None, failure


class HubFiles(DataSource):
    """path, length, content (what is read of it), cut, sha256 (null: not all is read) and error (a status bucket)."""

    @classmethod
    def name(cls):
        return "hub_files"

    def schema(self):
        return "path string, length long, content binary, cut boolean, sha256 string, error string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def hub_files(spark, targets: list[str], hub: str = HUB) -> DataFrame:
    """The files of hf:// repositories and http(s) addresses."""
    spark.dataSource.register(HubFiles)
    return spark.read.format("hub_files").option("targets", json.dumps(targets)).option("hub", hub).load()
