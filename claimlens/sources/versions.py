"""The publication log of a star: numbered versions, conflict detection, leases, removal.

``_published/<number>`` holds the id of the version folder published under that
number. A number is claimed by creating its file only if it is absent, so of
two loads that read the same state one gets the next number and the other
learns that it must read again. No clock decides. A claim whose content is not
there yet (its writer is between two calls, or died) is not read, and no later
number can be claimed before it is filled or released.

A reader that will run for a while takes a lease on its version; removal keeps
leased versions, the newest ones and those still being written.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

LOG, LEASES, VERSIONS = "_published", "_leases", "versions"
_NUMBER = re.compile(r"\d{12}")


class PublishConflict(RuntimeError):
    """Another load published after this one read the star; read again and retry."""


class UnfilledClaim(RuntimeError):
    """A claim of the next number was never filled: its load died, see release_claim."""


@dataclass(frozen=True)
class Published:
    number: int
    version: str


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._hadoop = spark._jsc.hadoopConfiguration()
        self._fs = self._p("").getFileSystem(self._hadoop)

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        if not self._fs.exists(self._p(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(name)))

    def modified(self, name: str) -> float:
        return self._fs.getFileStatus(self._p(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False, and nothing written, if there is one already."""
        at = self._fs.makeQualified(self._p(name)).toString()
        self._fs.mkdirs(self._p(name).getParent())
        if urlparse(at).scheme == "file":  # this file system of Hadoop checks and creates in two steps
            try:
                fd = os.open(unquote(urlparse(at).path), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
            except FileExistsError:
                return False
            with os.fdopen(fd, "w") as fh:
                fh.write(text)
            return True
        try:
            stream = self._fs.create(self._p(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    @contextmanager
    def reader(self, name: str):
        """A function that reads up to n bytes of a file, b"" at its end."""
        stream = self._fs.open(self._p(name))
        try:
            yield lambda n: bytes(stream.readNBytes(n))
        finally:
            stream.close()

    @contextmanager
    def writer(self, target: str):
        """A function that appends bytes to a new file of any path (overwritten if there is one)."""
        at = self._jvm.org.apache.hadoop.fs.Path(target)
        stream = at.getFileSystem(self._hadoop).create(at, True)
        try:
            yield lambda data: stream.write(bytearray(data))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._p(name), True)


def _claims(root: Folder) -> list[tuple[int, str]]:
    """(number, version or '' while the claim is not filled), in order."""
    return [(int(n), root.read(f"{LOG}/{n}").strip()) for n in root.names(LOG) if _NUMBER.fullmatch(n)]


def published(spark: SparkSession, root: str) -> Published | None:
    """The newest published version, or None before the first."""
    folder = Folder(spark, root)
    numbers = [n for n in folder.names(LOG) if _NUMBER.fullmatch(n)]
    for n in reversed(numbers):
        if version := folder.read(f"{LOG}/{n}").strip():
            return Published(int(n), version)
    return None


def publish(spark: SparkSession, root: str, version: str, after: Published | None, wait: float = 60.0) -> Published:
    """Publish ``version`` as the successor of ``after``, the state it was built on.

    Raises :class:`PublishConflict` if another version came first, once that one
    can be read.
    """
    folder, number = Folder(spark, root), (after.number if after else 0) + 1
    if folder.create(f"{LOG}/{number:012d}", version):
        return Published(number, version)
    until = time.monotonic() + wait
    while not folder.read(f"{LOG}/{number:012d}").strip():
        if time.monotonic() > until:
            raise UnfilledClaim(f"number {number} of {root} was claimed but never filled; if its load is dead, call release_claim")
        time.sleep(0.05)
    raise PublishConflict(f"{root}: version {number} was published by another load")


def release_claim(spark: SparkSession, root: str, number: int) -> bool:
    """Give an unfilled claim of a dead load free."""
    folder, name = Folder(spark, root), f"{LOG}/{number:012d}"
    if f"{number:012d}" not in folder.names(LOG) or folder.read(name).strip():
        return False
    folder.remove(name)
    return True


@contextmanager
def lease(spark: SparkSession, root: str, seconds: float = 24 * 3600):
    """The published version, kept from removal inside the block and for at most ``seconds``."""
    folder, token = Folder(spark, root), uuid.uuid4().hex
    while True:
        at = published(spark, root)
        if at is None:
            raise FileNotFoundError(f"no published star under {root}")
        folder.create(f"{LEASES}/{token}", f"{at.version} {time.time() + seconds}")
        if at.version in folder.names(VERSIONS):
            break
        folder.remove(f"{LEASES}/{token}")  # removed between the two steps: take the newer one
    try:
        yield at
    finally:
        folder.remove(f"{LEASES}/{token}")


def remove_versions(spark: SparkSession, root: str, keep: int = 2, unpublished_after: float = 7 * 24 * 3600) -> list[str]:
    """Remove version folders behind the ``keep`` newest, unless a lease holds them.

    Folders that were never published (a failed load, or one still running) go
    once they are ``unpublished_after`` seconds old. Expired leases go too. The
    log keeps its numbers. Returns the removed version ids.
    """
    if keep < 1:
        raise ValueError("the newest version is never removed")
    folder, now = Folder(spark, root), time.time()
    known = [v for _, v in _claims(folder) if v]
    held = set(known[-keep:])
    for token in folder.names(LEASES):
        version, until = folder.read(f"{LEASES}/{token}").split()
        if float(until) > now:
            held.add(version)
        else:
            folder.remove(f"{LEASES}/{token}")
    gone = []
    for version in folder.names(VERSIONS):
        if version in held or (version not in known and now - folder.modified(f"{VERSIONS}/{version}") < unpublished_after):
            continue
        folder.remove(f"{VERSIONS}/{version}")
        gone.append(version)
    return gone
