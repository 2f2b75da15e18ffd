"""Members of remote archives, by byte ranges: a file object over ranges, read by zipfile.

zipfile finds the directory (ZIP64 too), inflates, and checks sizes and sums; only the ranges
that it touches are fetched, in blocks.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from urllib.request import Request, urlopen


class RangeFile(io.RawIOBase):
    """A seekable file whose bytes come from ``fetch(start, end)``, end exclusive, block by block."""

    def __init__(self, fetch: Callable[[int, int], bytes], size: int, block: int = 1 << 20):
        self.fetch, self.size, self.block, self.pos = fetch, size, block, 0
        self._held: tuple[int, bytes] = (-1, b"")
        self.fetched = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.pos

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self.pos = offset + {os.SEEK_SET: 0, os.SEEK_CUR: self.pos, os.SEEK_END: self.size}[whence]
        return self.pos

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.pos)
        if n <= 0:
            return 0
        k = self.pos // self.block
        if self._held[0] != k:
            start, end = k * self.block, min((k + 1) * self.block, self.size)
            data = self.fetch(start, end)
            if len(data) != end - start:
                raise OSError(f"{len(data)} bytes came for the range {start}-{end}")
            self._held, self.fetched = (k, data), self.fetched + len(data)
        data = self._held[1][self.pos - k * self.block :][:n]
        buffer[: len(data)] = data
        self.pos += len(data)
        return len(data)


def open_url(url: str, user_agent: str, timeout: float = 300.0) -> RangeFile:
    def get(start: int, end: int):
        return urlopen(Request(url, headers={"User-Agent": user_agent, "Range": f"bytes={start}-{end - 1}"}), timeout=timeout)

    with get(0, 1) as answer:
        told = answer.headers.get("Content-Range")
    if not told:
        raise OSError(f"{url} serves no byte ranges")

    def fetch(start: int, end: int) -> bytes:
        with get(start, end) as answer:
            return answer.read()

    return RangeFile(fetch, int(told.rsplit("/", 1)[1]))


class Archive:
    """A zip over any seekable file."""

    def __init__(self, file: io.RawIOBase):
        self.zip = zipfile.ZipFile(io.BufferedReader(file) if isinstance(file, io.RawIOBase) else file)

    def members(self) -> list[zipfile.ZipInfo]:
        return self.zip.infolist()

    def member(self, fragment: str) -> zipfile.ZipInfo:
        """The only member whose name holds the fragment."""
        hits = [m for m in self.members() if fragment in m.filename]
        if len(hits) != 1:
            raise KeyError(f"{fragment!r} matches {sorted(m.filename for m in hits) or 'nothing'}")
        return hits[0]

    def read(self, member: zipfile.ZipInfo) -> bytes:
        return self.zip.read(member)

    def extract(self, member: zipfile.ZipInfo, to: str) -> str:
        """Write a member to a path; it appears there when it is whole."""
        os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
        part = f"{to}.part"
        try:
            with self.zip.open(member) as source, open(part, "wb") as out:
                while data := source.read(1 << 20):
                    out.write(data)
            os.replace(part, to)
        finally:
            if os.path.exists(part):
                os.unlink(part)
        return to


def extract_citygml(nested: str, folder: str) -> str:
    """The one .gml of an archive, written to the folder."""
    archive = Archive(open(nested, "rb"))
    found = [m for m in archive.members() if m.filename.lower().endswith(".gml")]
    if len(found) != 1:
        raise ValueError(f"{os.path.basename(nested)}: expected exactly one .gml, found {len(found)}")
    return archive.extract(found[0], os.path.join(folder, os.path.basename(found[0].filename)))
