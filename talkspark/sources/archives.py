"""Corpus archives, unpacked on the driver; the fetcher is injected, and nothing is fetched where the files are there."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

# What belongs to a corpus, and how many files it has where that is known.
WANTED: dict[str, tuple[str, int | None]] = {"sbcsae": (".cha", 60), "switchboard": ("-trans.text", 4876), "ami": (".xml", None)}
AMI_FOLDERS = ("words", "segments", "corpusResources")
# End of fixed values.


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            yield from ((m.name, f.read()) for m in t if m.isfile() and (f := t.extractfile(m)))


def _place(corpus: str, name: str) -> PurePosixPath | None:
    """Where a member goes: flat, but for the folders of the meeting corpus; None: not wanted."""
    path = PurePosixPath(name)
    if path.parts[0] == "__MACOSX" or not name.endswith(WANTED[corpus][0]):
        return None
    if corpus != "ami":
        return PurePosixPath(path.name)
    at = next((i for i, p in enumerate(path.parts) if p in AMI_FOLDERS), None)
    return PurePosixPath(*path.parts[at:]) if at is not None and ".." not in path.parts else None


def download(corpus: str, url: str, dest: str, fetch: Callable[[str], bytes], force: bool = False) -> list[str]:
    suffix, expected = WANTED[corpus]
    root = Path(dest)
    there = sorted(str(p) for p in root.rglob(f"*{suffix}"))
    if there and not force and expected in (None, len(there)):
        return there
    written = []
    for name, content in _members(fetch(url)):
        if place := _place(corpus, name):
            target = root / place
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(content)
            written.append(str(target))
    if expected not in (None, len(written)):
        raise RuntimeError(f"{corpus}: {len(written)} files in the archive, {expected} expected")
    return sorted(written)
