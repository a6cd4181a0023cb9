"""Entries of JAR and ZIP archives, and of archives inside them, one level down."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

NESTED = re.compile(r"/(BOOT-INF/lib|WEB-INF/lib)/.*\.jar|/[^/]+\.jar", re.DOTALL)


@dataclass
class Entry:
    container: str
    depth: int
    path: str
    content: bytes
    error: str | None = None


def is_nested(path: str) -> bool:
    return NESTED.fullmatch(path) is not None


def entries(container: str, content: bytes, ignore_prefix: str | None = None, known: frozenset[str] = frozenset()) -> Iterator[Entry]:
    """Files of an archive in order, then those of each archive inside it.

    ignore_prefix: paths that begin so are passed over. known: SHA-256 digests
    of inner archives that are stored already; they and repeats are skipped. A
    broken archive gives one entry with an error, and the others go on.
    """
    inner: list[tuple[str, bytes]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                path = "/" + info.filename.lstrip("/")
                if info.is_dir() or (ignore_prefix and path.startswith(ignore_prefix)):
                    continue
                try:
                    data = z.read(info)
                except Exception as e:  # one bad entry doesn't end the archive
                    yield Entry(container, 0, path, b"", f"{type(e).__name__}: {e}")
                    continue
                if is_nested(path):
                    inner.append((path, data))
                else:
                    yield Entry(container, 0, path, data)
    except (zipfile.BadZipFile, EOFError, ValueError) as e:
        yield Entry(container, 0, container, b"", f"{type(e).__name__}: {e}")
        return
    seen = set(known)
    for path, data in inner:
        digest = hashlib.sha256(data).hexdigest()
        if digest in seen:
            continue
        seen.add(digest)
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    at = "/" + info.filename.lstrip("/")
                    if not info.is_dir() and not (ignore_prefix and at.startswith(ignore_prefix)):
                        yield Entry(f"{container}!{path}", 1, at, z.read(info))
        except Exception as e:  # a broken inner archive is skipped
            yield Entry(f"{container}!{path}", 1, path, b"", f"{type(e).__name__}: {e}")
