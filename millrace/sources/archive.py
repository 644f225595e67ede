"""Fetching and unpacking source archives on the driver, and their manifest."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import urllib.request
import zipfile
from pathlib import Path
from typing import Any

from millrace.sources.files import GovernanceError, sha256_file, write_json


def download(url: str, to: str | Path, overwrite: bool = False, timeout: float = 60.0) -> Path:
    """Streams a file to its place; a length that differs from the announced one leaves nothing behind."""
    to = Path(to)
    if to.exists() and not overwrite:
        return to
    to.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=to.parent, suffix=".part")
    try:
        with os.fdopen(handle, "wb") as out, urllib.request.urlopen(url, timeout=timeout) as r:
            shutil.copyfileobj(r, out, 1 << 20)
            announced = r.headers.get("Content-Length")
        size = os.path.getsize(part)
        if not size or (announced is not None and int(announced) != size):
            raise GovernanceError(f"{url}: {size} bytes came, {announced} were announced")
        os.replace(part, to)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise
    return to


def validate_zip(path: str | Path, expected: list[str]) -> dict[str, str]:
    """Member of each expected file name; a broken archive, a missing or an ambiguous name is an error."""
    if not zipfile.is_zipfile(path):
        raise GovernanceError(f"{path} is not a ZIP archive")
    with zipfile.ZipFile(path) as z:
        if (bad := z.testzip()) is not None:
            raise GovernanceError(f"{bad} is damaged")
        names = [n for n in z.namelist() if not n.endswith("/")]
    found = {}
    for want in expected:
        hits = [n for n in names if Path(n).name == want]
        if len(hits) != 1:
            raise GovernanceError(f"{want} is in the archive {len(hits)} times")
        found[want] = hits[0]
    return found


def extract(path: str | Path, folder: str | Path, expected: list[str], overwrite: bool = False) -> list[Path]:
    """The expected members by their own names, whatever folder they lie in."""
    members, made = validate_zip(path, expected), []
    Path(folder).mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path) as z:
        for name, member in members.items():
            to = Path(folder) / name
            if to.exists() and not overwrite:
                raise FileExistsError(to)
            with z.open(member) as src, open(f"{to}.part", "wb") as out:
                shutil.copyfileobj(src, out, 1 << 20)
            os.replace(f"{to}.part", to)
            made.append(to)
    return made


def update_manifest(path: str | Path, source_id: str, **fields: Any) -> dict[str, Any]:
    """Sets fields of one source in a JSON manifest; an unknown source is an error."""
    manifest = json.loads(Path(path).read_text(encoding="utf-8"))
    hits = [s for s in manifest.get("sources", []) if s.get("source_id") == source_id]
    if len(hits) != 1:
        raise GovernanceError(f"{source_id} stands in the manifest {len(hits)} times")
    hits[0].update(fields)
    write_json(manifest, path)
    return hits[0]


def materialize(path: str | Path, url: str | None, sha256: str | None, offline: bool = True) -> dict[str, Any]:
    """A source that is there already, or fetched unless offline; its checksum must be the recorded one."""
    path = Path(path)
    how = "existing"
    if not path.exists():
        if offline or not url:
            raise GovernanceError(f"{path} is missing and may not be fetched")
        download(url, path)
        how = "remote"
    found = sha256_file(path)
    if sha256 is not None and found != sha256:
        raise GovernanceError(f"{path} has checksum {found}, not {sha256}")
    return {"path": str(path), "sha256": found, "retrieval": how}


def discard(paths: list[str | Path]) -> None:
    """Removes outputs of an earlier run before a new one begins."""
    for p in map(Path, paths):
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)


def confined(root: str | Path, relative: str) -> Path:
    """A path below ``root``, or an error."""
    p = (Path(root) / relative).resolve()
    if Path(root).resolve() not in (p, *p.parents):
        raise GovernanceError(f"{relative} leaves {root}")
    return p
