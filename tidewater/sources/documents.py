"""A registry of documents and the files that were fetched for it: bounded downloads, checks, hashes, confirmed reviews."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import urlparse

# The largest file, the first bytes of a PDF file, and the least note of a review.
MOST_BYTES, MAGIC, LEAST_NOTE = 120 * 1024 * 1024, b"%PDF-", 15


def inspect_pdf(data: bytes) -> int | None:
    """The number of pages that a PDF file tells of without being unpacked, or None; ValueError for other files and encrypted ones."""
    if not data.startswith(MAGIC):
        raise ValueError("the file is no PDF")
    if re.search(rb"/Encrypt\b", data):
        raise ValueError("the PDF is encrypted")
    told = [int(n) for n in re.findall(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)", data)] + [int(n) for n in re.findall(rb"/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", data)]
    return max(told, default=None) or len(re.findall(rb"/Type\s*/Page\b(?!s)", data)) or None


class Library:
    """Documents of a registry (a JSON list of id, url and, once verified, verified_sha256 and verified_pages) in a folder of the driver."""

    def __init__(self, registry: str, folder: str, opener=None):
        self.known = {s["id"]: s for s in json.loads(Path(registry).read_text())}
        self.folder, self.opener = Path(folder), opener

    def paths(self, name: str) -> tuple[Path, Path]:
        """The file of a document and the one of its metadata."""
        if name not in self.known:
            raise ValueError(f"{name} is not in the registry")
        return self.folder / f"{name}.pdf", self.folder / f"{name}.metadata.json"

    def metadata(self, name: str) -> dict | None:
        """What is known of a document's file, if that is there and as it was."""
        file, about = self.paths(name)
        if not (file.exists() and about.exists()):
            return None
        meta = json.loads(about.read_text())
        return meta if meta["sha256"] == hashlib.sha256(file.read_bytes()).hexdigest() else None

    def register(self, name: str, path: str, found_at: str | None = None, count=inspect_pdf) -> dict:
        """Takes a file over as a document's, verified if the registry has its hash and pages. count gives the pages, as a PDF library can."""
        file, about = self.paths(name)
        source = self.known[name]
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError("the file is too large")
        data = Path(path).read_bytes()
        pages, digest = count(data), hashlib.sha256(data).hexdigest()
        same = digest == source.get("verified_sha256") and pages == source.get("verified_pages")
        self.folder.mkdir(parents=True, exist_ok=True)
        if Path(path).resolve() != file.resolve():
            shutil.copyfile(path, file)
        meta = {
            "id": name, "source_url": source["url"], "document_url": found_at, "sha256": digest, "pages": pages,
            "registered_at": datetime.now(UTC).isoformat(), "verified": same, "note": source.get("note") if same else None,
        }
        about.write_text(json.dumps(meta, ensure_ascii=False))
        return meta

    def fetch(self, name: str, url: str | None = None) -> dict:
        """The document's metadata, downloaded over HTTPS unless its file is there and as it was."""
        known = self.metadata(name)
        if known:
            return known
        url = url or self.known[name]["url"]
        if urlparse(url).scheme != "https":
            raise ValueError("the address starts with https://")
        self.folder.mkdir(parents=True, exist_ok=True)
        part = self.folder / f"{name}.part"
        try:
            with self.opener.open(url, timeout=60) as answer, part.open("wb") as out:
                size = 0
                while block := answer.read(1 << 20):
                    size += len(block)
                    if size > MOST_BYTES:
                        raise ValueError("the file is too large")
                    out.write(block)
            return self.register(name, str(part), url)
        finally:
            part.unlink(missing_ok=True)

    def confirm(self, name: str, note: str) -> dict:
        """Marks a document as reviewed, with a note on what was looked at; ValueError if its file is not as it was."""
        meta = self.metadata(name)
        if meta is None:
            raise ValueError("the file has changed or is not there")
        if len(note.strip()) < LEAST_NOTE:
            raise ValueError(f"a note has {LEAST_NOTE} characters at least")
        meta |= {"verified": True, "note": note.strip()}
        self.paths(name)[1].write_text(json.dumps(meta, ensure_ascii=False))
        return meta
