"""Fetching JSON over HTTPS to a cache: named routes, no redirects, bounded size, retries, hashed copies."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from datetime import date, timedelta
from pathlib import Path

MOST_BYTES = 2_000_000


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


class JsonSource:
    """GET requests below a base address. opener and wait can be replaced, as tests do."""

    def __init__(self, base: str, routes: set[str], attempts: int = 3, opener=None, wait=time.sleep):
        if not base.startswith("https://"):
            raise ValueError("the base address starts with https://")
        self.base, self.routes, self.attempts, self.wait = base.rstrip("/"), routes, attempts, wait
        self.opener = opener or urllib.request.build_opener(_NoRedirect)

    def get(self, path: str, params: dict[str, str]) -> bytes:
        if path not in self.routes:
            raise ValueError(f"{path} is no known route")
        url = f"{self.base}{path}?{urllib.parse.urlencode(params)}"
        for attempt in range(self.attempts):
            try:
                with self.opener.open(url, timeout=30) as answer:
                    body = answer.read(MOST_BYTES + 1)
                if len(body) > MOST_BYTES:
                    raise ValueError("the answer is too large")
                json.loads(body)
                return body
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500 or attempt + 1 == self.attempts:
                    raise
                asked = (e.headers or {}).get("Retry-After", "")
                self.wait(min(30, int(asked)) if str(asked).isdigit() else 2**attempt)
            except (urllib.error.URLError, TimeoutError):
                if attempt + 1 == self.attempts:
                    raise
                self.wait(2**attempt)
        raise AssertionError

    def cached(self, folder: str, name: str, path: str, params: dict[str, str], refresh: bool = False) -> bytes:
        """The answer, kept as name.json with name.meta.json; a copy that does not match its hash or request is an error, and so is
        a refresh where a copy is kept: kept answers are never replaced."""
        raw, meta = Path(folder, f"{name}.json"), Path(folder, f"{name}.meta.json")
        if raw.exists() != meta.exists():
            raise ValueError(f"{name}: one of two files is missing")
        if raw.exists() and refresh:
            raise FileExistsError(f"{name} is kept; refresh into another folder")
        if raw.exists():
            body, known = raw.read_bytes(), json.loads(meta.read_text())
            if known != {"sha256": hashlib.sha256(body).hexdigest(), "path": path, "params": params}:
                raise ValueError(f"{name}: the copy does not match")
            return body
        body = self.get(path, params)
        raw.parent.mkdir(parents=True, exist_ok=True)
        raw.write_bytes(body)
        meta.write_text(json.dumps({"sha256": hashlib.sha256(body).hexdigest(), "path": path, "params": params}))
        return body

    def month(self, folder: str, volumes: str, prices: str, start: date, end: date, ids: list[int], format: str = "%Y.%m.%d") -> dict[str, bytes]:
        """The answers for a period, kept in a folder: one of volumes for all of it and one of prices for each day, by name."""
        if end < start:
            raise ValueError("the period ends before it starts")
        base = {"territories": ",".join(map(str, ids))}
        out = {"volumes": self.cached(folder, "volumes", volumes, base | {"startDate": start.strftime(format), "endDate": end.strftime(format)})}
        for i in range((end - start).days + 1):
            day = start + timedelta(days=i)
            out[f"prices_{day}"] = self.cached(folder, f"prices_{day}", prices, base | {"startDate": day.strftime(format)})
        return out
