"""Acquisition on the driver behind one injectable function, so that nothing else needs a network."""

from __future__ import annotations

import hashlib
import json
import re
import time
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from http.client import HTTPException
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from morbiscope.operators.checks import ContractError
from morbiscope.operators.latest import version_key  # noqa: F401  (the same order, in Spark)

#: (status, headers, body) of a GET request.
Response = tuple[int, dict[str, str], bytes]
Getter = Callable[[str], Response]


class Transient(Exception):
    """An error after which the same request may succeed."""


def with_retries(get: Getter, attempts: int = 4, first_wait: float = 2, longest_wait: float = 30, sleep: Callable[[float], None] = time.sleep) -> Getter:
    """Repeat on dropped connections, 429 and 5xx with doubling waits; other failures end at once."""

    def run(url: str) -> Response:
        wait = first_wait
        for left in range(attempts - 1, -1, -1):
            try:
                status, headers, body = get(url)
                if status == 403 and headers.get("x-ratelimit-remaining") == "0":
                    raise ContractError(f"{url}: rate limit used up")
                if status != 429 and status < 500:
                    if status >= 400:
                        raise ContractError(f"{url}: status {status}")
                    return status, headers, body
                error: Exception = Transient(f"{url}: status {status}")
            except (Transient, ConnectionError, TimeoutError) as e:
                error = e
            if not left:
                raise error
            sleep(wait)
            wait = min(wait * 2, longest_wait)
        raise AssertionError

    return run


class HttpClient:
    """GET over HTTP(S) with time limits; calling it is a ``Getter``, ``stream`` gives the body in pieces.

    Dropped connections, time-outs, bodies shorter than announced and undecodable ones are ``Transient``.
    """

    def __init__(self, agent: str = "morbiscope/1.0", timeout: float = 60, headers: dict[str, str] | None = None):
        self.headers, self.timeout = {"User-Agent": agent, **(headers or {})}, timeout

    @contextmanager
    def _open(self, url: str) -> Iterator:
        try:
            with urlopen(Request(url, headers=self.headers), timeout=self.timeout) as answer:  # noqa: S310
                yield answer
        except (HTTPException, zlib.error, EOFError, TimeoutError, ConnectionError) as e:
            raise Transient(f"{url}: {e}") from e
        except URLError as e:
            if isinstance(e, HTTPError):
                raise
            raise Transient(f"{url}: {e.reason}") from e

    def __call__(self, url: str) -> Response:
        try:
            with self._open(url) as answer:
                body = answer.read()
                if answer.headers.get("Content-Encoding") == "gzip":
                    body = zlib.decompress(body, 31)
                return answer.status, {k.lower(): v for k, v in answer.headers.items()}, body
        except HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()

    def stream(self, url: str, chunk: int = 1 << 20) -> Iterator[bytes]:
        """The body piece by piece, so that no file is ever held whole."""
        try:
            with self._open(url) as answer:
                announced, got = answer.headers.get("Content-Length"), 0
                while piece := answer.read(chunk):
                    got += len(piece)
                    yield piece
                if announced is not None and got < int(announced):
                    raise Transient(f"{url}: {got} of {announced} bytes")
        except HTTPError as e:
            kind = Transient if e.code == 429 or e.code >= 500 else ContractError
            raise kind(f"{url}: status {e.code}") from e


def get_json(get: Getter, url: str) -> dict:
    return json.loads(get(url)[2])


def check_response(url: str, response: Response, kind: str | None = None) -> bytes:
    """The body of an answer that is a success, not empty, and of the content type ``kind`` where that is stated."""
    status, headers, body = response
    if not 200 <= status < 300:
        raise ContractError(f"{url}: status {status}")
    if not body:
        raise ContractError(f"{url}: empty")
    if kind and kind not in headers.get("content-type", kind):
        raise ContractError(f"{url}: {headers['content-type']} instead of {kind}")
    return body


def check_landing(folder: str, pattern: str = "*") -> list[str]:
    """The files of a landing folder, which must hold some and none that is empty."""
    files = sorted(p for p in Path(folder).glob(pattern) if p.is_file())
    if not files or any(not p.stat().st_size for p in files):
        raise ContractError(f"{folder}: no files, or empty ones")
    return [str(p) for p in files]


def download(get: Getter, url: str, target: str, attempts: int = 4, wait: float = 2, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body in ``target``, through a ``.part`` file, so that a broken download leaves nothing behind.

    A getter that can ``stream`` is read piece by piece, and a stream that breaks is begun again.
    """
    path = Path(target)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    stream = getattr(get, "stream", None)
    for left in range(attempts - 1, -1, -1):
        try:
            with part.open("wb") as out:
                for piece in stream(url) if stream else [check_response(url, get(url))]:
                    out.write(piece)
            break
        except Transient:
            part.unlink(missing_ok=True)
            if not left or not stream:
                raise
            sleep(wait)
            wait = min(wait * 2, 30)
        except Exception:
            part.unlink(missing_ok=True)
            raise
    if not part.stat().st_size:
        part.unlink()
        raise ContractError(f"{url}: empty")
    part.replace(path)
    return str(path)


def verified_download(get: Getter, url: str, target: str, digest: str, kind: str = "sha256") -> str:
    """A download whose digest is the announced one; otherwise nothing is left in ``target``. A file that is there and right is kept."""
    if Path(target).is_file() and file_digest(target, kind) == digest:
        return target
    landed = download(get, url, target + ".unverified")
    if (found := file_digest(landed, kind)) != digest:
        Path(landed).unlink()
        raise ContractError(f"{url}: {kind} {found} instead of {digest}")
    Path(landed).replace(target)
    return target


# ---- fingerprints -------------------------------------------------------------------------------------------
def file_digest(path: str, kind: str = "sha256") -> str:
    """Hex digest of a file; ``git`` gives the id that git has for it as a blob."""
    data = Path(path)
    h = hashlib.sha1(f"blob {data.stat().st_size}\0".encode()) if kind == "git" else hashlib.new(kind)
    with data.open("rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


# ---- catalogues ---------------------------------------------------------------------------------------------
def parse_version(name: str) -> tuple[int, ...] | None:
    m = re.fullmatch(r"[Vv]?(\d+(?:\.\d+)*)", name.strip())
    return tuple(map(int, m[1].split("."))) if m else None


def newest_release(names: Iterable[str]) -> str:
    known = [n for n in names if parse_version(n) is not None]
    if not known:
        raise ContractError("no release with a version")
    return max(known, key=lambda n: parse_version(n) or ())


def release_file(entries: Sequence[dict], fragment: str) -> dict:
    """The one entry of a repository listing whose name holds ``fragment``."""
    hits = [e for e in entries if fragment.lower() in str(e.get("name", "")).lower()]
    if len(hits) != 1:
        raise ContractError(f"{len(hits)} files match {fragment}")
    return hits[0]


def latest_release_file(get: Getter, listing: str, fragment: str, folder: str) -> tuple[str, str]:
    """(release, path): the newest release of a repository listing, and its one file that holds ``fragment``, verified by its blob id."""
    entries = json.loads(check_response(listing, get(listing)))
    release = newest_release([e["name"] for e in entries if e.get("type") == "dir"])
    files = json.loads(check_response(listing, get(next(e["url"] for e in entries if e["name"] == release))))
    entry = release_file(files, fragment)
    return release, verified_download(get, entry["download_url"], str(Path(folder, release, entry["name"])), entry["sha"], "git")


def latest_record_file(get: Getter, search: str, name: str, url: str, folder: str) -> tuple[str, str]:
    """(record, path): a file of the newest record of a repository search, verified by its MD5. ``url`` holds ``{record}`` and ``{name}``."""
    record, sums = newest_record(json.loads(check_response(search, get(search))))
    if name not in sums:
        raise ContractError(f"{search}: record {record} has no {name}")
    return record, verified_download(get, url.format(record=record, name=name), str(Path(folder, record, name)), sums[name], "md5")


def catalogue_package(get: Getter, base: str, package: str) -> dict:
    """A package of a CKAN catalogue; an answer that says it failed is an error."""
    answer = get_json(get, f"{base}/api/3/action/package_show?{urlencode({'id': package})}")
    if not answer.get("success"):
        raise ContractError(f"{base}: no package {package}")
    return answer


def newest_resource(resources: Sequence[dict]) -> dict:
    """The resource with the greatest name, which is the newest year of a yearly series."""
    if not resources:
        raise ContractError("no resources")
    return max(resources, key=lambda r: r["name"])


def save_feed(get: Getter, url: str, target: str) -> str:
    """A feed's XML as it came, on disk before anything is parsed, so that a page that is no feed can be looked at."""
    return download(get, url, target)


def catalogue_resources(package: dict, pattern: str) -> list[dict]:
    """Resources of a CKAN package whose name matches; the version is their time of last change."""
    hits = [r for r in package["result"]["resources"] if re.search(pattern, r.get("name", ""), re.I)]
    if not hits:
        raise ContractError(f"no resource matches {pattern}")
    return [r | {"version": r.get("last_modified") or r.get("created")} for r in hits]


def newest_record(search: dict) -> tuple[str, dict[str, str]]:
    """Record id and file name -> md5 of the newest hit of a repository search."""
    hits = search["hits"]["hits"]
    if not hits:
        raise ContractError("no record")
    top = hits[0]
    return str(top["id"]), {f["key"]: f["checksum"].removeprefix("md5:") for f in top["files"]}


def member_filter(field: str, values: Sequence[str]) -> str:
    """OData ``$filter`` that lets the server drop other rows before they are sent."""
    quoted = ",".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"{field} in ({quoted})"


def odata_url(base: str, table: str, **options: str) -> str:
    return f"{base}/{table}?{urlencode({'$' + k: v for k, v in options.items()})}"


def feed_url(base: str, query: str, recency: str, language: str, country: str) -> str:
    return f"{base}?{urlencode({'q': f'{query} when:{recency}', 'hl': language, 'gl': country, 'ceid': f'{country}:{language}'})}"


def signed_download(get: Getter, url: str, target: str) -> str:
    """Two hops: a JSON answer with its own error code holds the address of the file."""
    answer = get_json(get, url)
    if answer.get("code") != 0:
        raise ContractError(f"{url}: {answer.get('errMsg') or answer.get('errorMsg') or answer.get('code')}")
    return download(get, answer["data"]["url"], target)


def fetch_each(jobs: dict[str, Callable[[], str]], cap: int | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """Results and errors by name: one failing part does not stop the others, all failing do."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = job()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)
    if jobs and not done:
        raise ContractError(f"all of {sorted(failed)} failed: {next(iter(failed.values()))}")
    if cap is not None and len(done) > cap:
        failed["cap"] = f"more than {cap} parts"
    return done, failed


def boundary_download(get: Getter, metadata_url: str, target: str) -> tuple[str, str]:
    """(version, path): the metadata names the boundary's id, which is its version, and its GeoJSON."""
    meta = get_json(get, metadata_url)
    if not meta.get("boundaryID") or not meta.get("gjDownloadURL"):
        raise ContractError(f"{metadata_url}: no boundary")
    return str(meta["boundaryID"]), download(get, meta["gjDownloadURL"], target)
