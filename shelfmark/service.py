"""A small HTTP service over a published catalog: JSON answers, limits on what is sent, a guarded reload.

Routes: ``/health /ready /version /metrics``, ``POST /reload``, ``/locate?basename=`` (labels of packages),
``/entries?pattern=`` (file search with its options), ``/search?pattern=`` (metadata) and
``/command?name=`` (providers). Queries are Spark jobs; the driver gets ``MOST`` rows of a result at most.
"""

from __future__ import annotations

import hmac
import json
import threading
import time
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import locate, textindex
from .plans.query import Field, FileSort, LocateQuery, MetaQuery, MetaSort

VERSION = "0.2"
#: Largest limit of a result.
MOST = 10_000


class Refused(Exception):
    def __init__(self, status: HTTPStatus, message: str) -> None:
        super().__init__(message)
        self.status = status


class State:
    """The open version, and a reload that waits in one slot however often it is asked for."""

    def __init__(self, spark: SparkSession, path: str, token: str | None = None) -> None:
        self.spark, self.path, self.token, self.began = spark, path, token, time.monotonic()
        self.requests, self.catalog, self.lock = 0, None, threading.Lock()
        self.asked = threading.Event()
        self.reload()

    def reload(self) -> bool:
        """Opens the version that is published now; the old one stays if there is none to open."""
        self.asked.clear()
        try:
            found = Catalog.open(self.spark, self.path, resident=True)
        except FileNotFoundError:
            return False
        if self.catalog is None or found.version != self.catalog.version:
            self.catalog = found
        return True

    def opened(self) -> Catalog:
        if self.catalog is None:
            raise Refused(HTTPStatus.SERVICE_UNAVAILABLE, "no catalog is loaded")
        return self.catalog

    def watch(self, seconds: float, stop: threading.Event) -> None:
        """Reloads when asked, and every so many seconds."""
        while not stop.is_set():
            self.asked.wait(seconds)
            if not stop.is_set():
                self.reload()


class Options:
    """Parameters of a request, each read by its kind."""

    def __init__(self, query: str) -> None:
        self.given = parse_qs(query, keep_blank_values=True)

    def text(self, name: str, default: str | None = None) -> str | None:
        return self.given.get(name, [default])[-1]

    def needed(self, name: str) -> str:
        if not self.text(name):
            raise Refused(HTTPStatus.BAD_REQUEST, f"the parameter {name} is missing")
        return self.text(name)

    def flag(self, name: str) -> bool:
        return self.text(name, "false").lower() in ("1", "true", "yes", "")

    def number(self, name: str, default: int | None = None) -> int | None:
        raw = self.text(name)
        if raw is None:
            return default
        if not raw.isdigit():
            raise Refused(HTTPStatus.BAD_REQUEST, f"{name} is no number")
        return int(raw)

    def limit(self) -> int:
        if (n := self.number("limit", MOST)) > MOST:
            raise Refused(HTTPStatus.BAD_REQUEST, f"limits are {MOST} at most")
        return n


def _rows(df: DataFrame) -> list[dict]:
    """Rows as JSON objects without null fields."""
    return [json.loads(r["line"]) for r in df.select(F.to_json(F.struct(*df.columns)).alias("line")).collect()]


def health(s: State, _: Options) -> dict:
    n = s.catalog.table("packages").count() if s.catalog else None
    return {"status": "ok", "index_loaded": s.catalog is not None, "package_db_loaded": s.catalog is not None, "package_count": n, "version": VERSION, "uptime_seconds": int(time.monotonic() - s.began)}


def located(s: State, o: Options) -> dict:
    c = s.catalog
    if c is None:
        return {"packages": []}
    name = o.needed("basename")
    pairs = c.table("basename_postings") if c.has("basename_postings") else textindex.basename_postings(c.table("files"))
    found = textindex.named(pairs.where(F.col("basename") == name), c.table("packages"))
    return {"packages": [r["label"] for r in found.select("label").distinct().orderBy("label").limit(MOST).collect()]}


def entries(s: State, o: Options) -> dict:
    c, limit = s.opened(), o.limit()
    try:
        q = LocateQuery(
            o.needed("pattern"), regex=o.flag("regex"), package=o.text("package"), hash=o.text("hash"), all=o.flag("all"), types=tuple(o.given.get("type", ())),
            group=not o.flag("no_group"), whole_name=o.flag("whole_name"), at_root=o.flag("at_root"), sort=FileSort.parse(o.text("sort", "none")),
            min_size=o.number("min_size"), max_size=o.number("max_size"), exclude_fhs=o.flag("exclude_fhs"), minimal=o.flag("minimal"),
        )
        found = c.locate(q)
    except ValueError as e:
        raise Refused(HTTPStatus.BAD_REQUEST, str(e)) from None
    if o.flag("count"):
        return {"count": found.count(), "matches": []}
    if q.minimal:
        return {"matches": [{"attr": r["label"]} for r in found.limit(limit).collect()]}
    node = F.when(F.col("kind") == "s", F.struct(F.col("kind").alias("type"), F.lit(None).cast("long").alias("size"), "target"))
    node = node.otherwise(F.struct(F.col("kind").alias("type"), "size", F.lit(None).cast("string").alias("target")))
    more = [x for x in locate.META if x in c.table("package_meta").columns]
    found = locate.enriched(found.limit(limit).withColumn("node", node), c.table("package_meta"))
    return {"matches": _rows(found.select("attr", "output", "name", "hash", "path", "node", *more))}


def searched(s: State, o: Options) -> dict:
    c, limit = s.opened(), o.limit()
    try:
        sort = MetaSort.NONE if o.text("sort", "none") == "relevance" else MetaSort(o.text("sort", "none"))
        q = MetaQuery(o.needed("pattern"), Field(o.text("field", "both")), regex=o.flag("regex"), exact=o.flag("exact"), fuzzy=o.flag("fuzzy"), case_sensitive=o.flag("case_sensitive"), sort=sort, limit=limit)
        found = c.search(q)
    except ValueError as e:
        raise Refused(HTTPStatus.BAD_REQUEST, str(e)) from None
    if o.flag("count"):
        return {"count": found.count(), "results": []}
    if o.flag("name_only"):
        return {"names": [r["attr"] for r in found.select("attr").collect()], "results": []}
    return {"results": _rows(found.drop("meta_ord", "score"))}


def command(s: State, o: Options) -> dict:
    name = o.needed("name")
    found = s.opened().which(name).select("attr", "output", "toplevel").limit(MOST)
    return {"command": name, "providers": [r.asDict() for r in found.collect()]}


def metrics(s: State) -> str:
    loaded = int(s.catalog is not None)
    rows = [
        ("requests_total", "counter", "HTTP requests served.", s.requests), ("index_loaded", "gauge", "Whether a catalog is loaded.", loaded),
        ("package_db_loaded", "gauge", "Whether package metadata is loaded.", loaded), ("uptime_seconds", "gauge", "Seconds since the start.", int(time.monotonic() - s.began)),
    ]
    return "".join(f"# HELP shelfmark_{n} {told}\n# TYPE shelfmark_{n} {kind}\nshelfmark_{n} {v}\n" for n, kind, told, v in rows) + f'shelfmark_version_info{{version="{VERSION}"}} 1\n'


ROUTES = {"/health": health, "/version": lambda s, o: {"version": VERSION}, "/locate": located, "/entries": entries, "/search": searched, "/command": command}


def _handler(state: State) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def answer(self, status: int, body: dict | str, kind: str = "application/json", **headers: str) -> None:
            raw = (body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)).encode()
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(raw)), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def counted(self) -> tuple[str, Options]:
            with state.lock:
                state.requests += 1
            at = urlsplit(self.path)
            return at.path, Options(at.query)

        def do_GET(self) -> None:
            path, options = self.counted()
            try:
                if path == "/metrics":
                    self.answer(HTTPStatus.OK, metrics(state), "text/plain; version=0.0.4")
                elif path == "/ready":
                    ready = state.catalog is not None
                    self.answer(HTTPStatus.OK if ready else HTTPStatus.SERVICE_UNAVAILABLE, {"ready": ready, "index_loaded": ready, "package_db_loaded": ready})
                elif path in ROUTES:
                    self.answer(HTTPStatus.OK, ROUTES[path](state, options))
                else:
                    self.answer(HTTPStatus.NOT_FOUND, {"error": "no such route"})
            except Refused as e:
                self.answer(e.status, {"error": str(e)})
            except Exception as e:  # one bad request does not end the service
                self.answer(HTTPStatus.INTERNAL_SERVER_ERROR, {"error": f"search failed: {type(e).__name__}"})

        def do_POST(self) -> None:
            path, _ = self.counted()
            if path != "/reload":
                self.answer(HTTPStatus.NOT_FOUND, {"error": "no such route"})
            elif not self.allowed():
                self.answer(HTTPStatus.UNAUTHORIZED, {"error": "not allowed"}, **{"WWW-Authenticate": "Bearer"})
            else:
                first = not state.asked.is_set()
                state.asked.set()
                self.answer(HTTPStatus.OK, {"reloaded": first})

        def allowed(self) -> bool:
            """With a token who has it; without one only callers on this machine."""
            if state.token is None:
                return self.client_address[0] in ("127.0.0.1", "::1")
            given = self.headers.get("Authorization", "")
            return given.startswith("Bearer ") and hmac.compare_digest(given[7:].encode(), state.token.encode())

    return Handler


def serve(spark: SparkSession, path: str, host: str = "127.0.0.1", port: int = 0, token: str | None = None, seconds: float = 60.0) -> ThreadingHTTPServer:
    """Starts the service in threads of its own; ``server_address`` tells the port, ``shutdown`` ends it."""
    state, stop = State(spark, path, token), threading.Event()
    server = ThreadingHTTPServer((host, port), _handler(state))
    server.state = state
    end = server.shutdown

    def shutdown() -> None:
        stop.set()
        state.asked.set()
        end()
        server.server_close()

    server.shutdown = shutdown
    threading.Thread(target=state.watch, args=(seconds, stop), daemon=True).start()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def render(body: dict) -> list[str]:
    """An answer of the service as the lines a command-line client prints."""
    if "error" in body:
        return [f"error: {body['error']}"]
    if body.get("count") is not None:
        return [str(body["count"])]
    if "matches" in body:
        return [f"{m['attr']}.{m['output']} {m['node'].get('size', 0):,} {m['node']['type']} {m['path']}" if "node" in m else m["attr"] for m in body["matches"]]
    if "providers" in body:
        return [f"{p['attr']}.{p['output']}" if p["toplevel"] else f"({p['attr']}.{p['output']})" for p in body["providers"]]
    if "packages" in body:
        return body["packages"]
    return body.get("names") or [f"{r['attr']}  {r.get('description', '')}".rstrip() for r in body.get("results", [])]
