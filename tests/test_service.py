"""The HTTP service on a small catalog."""

import json
import time
import urllib.error
import urllib.request

import pytest

from shelfmark import service
from shelfmark.catalog import Catalog


@pytest.fixture(scope="module")
def tables(spark):
    packages = spark.createDataFrame([(0, "coreutils", "out", True, None, "/store", "1" * 32, "coreutils-9.11"), (1, "abuild", "out", False, None, "/store", "2" * 32, "abuild-1.0")], "pkg_id long, attr string, output string, toplevel boolean, system string, store_dir string, hash string, name string")
    files = spark.createDataFrame([(0, "/bin/ls", "x", 1234, None), (1, "/bin/ls", "s", 0, "ls"), (0, "/lib/a.so", "r", 7, None)], "pkg_id long, path string, kind string, size long, target string")
    meta = spark.createDataFrame([(0, "coreutils", "coreutils", "GNU Core Utilities", None, "MIT")], "meta_ord long, attr string, name string, description string, main_program string, license string")
    return packages, files, meta


def call(server, path, method="GET", **headers):
    url = f"http://127.0.0.1:{server.server_address[1]}{path}"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=120) as r:
            raw = r.read().decode()
            return r.status, json.loads(raw) if r.headers["Content-Type"] == "application/json" else raw
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_service(spark, tables, tmp_path):
    path = str(tmp_path / "c")
    server = service.serve(spark, path, token="secret", seconds=3600)
    try:
        assert call(server, "/ready")[0] == 503 and call(server, "/entries?pattern=ls")[0] == 503 and call(server, "/locate?basename=ls") == (200, {"packages": []})
        Catalog.build(spark, path, *tables)
        assert call(server, "/reload", "POST")[0] == 401 and call(server, "/reload", "POST", Authorization="Bearer other")[0] == 401
        assert call(server, "/reload", "POST", Authorization="Bearer secret") == (200, {"reloaded": True})
        end = time.time() + 60
        while call(server, "/ready")[0] != 200 and time.time() < end:
            time.sleep(0.2)
        health = call(server, "/health")[1]
        assert health["status"] == "ok" and health["package_count"] == 2 and call(server, "/version") == (200, {"version": service.VERSION})
        assert call(server, "/locate?basename=ls") == (200, {"packages": ["abuild.out", "coreutils.out"]})
        status, body = call(server, "/entries?pattern=bin/ls&all=true&whole_name=true&sort=size-desc")
        assert status == 200 and body["matches"] == [
            {"attr": "coreutils", "output": "out", "name": "coreutils-9.11", "hash": "1" * 32, "path": "/bin/ls", "node": {"type": "x", "size": 1234}, "description": "GNU Core Utilities", "license": "MIT"},
            {"attr": "abuild", "output": "out", "name": "abuild-1.0", "hash": "2" * 32, "path": "/bin/ls", "node": {"type": "s", "target": "ls"}},
        ]
        assert service.render(body) == ["coreutils.out 1,234 x /bin/ls", "abuild.out 0 s /bin/ls"]
        assert call(server, "/entries?pattern=b.n/l&regex=1&count=1")[1] == {"count": 1, "matches": []} and call(server, "/entries?pattern=ls&minimal=1")[1]["matches"] == [{"attr": "coreutils.out"}, {"attr": "(abuild.out)"}]
        assert [call(server, p)[0] for p in ("/entries", "/entries?pattern=(&regex=1", "/entries?pattern=a&limit=10001", "/entries?pattern=a&type=q", "/entries?pattern=a&sort=q", "/entries?pattern=" + "a" * 1025, "/search?pattern=a&field=q", "/command", "/nothing")] == [400] * 8 + [404]
        assert call(server, "/search?pattern=core")[1]["results"] == [{"attr": "coreutils", "name": "coreutils", "description": "GNU Core Utilities", "license": "MIT"}]
        assert call(server, "/search?pattern=core&name_only=1")[1]["names"] == ["coreutils"] and call(server, "/search?pattern=core&count=1")[1]["count"] == 1
        body = call(server, "/command?name=ls")[1]
        assert body["command"] == "ls" and service.render(body) == ["coreutils.out", "(abuild.out)"]
        assert "shelfmark_index_loaded 1" in call(server, "/metrics")[1]
    finally:
        server.shutdown()
