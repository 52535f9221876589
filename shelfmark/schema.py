"""Schemas of the catalog's tables."""

from __future__ import annotations

PACKAGES = "pkg_id long, attr string, output string, toplevel boolean, system string, store_dir string, hash string, name string"
FILES = "pkg_id long, path string, kind string, size long, target string"
PACKAGE_META = (
    "meta_ord long, attr string, name string, description string, main_program string, "
    "license string, homepage string, maintainers array<string>, platforms array<string>"
)
REFS = "src_hash string, dst_hash string, dst_name string, ord long"
ROOTS = "hash string, attr string, output string, toplevel boolean, name string, main_program string, ord long"
FETCH_CACHE = "cache_key string, hash string, refs array<string>, tree string, fetched_at timestamp"
CHUNKS = "blob string, idx long, offset long, length long, hash binary"

#: A record of the package evaluation, as it comes over the wire.
EVAL = (
    "attr string, attrPath array<string>, name string, system string, storeDir string, outputs map<string,string>, "
    "cacheStatus string, isCached boolean, error string, fatal boolean, "
    "meta struct<mainProgram: string, description: string, homepage: string, platforms: array<string>>"
)
META_WIRE = (
    "attr string, name string, description string, mainProgram string, license string, homepage string, "
    "maintainers array<string>, platforms array<string>"
)
KINDS = ("r", "x", "d", "s")
