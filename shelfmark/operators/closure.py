"""Reference closure of root packages, and synthetic listings for missing ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..storage import cut


def registered_roots(roots: DataFrame) -> DataFrame:
    """One row per hash: the root that came first, its program the first known, top-level if any is."""
    one = roots.groupBy("hash").agg(
        F.min_by(F.struct("attr", "output", "name"), "ord").alias("own"),
        F.min_by("main_program", F.when(F.col("main_program").isNotNull(), F.col("ord"))).alias("main_program"),
        F.bool_or("toplevel").alias("toplevel"),
    )
    return one.select("hash", "own.attr", "own.output", "toplevel", "own.name", "main_program")


def reachable(roots: DataFrame, refs: DataFrame, most: int = 10_000) -> DataFrame:
    """``hash, depth``: breadth-first from the roots, each hash once; cycles are no problem.

    Each round joins the frontier to the references and drops what was seen. References are written
    out once; a round writes its frontier only, as a table of its own, so what is written grows with
    the result and not with its square. Only a count comes to the driver; more than ``most`` rounds
    are an error.
    """
    edges = cut(refs.select("src_hash", "dst_hash").where("src_hash <> dst_hash").distinct())
    seen = front = cut(roots.select("hash", F.lit(0).alias("depth")).distinct())
    for depth in range(1, most + 1):
        step = front.join(edges, front.hash == edges.src_hash).select(F.col("dst_hash").alias("hash")).distinct()
        front = cut(step.join(seen, "hash", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"more than {most} rounds")


def shallow(closure: bool, include_prefix: str | None) -> bool:
    """No traversal without closure, or if only programs are indexed."""
    return not closure or (include_prefix or "").startswith("/bin/")


def closure(roots: DataFrame, refs: DataFrame, deep: bool = True) -> DataFrame:
    """``hash, attr, output, toplevel, name, main_program, is_root``. Roots keep their labels; what
    is only referenced has an empty attribute and is not top-level."""
    own = registered_roots(roots).withColumn("is_root", F.lit(True))
    if not deep:
        return own
    rest = reachable(own, refs).select("hash").join(own.select("hash"), "hash", "left_anti")
    names = refs.groupBy(F.col("dst_hash").alias("hash")).agg(F.min("dst_name").alias("name"))
    rest = rest.join(names, "hash", "left")
    rest = rest.select(
        "hash", F.lit("").alias("attr"), F.lit("out").alias("output"), F.lit(False).alias("toplevel"), "name",
        F.lit(None).cast("string").alias("main_program"), F.lit(False).alias("is_root"),
    )
    return own.select(*rest.columns).unionByName(rest)


def with_listings(packages: DataFrame, listings: DataFrame, status: DataFrame, deep: bool = True) -> DataFrame:
    """File entries of packages: their listing, or for a root with a usable program whose listing
    (or, deep, whose reference list) is missing a synthetic one with /bin and the program.

    ``listings``: hash, path, kind, size, target. ``status``: hash, listing_status, refs_status (404
    for missing). Other errors leave the package out.
    """
    s = packages.join(status, "hash", "left")
    missing = (F.col("listing_status") == 404) | (F.lit(deep) & (F.col("refs_status") == 404))
    made = s.where(F.coalesce(missing, F.lit(False)) & F.col("is_root") & fn.main_program_ok(F.col("main_program")))
    entry = lambda path, kind, size: F.struct(path.alias("path"), F.lit(kind).alias("kind"), F.lit(size).cast("long").alias("size"), F.lit(None).cast("string").alias("target"))
    program = F.concat(F.lit("/bin/"), F.col("main_program"))
    tree = F.array(entry(F.lit(""), "d", 1), entry(F.lit("/bin"), "d", 1), entry(program, "x", 0))
    made = made.select("hash", F.explode(tree).alias("e")).select("hash", "e.*")
    there = s.where((F.coalesce("listing_status", F.lit(200)) == 200) & ~F.coalesce(missing, F.lit(False)))
    real = there.select("hash").join(listings, "hash")
    return real.select("hash", "path", "kind", "size", "target").unionByName(made)
