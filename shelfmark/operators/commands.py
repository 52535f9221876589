"""Commands and the packages that provide them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fn

#: Direct children of the program folders.
PROGRAM = r"^/(usr/)?s?bin/[^/]+$"


def providers(files: DataFrame, packages: DataFrame, strict: bool = False) -> DataFrame:
    """``command, attr, output, toplevel``, distinct. Strict: executables and links in /bin only."""
    where = F.col("path").rlike(r"^/bin/[^/]+$") & F.col("kind").isin("x", "s") if strict else F.col("path").rlike(PROGRAM)
    found = files.where(where).select("pkg_id", fn.basename(F.col("path")).alias("command")).distinct()
    return found.join(packages.select("pkg_id", "attr", "output", "toplevel"), "pkg_id").select("command", "attr", "output", "toplevel").distinct()


def which(provided: DataFrame, command: str, all_: bool = True) -> DataFrame:
    """Providers of a command (its basename counts), top-level ones first."""
    name = command.rsplit("/", 1)[-1]
    out = provided.where(F.col("command") == name)
    out = out.withColumn("shown", fn.shown_label(F.col("attr"), F.col("output"), F.col("toplevel")))
    out = out.orderBy(F.desc("toplevel"), "attr", "output")
    return out if all_ else out.limit(1)


MODES = ("message", "auto-install", "auto-run", "interactive", "json")


def suggest(provided: DataFrame, commands: DataFrame, mode: str = "message") -> DataFrame:
    """What to do about commands that were not found: ``command, n, action, exit_code, message``.

    ``commands`` has a column ``command``. Without a provider the exit code is 127 and nothing is
    offered. With one, the mode decides; only a top-level package is installed or run. With several,
    automatic modes refuse. Installing and running are left to the caller.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w = W.partitionBy("command").orderBy(F.desc("toplevel"), "attr", "output")
    first = provided.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    first = first.select("command", fn.label(F.col("attr"), F.col("output")).alias("first"), F.col("toplevel").alias("first_top"))
    sums = provided.groupBy("command").agg(F.count("*").alias("n"))
    out = commands.select("command").distinct().join(sums, "command", "left").join(first, "command", "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    one = {
        "message": F.lit("tell"),
        "json": F.lit("json"),
        "interactive": F.when(F.col("first_top"), "prompt").otherwise("tell"),
        "auto-install": F.when(F.col("first_top"), "install").otherwise("refuse"),
        "auto-run": F.when(F.col("first_top"), "run").otherwise("refuse"),
    }[mode]
    many = {"message": "list", "json": "json", "interactive": "prompt"}.get(mode, "refuse")
    action = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, one).otherwise(many)
    told = (
        F.when(F.col("n") == 0, F.concat(F.col("command"), F.lit(": command not found")))
        .when(F.col("n") == 1, F.concat(F.col("command"), F.lit(" is provided by "), F.col("first")))
        .otherwise(F.concat(F.col("command"), F.lit(" is provided by "), F.col("n").cast("string"), F.lit(" packages, first "), F.col("first")))
    )
    code = F.when(action.isin("install", "run"), 0).otherwise(127)
    return out.select("command", "n", action.alias("action"), code.cast("int").alias("exit_code"), told.alias("message"))
