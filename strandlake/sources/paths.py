"""Where the files of a genome are, and files that belong together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from strandlake.storage import filesystem

#: Endings of sequence files, in the order in which they are tried.
SEQUENCES = (".fa", ".fna", ".fasta", ".fa.gz", ".fna.gz", ".fasta.gz")
#: Tables of one genome, by the ending of its folder.
TABLES = {"genome": ".genome", "index": ".index", "annotation": ".notes", "alignments": ".alignments"}


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = filesystem(spark, path)
    return fs.exists(target)


def root(path: str, endings: Sequence[str] = SEQUENCES) -> str:
    """The path without a known ending."""
    for e in sorted((*endings, *TABLES.values()), key=len, reverse=True):
        if path.endswith(e) and not path.rstrip("/").endswith("/" + e):
            return path[: -len(e)]
    return path.rstrip("/")


def find(spark: SparkSession, path: str, endings: Sequence[str] = (TABLES["index"], TABLES["genome"], *SEQUENCES)) -> str:
    """path itself if it is there, else the first of path + ending that is; an error if none is."""
    for e in ("", *endings):
        if exists(spark, path + e):
            return path + e
    raise FileNotFoundError(f"there is neither {path} nor one of its endings {', '.join(endings)}")


def target(source: str, folder_or_name: str | None, ending: str) -> str:
    """Where something made from `source` goes: beside it, into a folder (a path that ends in /), or under a name; the ending is added where it is missing."""
    base = root(source)
    if folder_or_name is None:
        return base + ending
    if folder_or_name.endswith("/"):
        return folder_or_name + base.rpartition("/")[2] + ending
    return folder_or_name if folder_or_name.endswith(ending) else root(folder_or_name) + ending


def made(spark: SparkSession, path: str, make: Callable[[], DataFrame], keep: bool = True) -> DataFrame:
    """The table at path, made and written there first if it is missing; without keep it goes when the application ends."""
    if not exists(spark, path):
        make().write.parquet(path)
        if not keep:
            fs, where = filesystem(spark, path)
            fs.deleteOnExit(where)
    return spark.read.parquet(path)


def _whole(spark: SparkSession, base: str) -> list[str]:
    found = [base + e for e in TABLES.values() if exists(spark, base + e)]
    if not found:
        raise FileNotFoundError(f"{base} has no tables")
    return found


def remove(spark: SparkSession, base: str, missing_ok: bool = False) -> list[str]:
    """Delete the tables of a genome; returns what went."""
    found = [] if missing_ok and not any(exists(spark, base + e) for e in TABLES.values()) else _whole(spark, base)
    for path in found:
        fs, where = filesystem(spark, path)
        fs.delete(where, True)
    return found


def move(spark: SparkSession, base: str, to: str, replace: bool = False) -> list[str]:
    """Rename the tables of a genome together; an error, before anything is moved, if one is there already and replace is not said."""
    found = _whole(spark, base)
    for path in found:
        if exists(spark, new := to + path[len(base) :]) and not replace:
            raise FileExistsError(new)
    for path in found:
        fs, where = filesystem(spark, path)
        _, new = filesystem(spark, to + path[len(base) :])
        fs.delete(new, True)
        fs.rename(where, new)
    return [to + path[len(base) :] for path in found]


def copy(spark: SparkSession, base: str, to: str, replace: bool = False) -> list[str]:
    """Copy the tables of a genome together."""
    found = _whole(spark, base)
    for path in found:
        if exists(spark, to + path[len(base) :]) and not replace:
            raise FileExistsError(to + path[len(base) :])
    for path in found:
        spark.read.parquet(path).write.mode("overwrite").parquet(to + path[len(base) :])
    return [to + path[len(base) :] for path in found]
