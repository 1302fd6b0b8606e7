"""File sources: scans, path predicates, decoding, and the index configuration."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.config import ALLOWED_EXTENSIONS, DEFAULT


def extensions(wanted: Iterable[str]) -> frozenset[str]:
    """Lower-case suffixes with their dot."""
    return frozenset("." + e.lower().removeprefix(".") for e in wanted)


def suffix(path: Column) -> Column:
    """The last suffix of a path's name, lower-case; '' for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def allowed(path: Column, wanted: Iterable[str]) -> Column:
    return suffix(path).isin(*extensions(wanted))


def under(path: Column, roots: Iterable[str]) -> Column:
    """Whether a path is one of ``roots`` or below one."""
    out = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        out = out | (path == root) | path.startswith(root + "/")
    return out


def indexable(path: Column, wanted: Iterable[str], patterns: Iterable[str]) -> Column:
    """Whether a path has an allowed suffix and matches no pattern to ignore."""
    return allowed(path, wanted) & ~ignored(path, patterns)


def safe(files: DataFrame, roots: Iterable[str], wanted: Iterable[str] = ALLOWED_EXTENSIONS, max_bytes: int = DEFAULT.max_file_bytes) -> DataFrame:
    """Those of ``files`` (path, length, is_link, is_file) that may be read: regular files, not links, below one of
    ``roots``, of an allowed suffix and size."""
    return files.filter(F.col("is_file") & ~F.col("is_link") & under(F.col("path"), roots) & allowed(F.col("path"), wanted) & (F.col("length") <= max_bytes))


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Whether a component of the path, or the whole path, matches a pattern; patterns with a slash match any stretch of it."""
    choices = []
    for p in patterns:
        whole = fnmatch.translate(p)
        choices += [rf"(?:^|.*/){_body(p, '[^/]')}(?:/.*)?$", whole]
        if "/" in (q := p.replace("\\", "/")):
            choices += [fnmatch.translate(f"*/{q}"), fnmatch.translate(f"*/{q}/*")]
    if not choices:
        return F.lit(False)
    return path.rlike("^(?:" + "|".join(c.replace(r"\Z", "$").replace(r"\z", "$") for c in choices) + ")")


def _body(pattern: str, any_char: str) -> str:
    """A glob as a regular expression in which wildcards stay within a path component."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += any_char + "*"
        elif c == "?":
            out += any_char
        elif end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not (c.isalnum() or c == "_" or c == "/") else c
        i += 1
    return out


@dataclass(frozen=True)
class IndexPath:
    path: str
    recursive: bool = True
    exclude_dirs: frozenset[str] = frozenset()


@dataclass(frozen=True)
class IndexSettings:
    paths: tuple[IndexPath, ...]
    allowed_extensions: frozenset[str] | None = None
    ignore_patterns: tuple[str, ...] = ()


def _strings(value, name: str) -> list[str]:
    if value is None:
        return []
    items = [value] if isinstance(value, str) else value
    if not isinstance(items, list) or not all(isinstance(x, str) for x in items):
        raise ValueError(f"{name} must be a string or a list of strings")
    return items


def index_settings(data: dict) -> IndexSettings:
    """Settings from a parsed mapping with index_paths, allowed_extensions and ignore_patterns."""
    if not isinstance(data, dict) or not data:
        raise ValueError("the configuration must be a mapping that isn't empty")
    entries = data.get("index_paths")
    if not isinstance(entries, list) or not entries:
        raise ValueError("index_paths must be a list that isn't empty")
    paths = []
    for entry in entries:
        entry = {"path": entry} if isinstance(entry, str) else entry
        if not isinstance(entry, dict) or not entry.get("path"):
            raise ValueError("each of index_paths needs a path")
        if not isinstance(recursive := entry.get("recursive", True), bool):
            raise ValueError("recursive must be true or false, without quotes")
        paths.append(IndexPath(normal(entry["path"]), recursive, frozenset(_strings(entry.get("exclude_dirs"), "exclude_dirs"))))
    suffixes = _strings(data.get("allowed_extensions"), "allowed_extensions")
    return IndexSettings(tuple(paths), extensions(suffixes) if suffixes else None, tuple(_strings(data.get("ignore_patterns"), "ignore_patterns")))


def normal(path: str) -> str:
    """A local path as absolute, without links and user's short form; one with a scheme as it is, without a slash at the end."""
    return path.rstrip("/") if "://" in path else os.path.realpath(os.path.expanduser(path))


def load_settings(path: str) -> IndexSettings:
    """Settings from a YAML file; needs a YAML parser."""
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            data = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ValueError(f"{path} is not valid YAML: {e}") from e
    return index_settings(data)


def fallback_settings(root: str) -> IndexSettings:
    """Settings for one folder and all below, where there is no configuration: nothing is ignored."""
    return IndexSettings((IndexPath(normal(root)),))


def _links(spark: SparkSession, root: str) -> list[str]:
    """Local paths below ``root`` that are symbolic links, or lie behind one. Other file systems have none that Spark follows."""
    if "://" in root and not root.startswith("file:"):
        return []
    top, found = root.removeprefix("file:"), []
    top = "/" + top.lstrip("/")
    for here, folders, names in os.walk(top):
        found += [os.path.join(here, n) for n in [*folders, *names] if os.path.islink(os.path.join(here, n))]
    return found


def scan(spark: SparkSession, settings: IndexSettings, max_bytes: int = DEFAULT.max_file_bytes) -> DataFrame:
    """(filepath, length, sha256, content) of the files to index.

    Spark lists and reads the roots; missing roots are skipped, symbolic links and what lies behind them are left
    out, and sizes above the limit are never read (the filter reaches the source). Roots may have a scheme;
    local paths are given without one.
    """
    parts = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for root in settings.paths:
        path = hadoop(root.path)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(root.recursive).lower()).load(root.path)
        name = F.regexp_replace("path", "^file:/*", "/")
        top = re.sub("^file:/*", "/", root.path)
        kept = files.filter(F.col("length") <= max_bytes).withColumn("filepath", name)
        kept = kept.filter(allowed(F.col("filepath"), settings.allowed_extensions or ALLOWED_EXTENSIONS))
        below = F.substring(F.regexp_replace("filepath", "^[a-z0-9]+://[^/]*", ""), len(re.sub("^[a-z0-9]+://[^/]*", "", top)) + 1, 1 << 20)
        if links := _links(spark, root.path):
            kept = kept.filter(~under(F.col("filepath"), links))
        if root.exclude_dirs:
            kept = kept.filter(~F.arrays_overlap(F.split(below, "/"), F.array(*(F.lit(d) for d in sorted(root.exclude_dirs)))))
        if settings.ignore_patterns:
            kept = kept.filter(~ignored(below, settings.ignore_patterns))
        parts.append(kept.select("filepath", "length", F.sha2("content", 256).alias("sha256"), "content"))
    if not parts:
        return spark.createDataFrame([], "filepath string, length bigint, sha256 string, content binary")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["filepath"])


def decoded(files: DataFrame) -> DataFrame:
    """``files`` with text: the content as UTF-8 without its invalid bytes (built-ins replace or fail on them)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "text string"])
    at, names = files.columns.index("content"), [*files.columns, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.as_py().decode("utf-8", "ignore") if x.is_valid else None for x in b.column(at)], pa.string())], names=names)

    return files.mapInArrow(run, schema)
