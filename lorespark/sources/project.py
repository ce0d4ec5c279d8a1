"""A project folder as a frame of files, and its configuration."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__

FILES = "relpath string, role string, content binary"


class ConfigError(ValueError):
    """A manifest that cannot be used."""


KNOWN_VERSION = 1  # of manifests


@dataclass
class Config:
    """What the data engine reads of a manifest."""

    uri_base: str = "https://example.org/book/"
    language: str = "en"
    vocabularies: tuple[str, ...] = ()
    research: bool = True
    min_reliability: str = "media"
    enabled: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    custom: tuple[str, ...] = ()
    focus: str | None = None
    paths: dict[str, str] = field(default_factory=lambda: {"bible": "bible", "outline": "outline", "manuscript": "manuscript", "graph": "bible/graph.ttl"})
    warnings: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not re.fullmatch(r"https?://[^?#\s]+/", self.uri_base):
            raise ConfigError("uri_base must be an http(s) address with a final slash and no query or fragment")
        if self.min_reliability not in ("baja", "media", "alta"):
            raise ConfigError(f"unknown reliability {self.min_reliability!r}")


def _release(text: str) -> tuple[int, ...]:
    m = re.match(r"v?(\d+(?:\.\d+)*)", text.strip())
    if not m:
        raise ConfigError(f"{text!r} is no version")
    parts = [int(x) for x in m[1].split(".")]
    while len(parts) > 1 and parts[-1] == 0:
        parts.pop()
    return tuple(parts)


def load_manifest(path: str | Path) -> Config:
    """The configuration in a TOML manifest: the table with ``uri_base``, and book, vocabularies, research, validators, focus, paths.

    Values of a wrong type are errors, unknown tables are not. Beside uri_base may stand
    manifest_version, of which a later one than is known is a warning, and cli_version_min, the
    least release of this engine.
    """
    try:
        data = tomllib.loads(Path(path).read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"cannot read the manifest: {e}") from e
    main = next((n for n, t in data.items() if isinstance(t, dict) and "uri_base" in t), None)
    if main is None:
        raise ConfigError("the manifest names no uri_base")

    def value(table: str, key: str, kind: type, default: object = None) -> object:
        found = data.get(table, {})
        if not isinstance(found, dict):
            raise ConfigError(f"{table} must be a table")
        out = found.get(key, default)
        if key in found and (not isinstance(out, kind) or (kind is int and isinstance(out, bool))):
            raise ConfigError(f"{table}.{key} must be of type {kind.__name__}")
        return out

    def strings(table: str, key: str) -> tuple[str, ...]:
        out = value(table, key, list, [])
        if not all(isinstance(x, str) for x in out):
            raise ConfigError(f"{table}.{key} must be a list of strings")
        return tuple(out)

    warnings = []
    version = str(data[main].get("manifest_version", KNOWN_VERSION))
    if not re.fullmatch(r"[1-9]\d*", version):
        raise ConfigError(f"manifest_version {version!r} is no whole number")
    if int(version) > KNOWN_VERSION:
        warnings.append(f"manifest_version {version} is later than {KNOWN_VERSION}, the last one known")
    least = value(main, "cli_version_min", str)
    if least is not None and _release(least) > _release(__version__):
        raise ConfigError(f"this is release {__version__}; the manifest needs {least} at least")
    out = Config(
        value(main, "uri_base", str),
        value("book", "language", str, "en"),
        strings("vocabularies", "active"),
        value("research", "enabled", bool, True),
        value("research", "min_reliability_for_anchor", str, "media"),
        strings("validators", "enabled"),
        strings("validators", "disabled"),
        strings("validators", "custom"),
        value("focus", "target", str) or None,
        warnings=tuple(warnings),
    )
    out.paths |= {k: value("paths", k, str) for k in out.paths if k in data.get("paths", {})}
    return out


def missing_folder(root: str | Path, config: Config) -> str | None:
    """The first folder that a build needs and that is not there: the bible, then the manuscript."""
    return next((name for name in ("bible", "manuscript") if not (Path(root) / config.paths[name]).is_dir()), None)


def find_root(start: str | Path, manifest: str = "manifest.toml") -> Path | None:
    """The nearest folder, upwards, that holds a manifest."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / manifest).is_file()), None)


def read_files(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """(relpath, role, content) of a project's Markdown files. Bytes are read as they are: a text reader would replace bad ones."""
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    found = reader.load(root)
    index = f"{config.paths['bible'].rstrip('/')}/research/_index.md"
    # a listing takes a name with this first letter for hidden; it is one small file, so the driver reads it
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{index}")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = F.regexp_replace("path", r"^\w+:(?://[^/]*)?", "")
    relpath = F.substr(path, F.instr(path, F.lit(f"{os.path.basename(root)}/")) + F.lit(len(os.path.basename(root)) + 1))
    files = found.select(relpath.alias("relpath"), "content")
    if store.exists(place):
        stream = store.open(place)
        content = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        stream.close()
        files = files.union(spark.createDataFrame([(index, bytearray(content))], files.schema))
    return with_roles(files, config)


def with_roles(files: DataFrame, config: Config) -> DataFrame:
    """Files with their role by place: folders are scanned one level deep, the manuscript at any depth."""
    bible, outline, prose = (re.escape(config.paths[k].rstrip("/")) for k in ("bible", "outline", "manuscript"))
    rules = [(rf"^{bible}/{plural}/[^/]+\.md$", role) for plural, role in (("characters", "character"), ("settings", "setting"), ("locations", "location"), ("objects", "object"))]
    rules += [(rf"^{bible}/{name}\.md$", role) for name, role in (("timeline", "timeline"), ("relationships", "relationships"), ("constitution", "constitution"))]
    rules += [(rf"^{bible}/research/sources\.md$", "sources"), (rf"^{bible}/research/_index\.md$", "index"), (rf"^{bible}/research/[^/]+\.md$", "topic")]
    rules += [(rf"^{outline}/units/[^/]+\.md$", "unit"), (rf"^{prose}/.+\.md$", "manuscript")]
    role = F.lit("other")
    for pattern, name in reversed(rules):
        role = F.when(F.col("relpath").rlike(pattern), name).otherwise(role)
    return files.select("relpath", role.alias("role"), "content")


def files_from(spark: SparkSession, files: dict[str, str | bytes], config: Config) -> DataFrame:
    """The same from a mapping of paths to contents."""
    rows = [(p, bytearray(t if isinstance(t, bytes) else t.encode())) for p, t in files.items()]
    return with_roles(spark.createDataFrame(rows, "relpath string, content binary"), config)
