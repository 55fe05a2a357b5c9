"""The vault source (A1-A10): markdown notes of a folder as a Python data source, one row per file.

Only names that start with a dot are hidden; folders such as ``_archive`` belong to the vault. Files are listed on the
driver, read and parsed on the executors in blocks of :data:`BLOCK` files, and the frontmatter is parsed only where it is asked
for. A folder given as a URI (``hdfs://``, ``s3://``, ``file://`` and what else Arrow's file systems know) is read there.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 256
SCHEMA = "rel_path string, name string, metadata map<string,string>, fm_strings array<string>, content string, raw_text string, fault_kind string, fault_error string"


class VaultPathError(ValueError):
    """A path that leaves the vault, or a root that is no folder."""


def vault_root(path: str | os.PathLike) -> Path:
    """A1."""
    root = Path(path).expanduser().resolve()
    if not root.is_dir():
        raise VaultPathError(f"not a folder: {path}")
    return root


def inside(root: Path, rel: str) -> Path:
    """A2: the file a relative path names; leading slashes are ignored, backslashes are slashes, escapes are refused."""
    target = (root / str(rel).replace("\\", "/").lstrip("/")).resolve()
    if target != root and root not in target.parents:
        raise VaultPathError(f"outside the vault: {rel}")
    return target


def note_paths(root: Path) -> list[str]:
    """A4: relative POSIX paths of all notes, in order; parts that start with a dot are hidden."""
    found = (p.relative_to(root) for p in root.rglob("*.md") if p.is_file())
    return sorted(p.as_posix() for p in found if not any(part.startswith(".") for part in p.parts))


def far_paths(uri: str) -> list[str]:
    """:func:`note_paths` of a folder given as a URI; a folder that does not exist is refused."""
    fs, root = FileSystem.from_uri(uri)
    root = root.rstrip("/")
    if fs.get_file_info(root).type != FileType.Directory:
        raise VaultPathError(f"not a folder: {uri}")
    found = (f.path[len(root) + 1 :] for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and f.path.endswith(".md"))
    return sorted(p for p in found if not any(part.startswith(".") for part in p.split("/")))


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """(frontmatter text or None, body) of a note."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return None, text
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :]).strip("\n")
    return None, text


def _strings(value) -> Iterator[str]:
    """Every string in nested lists and mappings."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _strings(v)


def _plain(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def parse_note(text: str) -> tuple[dict[str, str | None], list[str], str]:
    """(flat metadata, frontmatter strings, body); raises ValueError where the frontmatter is no mapping or does not parse."""
    import yaml

    head, body = split_frontmatter(text)
    if head is None:
        return {}, [], body
    try:
        data = yaml.safe_load(head)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e
    if data is None:
        return {}, [], body
    if not isinstance(data, dict):
        raise ValueError("frontmatter is not a mapping")
    return {str(k): _plain(v) for k, v in data.items()}, list(_strings(data)), body


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"] if "://" in options["path"] else None
        self.root = None if self.uri else vault_root(options["path"])
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.parse = options.get("parse", "true").lower() != "false"

    def partitions(self) -> list[_Files]:
        paths = far_paths(self.uri) if self.uri else note_paths(self.root)
        return [_Files(paths[i : i + BLOCK]) for i in range(0, len(paths), BLOCK)] or [_Files([])]

    def _opened(self) -> Callable[[str], bytes]:
        if not self.uri:
            return lambda rel: (self.root / rel).read_bytes()
        fs, root = FileSystem.from_uri(self.uri)

        def content(rel: str) -> bytes:
            with fs.open_input_file(f"{root.rstrip('/')}/{rel}") as f:
                return f.read()

        return content

    def read(self, partition: _Files) -> Iterator[tuple]:
        content = self._opened()
        for rel in partition.paths:
            name = PurePosixPath(rel).stem
            try:
                raw = content(rel).decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
            except (OSError, UnicodeDecodeError) as e:
                if self.strict:
                    raise ValueError(f"{rel}: {e}") from e
                yield rel, name, None, None, None, f"<unreadable:{type(e).__name__}>", "read", " · ".join(str(e).splitlines())
                continue
            if not self.parse:
                yield rel, name, None, None, None, raw, None, None
                continue
            try:
                meta, strings, body = parse_note(raw)
                yield rel, name, meta, strings, body, raw, None, None
            except ValueError as e:
                if self.strict:
                    raise ValueError(f"{rel}: {e}") from e
                yield rel, name, None, None, None, raw, "parse", " · ".join(str(e).splitlines())


class VaultSource(DataSource):
    """``spark.read.format("notevault").option("mode", "PERMISSIVE" | "FAILFAST").option("parse", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "notevault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_vault(spark: SparkSession, path: str, mode: str = "PERMISSIVE", parse: bool = True) -> DataFrame:
    """Every note of a vault, faults as columns; FAILFAST raises at the first fault."""
    spark.dataSource.register(VaultSource)
    return spark.read.format("notevault").option("mode", mode).option("parse", str(parse).lower()).load(path if "://" in str(path) else str(vault_root(path)))


def split_faults(scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, faults) of a permissive scan."""
    faults = scan.where("fault_kind is not null").select("rel_path", F.col("fault_kind").alias("kind"), F.col("fault_error").alias("error"))
    return scan.where("fault_kind is null").drop("fault_kind", "fault_error"), faults


def typed_notes(notes: DataFrame) -> DataFrame:
    """The columns the operators use, from a scan's notes: frontmatter keys as columns, ``touches`` as an array."""
    m = F.col("metadata")
    touched = F.coalesce(F.from_json(m["touches"], "array<string>"), F.when(m["touches"].isNotNull(), F.array(m["touches"])))
    keys = [m[k].alias(k) for k in ("valid_from", "valid_until", "superseded_by", "supersedes", "date")]
    return notes.select(F.xxhash64("rel_path").alias("note_id"), "rel_path", "name", "metadata", "content", "raw_text", touched.alias("touches"), *keys, F.lit(False).alias("deleted"))
