"""Folders that all executors share, and small files in them."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/glyphlake/{label}-{uuid.uuid4().hex}"


def store(path: str) -> tuple[Any, str]:
    """The file system and the path in it; Hadoop also writes local paths with one slash."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def write_json(path: str, value: Any) -> None:
    """A new small file; one that exists is never overwritten."""
    from pyarrow import fs

    system, at = store(path)
    system.create_dir(os.path.dirname(at))
    text = json.dumps(value).encode()
    if isinstance(system, fs.LocalFileSystem):
        with open(at, "xb") as f:
            f.write(text)
        return
    if system.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    with system.open_output_stream(at, compression=None) as f:
        f.write(text)


def read_json(path: str) -> Any:
    system, at = store(path)
    with system.open_input_stream(at, compression=None) as f:
        return json.loads(f.read())


def names(path: str) -> list[str]:
    from pyarrow import fs

    system, at = store(path)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def remove(path: str) -> None:
    system, at = store(path)
    system.delete_dir(at)


def size_of(path: str) -> int:
    """Bytes of the data files below a folder."""
    from pyarrow import fs

    system, at = store(path)
    infos = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sum(i.size for i in infos if i.is_file and i.base_name.endswith(".parquet"))
