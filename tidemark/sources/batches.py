"""A batch sink whose rows arrive once: tasks stage batches, the driver publishes those of committed tasks.

Spark runs a task again where it failed or its executor was lost, and may run one twice.  So a task only stages (the store holds the rows
back under a token); the tokens of the attempts that count come back as commit messages, and one commit publishes them.
An aborted write discards what is known of it; what a lost attempt staged stays unpublished for the store to sweep.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.sinks import in_lists


class Store(Protocol):
    """A store that can hold rows back.  ``publish`` and ``discard`` may be called again with the same tokens."""

    def stage(self, rows: list[Row]) -> str: ...

    def publish(self, tokens: list[str]) -> None: ...

    def discard(self, tokens: list[str]) -> None: ...


@dataclass(frozen=True)
class Folder:
    """JSON lines in a folder that all executors share: staged files lie in ``_staged`` and are moved when published."""

    uri: str

    def _at(self) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        return fs, path.rstrip("/")

    def stage(self, rows: list[Row]) -> str:
        fs, path = self._at()
        token = f"batch-{uuid.uuid4().hex}.jsonl"
        fs.create_dir(f"{path}/_staged", recursive=True)
        with fs.open_output_stream(f"{path}/_staged/{token}") as out:
            for r in rows:
                out.write((json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
        return token

    def publish(self, tokens: list[str]) -> None:
        fs, path = self._at()
        staged = [f"{path}/_staged/{t}" for t in tokens]
        for info, token in zip(fs.get_file_info(staged) if staged else [], tokens, strict=True):
            if info.type == pafs.FileType.File:
                fs.move(f"{path}/_staged/{token}", f"{path}/{token}")

    def discard(self, tokens: list[str]) -> None:
        fs, path = self._at()
        for t in tokens:
            if fs.get_file_info(f"{path}/_staged/{t}").type == pafs.FileType.File:
                fs.delete_file(f"{path}/_staged/{t}")


@dataclass
class Staged(WriterCommitMessage):
    tokens: list[str]
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, store: Store, size: int):
        self.store, self.size = store, size

    def write(self, iterator: Iterator[Row]) -> Staged:
        tokens, n = [], 0
        for rows in in_lists(iterator, self.size):
            tokens.append(self.store.stage(rows))
            n += len(rows)
        return Staged(tokens, n)

    def commit(self, messages: list[Staged | None]) -> None:
        self.store.publish([t for m in messages if m for t in m.tokens])

    def abort(self, messages: list[Staged | None]) -> None:
        self.store.discard([t for m in messages if m for t in m.tokens])


def source_of(store: Store, size: int) -> type[DataSource]:
    """A data source that writes to a store."""
    name_ = f"tidemark_batches_{uuid.uuid4().hex}"

    class Batches(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(store, size)

    return Batches


def send_once(df: DataFrame, store: Store, size: int = 5000) -> None:
    """Writes each row of df to the store once, in batches of at most ``size`` rows; all of them or none are published."""
    source = source_of(store, size)
    df.sparkSession.dataSource.register(source)
    df.write.format(source.name()).mode("append").save()
