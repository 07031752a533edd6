"""Folders of part files that tasks write and one manifest lists: what counts is what the manifest names.

Each task writes files of its own, under names that no other attempt has, and tells their names with its commit message. The driver then replaces the manifest in one move. Files of failed or
repeated attempts are in no manifest; no reader opens them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from reachway.sources.paths import delete, read_bytes, replace_bytes, write_bytes

_MANIFEST = "_parts.json"


@dataclass
class Written(WriterCommitMessage):
    """The names of the parts of one task."""

    names: list[str]


def listed(folder: str) -> list[str] | None:
    """The parts that count, by name without ending; None where folder isn't one of parts."""
    data = read_bytes(f"{folder}/{_MANIFEST}")
    return None if data is None else json.loads(data)["parts"]


class PartWriter(DataSourceWriter):
    """Writes rows in parts of some `size` rows each. encode makes the files (content by ending) of a part's rows."""

    def __init__(self, folder: str, overwrite: bool, kind: str, endings: Sequence[str], encode: Callable[[list], dict[str, bytes]], size: int):
        self.folder, self.overwrite, self.kind, self.endings, self.encode, self.size = folder, overwrite, kind, endings, encode, size

    def _part(self, rows: list) -> str:
        name = f"{self.kind}-{uuid.uuid4().hex}"
        for ending, data in self.encode(rows).items():
            write_bytes(f"{self.folder}/{name}.{ending}", data)
        return name

    def write(self, iterator: Iterator) -> Written:
        names, rows = [], []
        for row in iterator:
            rows.append(row)
            if len(rows) >= self.size:
                names.append(self._part(rows))
                rows = []
        if rows:
            names.append(self._part(rows))
        return Written(names)

    def commit(self, messages: list) -> None:
        old = listed(self.folder) or []
        new = sorted(n for m in messages if m is not None for n in m.names)
        replace_bytes(f"{self.folder}/{_MANIFEST}", json.dumps({"parts": new if self.overwrite else [*old, *new]}).encode())
        if self.overwrite:
            self._drop(old)

    def abort(self, messages: list) -> None:
        self._drop([n for m in messages if m is not None for n in m.names])

    def _drop(self, names: list[str]) -> None:
        for n in names:
            for e in self.endings:
                delete(f"{self.folder}/{n}.{e}")
