"""A collection's path dictionary, published version by version in a folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import fail
from ..functions.dictionary import Snapshot, schema_paths
from . import folders


@dataclass
class PathRegistry:
    """Snapshots as files that only one writer can create. A session registers against the version it has read; another
    session's publication in between is a conflict, after which it recovers and registers again."""

    spark: SparkSession
    folder: str
    current: Snapshot = field(default_factory=lambda: Snapshot(0, ("_id",)))

    def _file(self, version: int) -> str:
        return f"{self.folder}/paths/{version:08d}"

    def prepare(self, paths: list[str]) -> Snapshot:
        """The successor that has the paths; the current snapshot if it has them all."""
        return self.current.register(paths)

    def publish(self, successor: Snapshot) -> Snapshot:
        """Make a prepared successor the current snapshot."""
        if successor == self.current:
            return successor
        if not successor.follows(self.current):
            fail("CON_WRITE_CONFLICT", "prepared from another version")
        if not folders.create_text(self.spark, self._file(successor.version), successor.encode().decode()):
            fail("CON_WRITE_CONFLICT", f"version {successor.version} of the path dictionary exists")
        self.current = successor
        return successor

    def register(self, paths: list[str]) -> dict[str, int]:
        """The ids of paths, published where they are new."""
        now = self.publish(self.prepare(paths))
        return {p: now.id(p) for p in paths}

    def register_schema(self, schema: T.StructType) -> dict[str, int]:
        return self.register(schema_paths(schema))

    def pin(self, version: int) -> Snapshot:
        """A published snapshot; what is published later never changes it."""
        if version == 0:
            return Snapshot(0, ("_id",))
        text = folders.read_text(self.spark, self._file(version))
        return Snapshot.decode(text.encode()) if text else fail("VAL_RESOURCE_NOT_FOUND", f"path dictionary {version}")

    def recover(self) -> Snapshot:
        """Read all versions from the first, each of which has to follow the one before, and go on from the last."""
        at = self.pin(0)
        for version in sorted(map(int, folders.names(self.spark, f"{self.folder}/paths"))):
            nxt = self.pin(version)
            if not nxt.follows(at):
                fail("DUR_CORRUPTION", f"path dictionary {version} doesn't follow {at.version}")
            at = nxt
        self.current = at
        return at
