"""Tables that change by commits: each version is one small file of a log, added only if its number is free.

Data are written first, under names of their own; a commit then names them. A reader takes a version and
keeps it: later commits add files and touch none that it reads, until versions are retired.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another commit has taken the version's number."""


class Log:
    """The versions of the table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def fresh(self) -> str:
        """A folder that no version has, for data of the next."""
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        log = self._at("log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def latest(self) -> int:
        """The last version's number, 0 before the first."""
        return max(self.versions(), default=0)

    def read(self, version: int) -> dict:
        """What a version names; KeyError if it is not there, or no longer."""
        if version not in self.versions():
            raise KeyError(f"no version {version} in {self.path}")
        stream = self._fs.open(self._at(f"log/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, entry: dict, after: int) -> int:
        """entry as the version after `after`; Conflict if there is one already. The file appears whole or not at all."""
        new = self._at(f"log/{after + 1:012d}.json")
        held = self._at(f"log/.{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a link fails if the name is taken, a rename does not
                local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(new), local(held))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                context.rename(held, new, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} of {self.path} is taken") from e
            raise
        finally:
            self._fs.delete(held, False)
        return after + 1

    def retire(self, keep: int, names) -> list[str]:
        """Deletes all versions but the last `keep`, and the data folders that names(entry) gives for none of those
        left; gives the folders. Folders that no version names yet may belong to a commit under way and stay."""
        every = self.versions()
        old, left = every[:-keep], every[-keep:]
        gone = {d for v in old for d in names(self.read(v))}
        gone -= {d for v in left for d in names(self.read(v))}
        for v in old:
            self._fs.delete(self._at(f"log/{v:012d}.json"), False)
        for d in gone:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(d), True)
        return sorted(gone)
