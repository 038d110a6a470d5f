"""A commit log in a folder: numbered states, the newest of which counts, and every batch id that was ever committed.

A state is written under another name and then given its number, which fails if another
writer was first; so a state is there whole or not at all. The newest states hold the ids of
the last RECENT batches; older ids have a marker each. No id is ever forgotten, and a commit
costs the same after a million batches as after ten.
"""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from pyspark.sql import SparkSession

RECENT = 256
#: States that are kept, for readers that have just opened one.
KEPT = 64


class CommitLog:
    def __init__(self, spark: SparkSession, root: str, recent: int = RECENT) -> None:
        self.root, self.recent = root, recent
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.files = self.path(root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(root).toUri(), conf) if ":" in root.split("/")[0] else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def read_text(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Writes a whole file, or fails if the name is taken."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        stream = self.files.create(self.path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        self.files.mkdirs(self.path(name).getParent())
        self._context.rename(self.path(aside), self.path(name), none)

    def _numbers(self) -> list[int]:
        folder = self.path(f"{self.root}/states")
        found = self.files.listStatus(folder) if self.files.exists(folder) else []
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def newest(self) -> dict:
        """number, batches and what publish() was told; number 0 before the first."""
        while numbers := self._numbers():
            try:
                return json.loads(self.read_text(f"{self.root}/states/{numbers[-1]:012d}"))
            except Exception as e:  # a state this old was removed meanwhile, as newer ones came
                if "FileNotFound" not in str(e):
                    raise
        return {"number": 0, "batches": []}

    def _marker(self, batch: str) -> str:
        name = sha256(batch.encode()).hexdigest()
        return f"{self.root}/batches/{name[:2]}/{name}"

    def seen(self, batch: str, now: dict | None = None) -> bool:
        now = self.newest() if now is None else now
        return batch in now["batches"] or self.files.exists(self.path(self._marker(batch)))

    def publish(self, now: dict, batch: str, **told) -> dict:
        """Makes told, and all of now that it doesn't replace, the newest state, with batch committed."""
        batches = [*now["batches"], batch]
        for old in batches[: -self.recent]:
            stream = self.files.create(self.path(self._marker(old)), True)
            stream.write(bytearray(old.encode()))
            stream.close()
        said = now | told | {"number": now["number"] + 1, "batches": batches[-self.recent :]}
        self.write_new(f"{self.root}/states/{said['number']:012d}", json.dumps(said))
        for n in self._numbers()[:-KEPT]:
            self.remove(f"{self.root}/states/{n:012d}")
        return said

    def remove(self, name: str) -> None:
        self.files.delete(self.path(name), True)
