"""Live views: the result of a query over one file, kept until the file changes.

A file is unchanged if its size and first 64 bytes are. A plain ``SELECT *`` over a
CSV file that only grew takes in the new lines alone, from the byte where the last
whole line ended.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.streaming.tail import last_line_end, lines


@dataclass
class LiveView:
    file: str
    build: Callable[[], DataFrame]
    store: Callable[[DataFrame], DataFrame]  # writes and reads back: what is held can't be stale, lost or taken for the file
    grows: bool  # SELECT * of a CSV or TSV file
    delimiter: str = ","
    size: int = -1
    head: bytes = b""
    done: int = 0  # bytes of whole lines taken in
    frame: DataFrame | None = None
    refreshes: tuple[int, int] = (0, 0)  # full, appended

    def _state(self) -> tuple[int, bytes]:
        with open(self.file, "rb") as f:
            return os.path.getsize(self.file), f.read(64)

    def current(self, spark: SparkSession) -> DataFrame:
        size, head = self._state()
        if self.frame is not None and (size, head) == (self.size, self.head):
            return self.frame
        grown = self.frame is not None and self.grows and size > self.size and head[: len(self.head)] == self.head and self.done > 0
        if grown:
            end = last_line_end(self.file, self.done)
            if end > self.done:
                text = lines(spark, self.file, self.done, end)
                ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.frame.schema)
                new = text.select(F.from_csv("value", ddl, {"sep": self.delimiter, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}).alias("r")).select("r.*")
                self.frame = self.frame.unionAll(self.store(new))
            self.done, self.refreshes = end, (self.refreshes[0], self.refreshes[1] + 1)
        else:
            self.frame = self.store(self.build())
            self.done, self.refreshes = 0, (self.refreshes[0] + 1, self.refreshes[1])
            self.done = last_line_end(self.file)
        self.size, self.head = size, head
        return self.frame
