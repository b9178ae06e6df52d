"""A sink for results: JSON lines or one Markdown report, which appear as a whole or not at all."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Lines of a Markdown report that one task may give: a report is a summary.
MOST_LINES = 100_000
TRIES = 10


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves: the file of its rows, or its numbered lines of a report."""

    file: str | None = None
    lines: list[tuple[int, int, str]] | None = None


def _files(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else path)


class ReportWriter(DataSourceWriter):
    """Tasks write aside; the commit moves their files into place, a failure removes all of them."""

    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "json")
        if self.kind not in ("json", "markdown"):
            raise ValueError(f"unknown kind of report: {self.kind}")
        if self.kind == "markdown" and names != ["section", "place", "line"]:
            raise ValueError("a Markdown report needs the columns section, place and line")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        self.aside = f"{self.path}/_aside-{self.job}"
        # Made here and never by a task: one that still runs when the job is given up can't bring it back.
        files, aside = _files(self.aside)
        files.create_dir(aside, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        if self.kind == "markdown":
            lines = []
            for row in iterator:
                if len(lines) == MOST_LINES:
                    raise ValueError(f"a report has at most {MOST_LINES} lines per task")
                lines.append((row.section, row.place, row.line))
            return Written(lines=lines)
        files, aside = _files(self.aside)
        name = f"part-{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{aside}/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
        return Written(file=name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, path = _files(self.path)
        files.create_dir(path, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.is_file] if self.overwrite else []
        if self.kind == "markdown":
            lines = sorted(line for m in messages if m for line in m.lines or [])
            with files.open_output_stream(f"{path}/_report-{self.job}") as out:
                out.write("".join(line + "\n" for _, _, line in lines).encode())
            files.move(f"{path}/_report-{self.job}", f"{path}/report.md")
        else:
            for m in messages:
                if m and m.file:
                    files.move(f"{path}/_aside-{self.job}/{m.file}", f"{path}/{m.file}")
        self._clear()
        for name in old:
            if not name.endswith("/report.md") or self.kind == "json":
                files.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what lies aside, again where a task has put a file there meanwhile."""
        from pyarrow import fs

        files, aside = _files(self.aside)
        for attempt in range(TRIES):
            if files.get_file_info(aside).type == fs.FileType.NotFound:
                return
            try:
                files.delete_dir(aside)
            except OSError:
                time.sleep(0.1 * attempt)
        files.delete_dir(aside)


class ReportSink(DataSource):
    """``df.write.format("report")`` with the options ``path`` and ``kind`` (``json`` or ``markdown``)."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options, schema.names, overwrite)
