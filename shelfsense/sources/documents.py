"""A sink of one JSON file per document: tasks write beside the target, the commit moves their files in, an abort removes them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _open(path: str):
    """File system and path of a URI or an absolute path; the folder has to be one that all executors and the driver reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class DocumentWriter(DataSourceWriter):
    """Rows (file_name, document). Every attempt of a task has a folder of its own, so a failed or repeated one leaves nothing in the target."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.path}/_staging-{self.job}"

    def write(self, rows: Iterator) -> Written:
        files, base = _open(self.path)
        own = f"{base}/_staging-{self.job}/{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        done = Written()
        for row in rows:
            if not row.file_name or "/" in row.file_name or row.file_name.startswith("_"):
                raise ValueError(f"no file name: {row.file_name!r}")
            with files.open_output_stream(f"{own}/{row.file_name}") as out:
                out.write((row.document or "").encode())
            done.names.append(f"{own}/{row.file_name}")
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Only the files that committed tasks named move in; two documents of one name fail before anything moves."""
        from pyarrow import fs

        files, base = _open(self.path)
        moved = [name for m in messages if m is not None for name in m.names]
        short = [name.rsplit("/", 1)[1] for name in moved]
        if len(set(short)) != len(short):
            self.abort(messages)
            raise ValueError("documents with the same file name")
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.type == fs.FileType.File and (old.base_name.endswith(".json") or old.base_name == "_SUCCESS"):
                    files.delete_file(old.path)
        for name, to in zip(moved, short):
            files.move(name, f"{base}/{to}")
        files.open_output_stream(f"{base}/_SUCCESS").close()
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, base = _open(self.path)
        if files.get_file_info(f"{base}/_staging-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/_staging-{self.job}")


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        missing = {"file_name", "document"} - set(schema.names)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        return DocumentWriter(self.options["path"], overwrite)


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file per row in ``path``: ``file_name`` with the text of ``document``. Its readers see all of them or, where the job fails, none."""
    documents.sparkSession.dataSource.register(DocumentSink)
    documents.select("file_name", "document").write.format("document_files").mode(mode).option("path", path).save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, document) of every file."""
    from pyspark.sql import functions as F

    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("document"))
