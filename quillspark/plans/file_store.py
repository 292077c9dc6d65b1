"""Where the bytes of indexed files are kept, so that queued and content-only documents can be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog


class FileStore:
    """A place for raw files by document id; override all."""

    def save(self, rows: DataFrame) -> None:
        """Keeps ``(doc_id, path, content)`` rows; those of a known id are replaced."""
        raise NotImplementedError

    def load(self, ids: DataFrame) -> DataFrame:
        """``(doc_id, path, content)`` of the ids that are kept."""
        raise NotImplementedError

    def exists(self, doc_id: str) -> bool:
        raise NotImplementedError

    def get(self, doc_id: str) -> bytes | None:
        """The bytes of one document; None where there are none."""
        raise NotImplementedError

    def size(self, doc_id: str | None = None) -> int:
        """Bytes kept of a document, or of all; 0 where there are none."""
        raise NotImplementedError


class TableFileStore(FileStore):
    """Keeps files as rows of the catalog's table ``raw_files``; deleting a document deletes its row."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def save(self, rows: DataFrame) -> None:
        self.catalog.upsert("raw_files", rows.select("doc_id", "path", "content"), ["doc_id"])

    def load(self, ids: DataFrame) -> DataFrame:
        return self.catalog.read("raw_files").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def _one(self, doc_id: str) -> DataFrame:
        return self.catalog.read("raw_files").where(F.col("doc_id") == doc_id)

    def exists(self, doc_id: str) -> bool:
        return not self._one(doc_id).isEmpty()

    def get(self, doc_id: str) -> bytes | None:
        row = self._one(doc_id).select("content").first()
        return None if row is None else bytes(row["content"])

    def size(self, doc_id: str | None = None) -> int:
        rows = self.catalog.read("raw_files") if doc_id is None else self._one(doc_id)
        return rows.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
