"""Documents - named contents with a media type - as rows of one table."""

from __future__ import annotations

import mimetypes
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.plans.ir import Leaf, Query
from heliograph.schema import Attribute, EntitySchema
from heliograph.sources.warehouse import Warehouse

DOCUMENT = EntitySchema(
    "_document",
    (Attribute("documentId", T.StringType(), False), Attribute("path", T.StringType()), Attribute("created", T.TimestampType()), Attribute("updated", T.TimestampType()), Attribute("mimeType", T.StringType()), Attribute("content", T.BinaryType())),
    "documentId",
    "UUID",
    buckets=64,  # a document saved or deleted rewrites one of them
)


class Documents:
    """Save, get and delete documents; a folder of files comes in by Spark's own reader, in parallel."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse
        warehouse.declare(DOCUMENT)

    def save(self, content: bytes, path: str | None = None, document_id: str | None = None, mime_type: str | None = None) -> str:
        """The document's id. An id that is known keeps its time of creation."""
        document_id = document_id or uuid.uuid4().hex
        before = self.warehouse.find("_document", document_id)
        kind = mime_type or (mimetypes.guess_type(path)[0] if path else None) or "application/octet-stream"
        row = self.warehouse.spark.createDataFrame([(document_id, path, before["created"] if before else None, kind, bytearray(content))], "documentId string, path string, created timestamp, mimeType string, content binary")
        now = F.current_timestamp()
        self.warehouse.save("_document", row.withColumns({"created": F.coalesce("created", now), "updated": now}))
        return document_id

    def import_folder(self, folder: str, pattern: str = "*") -> int:
        """Every file below the folder whose name fits; ids are the paths."""
        files = self.warehouse.spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        rows = files.select(F.col("path").alias("documentId"), "path", F.col("modificationTime").alias("created"), F.col("modificationTime").alias("updated"), F.lit(None).cast("string").alias("mimeType"), "content")
        return self.warehouse.save("_document", rows)

    def get(self, document_id: str) -> dict | None:
        return self.warehouse.map_of("_document", document_id)

    def delete(self, document_id: str) -> bool:
        return self.warehouse.delete(Query("_document", criteria=Leaf("documentId", "EQUAL", document_id))) > 0

    def table(self) -> DataFrame:
        return self.warehouse.read("_document")
