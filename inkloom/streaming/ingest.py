"""Continuous registration of page images: new files become rows of the pages frame, each content once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkloom.sources.files import SUFFIXES, register
from inkloom.sources.store import Store


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, letter: str | None = None):
    """A query that registers the folder's new images and then ends; run it again for what came since.

    The checkpoint folder must be shared by all executors. A batch that is repeated after a loss changes nothing, as
    pages are updated by their content's id.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def put(batch, _):
        pages = register(batch.where(batch["path"].rlike(r"(?i)\.(" + "|".join(SUFFIXES) + ")$")).select("path", "content"), letter)
        store.upsert("pages", pages.dropDuplicates(["page_id"]))

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
