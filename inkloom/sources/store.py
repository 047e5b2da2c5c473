"""The frame store: typed Parquet tables with keyed updates.

A frame is a folder of versions and of numbered manifests; the manifest with the highest number counts. It names, for
each bucket of the frame's key, the version that holds the bucket's rows, so that an update rewrites only the buckets
that its keys fall into. Versions are written whole before a manifest names them, and a manifest appears by one rename
that fails if its number is taken: a crash leaves what was there before, and two writers can't both win. Versions that
the last KEPT manifests name stay, so that a running reader keeps its files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.sources.schemas import FRAMES, KEYS

#: Buckets of a frame, and manifests whose versions are kept.
BUCKETS, KEPT = 16, 3


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `existing` whose keys don't come in `new`, and all of `new`. Null keys are never equal, so that such rows
    stay; `new` isn't de-duplicated against itself. Columns come in `existing`'s order."""
    kept = existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns)
    return kept.unionByName(new.select(*existing.columns))


def replace_bags(existing: DataFrame, new: DataFrame, key: str = "letter_id", strict: DataFrame | None = None) -> DataFrame:
    """Bags of the letters in `new` replaced; rows with a null key are dropped, as a null is never "not in" a list.

    Letters that gave no new row keep their old ones, unless `strict` names the letters that were done.
    """
    done = (strict if strict is not None else new).select(key).where(F.col(key).isNotNull())
    return existing.where(F.col(key).isNotNull()).join(done, key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def unprotected(new: DataFrame, letters: DataFrame) -> DataFrame:
    """The rows of `new` whose page isn't reviewed or gold."""
    safe = letters.where(F.col("text_source").isin("reviewed", "gold") & F.col("page_id").isNotNull()).select("page_id")
    return new.join(safe, "page_id", "left_anti")


class Store:
    """Frames under one root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        i = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(i, "UTF-8")
        finally:
            i.close()

    def _put(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        o = fs.create(p, True)
        o.write(bytearray(text.encode()))
        o.close()

    def _manifests(self, name: str) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._names(f"{self.root}/{name}") if n.startswith("manifest-") and n.endswith(".json"))

    def _state(self, name: str) -> tuple[int, dict[int, str]]:
        """(number, {bucket: version}) of the manifest that counts; (0, {}) for a frame that was never written. A frame
        with versions but no manifest is broken, or being written for the first time: no empty frame is made of it."""
        numbers = self._manifests(name)
        if not numbers:
            if any(n.startswith("v-") for n in self._names(f"{self.root}/{name}")):
                raise RuntimeError(f"{self.root}/{name} has versions but no manifest: a first write did not end; remove the folder if nothing is writing")
            return 0, {}
        return numbers[-1], {int(k): v for k, v in json.loads(self._text(f"{self.root}/{name}/manifest-{numbers[-1]:012d}.json")).items()}

    def _load(self, name: str, state: dict[int, str], buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{name}/{v}/_bucket={k}" for k, v in sorted(state.items()) if buckets is None or k in buckets]
        schema = FRAMES[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS.get(name, ["letter_id"])), F.lit(BUCKETS)).cast("int")

    def read(self, name: str) -> DataFrame:
        """The frame, or an empty one of the right schema; an unknown name is a KeyError."""
        if name not in FRAMES:
            raise KeyError(name)
        return self._load(name, self._state(name)[1])

    def write(self, name: str, df: DataFrame, buckets: set[int] | None = None, base: tuple[int, dict[int, str]] | None = None) -> None:
        """df as the frame, or as the given buckets of it; base: the state that df was made from."""
        number, state = base or self._state(name)
        version = f"v-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], FRAMES[name]).columns
        out = df.select(*columns).withColumn("_bucket", self._bucket(name))
        out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{version}")
        there = {int(n.split("=")[1]) for n in self._names(f"{self.root}/{name}/{version}") if n.startswith("_bucket=")}
        kept = {k: v for k, v in state.items() if buckets is not None and k not in buckets}
        self._publish(name, number + 1, kept | {k: version for k in there})
        self._clean(name)

    def _publish(self, name: str, number: int, state: dict[int, str]) -> None:
        fs, to = self._fs(f"{self.root}/{name}/manifest-{number:012d}.json")
        at = f"{self.root}/{name}/_{uuid.uuid4().hex}"
        self._put(at, json.dumps(state))
        if fs.exists(to) or not fs.rename(self._fs(at)[1], to):
            fs.delete(self._fs(at)[1], False)
            raise RuntimeError(f"{name} was written by another at the same time; nothing was changed")

    def _clean(self, name: str) -> None:
        numbers = self._manifests(name)
        used = {v for n in numbers[-KEPT:] for v in json.loads(self._text(f"{self.root}/{name}/manifest-{n:012d}.json")).values()}
        old = {v for n in numbers[:-KEPT] for v in json.loads(self._text(f"{self.root}/{name}/manifest-{n:012d}.json")).values()}
        for path in [*(old - used), *(f"manifest-{n:012d}.json" for n in numbers[:-KEPT])]:
            fs, p = self._fs(f"{self.root}/{name}/{path}")
            fs.delete(p, True)

    def _update(self, name: str, new: DataFrame, touched: DataFrame, merge) -> None:
        base = self._state(name)
        buckets = {r[0] for r in touched.select(self._bucket(name)).distinct().collect()}  # at most BUCKETS rows
        if buckets:
            self.write(name, merge(self._load(name, base[1], buckets)), buckets, base)

    def upsert(self, name: str, new: DataFrame) -> None:
        self._update(name, new, new, lambda old: upsert(old, new, KEYS[name]))

    def replace(self, name: str, new: DataFrame, done: DataFrame | None = None) -> None:
        """The bags of the letters in `new` (or in `done`) replaced."""
        nobody = self.spark.createDataFrame([(None,)], "letter_id string")  # rows without a letter go with every replacement
        touched = new.select("letter_id").unionByName(nobody)
        touched = touched.unionByName(done.select("letter_id")) if done is not None else touched
        self._update(name, new, touched, lambda old: replace_bags(old, new, strict=done))

    def frame(self, name: str, page_id: str | None = None, letter_id: str | None = None) -> DataFrame:
        """A frame, filtered; an empty value or a column that the frame lacks filters nothing."""
        df = self.read(name)
        for col, value in (("page_id", page_id), ("letter_id", letter_id)):
            df = df.where(F.col(col) == value) if value and col in df.columns else df
        return df

    def review(self, page_id: str, text: str, by: str, spans: list | None = None) -> None:
        """A reviewed text; spans that aren't given are cleared."""
        row = self.spark.createDataFrame([(page_id, text, "reviewed", spans or [], by, None, None)], FRAMES["letters"])
        now = F.current_timestamp().cast("timestamp_ntz")
        self.upsert("letters", row.withColumns({"reviewed_at": now, "updated_at": now}))

    def set_meta(self, letter_id: str, date: str | None = None, place: str | None = None, recipient: str | None = None, title: str | None = None, notes: str | None = None) -> None:
        """A letter's whole metadata row; what isn't given becomes null, a date that is none as well."""
        row = self.spark.createDataFrame([(letter_id, date, place, recipient, title, notes)], "letter_id string, date string, place string, recipient string, title string, notes string")
        self.upsert("letter_meta", row.withColumn("date", F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date")))

    def assign(self, page_id: str, letter_id: str | None, page_no: int | None) -> None:
        """A page's letter and number, also to null; an unknown page is a KeyError."""
        row = self.read("pages").where(F.col("page_id") == page_id)
        if row.isEmpty():
            raise KeyError(page_id)
        self.upsert("pages", assigned(row, page_id, letter_id, page_no))

    def export(self, out: str) -> dict:
        """All frames but the transcriptions as Parquet, with a manifest of their row counts and files."""
        manifest = {"frames": {}}
        for name in FRAMES:
            if name == "transcriptions":
                continue
            df = self.read(name)
            df = df.withColumn("image", image_path(F.col("page_id"))) if name == "pages" else df
            df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
            manifest["frames"][name] = {"rows": self.spark.read.parquet(f"{out}/{name}.parquet").count(), "file": f"{name}.parquet"}
        manifest["generated_at"] = self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
        self._put(f"{out}/manifest.json", json.dumps(manifest, indent=2))
        return manifest


def assigned(pages: DataFrame, page_id: str, letter_id: str | None, page_no: int | None) -> DataFrame:
    hit = F.col("page_id") == page_id
    return pages.withColumns({"letter_id": F.when(hit, F.lit(letter_id)).otherwise(F.col("letter_id")), "page_no": F.when(hit, F.lit(page_no).cast("int")).otherwise(F.col("page_no"))})


def image_path(page_id):
    return F.concat(F.lit("images/"), page_id, F.lit(".jpg"))


def by_letter(pages: DataFrame) -> DataFrame:
    """Pages in the archive's order: letter, number, time taken; nulls first."""
    return pages.orderBy(F.asc_nulls_first("letter_id"), F.asc_nulls_first("page_no"), F.asc_nulls_first("captured_at"), "page_id")
