"""The archive as its users drive it: one object over a store, a folder of images and one of checked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import jsonx
from inkloom.operators import images, scoring, transcribe, views, voting
from inkloom.session import cut
from inkloom.sources import files, sinks
from inkloom.sources.store import Store, by_letter, unprotected


class Archive:
    """Every command of the archive. Pages are picked by a list of ids, else by letter, else all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, f"{root.rstrip('/')}/frames")
        self.gold_dir, self.processed_dir = f"{self.root}/gold", f"{self.root}/processed"

    def pick(self, page: list[str] | None = None, letter: str | None = None) -> DataFrame:
        """(page_id) of the pages meant: ids as given, whether registered or not; else those of a letter; else all."""
        if page:
            return self.spark.createDataFrame([(p,) for p in dict.fromkeys(page)], "page_id string")
        return self.store.frame("pages", letter_id=letter).select("page_id").distinct()

    def pages(self) -> DataFrame:
        return by_letter(self.store.read("pages"))

    def ingest(self, folder: str, letter: str | None = None) -> int:
        """Registers a folder's images by their content; gives the number of pages."""
        self.store.upsert("pages", cut(files.register(files.images(self.spark, folder), letter).dropDuplicates(["page_id"])))
        return self.store.read("pages").count()

    def preprocess(self, page: list[str] | None = None, letter: str | None = None, config: images.Config = images.Config(), force: bool = False) -> int:
        """Writes the page and band images of pages that have none yet; gives the number of pages."""
        done = self.processed_pages()
        p = self.store.read("pages").join(self.pick(page, letter), "page_id", "left_semi").groupBy("page_id").agg(F.max("source_path").alias("source_path"))
        p = cut(p if force else p.join(done, "page_id", "left_anti"))
        if p.isEmpty():
            return 0
        folders = [r[0] for r in p.select(F.regexp_replace("source_path", r"/[^/]+$", "")).distinct().collect()]  # folders, not pages
        plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
        decoded = self.spark.read.format("image").load(folders).select("image.*").withColumn("at", plain(F.col("origin")))
        x = p.select("page_id", plain(F.col("source_path")).alias("at")).join(decoded, "at").drop("at", "origin")
        sinks.write_processed(images.processed(x, config), self.processed_dir)
        return p.count()

    def processed_pages(self) -> DataFrame:
        """(page_id) of the pages with a processed image."""
        names = [n[:-4] for n in self.store._names(self.processed_dir) if n.endswith(".jpg") and "_band" not in n]
        return self.spark.createDataFrame([(n,) for n in names], "page_id string")

    def image(self, page_id: str, kind: str = "original") -> str:
        """The path of a page's image; an unknown page or a missing file is a KeyError."""
        if kind == "processed":
            at = f"{self.processed_dir}/{page_id}.jpg"
        else:
            row = self.store.frame("pages", page_id=page_id).select("source_path").first()
            if row is None:
                raise KeyError(f"unknown page {page_id}")
            at = row[0]
        fs, p = self.store._fs(at)
        if not fs.exists(p):
            raise KeyError(f"image missing: {at}")
        return at

    def transcribe(self, engine: str | transcribe.Factory, prompt: str, page: list[str] | None = None, letter: str | None = None, samples: int = 1, temperature: float = 0.6, model: str = "-", with_bands: bool = False, shots: int = 2, holdout: str | None = None) -> int:
        """Runs pages through an engine; every sample is stored under its six keys, a repeated one replaces the old. Gives
        the number of lines."""
        name = engine if isinstance(engine, str) else "custom"
        factory = transcribe.engine(engine) if isinstance(engine, str) else engine
        text, version = files.prompt(self.spark, prompt)
        pages, letters, gold = self.store.read("pages"), self.store.read("letters"), self.gold()
        held = files.holdout(self.spark, holdout) if holdout else self.spark.createDataFrame([], "stem string")
        path = F.concat(F.lit(f"{self.processed_dir}/"), F.col("page_id"), F.lit(".jpg"))
        mine = views.page_context(pages, letters).join(self.pick(page, letter), "page_id", "left_semi").withColumn("image", path)
        band = F.transform(F.sequence(F.lit(0), F.lit(images.Config().bands - 1)), lambda k: F.concat(F.lit(f"{self.processed_dir}/"), F.col("page_id"), F.lit("_band"), k.cast("string"), F.lit(".jpg")))
        mine = mine.withColumn("bands", band if with_bands else F.array().cast("array<string>"))
        few = views.few_shot(gold, held, pages, shots, self.processed_pages()) if shots > 0 else self.spark.createDataFrame([], "page_id string, shot string, n bigint")
        few = few.withColumn("image", F.concat(F.lit(f"{self.processed_dir}/"), F.col("shot"), F.lit(".jpg")))
        asked = transcribe.messages(mine.select("page_id", "image", "bands", "context"), few, gold)
        asked = asked.select("page_id", F.concat(F.lit(text + "\n\n"), transcribe.flattened(F.col("messages"))).alias("message"))
        replies = cut(transcribe.generate(asked, factory, samples, temperature))
        lines = cut(transcribe.to_lines(replies, name, model, version, "page+bands" if with_bands else "page"))
        self.store.upsert("transcriptions", lines)
        return lines.count()

    def reconcile(self, page: list[str] | None = None, letter: str | None = None, prefer: str = "local", corrector: transcribe.Factory | None = None) -> int:
        """Votes on the pages that no human has done, lets a model resolve doubts if one is given, and stores the texts.
        Gives the number of pages."""
        todo = unprotected(self.pick(page, letter), self.store.read("letters"))
        v = cut(voting.voted(self.store.read("transcriptions").join(todo, "page_id", "left_semi"), prefer))
        if corrector:
            asked = voting.doubts(v).select("page_id", F.concat(F.lit("Transcription with alternatives:\n"), "body").alias("message"))
            new = voting.corrected(v, cut(transcribe.generate(asked, corrector, 1, 0.0)))
        else:
            new = voting.reconciled(v)
        none = F.lit(None)
        new = cut(new.withColumns({"reviewed_by": none.cast("string"), "reviewed_at": none.cast("timestamp_ntz"), "updated_at": F.current_timestamp().cast("timestamp_ntz")}))
        self.store.upsert("letters", new)
        return new.count()

    def gold(self) -> DataFrame:
        """(page_id, gold_text) of the checked texts of registered pages."""
        if not any(n.endswith(".txt") for n in self.store._names(self.gold_dir)):
            return self.spark.createDataFrame([], "page_id string, gold_text string")
        return files.gold(self.spark, self.gold_dir, self.store.read("pages"))

    def seed_gold(self) -> int:
        """Puts the checked texts into the letters frame; gives their number."""
        g = self.gold()
        now = F.current_timestamp().cast("timestamp_ntz")
        spans = F.array().cast("array<struct<line_no:int,word:string,alternatives:array<string>>>")
        new = cut(g.select("page_id", F.array_join(jsonx.gold_lines(F.col("gold_text")), "\n").alias("text_final"), F.lit("gold").alias("text_source"), spans.alias("uncertain_spans"), F.lit("gold").alias("reviewed_by"), now.alias("reviewed_at"), now.alias("updated_at")))
        self.store.upsert("letters", new)
        return new.count()

    def promote_gold(self) -> int:
        """Writes reviewed pages as checked texts; gives their number."""
        return sinks.promote(self.store.read("letters"), self.store.read("pages"), self.gold_dir)

    def coverage(self) -> tuple[int, int]:
        """(checked texts that match a page, registered pages)."""
        return self.gold().count(), self.store.read("pages").count()

    def evaluate(self) -> tuple[DataFrame, DataFrame]:
        """(leaderboard, every scored reading)."""
        r = scoring.join_lines(self.store.read("transcriptions")).unionByName(scoring.finals(self.store.read("letters")))
        s = scoring.score(r, self.gold())
        return scoring.leaderboard(s), scoring.detail(s)

    def enrich(self, engine: transcribe.Factory, letters: list[str] | None = None, model: str = "-") -> dict[str, int]:
        """Extracts people, places, events and summaries of letters and replaces what was known of them."""
        texts = views.letter_texts(self.store.read("pages"), self.store.read("letters"))
        texts = texts.where(F.col("letter_id").isin(letters)) if letters else texts
        meta = self.store.read("letter_meta")
        replies = transcribe.generate(transcribe.extraction_request(texts, meta), engine, 1, 0.0)
        replies = cut(replies.select(F.col("page_id").alias("letter_id"), "reply", F.lit(model).alias("model")))
        got = {k: cut(x) for k, x in transcribe.enrich(replies, meta).items()}
        for k, x in got.items():
            self.store.upsert(k, x) if k == "summaries" else self.store.replace(k, x)
        return {k: x.count() for k, x in got.items()}

    def export(self, out: str, with_images: bool = True) -> dict:
        """Frames with a manifest, and the pages' images."""
        manifest = self.store.export(out)
        if with_images:
            sinks.copy_images(self.store.read("pages"), out, self.processed_dir)
        return manifest

    def frame(self, name: str, page_id: str | None = None, letter_id: str | None = None) -> DataFrame:
        return self.store.frame(name, page_id, letter_id)

    def arrow(self, name: str, page_id: str | None = None, letter_id: str | None = None):
        """The filtered frame as the bytes of one Arrow file, piece by piece."""
        return sinks.arrow_file(self.frame(name, page_id, letter_id))

    def load(self, exported: str | None = None) -> dict[str, DataFrame]:
        """The six frames that views read: from the store, or from an exported folder."""
        names = ("pages", "letters", "letter_meta", "entities", "events", "summaries")
        return {n: self.spark.read.parquet(f"{exported}/{n}.parquet") if exported else self.store.read(n) for n in names}

    def review(self, *args, **kwargs) -> None:
        self.store.review(*args, **kwargs)

    def set_meta(self, *args, **kwargs) -> None:
        self.store.set_meta(*args, **kwargs)

    def assign(self, *args, **kwargs) -> None:
        self.store.assign(*args, **kwargs)
