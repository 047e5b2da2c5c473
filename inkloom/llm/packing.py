"""Documents packed into sequences of fixed capacity, at target proportions of their sources (problem 8).

Method: mixture-controlled packing. The corpus is cut into shards by a hash; each shard packs its own windows by
deficit round-robin over source queues: a window gives every source its quantum (target share of the capacity) on top
of the deficit carried from the windows before, and what room is left goes to a queued document that fits it well, of
the source that is most in deficit among such; it is charged to its source. What the shards before a shard over- or underfeed is known from token totals alone, so
that deficits also carry across partitions: a shard starts with the difference between the target and the supply of all
shards before it.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkloom.session import cut

CAPACITY = 4096
NONE = "(none)"
#: Each source has a queue in every shard.
MOST_SOURCES = 10_000
#: Tokens of a shard; bounds what one task holds (ids and sizes only, never texts).
SHARD_TOKENS = 2_000_000
#: A fit counts as good as the best if it fills this share of what the best does.
NEARLY = 0.8
_loaded: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _tokenizer(path: str):
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        elif path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [len(e.encode_ordinary(x)) for x in texts]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            t.no_truncation()
            t.no_padding()
            _loaded[path] = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def sizes(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens) of every document; whole texts are counted, of equal texts in a batch one.

    Null text has 0 tokens, a null source is "(none)". The tokenizer's path must exist on every executor.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _tokenizer(path)
        for b in batches:
            each = list(b["text"].dropna().unique())
            n: dict[str, int] = {}
            for i in range(0, len(each), 64):  # few at a time: encodings are many times as large as their text
                n.update(zip(each[i : i + 64], count(each[i : i + 64])))
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "n_tokens": [n.get(t, 0) for t in b["text"]]})

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source), F.lit(NONE)).alias("source"), F.col(text).alias("text")).where("id IS NOT NULL")
    return d.mapInPandas(run, "id bigint, source string, n_tokens bigint").withColumnRenamed("id", id_col)


def pack_shard(ids, sources, tokens, shares: dict[str, float], start: dict[str, float], capacity: int = CAPACITY):
    """One shard's windows: yields (position in the shard's input, piece, window, n) for each piece.

    Pieces of a document over the capacity: full windows by themselves, the rest is queued like a document.
    """
    queue: dict[str, list[tuple[int, int, int]]] = {s: [] for s in shares}  # (size, order, piece) ascending
    out, window = [], 0
    for i, (s, n) in enumerate(zip(sources, tokens)):
        piece = 0
        while n > capacity:
            out.append((i, piece, window, capacity))
            n, piece, window = n - capacity, piece + 1, window + 1
        insort(queue[s], (int(n), -i, piece))
    deficit = dict(start)
    names = sorted(queue)
    turn = 0
    while any(queue.values()):
        room = capacity
        live = [s for s in names if queue[s]]
        total = sum(shares[s] for s in live) or 1.0
        for s in live:
            deficit[s] = deficit.get(s, 0.0) + capacity * (shares[s] / total if total else 1 / len(live))
        # The largest that fits the source's credit, source by source, the one most in deficit first.
        order = sorted(live, key=lambda s: (-deficit[s], (names.index(s) - turn) % len(names)))
        turn += 1
        for s in order:
            while queue[s] and room > 0:
                k = bisect_right(queue[s], (min(room, deficit[s]), 1, 0)) - 1
                if k < 0:
                    break
                n, i, piece = queue[s].pop(k)
                out.append((-i, piece, window, n))
                room, deficit[s] = room - n, deficit[s] - n
        # What is left: of the queues' best fits those that fill nearly as much as the best, the one most in deficit.
        while room > 0:
            fits = [(queue[s][k][0], s, k) for s in names if (k := bisect_right(queue[s], (room, 1, 0)) - 1) >= 0]
            if not fits:
                break
            top = max(f[0] for f in fits)
            if top == 0 and room < capacity and not any(q and q[0][0] == 0 for q in queue.values()):
                break
            n, s, k = max((f for f in fits if f[0] >= NEARLY * top), key=lambda f: (deficit.get(f[1], 0.0), f[0]))
            n, i, piece = queue[s].pop(k)
            out.append((-i, piece, window, n))
            room, deficit[s] = room - n, deficit.get(s, 0.0) - n
        window += 1
    return out


def pack(sized: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", target: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, piece, source, window, n_tokens): where each document, or piece of one over the capacity, goes.

    target: shares by source, by default the corpus's own; a source without a share gets 0 and fills what is left.
    Every document is placed exactly once, also of 0 tokens; equal input gives equal windows. `window` is a string of
    shard and number. An empty table gives an empty result.
    """
    sized = cut(sized)  # ids and sizes: they are read three times, the texts once
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them before packing")
    total = sum(r["n"] or 0 for r in totals)
    wanted = {r["source"]: (target.get(r["source"], 0.0) if target else (r["n"] or 0) / max(1, total)) for r in totals}
    shards = max(1, round(total / shard_tokens))
    s = sized.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    supply = s.groupBy("shard", "source").agg(F.sum("n_tokens").alias("n"))
    names = F.from_json(F.lit(json.dumps(wanted)), "map<string,double>")
    grid = s.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(names).alias("source", "share"))
    carried = grid.join(supply, ["shard", "source"], "left").fillna(0, ["n"])
    whole = F.sum("n").over(W.partitionBy("shard"))
    carried = carried.withColumn("owed", whole * F.col("share") - F.col("n"))
    carried = carried.withColumn("deficit", F.coalesce(F.sum("owed").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    start = carried.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("source", "deficit"))).alias("start"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values([id_col, "source"], kind="stable").reset_index(drop=True)
        began = dict(right["start"].iloc[0]) if len(right) else {}
        shares = {k: wanted.get(k, 0.0) for k in left["source"].unique()}
        rows = pack_shard(left[id_col].tolist(), left["source"].tolist(), left["n_tokens"].tolist(), shares, {k: v for k, v in began.items() if k in shares}, capacity)
        at = [r[0] for r in rows]
        shard = str(left["shard"].iloc[0]) if len(left) else ""
        return pd.DataFrame({id_col: left[id_col].to_numpy()[at], "piece": [r[1] for r in rows], "source": left["source"].to_numpy()[at], "window": [f"{shard}-{r[2]}" for r in rows], "n_tokens": [r[3] for r in rows]})

    schema = f"{id_col} bigint, piece int, source string, window string, n_tokens bigint"
    return s.groupBy("shard").cogroup(start.groupBy("shard")).applyInPandas(run, schema)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per shard of a packed corpus: windows, n_tokens, fill (the share of the room used), and how far the sources' shares
    are from the corpus's: off_mean and off_max, the mean and the largest difference of any source in a window that more
    than one document shares, and off_shard, the largest difference of any source in the shard."""
    p = packed.withColumn("shard", F.substring_index("window", "-", 1))
    by = p.groupBy("shard", "window", "source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    share = by.groupBy("source").agg(F.sum("n").alias("of")).withColumn("share", F.col("of") / F.sum("of").over(W.partitionBy(F.lit(1)))).select("source", "share")
    whole = by.groupBy("shard", "window").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("x"))
    target = share.agg(F.map_from_entries(F.collect_list(F.struct("source", "share")))).scalar()
    whole = whole.withColumn("t", target)
    got = F.map_from_entries("x")
    off = F.array_max(F.transform(F.map_keys("t"), lambda s: F.abs(F.coalesce(F.try_element_at(got, s), F.lit(0)) / F.greatest("all", F.lit(1)) - F.try_element_at(F.col("t"), s))))
    windows = whole.withColumn("off", F.when(F.col("docs") > 1, off)).groupBy("shard").agg(F.count("*").alias("windows"), F.sum("all").alias("n_tokens"), F.avg("off").alias("off_mean"), F.max("off").alias("off_max"))
    shards = by.groupBy("shard", "source").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("shard"))).join(share, "source").groupBy("shard").agg(F.max(F.abs(F.col("n") / F.col("all") - F.col("share"))).alias("off_shard"))
    return windows.join(shards, "shard").select("shard", "windows", "n_tokens", (F.col("n_tokens") / (F.col("windows") * capacity)).alias("fill"), "off_mean", "off_max", "off_shard")


def found(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """p8_found: the documents that the packer had to split, as they alone exceed the capacity."""
    return pack(sizes(docs, tokenizer), capacity).where("piece > 0").select("doc_id").distinct()
