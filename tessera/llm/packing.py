"""Containers of fixed capacity filled with items of varying length: conflict-constrained best fit.

Rows are spread over shards by hash, of the row and not only its doc_id, so that shards hold about a set amount of tokens, and each shard is
packed by best fit, longest first. Open packs are kept ordered by the room they have left; each carries the sources and the
duplicate clusters it holds as sparse bitmaps. The search starts at the tightest pack that has room and goes on to the next until
one is found in which no near-duplicate of the document lies; among equally tight ones it prefers one without the source.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import VOCABULARY, Counter_, ranks_of
from tessera.session import cut, spread

#: Words of a shingle; bands and rows of the MinHash signature. Texts of similarity 0.8 share a band with probability 0.998.
SHINGLE, BANDS, ROWS = 5, 16, 5
_rng = np.random.default_rng(20_240_101)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Signer:
    """Duplicate-cluster tags of a text: one number per band of its MinHash signature over five-word shingles."""

    def __init__(self) -> None:
        from xxhash import xxh64_intdigest

        class Hashes(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > 1_000_000:
                    self.clear()
                h = self[word] = xxh64_intdigest(word)
                return h

        self.hashes = Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.int64)
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - SHINGLE + 1)
        s = np.zeros(n, dtype=np.uint64)
        for k in range(min(SHINGLE, len(h))):
            s = s * _PRIME + h[k : k + n]
        s ^= s >> np.uint64(29)
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, n, 2048):  # in slices, so that a very long text needs no more memory
            low = np.minimum(low, (s[at : at + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
        tag = np.arange(BANDS, dtype=np.uint64)
        for row in low.reshape(BANDS, ROWS).T:
            tag = (tag ^ row) * _PRIME
            tag ^= tag >> np.uint64(31)
        return tag.view(np.int64)


def profiles(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, tags of every document. The text itself goes no further."""
    held = documents.sparkSession.sparkContext.broadcast(ranks_of(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, sign = Counter_(held.value), Signer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [count(x) for x in b["text"]], "tags": [sign(x) for x in b["text"]]})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, n_tokens bigint, tags array<bigint>")


class Packer:
    """Best fit into packs of one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # (room left, pack), in order
        self.tags: list[set[int]] = []
        self.sources: list[set[str]] = []

    def put(self, size: int, tags: frozenset[int], source: str) -> int:
        """The pack that takes an item of this size (at most the capacity)."""
        found = None
        at = bisect.bisect_left(self.open, (size, -1))
        while at < len(self.open):
            room, pack = self.open[at]
            if found is not None and room > found[0]:
                break
            if self.tags[pack].isdisjoint(tags):
                if source not in self.sources[pack]:
                    found = (room, pack, at)
                    break
                if found is None:
                    found = (room, pack, at)
            at += 1
        if found is None:
            pack = len(self.tags)
            self.tags.append(set())
            self.sources.append(set())
            room = self.capacity
        else:
            room, pack, at = found
            del self.open[at]
        self.tags[pack] |= tags
        self.sources[pack].add(source)
        if room > size:
            bisect.insort(self.open, (room - size, pack))
        return pack


def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Packs one shard for one capacity; pieces of documents beyond the capacity come first, each but the last filling a pack."""
    capacity, name, shard = int(rows["capacity"].iloc[0]), rows["pack_name"].iloc[0], int(rows["shard"].iloc[0])
    rows = rows.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
    packer, items, out = Packer(capacity), [], []
    for doc, n, source, tags in zip(rows["doc_id"], rows["n_tokens"], rows["source"], rows["tags"]):
        tags, source = frozenset(tags.tolist() if tags is not None else ()), source if isinstance(source, str) else ""
        whole = max(0, -(-n // capacity) - 1)
        for k in range(whole):
            pack = packer.put(capacity, tags, source)
            out.append((pack, doc, k, k * capacity, capacity))
        items.append((n - whole * capacity, doc, whole, source, tags))
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    for size, doc, piece, source, tags in items:
        out.append((packer.put(size, tags, source), doc, piece, piece * capacity, size))
    done = pd.DataFrame(out, columns=["pack", "doc_id", "piece_no", "first_token", "n_tokens"])
    done["pack_name"], done["pack_id"] = name, [f"{shard}-{p}" for p in done.pop("pack")]
    return done[["pack_name", "pack_id", "doc_id", "piece_no", "first_token", "n_tokens"]]


def packs(sized: DataFrame, capacities: DataFrame, shard_tokens: int = 4_000_000) -> DataFrame:
    """One row per document and pack size, or per piece where a document exceeds the capacity.

    sized: doc_id, source, n_tokens, tags. capacities: pack_name, capacity_tokens (few rows; null or below 1 are ignored).
    Gives pack_name, pack_id, doc_id, piece_no (from 0), first_token, n_tokens. No document is cut unless it exceeds the capacity; a
    cut one fills its own packs but for its last piece. No pack holds two texts that share a MinHash band: near-duplicates of similarity 0.8 do so
    with probability 0.998, and so do some less similar texts. Texts without tokens
    are items of size 0. Rows without doc_id are ignored; a repeated doc_id is packed as often as it occurs. shard_tokens bounds
    what one task packs, whatever the table's size; a shard leaves a few packs partly empty, far below a thousandth of its packs.
    """
    sized = cut(sized.where("doc_id is not null").select("doc_id", "source", "n_tokens", "tags"), "sized")
    total = sized.agg(F.sum(F.col("n_tokens") + 200)).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    sizes = capacities.where("pack_name is not null and capacity_tokens >= 1").select("pack_name", F.col("capacity_tokens").alias("capacity")).distinct()
    rows = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")).crossJoin(F.broadcast(sizes))  # a few sizes
    return rows.groupBy("pack_name", "shard").applyInPandas(pack_shard, "pack_name string, pack_id string, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint")


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack size: packs, documents, tokens, used (share of the packs' capacity), cut (documents in more than one piece)."""
    per = packed.groupBy("pack_name").agg(
        F.count_distinct("pack_id").alias("packs"), F.count(F.when(F.col("piece_no") == 0, 1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.count(F.when(F.col("piece_no") == 1, 1)).alias("cut")
    )
    return per.join(F.broadcast(capacities.select("pack_name", "capacity_tokens").distinct()), "pack_name").select(
        "pack_name", "packs", "documents", "tokens", "cut", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6).alias("used")
    )
