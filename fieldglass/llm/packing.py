"""Packing documents into fixed windows, filled with lexical neighbours.

1. Texts become token ids with an end id.  Whole windows are cut off a
   document's start and need no partner; what is left is its tail.
2. Document frequencies of ids are counted over all tails.
3. Tails are dealt into shards of at most about ``SHARD_DOCS`` by what they
   hold: by a term drawn from their ids, rare ones likelier, so that the chance
   that two tails draw the same term is their weighted overlap.  Shards that
   many tails draw are cut by a MinHash of id pairs, and those of one pair by a
   hash of the document.  Every run gives the same rows.  Each shard builds a
   BM25 inverted index of its tails, asked with all terms of a seed.  The longest
   unused tail seeds a window, its unused neighbours fill it, best first and as
   far down the ranking as there is room, and the neighbour that no longer fits
   is cut; its rest stays in the shard.  Tails without a term in common with
   the seed come last.
4. What remains at a shard's end is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .core import hot_keys, materialize, mix64, salted_join, share, shared
from .tokens import Tokens

WINDOW = 1024
END_ID = 0
SHARD_DOCS = 2_048
VOCABULARY = 50_257
#: Counts of up to so many shards, at most twice as many rows of three numbers, are sent to every task; more are joined.
BROADCAST_SHARDS = 200_000
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Terms with more postings than this in a shard are scored for all seeds at once, so many terms in a product of matrices.
DENSE, DENSE_TERMS = 64, 512
#: Neighbours that are ranked at first; the ranking goes on where they do not fill a window.
FIRST = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def ids_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def term_order() -> np.ndarray:
    """For each id its place in the draw of a term: exponential, at a rate equal to the id, since later ids of a merge list are rarer."""
    ids = np.arange(VOCABULARY, dtype=np.uint64)
    uniform = (mix64(ids + np.uint64(1)) >> np.uint64(11)).astype(float) / 2.0**53
    out = -np.log(np.maximum(uniform, 2.0**-53)) / np.maximum(1.0, ids.astype(float))
    out[END_ID] = np.inf
    return out


def pair_hash(ids: np.ndarray) -> int:
    """MinHash of the pairs of neighbouring ids, as a non-negative long; 0 without a pair."""
    if len(ids) < 2:
        return 0
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(16)) | ids[1:].astype(np.uint64)
    return int(mix64(mix64(pairs).min()) >> np.uint64(1))


def _tokenized(docs: DataFrame, folder: str | None) -> DataFrame:
    """doc_id, doc_tokens, the sums of whole windows, the tail as 16-bit ids, the term it draws and the MinHash of its pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(folder)
        order = term_order()
        for batch in batches:
            sizes, sums, tails, terms, grains = [], [], [], [], []
            for text in batch["text"].array:
                ids = np.array([*tokens.ids(None if text is pd.NA else text), END_ID], dtype=np.uint16)
                whole = len(ids) // WINDOW
                sizes.append(len(ids))
                sums.append([ids_crc(ids[i * WINDOW : (i + 1) * WINDOW]) for i in range(whole)])
                tail = ids[whole * WINDOW :]
                tails.append(tail.tobytes())
                terms.append(int(tail[order[tail].argmin()]) if len(tail) else END_ID)
                grains.append(pair_hash(tail))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "doc_tokens": sizes, "whole": sums, "tail": tails, "term": terms, "grain": grains})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, doc_tokens long, whole array<long>, tail binary, term int, grain long")


def _document_frequencies(tokenized: DataFrame) -> np.ndarray:
    """For each id the number of tails that have it; one vector leaves each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(VOCABULARY, dtype=np.int64)
        for batch in batches:
            for tail in batch["tail"]:
                total[np.unique(np.frombuffer(tail, dtype=np.uint16))] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    counts = tokenized.select("tail").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(VOCABULARY, dtype=np.int64)
    for r in counts.collect():  # at most one row for each id of the vocabulary
        out[r.id] = r.n
    return out


class ShardIndex:
    """BM25 inverted index of the tails of one shard."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        docs, terms, counts = [], [], []
        for i, ids in enumerate(tails):
            t, n = np.unique(ids, return_counts=True)
            docs.append(np.full(len(t), i, dtype=np.int64))
            terms.append(t.astype(np.int64))
            counts.append(n)
        doc, term, tf = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (docs, terms, counts))
        lengths = np.array([len(t) for t in tails], dtype=float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean_length))
        by = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by], weight[by].astype(np.float32)
        self.first = np.searchsorted(term[by], np.arange(VOCABULARY + 1))
        self.size = len(tails)
        spread = np.diff(self.first)
        self.scores = np.zeros((self.size, self.size), np.float32)  # seed by neighbour, of the dense terms
        dense = np.flatnonzero(spread > DENSE)
        for i in range(0, len(dense), DENSE_TERMS):
            part = dense[i : i + DENSE_TERMS]
            column = np.repeat(np.arange(len(part)), spread[part])
            at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in part])
            weights = np.zeros((self.size, len(part)), np.float32)
            weights[self.doc[at], column] = self.weight[at]
            self.scores += (weights > 0).astype(np.float32) @ weights.T
        sparse = np.flatnonzero(spread[term] <= DENSE)
        self.queries = np.split(term[sparse], np.searchsorted(doc[sparse], np.arange(1, self.size)))

    def ranking(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused tails that share terms with the seed, best first; ties go to the earlier."""
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.queries[seed].tolist()]
        scores = self.scores[seed]
        if spans:
            scores = scores + np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=self.size)
        some = np.flatnonzero((scores > 0) & unused)
        if len(some) > FIRST:
            least = np.partition(scores[some], -FIRST)[-FIRST]
            best = some[scores[some] >= least]
            yield from best[np.lexsort((best, -scores[best]))].tolist()
            some = some[scores[some] < least]
        yield from some[np.lexsort((some, -scores[some]))].tolist()


def fill_windows(tails: list[np.ndarray], idf: np.ndarray, mean_length: float) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, begin, end); all but the last few hold ``WINDOW`` ids, and those a power of two."""
    lengths = np.array([len(t) for t in tails], dtype=np.int64)
    begin = np.zeros(len(tails), dtype=np.int64)
    unused = lengths > 0
    index = ShardIndex(tails, idf, max(mean_length, 1.0))
    by_length = np.argsort(-lengths, kind="stable").tolist()
    left = int(lengths.sum())
    windows: list[list[tuple[int, int, int]]] = []
    at = 0
    while left >= WINDOW:
        while not unused[by_length[at]]:
            at += 1
        seed, room = by_length[at], WINDOW
        window: list[tuple[int, int, int]] = []

        def take(i: int, most: int, window: list = window) -> int:
            n = int(min(most, lengths[i] - begin[i]))
            window.append((i, int(begin[i]), int(begin[i]) + n))
            begin[i] += n
            unused[i] = begin[i] < lengths[i]
            return n

        room -= take(seed, room)
        passed = []
        for i in index.ranking(seed, unused):
            if lengths[i] - begin[i] > room:  # whole ones first
                passed.append(i)
                if len(passed) < FIRST:
                    continue
                break
            room -= take(i, room)
            if not room:
                break
        for i in passed:
            if room:
                room -= take(i, room)
        back = len(by_length) - 1
        while room:  # no neighbour is left: the shortest others
            if unused[by_length[back]]:
                room -= take(by_length[back], room)
            else:
                back -= 1
        left -= WINDOW
        windows.append(window)
    rest = [i for i in by_length if unused[i]]
    size = WINDOW >> 1
    while left:
        if left >= size:
            room, window = size, []
            while room:
                i = rest[0]
                n = int(min(room, lengths[i] - begin[i]))
                window.append((i, int(begin[i]), int(begin[i]) + n))
                begin[i] += n
                room -= n
                if begin[i] == lengths[i]:
                    rest.pop(0)
            windows.append(window)
            left -= size
        size >>= 1
    return windows


def dealt(tokenized: DataFrame, n: int) -> DataFrame:
    """The n tails with their ``shard``: by drawn term, then, where a shard has too many, by pairs, then by a hash of the document.

    Only counts of shards, one or two for ``SHARD_DOCS`` tails, are joined and
    numbered.  While they are few they go to the tails; beyond that the tails
    of hot shards are dealt over tasks in the join.
    """
    shards = -(-n // SHARD_DOCS)
    if shards < 2:
        return tokenized.withColumn("shard", F.lit(0).cast("long"))
    parts = F.ceil(F.count(F.lit(1)) / SHARD_DOCS)

    def counted(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
        if shards <= BROADCAST_SHARDS:
            return rows.join(F.broadcast(counts), key)
        return salted_join(rows, counts, key, "_spread", hot_keys(rows, key, n))

    first = tokenized.withColumns({"_first": F.pmod(F.xxhash64("term"), F.lit(shards)), "_spread": F.xxhash64("doc_id", "whole", "tail")})
    cut = counted(first, first.groupBy("_first").agg(parts.alias("_cuts")), "_first")
    second = cut.withColumn("_group", F.struct("_first", F.pmod("grain", "_cuts").alias("second")))
    before = F.coalesce(F.sum("_parts").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = second.groupBy("_group").agg(parts.alias("_parts")).withColumn("_before", before)
    at = counted(second, groups, "_group")
    return at.select(*tokenized.columns, (F.col("_before") + F.pmod("_spread", "_parts")).alias("shard"))


def pack(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Every id of every document lies in exactly one piece.  Sequences hold
    1,024 ids; at each shard's end a few hold a smaller power of two, so there
    is no padding.  A null or empty text has only its end id.  Repeated rows
    are packed each; a null doc_id is carried as null.  Other columns are not
    used; an empty table gives no rows.  ``folder`` holds the vocabulary files.
    """
    tokenized = materialize(_tokenized(docs, folder), "tokens")
    frequency = _document_frequencies(tokenized)
    n, ids = tokenized.agg(F.count(F.lit(1)), F.sum(F.length("tail") / 2)).first()
    idf = np.log(1.0 + (n - frequency + 0.5) / (frequency + 0.5))
    sent = share(docs.sparkSession, (idf, (ids or 0.0) / max(1, n)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens", "tail"])  # rows equal in all three differ in their whole windows at most
        tails = [np.frombuffer(t, dtype=np.uint16) for t in rows["tail"]]
        doc_ids, sizes = rows["doc_id"].tolist(), rows["doc_tokens"].tolist()
        base, out = int(key[0]) << 32, []
        for doc, size, sums in zip(doc_ids, sizes, rows["whole"], strict=True):
            for i, crc in enumerate(sums):
                out.append((doc, i * WINDOW, WINDOW, int(crc), size, base, 0))
                base += 1
        for window in fill_windows(tails, *shared(sent)):
            offset = 0
            for i, a, b in window:
                out.append((doc_ids[i], sizes[i] - len(tails[i]) + a, b - a, ids_crc(tails[i][a:b]), sizes[i], base, offset))
                offset += b - a
            base += 1
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    columns = ["doc_id", "doc_tokens", "whole", "tail", "shard"]
    return dealt(tokenized, n).select(*columns).groupBy("shard").applyInPandas(run, PIECES)
