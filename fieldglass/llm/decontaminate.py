"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive tokens; positions under a 0 do not enter its
hash, so a passage whose words were changed there still meets the benchmark's
hash.  The masks are chosen by enumeration: whatever tokens of a run were
changed, up to what ``SHARE`` allows, some mask at some place avoids them all,
so no run is missed.  A document's seed hashes are joined with the benchmark's, and every hit
is verified: along its diagonal, some run of ``RUN`` aligned tokens (the whole
item, if shorter) must agree in at least ``SHARE`` of them.

The benchmark is a stated query set.  It is sent to the executors in blocks of
at most ``BLOCK_TOKENS`` tokens; a task searches each batch of texts for one
block after another and holds one block's index at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import WordHasher, mix64, share, shared

RUN = 13
#: For items of at least RUN tokens: every choice of two changed tokens among 13 leaves a place for one of these.
MASKS = ("11101011", "11001111")
#: The same for shorter items, by their length; under 5 tokens all must agree.
SHORT_MASKS = {
    5: ("111", "1101"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("11111", "111011"),
    9: ("1111011", "1101111"),
    10: ("11111", "111011", "11010011"),
    11: ("1101011", "1110011"),
    12: ("111111", "11101011", "101100111"),
}
SHARE = 0.8
#: Tokens to either side of a hit that verification looks at.
REACH = 64
BLOCK_TOKENS = 1_000_000

_HIT = "array<struct<item:{},doc_start:int,item_start:int,matched:int,aligned:int>>"


def masks_for(length: int) -> tuple[str, ...]:
    """The masks that find every permitted copy of an item of so many tokens."""
    return MASKS if length >= RUN else SHORT_MASKS.get(length, ("1" * length,))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, sum(1 << i for i, c in enumerate(mask) if c == "1"), dtype=np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                out = (out ^ words[i : i + n]) * np.uint64(0x9DDFEA08EB382D69)
                out ^= out >> np.uint64(31)
    return mix64(out)


@dataclass
class SeedIndex:
    """Sorted seed hashes of a block of items, with the item and position of each."""

    words: list[np.ndarray]
    masks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, words: list[np.ndarray]) -> SeedIndex:
        by_mask: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for mask in masks_for(len(w)) if len(w) else ():
                by_mask.setdefault(mask, []).append(i)
        masks = {}
        for mask, at in by_mask.items():
            parts = [(seed_hashes(words[i], mask), i) for i in at]
            hashes = np.concatenate([h for h, _ in parts])
            items = np.concatenate([np.full(len(h), i, dtype=np.int64) for h, i in parts])
            places = np.concatenate([np.arange(len(h)) for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            masks[mask] = hashes[order], items[order], places[order]
        return cls(words, masks)

    def find(self, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, start in the document, start in the item, tokens that agree, tokens aligned): the best of each item."""
        best: dict[int, tuple[int, int, int, int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for mask, (hashes, items, places) in self.masks.items():
            seeds = seed_hashes(doc, mask)
            if not len(seeds):
                continue
            lo = np.searchsorted(hashes, seeds, "left")
            hits = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == seeds)
            for p in hits.tolist():
                k = int(lo[p])
                while k < len(hashes) and hashes[k] == seeds[p]:
                    item, q = int(items[k]), int(places[k])
                    k += 1
                    key = (item, p - q, p // REACH)
                    if key in done:
                        continue
                    done.add(key)
                    found = verify(doc, self.words[item], p, q)
                    if found and (item not in best or (found[2], -found[0]) > (best[item][3], -best[item][1])):
                        best[item] = (item, *found)
        return [best[i] for i in sorted(best)]


def verify(doc: np.ndarray, item: np.ndarray, p: int, q: int) -> tuple[int, int, int, int] | None:
    """Look along the diagonal through document place p and item place q, ``REACH`` tokens to either side and over the whole of shorter items."""
    left, right = min(p, q, 2 * REACH), min(len(doc) - p, len(item) - q, 2 * REACH)
    same = doc[p - left : p + right] == item[q - left : q + right]
    run = min(RUN, len(item))
    if len(same) < run:
        return None
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(total[run:] - total[:-run] >= math.ceil(SHARE * run - 1e-9))
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + run
    return p - left + first, q - left + first, int(total[last] - total[first]), last - first


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Item ids and words of one block after another, streamed to the driver."""
    hasher = WordHasher()
    ids: list = []
    words: list[np.ndarray] = []
    held = 0
    for row in benchmark.select(item, text).toLocalIterator():
        w = hasher(row[1])
        if not len(w):
            continue
        if ids and held + len(w) > most:
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(row[0])
        words.append(w)
        held += len(w)
    if ids:
        yield ids, words


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", out: str = "overlaps", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Add array ``out`` of struct(item, doc_start, item_start, matched, aligned), one for each benchmark item found.

    Places count words from 0.  A narrow map: documents are not shuffled.
    An existing column ``out`` is replaced.  Null and empty texts, on either
    side, have no overlaps; an empty benchmark
    gives empty arrays.  Repeated items are reported each under its own id.
    """
    kind = benchmark.schema[item].dataType.simpleString()
    blocks = [share(docs.sparkSession, (ids, SeedIndex.build(words))) for ids, words in _blocks(benchmark, item, "text", block_tokens)]
    if not blocks:
        return docs.withColumn(out, F.array().cast(_HIT.format(kind)))
    return docs.withColumn(out, _searcher(blocks, kind)(F.col(text)))


def _searcher(blocks: list[Broadcast], kind: str):
    """The pandas UDF that searches texts for the items of all blocks; said not to be deterministic, so that no filter on its result runs it twice."""
    fields = ("item", "doc_start", "item_start", "matched", "aligned")

    @F.pandas_udf(_HIT.format(kind))
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, held = WordHasher(), None
        for texts in batches:
            found: list[list[dict]] = [[] for _ in texts]
            for block in blocks:
                if held is None or len(blocks) > 1:
                    held = None  # let go of the one before first
                    held = shared(block)
                ids, index = held
                for out, text in zip(found, texts, strict=True):
                    out += [dict(zip(fields, (ids[f[0]], *f[1:]), strict=True)) for f in index.find(hasher(text))]
            yield pd.Series(found)

    return search.asNondeterministic()
