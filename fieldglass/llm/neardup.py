"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components.

1. A text becomes the set of hashes of its word shingles.  Equal sets form a
   class; from here on a class is one node, named by its smallest doc_id, so
   large groups of copies cost one row.
2. ``BANDS`` bands of ``ROWS`` MinHash values find candidates: two sets of
   similarity 0.8 share no band with probability under 1e-6.
3. A MinHash sample of each set (all of it, or of large sets the items whose
   hashes are smallest) is folded into a parity bitmap.  The XOR of two
   bitmaps has at most as many bits as the samples differ in, and almost as
   many when they are similar, so its population count tells pairs that reach
   the threshold from those just below.  Unsampled sets lose no link here;
   sampled ones keep five standard deviations.
4. The rest are confirmed on their full sets.

Pairs are not listed bucket by bucket.  First each bucket is a star around its
most central class (the one in the largest buckets), and the confirmed edges
are joined into components.  Then only members outside their bucket's largest
component meet the members of other components, and the join itself applies
the sketches.  Buckets of more than ``WIDE`` classes are dealt into square
blocks, so that tasks share their pairs and every pair still meets once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import WordHasher, discard, hot_keys, materialize, mix64, possible, salted_join, window_hashes
from .graph import components

BANDS, ROWS = 36, 5
SAMPLES = BANDS * ROWS
#: Bits of a parity bitmap, and items that a sample holds at most, about.
BITS, SAMPLE = 1024, 512
#: Standard deviations that a sampled pair may exceed the threshold by.
SLACK = 5.0
#: Classes in a bucket from which on its pairs are dealt into blocks; a block's sides hold about as many each.
WIDE = 256

_WORDS = BITS // 64
#: Bitmaps at a set's own sampling level and at the next.
_SKETCH = [f"{side}{i}" for side in "st" for i in range(_WORDS)]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words."""
    return np.unique(window_hashes(words, size))


class Sketcher:
    """MinHash values, band keys and the odd sketch of a set."""

    CHUNK = 1024

    def __init__(self) -> None:
        seeds = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
        self.flip = seeds[:SAMPLES].astype(np.uint32)[:, None]
        self.by = (seeds[SAMPLES:].astype(np.uint32) | np.uint32(1))[:, None]
        self.salt = np.uint64(0x8EBC6AF09C88C6E3)
        self.band = mix64(np.arange(5000, 5000 + BANDS, dtype=np.uint64))

    def minhash(self, items: np.ndarray) -> np.ndarray:
        small = (items >> np.uint64(32)).astype(np.uint32)
        best = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(small), self.CHUNK):
            part = (small[None, i : i + self.CHUNK] ^ self.flip) * self.by
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(best, part.min(axis=1), out=best)
        return best

    def bands(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = self.band.copy()
            for column in values.astype(np.uint64).reshape(BANDS, ROWS).T:
                key = mix64(key ^ (column * np.uint64(0x9E3779B97F4A7C15)))
        return key.view(np.int64)

    def odd(self, items: np.ndarray, level: int) -> np.ndarray:
        """Parity bitmap of the items whose hashes are in the lowest 2^-level part."""
        sample = items[: np.searchsorted(items, np.uint64(1 << (64 - level)))] if level else items
        at = (mix64(sample ^ self.salt) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
        parity = np.bincount(at, minlength=BITS) & 1
        return np.packbits(parity.astype(np.uint8)).view(np.int64)


def sampling_level(n: int) -> int:
    return max(0, (n - 1).bit_length() - SAMPLE.bit_length() + 1)


def similar_enough(a: str, b: str, percent: int) -> Column:
    """Whether the bitmaps of sides ``a`` and ``b`` (:func:`_side`) allow the threshold.

    Sets of sizes n and m reach it when they differ in at most
    (n + m) * (100 - percent) / (100 + percent) items; a sample of the coarser
    level sees that many by its rate.
    """
    x, y = F.col(f"{a}_level"), F.col(f"{b}_level")
    own, other = F.when(x >= y, F.col(f"{a}_s")).otherwise(F.col(f"{a}_t")), F.when(y >= x, F.col(f"{b}_s")).otherwise(F.col(f"{b}_t"))
    words = [F.get(own, i).bitwiseXOR(F.get(other, i)) for i in range(_WORDS)]
    bits = reduce(lambda p, q: p + q, [F.bit_count(w) for w in words])
    level = F.greatest(x, y)
    total = F.col(f"{a}_n") + F.col(f"{b}_n")
    most = total * ((100.0 - percent) / (100.0 + percent)) / F.pow(F.lit(2.0), level)
    near = F.least(f"{a}_n", f"{b}_n") * 100 >= F.greatest(f"{a}_n", f"{b}_n") * percent
    return near & (F.abs(x - y) <= 1) & (bits <= most + F.when(level > 0, SLACK * F.sqrt(most)).otherwise(1e-9))


def _side(classes: DataFrame, key: str, side: str) -> DataFrame:
    """Classes as (key, side_n, side_level, side_s, side_t); the bitmaps are two arrays, so that plans of joins hold few columns."""
    bitmaps = [F.array(*[c for c in _SKETCH if c[0] == x]).alias(f"{side}_{x}") for x in "st"]
    return classes.select(F.col("node").alias(key), F.col("n").alias(f"{side}_n"), F.col("level").alias(f"{side}_level"), *bitmaps)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, digest long, check long, bands array<long>, level int, " + ", ".join(f"{s} long" for s in _SKETCH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, sketcher = WordHasher(), Sketcher()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                items = shingle_set(hasher(text), size)
                doc = None if pd.isna(doc) else int(doc)
                if not len(items):
                    rows.append((doc, 0, 0, 0, None, 0, *[0] * len(_SKETCH)))
                    continue
                level = sampling_level(len(items))
                odd = [*sketcher.odd(items, level).tolist(), *sketcher.odd(items, level + 1).tolist()]
                rows.append((doc, len(items), *set_digest(items), sketcher.bands(sketcher.minhash(items)), level, *odd))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "check", "bands", "level", *_SKETCH])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def set_digest(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that together identify a set."""
    with np.errstate(over="ignore"):
        one = mix64(items ^ np.uint64(0xA0761D6478BD642F)).sum()
        two = mix64(items ^ np.uint64(0xE7037ED1A0B428DB)).sum()
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _nodes(pairs: DataFrame) -> DataFrame:
    """(node) of the pairs (u, v), once for each pair that a node is in."""
    return pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v"))


def _sets(docs: DataFrame, wanted: DataFrame, n: int, size: int) -> DataFrame:
    """(node, items) of the classes in ``wanted`` (node; n rows at most), read again from the texts of their first documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            items = [shingle_set(hasher(t), size).view(np.int64) for t in batch["text"].array]
            yield pd.DataFrame({"node": batch["doc_id"].astype("int64"), "items": items})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = possible(texts, "doc_id", wanted, n).join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return found.mapInPandas(run, "node long, items array<long>")


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have at least ``percent`` per cent of their union in common."""
    n = pairs.count()
    nodes = materialize(_nodes(pairs).distinct(), "wanted")
    sets = materialize(_sets(docs, nodes, 2 * n, size), "sets")
    discard(nodes)
    # the side with more pairs is joined last: its set meets them without being copied into them
    hubs = hot_keys(_nodes(pairs), "node", n)
    if hubs is None:
        turned = pairs.select(F.col("u").alias("x"), F.col("v").alias("y"))
    else:
        wide = F.broadcast(hubs.select(F.col("node").alias("u"), F.lit(True).alias("hub")))
        turned = pairs.join(wide, "u", "left").select(F.when(F.col("hub"), F.col("v")).otherwise(F.col("u")).alias("x"), F.when(F.col("hub"), F.col("u")).otherwise(F.col("v")).alias("y"))
    named = lambda c: None if hubs is None else hubs.withColumnRenamed("node", c)
    left = salted_join(turned, sets.select(F.col("node").alias("x"), F.col("items").alias("a")), "x", "y", named("x"))
    both = salted_join(left, sets.select(F.col("node").alias("y"), F.col("items").alias("b")), "y", "x", named("y"))
    common = F.size(F.array_intersect("a", "b"))
    kept = both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    edges = materialize(kept, "links")
    discard(sets)
    if hubs is not None:
        discard(hubs)
    return edges


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose odd sketches allow the threshold."""
    n = pairs.count()
    classes = possible(classes, "node", _nodes(pairs), 2 * n)
    with_u = salted_join(pairs, _side(classes, "u", "a"), "u", "v", hot_keys(pairs, "u", n))
    return salted_join(with_u, _side(classes, "v", "b"), "v", "u", hot_keys(pairs, "v", n)).where(similar_enough("a", "b", percent)).select("u", "v")


def _leftover(members: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) in a bucket but in different components, at least one outside the bucket's largest component, whose sketches allow the threshold."""
    named = members.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("label"))
    counts = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("bucket", F.col("top.label").alias("main"))
    open_ = named.join(mixed, "bucket").select("bucket", "node", "label", "size", (F.col("label") != F.col("main")).alias("outside"))
    # a side's row lies in one slice of its bucket and is copied to the blocks of all slices of the other side
    slices = F.ceil(F.col("size") / WIDE).cast("int")
    open_ = materialize(open_.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")), "open")
    n = open_.count()
    sketches = possible(classes, "node", open_.select("node"), n)
    every_slice = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    outside = open_.where("outside").withColumn("other", every_slice).select(F.xxhash64("bucket", "own", "other").alias("block"), "bucket", F.col("node").alias("x"), F.col("label").alias("x_label")).join(_side(sketches, "x", "a"), "x")
    every = open_.withColumn("other", every_slice).select(F.xxhash64("bucket", "other", "own").alias("block"), F.col("bucket").alias("y_bucket"), F.col("node").alias("y"), F.col("label").alias("y_label"), F.col("outside").alias("y_outside")).join(_side(sketches, "y", "b"), "y")
    # two outside members meet once
    once = (F.col("x_label") != F.col("y_label")) & (~F.col("y_outside") | (F.col("x") < F.col("y")))
    pairs = outside.withColumnRenamed("block", "x_block").join(every, (F.col("x_block") == F.col("block")) & (F.col("bucket") == F.col("y_bucket")) & once & similar_enough("a", "b", percent))
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents whose sets of ``size``-word shingles have at least ``percent``
    per cent of their union in common are linked; ``component_id`` is the
    smallest doc_id reachable and ``kept`` marks that document.  A text with
    fewer words is one shingle; null, empty and blank texts have no shingles
    and are linked with nothing.  Rows that share a doc_id count as one
    document for linking and stay separate rows.  A null doc_id is linked
    with nothing, has a null component and is kept.  Other columns are not
    used.  An empty table gives no rows.
    """
    sketched = materialize(_sketched(docs, size), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    firsts = full.groupBy("digest", "check").agg(F.min("doc_id").alias("node"))
    named = materialize(firsts, "classes")
    # repeated rows go where the join has put them, so that bands and sketches are shuffled once
    own = full.join(named.withColumnRenamed("node", "doc_id"), ["digest", "check", "doc_id"]).dropDuplicates(["digest", "check", "doc_id"])
    classes = materialize(own.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "level", "bands", *_SKETCH), "nodes")
    entries = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = materialize(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = materialize(possible(entries, "bucket", sizes.select("bucket"), sizes.count()).join(sizes, "bucket"), "buckets")

    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    heads = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top")).select("bucket", F.col("top.node").alias("head"))
    wide = hot_keys(members, "bucket", members.count())
    star = salted_join(members, heads, "bucket", "node", wide).where("node != head").select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")).distinct()
    star = materialize(star, "stars")
    first = materialize(_promising(star, classes, percent), "pairs")
    links = _confirm(first, docs, size, percent)
    labels = materialize(components(links), "labels")

    second = materialize(_leftover(members, labels, classes, percent).join(first, ["u", "v"], "left_anti"), "pairs")
    more = _confirm(second, docs, size, percent)
    # rows that share a doc_id, in different classes, are one document
    shared = full.join(named, ["digest", "check"]).where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    repeated = full.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select(F.col("doc_id").alias("u"))
    shared = shared.join(repeated, "u", "left_semi").select("u", "v")
    final = materialize(components(links.unionByName(more).unionByName(shared)), "labels")
    for df in (first, second, members, sizes, classes, labels, star, links, more):
        discard(df)

    owner = named.join(final, "node", "left").select("digest", "check", F.coalesce("component", "node").alias("component_id"))
    linked = full.join(owner, ["digest", "check"]).select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
