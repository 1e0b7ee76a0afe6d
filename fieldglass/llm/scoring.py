"""Language-model scores of texts.

The model is a causal self-attention network with one place for each word
(:mod:`.attention`) and a memory of the whole corpus.

* The network gives the probabilities of slots.  The most frequent words have a
  slot each; other words that the network's table holds share slots by their
  last two bytes, and follow their frequency in it.  All others, among them
  those that occur once in training, are rare: they share slots by their last
  two bytes, too, and are equally likely in it.  Words that never occur in
  training are one such word in each slot, as they are one word in the base
  score; words that occur once teach the network when to expect them.
* The network is trained on all training rows.  Rounds take disjoint shares of
  the rows, each larger than the one before; in a round every task trains on
  its own rows from the same start, and Spark averages the tasks' parameters.
* The memory holds phrases.  A text is cut where the hash of three words in a
  row says so, and every ``LONGEST`` words; what follows such a context up to
  the next cut is a phrase.  A phrase is a copy from the memory with
  probability g, drawn as the training rows continued the same context, else it
  is the network's.  So texts that occur elsewhere are told apart.  A training
  row's own occurrence is taken off, so no text remembers itself.

Word probabilities of the network sum to 1, over the training words, one
unknown word for each slot of rare words, and slots that no training word has,
which a small table leaves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import BATCH, BEGIN_CLASSES, BLOCK, INNER_CLASSES, MEMBERS, Blocks, Params, Trainer, Units, initial, pack, score, unpack
from .core import LOWER, UPPER, WordHasher, discard, keep_memory, materialize, mix64, share, shared, window_hashes

#: Slots of words of their own, of the other words of the table and of rare words, by endings; the last slot is the end of a text.
OWN, GROUPS, RARE = 1_200, BEGIN_CLASSES * MEMBERS - 1_201, INNER_CLASSES * MEMBERS
VOCABULARY = OWN + GROUPS + RARE + 1
END_ID = VOCABULARY - 1
#: The end of a text among the words; no word can hold a line feed.
END = "\n"
_END = END.encode()
#: The most frequent words and phrases, whose counts each task holds; all others are joined.
FREQUENT_WORDS, FREQUENT_PHRASES = 500_000, 20_000
#: The most words in the network's table; those that occur once are never in it.
TABLE_WORDS = 131_072
#: Shares of the training rows that the rounds of a pass take, in sixteenths.
ROUNDS = (1, 1, 2, 4, 8)
#: Step sizes of the last two rounds; those before take the first.
RATES = (0.01, 0.006, 0.003)
#: Small tables are gone over again, until so many ids are seen or ``MOST_PASSES`` are done.
LEAST_IDS, MOST_PASSES = 4_000_000, 4
#: Batches of training are as large as gives about so many over all rows, up to the network's own bound.
STEPS = 1_500
#: Words of a phrase's context; one context in so many begins a phrase; a phrase's most words.
CONTEXT, EVERY, LONGEST = 3, 32, 64
#: Words that are gathered from several texts before they are scored or learned from.
BATCH_WORDS = 32_768
#: Distinct words that a task counts before it sends them on.
DISTINCT = 400_000
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; ``bytes.split`` parts at just the separators of the word rule."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()


# -- phrases -------------------------------------------------------------------------

with np.errstate(over="ignore"):
    _POWERS = np.multiply.accumulate(np.full(LONGEST + 1, 0x9DDFEA08EB382D69, dtype=np.uint64))
_END_HASH = np.uint64(0x1B873593CC9E2D51)


def phrases(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, context, phrase) of each phrase of a text with these word hashes; the text's end counts as a word of the last one."""
    none = np.empty(0, dtype=np.int64)
    if len(words) < CONTEXT:
        return none, none, none
    contexts = window_hashes(words, CONTEXT)  # number i ends before word i + CONTEXT
    cuts = np.flatnonzero(contexts % np.uint64(EVERY) == 0) + CONTEXT
    if not len(cuts):
        return none, none, none
    # more cuts in gaps that are too long
    ends = np.concatenate((cuts[1:], [len(words) + 1]))
    pieces = -(-(ends - cuts) // LONGEST)
    starts = np.repeat(cuts - LONGEST * (np.cumsum(pieces) - pieces), pieces) + LONGEST * np.arange(pieces.sum())
    flat = np.append(words, _END_HASH)[starts[0] :]
    place = np.arange(len(flat)) - np.repeat(starts - starts[0], np.diff(np.append(starts - starts[0], len(flat))))
    with np.errstate(over="ignore"):
        phrase = mix64(np.add.reduceat(flat * _POWERS[place], starts - starts[0]))
    return starts, contexts[starts - CONTEXT].view(np.int64), phrase.view(np.int64)


def phrase_key(context: int, phrase: int) -> str:
    """The key of a phrase among the words."""
    return f"{END}{context}:{phrase}"


# -- words as arrays --------------------------------------------------------------------


class HashMap:
    """Places of distinct 64-bit hashes; ``find`` looks up whole arrays."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        bits = max(4, (4 * n).bit_length())
        self.n, self.shift, self.last = n, np.uint64(64 - bits), (1 << bits) - 1
        self.hashes, self.places = np.append(hashes, np.uint64(0)), np.full(1 << bits, n, np.int32)
        todo = np.arange(n, dtype=np.int32)
        at = (hashes >> self.shift).astype(np.int64)
        while len(todo):
            free = self.places[at] == n
            self.places[at[free]] = todo[free]
            lost = self.places[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.last

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each; the number of hashes held where there is none."""
        at = (hashes >> self.shift).astype(np.int64)
        out = self.places.take(at)
        wrong = np.flatnonzero((self.hashes.take(out) != hashes) & (out < self.n))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            out[wrong] = now = self.places[at[wrong]]
            wrong = wrong[(self.hashes[now] != hashes[wrong]) & (now < self.n)]
        return out


@dataclass
class Text:
    """Words of a text: ``raw`` bytes, where each word starts and ends there, and the hashes of the words and of the text's end."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def endings(self, at: np.ndarray) -> np.ndarray:
        """The last byte of each of these words and the one before, as one number; 256 stands before a word's first byte."""
        ends = self.ends[at]
        return self.raw[ends - 1].astype(np.int64) * 257 + np.where(ends - self.starts[at] > 1, self.raw[ends - 2].astype(np.int64), 256)

    def name(self, i: int) -> str:
        return END if i == len(self.starts) else self.raw[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "surrogatepass")


class WordTable:
    """Reads texts as arrays of words."""

    def __init__(self, hasher: WordHasher | None = None) -> None:
        self.hasher = hasher or WordHasher()

    def read(self, text: str | None) -> Text:
        raw, starts, ends, hashes = self.hasher.words(text)
        return Text(raw, starts, ends, np.append(hashes, _END_HASH))

    def number(self, words: list[bytes]) -> Text:
        return self.read(b" ".join(words).decode("utf-8", "surrogatepass"))


def _gathered(texts: Iterator[str | None], table: WordTable) -> Iterator[list[Text]]:
    """Texts in lists of about ``BATCH_WORDS``."""
    out: list[Text] = []
    held = 0
    for text in texts:
        out.append(table.read(None if text is pd.NA else text))
        held += len(out[-1].hashes)
        if held >= BATCH_WORDS:
            yield out
            out, held = [], 0
    if out:
        yield out


def _by_ending(endings: np.ndarray, n: int) -> np.ndarray:
    return ((endings * 2_654_435_761) >> 12) % n


@dataclass
class WordUnits(Units):
    """Units of slots, with the table of words: ``slot`` of each and ``inside``, its log share of the slot; the end of a text is in it.

    ``each`` is the log share of a rare word by slot, 0 for other slots.
    """

    table: HashMap
    slot: np.ndarray
    inside: np.ndarray
    each: np.ndarray

    def slots_of(self, texts: list[Text]) -> tuple[list[np.ndarray], np.ndarray]:
        """Slots of the words of each text, and the log shares of all words in them."""
        place = self.table.find(np.concatenate([t.hashes for t in texts]))
        slots = self.slot.take(place)
        streams, at = [], 0
        for t in texts:
            mine = slots[at : at + len(t.hashes)]
            at += len(t.hashes)
            rare = np.flatnonzero(mine < 0)
            mine[rare] = OWN + GROUPS + _by_ending(t.endings(rare), RARE)
            streams.append(mine)
        return streams, self.inside.take(place) + self.each.take(slots)


def word_log_probs(params: Params, units: WordUnits, table: WordTable, texts: list[Text]) -> list[np.ndarray]:
    """Natural log p(word | words before), of each word of each text; every text ends in END."""
    streams, share_of_slot = units.slots_of(texts)
    blocks = Blocks.cut(streams, units, END_ID)
    lp = score(params, units, blocks)[0][blocks.place] + share_of_slot
    return np.split(lp, np.cumsum([len(s) for s in streams])[:-1])


# -- counts over all training rows -------------------------------------------------------


def _is_training(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(word, context, phrase, c) over ``rows`` (text): of each word, with one END for each row, and of each phrase, whose word is null.

    Tasks count what they hold, so a frequent word or phrase is one row of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept, hasher = Counter(), Counter(), WordHasher()

        def flush() -> pa.RecordBatch:
            none, n, m = None, len(words), len(kept)
            pairs = list(zip(*kept, strict=True)) or [(), ()]
            columns = [
                pa.array([*words, *[none] * m], pa.binary()).cast(pa.string()),
                pa.array([*[none] * n, *pairs[0]], pa.int64()),
                pa.array([*[none] * n, *pairs[1]], pa.int64()),
                pa.array([*words.values(), *kept.values()], pa.int64()),
            ]
            words.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "context", "phrase", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(words_of(text))
                words[_END] += 1
                _, context, phrase = phrases(hasher(text))
                kept.update(zip(context.tolist(), phrase.tolist(), strict=True))
                if len(words) + len(kept) > DISTINCT:
                    yield flush()
        yield flush()

    partial = rows.select("text").mapInArrow(run, "word string, context long, phrase long, c long")
    return partial.groupBy("word", "context", "phrase").agg(F.sum("c").alias("c"))


def _least(counts: DataFrame, room: int) -> int:
    """The lowest count that leaves no more than ``room`` rows, from a histogram of counts."""
    least = 1
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).toLocalIterator():
        room -= r.k
        if room < 0:
            return r.c + 1
    return least


def _arrays(rows: DataFrame) -> list[np.ndarray]:
    """The columns, all long, of a table of bounded size; they reach the driver as bytes, not as rows."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({n: [b[n].to_numpy(np.int64).tobytes()] for n in names})

    parts = rows.mapInPandas(run, ", ".join(f"{n} binary" for n in names)).collect()
    return [np.frombuffer(b"".join(bytes(r[n]) for r in parts), np.int64) for n in names]


def _read(words: pd.Series) -> Text:
    """Words, none of them END, as one text."""
    return WordTable().read(" ".join(words))


def _hashed(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending and count of each of ``words`` (word, c), none of them END."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = _read(b["word"])
            yield pd.DataFrame({"h": text.hashes[:-1].view(np.int64), "e": text.endings(np.arange(len(b))), "c": b["c"]})

    h, e, c = _arrays(words.mapInPandas(run, "h long, e long, c long"))
    return h.view(np.uint64), e, c


def _rare_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and number of the rare ``words`` (word, c) of each slot; what leaves a task is bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, each = np.zeros(RARE), np.zeros(RARE)
        for b in batches:
            slot = _by_ending(_read(b["word"]).endings(np.arange(len(b))), RARE)
            total += np.bincount(slot, b["c"], minlength=RARE)
            each += np.bincount(slot, minlength=RARE)
        yield pd.DataFrame({"slot": np.arange(RARE), "n": total.astype(np.int64), "k": each.astype(np.int64)})

    sums = words.mapInPandas(run, "slot long, n long, k long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total, each = np.zeros(RARE, dtype=np.int64), np.zeros(RARE, dtype=np.int64)
    slot, n, k = _arrays(sums)
    total[slot], each[slot] = n, k
    return total, each


def word_units(words: DataFrame, rows: int) -> WordUnits:
    """The network's units and table, from the counts (word, c) of all training words of so many rows."""
    real = words.where(F.col("word") != END)
    least = max(2, _least(real, TABLE_WORDS))
    hashes, endings, c = _hashed(real.where(F.col("c") >= least))
    order = np.lexsort((hashes, -c))
    hashes, endings, c = hashes[order], endings[order], c[order]
    slot = np.where(np.arange(len(c)) < OWN, np.arange(len(c)), OWN + _by_ending(endings, GROUPS))
    rare, kinds_of_rare = _rare_counts(real.where(F.col("c") < least))
    counts = np.bincount(slot, c, minlength=VOCABULARY)
    counts[OWN + GROUPS : END_ID], counts[END_ID] = rare, rows
    kinds = np.arange(VOCABULARY) < OWN + GROUPS
    kinds[END_ID] = True
    plain = Units.build(counts, kinds)
    inside = np.log(c / counts[slot])
    each = np.zeros(VOCABULARY)
    each[OWN + GROUPS : END_ID] = -np.log(kinds_of_rare + 1.0)
    # the last two entries are the end of a text and any word that is not in the table
    table, slot = HashMap(np.append(hashes, _END_HASH)), np.concatenate((slot, [END_ID, -1]))
    return WordUnits(plain.of, plain.log_share, plain.mass, table, slot, np.append(inside, [0.0, 0.0]), each)


# -- training ------------------------------------------------------------------------------


def train_network(rows: DataFrame, units: WordUnits, ids: int) -> Params:
    """The network's parameters after training on all ``rows`` (text), which hold so many words and ends.

    In each pass a row belongs to one round by the hash of its text.  What a
    task sends is one vector of fixed size; the driver gets one for each round.
    """
    batch = int(np.clip(ids / BLOCK / STEPS, 16, BATCH))
    passes = int(np.clip(-(-LEAST_IDS // max(1, ids)), 1, MOST_PASSES))
    ends = np.cumsum(ROUNDS).tolist()
    rounds = [*zip([0, *ends[:-1]], ends, strict=True), *[(0, ends[-1])] * (passes - 1)]
    spark = rows.sparkSession
    params = initial(units)
    share_of = F.pmod(F.xxhash64("text"), F.lit(sum(ROUNDS)))
    for i, (begin, end) in enumerate(rounds):
        rate = RATES[max(0, i - len(rounds) + 3)] if i + 3 > len(rounds) else RATES[0]
        sent = share(spark, (params, units))

        def run(batches: Iterator[pd.DataFrame], sent: object = sent, rate: float = rate) -> Iterator[pd.DataFrame]:
            start, known = shared(sent)
            keep_memory()
            trainer = Trainer(start, known, batch, rate)
            for texts in _gathered((t for b in batches for t in b["text"].array), WordTable()):
                trainer.learn(Blocks.cut(known.slots_of(texts)[0], known, END_ID))
            if trainer.seen:
                yield pd.DataFrame({"seen": [trainer.seen], "flat": [(pack(trainer.params) * np.float64(trainer.seen)).tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, total = 0, None
            for b in batches:
                for n, flat in zip(b["seen"], b["flat"], strict=True):
                    part = np.frombuffer(flat)
                    seen, total = seen + n, part.copy() if total is None else total + part
            if seen:
                yield pd.DataFrame({"seen": [seen], "flat": [total.tobytes()]})

        schema = "seen long, flat binary"
        mine = rows.where((share_of >= begin) & (share_of < end)).select("text")
        sums = mine.mapInPandas(run, schema).repartition(16).mapInPandas(add, schema).repartition(1).mapInPandas(add, schema).collect()
        for r in sums:
            params = unpack((np.frombuffer(bytes(r.flat)) / r.seen).astype(np.float32))
        sent.destroy()
    return params


@dataclass
class TextModel:
    params: Params
    units: WordUnits
    copies: float  #: g, the probability that a phrase is a copy
    n: int  #: training tokens
    v: int  #: distinct ones
    words: HashMap  #: frequent words
    counts: np.ndarray  #: and their counts; the last entry, -1, stands for all others
    phrases: dict[tuple[int, int], tuple[int, int]]  #: counts of frequent phrases and of their contexts


def fit_text_model(docs: DataFrame, training: Column) -> tuple[TextModel, DataFrame, DataFrame]:
    """The model; the table (word, c, of) of the counts that it does not hold, which stays distributed; and the scratch table of all counts.

    ``of`` is the count of a phrase's context, null for words.
    """
    rows = docs.where(training)
    counts = materialize(corpus_counts(rows.select("text")), "counts")
    words, kept = counts.where("word is not null").select("word", "c"), counts.where("word is null").select("context", "phrase", "c")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    copied, every = kept.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    least_word, least_phrase = _least(words, FREQUENT_WORDS), _least(kept, FREQUENT_PHRASES)
    ends = words.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top, _, top_counts = _hashed(words.where((F.col("c") >= least_word) & (F.col("word") != END)))
    if ends >= least_word:
        top, top_counts = np.append(top, _END_HASH), np.append(top_counts, ends)
    remembered = kept.join(kept.groupBy("context").agg(F.sum("c").alias("of")), "context")
    often = {(r.context, r.phrase): (r.c, r.of) for r in remembered.where(F.col("c") >= least_phrase).collect()}
    units = word_units(words, ends)
    params = train_network(rows, units, int(n))
    rare = words.where(F.col("c") < least_word).select("word", "c", F.lit(None).cast("long").alias("of"))
    key = F.concat(F.lit(END), F.col("context").cast("string"), F.lit(":"), F.col("phrase").cast("string"))
    looked_up = rare.unionByName(remembered.where(F.col("c") < least_phrase).select(key.alias("word"), "c", "of"))
    copies = float(np.clip(copied / max(1, every), 1e-4, 0.5))
    return TextModel(params, units, copies, int(n), int(v), HashMap(top), np.append(top_counts, -1), often), looked_up, counts


def score_texts(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, network_score and score.

    ``training`` marks the rows to learn from; by default those whose
    crc32(doc_id as text) modulo 7 is not 2, and those with a null doc_id.
    Scores are log10 probabilities of all words and the end of the text:
    ``base_score`` by the add-one word frequencies, ``network_score`` by the
    network alone, ``score`` by the network and the memory.  Null and empty
    texts are one end token.  Repeated rows are scored each; an empty table
    gives no rows.  Other columns are not used.

    Counts of frequent words and phrases are looked up in the task.  Other
    occurrences are joined with the distributed counts and summed for each row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = _is_training(F.col("doc_id")) if training is None else training
    model, looked_up, scratch = fit_text_model(rows, training)
    sent = share(docs.sparkSession, model)
    base = float(model.n + model.v + 1)
    g = model.copies

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: TextModel = shared(sent)
        table = WordTable()
        keep_memory()
        for batch in batches:
            out = []
            for group in _gathered(iter(batch["text"].array), table):
                every = m.counts.take(m.words.find(np.concatenate([t.hashes for t in group])))
                at = 0
                for text, lp in zip(group, word_log_probs(m.params, m.units, table, group), strict=True):
                    held = batch["held_out"].iat[len(out)]
                    c = every[at : at + len(lp)]
                    at += len(lp)
                    sure = c >= 0
                    keys = [text.name(i) for i in np.flatnonzero(~sure).tolist()]
                    lps, gain = [None] * len(keys), 0.0
                    starts, context, phrase = phrases(text.hashes[:-1])
                    if len(starts):
                        sums = np.add.reduceat(lp, starts).tolist()
                        for a, b, s in zip(context.tolist(), phrase.tolist(), sums, strict=True):
                            if (a, b) in m.phrases:
                                times, of = m.phrases[a, b]
                                gain += memory_gain(times, of, s, m.copies, not held)
                            else:
                                keys.append(phrase_key(a, b))
                                lps.append(s)
                    network = float(lp.sum()) / np.log(10)
                    out.append((len(lp), int((c > 0).sum()), float(np.log10((c[sure] + 1.0) / base).sum()), network, network + gain, keys, lps))
            frame = pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "network", "score", "keys", "lps"])
            frame.insert(0, "held_out", batch["held_out"].to_numpy())
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, network double, score double, keys array<string>, lps array<float>"
    scored = materialize(rows.withColumn("held_out", ~training).mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    items = scored.select("row", F.col("held_out").alias("held"), F.explode(F.arrays_zip("keys", "lps")).alias("x")).select("row", "held", F.col("x.keys").alias("word"), F.col("x.lps").alias("lp"))
    joined = items.join(looked_up, "word", "left")
    is_word = F.col("lp").isNull()
    c, own = F.coalesce("c", F.lit(0)), F.when(F.col("held"), 0).otherwise(1)
    copied = F.when(F.col("c") > own, F.ln(F.lit(g) * (F.col("c") - own) / (F.col("of") - own)) - F.col("lp").cast("double"))
    alone = float(np.log1p(-g))
    # log of the sum of both ways to the phrase, over the network's way
    gain = F.when(copied.isNull(), alone).otherwise(F.greatest(copied, F.lit(alone)) + F.log1p(F.exp(-F.abs(copied - alone)))) / float(np.log(10))
    each = joined.select(
        "row",
        F.when(is_word, F.log10((c + 1.0) / base)).otherwise(0.0).alias("b"),
        F.when(is_word & F.col("c").isNotNull(), 1).otherwise(0).alias("known"),
        F.when(is_word, 0.0).otherwise(gain).alias("gain"),
    )
    sums = each.groupBy("row").agg(F.sum("b").alias("b"), F.sum("known").alias("known"), F.sum("gain").alias("gain"))
    total = scored.drop("keys", "lps").join(sums, "row", "left")
    whole = lambda a, b, name: (F.col(a) + F.coalesce(b, F.lit(0))).alias(name)
    done = total.select("doc_id", "held_out", "n_tokens", whole("n_known", "known", "n_known"), F.lit(model.n).cast("long").alias("train_tokens"), whole("base", "b", "base_score"), F.col("network").alias("network_score"), whole("score", "gain", "score"))
    out = materialize(done, "scores")
    discard(scored)
    discard(scratch)
    return out


def memory_gain(times: int, of: int, lp: float, g: float, own: bool) -> float:
    """What the memory adds to the log10 probability of a phrase that the network gives exp(``lp``); ``own`` takes one occurrence off."""
    alone = np.log1p(-g)
    if times <= own:
        return float(alone / np.log(10))
    return float(np.logaddexp(np.log(g * (times - own) / (of - own)) - lp, alone) / np.log(10))
