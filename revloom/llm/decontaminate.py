"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

The score is the alignment's share of a perfect one, for the best local alignment of a text and an item word by word
(match +2, mismatch -1, gap -1). Every pair of document and item from the threshold on is found: what precedes the
alignment leaves out only what cannot reach it.

* A score from ``threshold`` on takes at least ``threshold`` of the item's words, and at most (3 - 2 threshold) times its
  length of the text. With m words needed of n, any n - m + c of them hold c that match.
* A first pass counts the words of the items in the corpus; the rarest n - m + c words of an item are its seeds (words
  that occur nowhere among them). A second pass looks for ``HITS`` = c seeds of an item within that length of text.
* Where the text around them has m words of the item within that length, all such stretches are aligned.

Texts are never shuffled: the items go to the texts, in blocks of at most ``BLOCK_WORDS`` words (the proven
bound of what is broadcast), one pass per block.

Null and empty texts have no hit. Null and empty items match nothing. Items with less than ``SEED`` words must
occur whole. Rows are reported per document row, so repeated rows repeat. A null doc_id or
item_id is reported as null. Other columns are ignored.
"""

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.llm.words import text_of, words

SEED = 4
HITS = 5
THRESHOLD = 0.5
BLOCK_WORDS = 500_000
# known words that a task holds before it counts them
COUNTED = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, 1


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: its score and where it ends in ``window``.

    Row by row; gaps along a row are resolved with a running maximum.
    """
    steps = GAP * np.arange(1, len(window) + 1)
    above = np.zeros(len(window) + 1, dtype=np.int64)
    # the gain of every place of the window, once per distinct word of the item
    gains = {word: np.where(window == word, MATCH, MISMATCH) for word in set(item.tolist())}
    best, end = 0, 0
    for word in item.tolist():
        here = gains[word] + above[:-1]
        np.maximum(here, above[1:] - GAP, out=here)
        np.maximum(here, 0, out=here)
        here += steps
        np.maximum.accumulate(here, out=here)
        here -= steps
        above[1:] = here
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top + 1
    return best, end


class Vocabulary:
    """The distinct words of a block of items, numbered. Texts are read as numbers of these words: all other words are
    -1, which matches nothing, so that most words of a text cost one look-up and are not hashed or kept."""

    def __init__(self, items: list[list[bytes]]):
        self.number = {word: k for k, word in enumerate(sorted({w for item in items for w in item}))}

    def __len__(self) -> int:
        return len(self.number)

    def read(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, found, repeat(-1)), dtype=np.int64, count=len(found))


class Seeds:
    """Seed words of a block of items, and what an alignment from the threshold on takes at least."""

    def __init__(self, items: list[np.ndarray], counts: np.ndarray, threshold: float = THRESHOLD, short: int = SEED):
        self.items = items
        sizes = np.array([len(i) for i in items], dtype=np.int64)
        # a short item is found whole or not at all
        self.least = np.where(sizes < short, max(threshold, 1.0), threshold)
        self.needed = np.maximum(np.ceil(self.least * sizes - 1e-9), 1).astype(np.int64)
        self.span = np.maximum(np.floor((3 - 2 * self.least) * sizes + 1e-9), 1).astype(np.int64)
        self.hits = np.minimum(self.needed, HITS)
        self.words = [np.unique(i) for i in items]
        chosen, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, item in enumerate(items):
            distinct, times = np.unique(item, return_counts=True)
            order = np.argsort(counts[distinct], kind="stable")
            # with all places of a word, until so many are left that the others alone cannot do
            before = np.cumsum(times[order]) - times[order]
            rare = distinct[order][before < len(item) - self.needed[i] + self.hits[i]]
            chosen.append(rare)
            owners.append(np.full(len(rare), i))
        word, owner = np.concatenate(chosen), np.concatenate(owners)
        order = np.argsort(word, kind="stable")
        self.owner = owner[order]
        # the seeds of word k stand at first[k] up to first[k + 1]; the last word is the unknown one, which has none
        self.first = np.searchsorted(word[order], np.arange(len(counts) + 1))
        self.many = np.append(np.diff(self.first), 0)

    def look_up(self, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, items) of all hits, by item and place."""
        count = self.many[read]
        at = np.flatnonzero(count)
        count = count[at]
        low = self.first[read[at]]
        skipped = np.cumsum(count) - count
        owner = self.owner[np.repeat(low - skipped, count) + np.arange(count.sum())]
        at = np.repeat(at, count)
        order = np.argsort(owner, kind="stable")
        return at[order], owner[order]


def _count_words(batches, shared):
    """(word, n): how often each word of the items occurs, summed up per task."""
    vocabulary = shared.value
    totals = np.zeros(len(vocabulary), dtype=np.int64)
    for batch in batches:
        held, size = [], 0
        for text in text_of(batch, "text"):
            read = vocabulary.read(words(text))
            held.append(read[read >= 0])
            size += len(held[-1])
            if size > COUNTED:
                totals += np.bincount(np.concatenate(held), minlength=len(totals))
                held, size = [], 0
        if held:
            totals += np.bincount(np.concatenate(held), minlength=len(totals))
    some = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(totals[some], pa.int64())],
                                     names=["word", "n"])


def _united(low: np.ndarray, high: np.ndarray):
    """Stretches [low, high), in order of ``low``, with those that meet as one."""
    if len(low):
        reach = np.maximum.accumulate(high)
        cut = np.flatnonzero(low[1:] > reach[:-1]) + 1
        yield from zip(low[np.concatenate([[0], cut])].tolist(),
                       reach[np.concatenate([cut - 1, [len(low) - 1]])].tolist())


def _stretches(read: np.ndarray, seeds: Seeds):
    """(item, low, high): all stretches of a text where an alignment may reach the threshold."""
    at, owner = seeds.look_up(read)
    if not len(at):
        return
    last = np.arange(len(at)) + seeds.hits[owner] - 1
    inside = last < len(at)
    first, last = np.flatnonzero(inside), last[inside]
    near = (owner[first] == owner[last]) & (at[last] - at[first] < seeds.span[owner[first]])
    first, last = first[near], last[near]
    for i in np.unique(owner[first]).tolist():
        mine, span = owner[first] == i, int(seeds.span[i])
        low = np.maximum(at[last[mine]] - span + 1, 0)
        high = np.minimum(at[first[mine]] + span, len(read))
        for start, end in _united(low, high):
            part, known = read[start:end], seeds.words[i]
            own = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum(known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part, out=own[1:])
            width = min(span, end - start)
            rich = start + np.flatnonzero(own[width:] - own[:-width] >= seeds.needed[i])
            for from_, to in _united(rich, rich + width):
                yield i, from_, to


def best_alignments(read: np.ndarray, seeds: Seeds) -> dict[int, tuple]:
    """Item -> (score, end word) of the best alignment with a text, for all items that reach their least score."""
    found: dict[int, tuple] = {}
    for owner, low, high in _stretches(read, seeds):
        item = seeds.items[owner]
        score, end = align(item, read[low:high])
        share = score / (MATCH * len(item))
        if share >= seeds.least[owner] and share > found.get(owner, (0.0, 0))[0]:
            found[owner] = (share, low + end)
    return found


def _align_all(batches, shared):
    seeds, ids, vocabulary = shared.value
    for batch in batches:
        rows = []
        for doc, text in zip(text_of(batch, "doc_id"), text_of(batch, "text")):
            for owner, (share, end) in best_alignments(vocabulary.read(words(text)), seeds).items():
                rows.append((doc, ids[owner], share, end, len(seeds.items[owner])))
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(
                columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
            names=["doc_id", "item_id", "score", "end_word", "item_words"])


def _blocks(benchmark: DataFrame, block_words: int):
    """The items in blocks of about ``block_words`` words; each comes to the driver on its own."""
    items = benchmark.select("item_id", "text").filter(F.length(F.trim("text")) > 0).distinct()
    # a word takes two characters at least
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * block_words)))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r.item_id, words(r.text)) for r in part.collect()]
        rows = [(i, w) for i, w in rows if len(w)]
        yield [i for i, _ in rows], [w for _, w in rows]


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, end_word, item_words): the best alignment of each document and item from
    ``threshold`` on; items with less than ``seed`` words must occur whole. Counts words when called; the alignment
    itself is lazy."""
    spark = documents.sparkSession
    texts = documents.select("text")
    results = []
    for ids, items in _blocks(benchmark, block_words):
        vocabulary = Vocabulary(items)
        shared = spark.sparkContext.broadcast(vocabulary)
        counts = texts.mapInArrow(partial(_count_words, shared=shared), "word long, n long").groupBy(
            "word").agg(F.sum("n").alias("n"))
        known = np.zeros(len(vocabulary), dtype=np.int64)
        for r in counts.collect():
            known[r.word] = r.n
        final = spark.sparkContext.broadcast(
            (Seeds([vocabulary.read(i) for i in items], known, threshold, seed), ids, vocabulary))
        results.append(documents.select("doc_id", "text").mapInArrow(
            partial(_align_all, shared=final),
            "doc_id long, item_id long, score double, end_word long, item_words long"))
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return found


def remove_contaminated(documents: DataFrame, benchmark: DataFrame,
                        threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no test item was found, with their columns. Rows without doc_id stay."""
    found = contaminated(documents, benchmark, threshold).select("doc_id").filter(
        F.col("doc_id").isNotNull()).distinct()
    return documents.join(found, "doc_id", "left_anti").select(*documents.columns)
