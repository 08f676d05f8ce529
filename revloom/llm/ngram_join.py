"""N-gram Jaccard self join of documents by rare-first prefix filtering.

A document is the set of its distinct word shingles; two link when their Jaccard similarity reaches
``similarity`` (percent). Equal sets form one class and are handled once, so copies are never paired.

* **Order.** Shingles are ordered by how often they occur, rarest first, then by hash. Occurrences are
  counted over all documents in ``CELLS`` counters, a table of fixed size; shingles that share a counter
  only order less well. Any order that is the same everywhere loses nothing.
* **Prefix.** Sets of size n that link share one of their first n - ceil(t n) + 1 shingles, so only these
  are shuffled, and those that no other set has are left out at once.
* **Filters.** Length: t max(n) <= min(n). Position: the shingles after the shared one must suffice.
  Suffix: parities of the shingles over hash cells bound the number of shingles two sets do not share
  from below; 512 cells are folded into the join, finer ones (about four per shingle) follow.
* **Verification** counts the shared shingles of each remaining pair exactly and once.
* **Hot shingles.** The counters tell which shingles many sets may have; these are shared anyway and go to as many tasks
  as their count asks for, instead of one. Facts of a shingle come from partial aggregates that are joined back, so
  adaptive execution can split what is left.

A large group of near copies would offer all its pairs. Links only matter for the components, so the first
round pairs the sets of each prefix shingle with one of them (the one with most copies); the second pairs
only sets of different components, which leaves out no link between components.

Rows with null or empty text, or without words, are documents with no shingle and no link. Equal texts,
ties and repeated ids are separate rows with the same component; a component's id is its least doc_id and is
null only if no member has one. Other columns are ignored.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from revloom.llm.components import components
from revloom.llm.words import WordHashes, shingle_hashes, text_of, word_hashes, words
from revloom.plans.runtime import Scratch

WIDTH = 5
SIMILARITY = 75
CELLS = 1 << 20
CHUNK = 1 << 12
# rows of a shingle that one task takes; more where a counter holds more than that on average
HOT_ROWS = 50_000
FOLDS = 8
_FOLD_NAMES = [f"s{i}" for i in range(FOLDS)]


def least_overlap(size: int, similarity: int) -> int:
    """ceil(t n): shingles that any partner must share with a set of this size."""
    return -(-similarity * size // 100)


def _token_set(text, width: int, cache: WordHashes) -> np.ndarray:
    """Distinct shingle hashes of the whole text, ascending."""
    return np.unique(shingle_hashes(word_hashes(words(text), cache), width))


def _fingerprint(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def parity_bits(tokens: np.ndarray) -> bytes:
    """Parity of the number of shingles per hash cell; at least 512 cells and four per shingle."""
    cells = max(64 * FOLDS, 1 << int(4 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold_bits(bits: np.ndarray, size: int) -> np.ndarray:
    """Halve the number of cells until ``size`` bytes are left."""
    while len(bits) > size:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def _describe(batches, width: int):
    """One row per document, and at the end the task's counters in chunks."""
    cache, seen = WordHashes(), set()
    counters = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        prints, sizes, bits, folds, fresh = [], [], [], [], []
        for doc, text in zip(text_of(batch, "doc_id"), text_of(batch, "text")):
            tokens = _token_set(text, width, cache)
            # without shingles a document is a class of its own
            own = _fingerprint(tokens) if len(tokens) else xxhash.xxh3_64_intdigest(f"none {doc}")
            packed = parity_bits(tokens)
            prints.append(own), sizes.append(len(tokens)), bits.append(packed)
            folds.append(fold_bits(np.frombuffer(packed, np.uint8), 8 * FOLDS).view(np.int64))
            if own not in seen:
                seen.add(own)
                fresh.append((tokens & np.uint64(CELLS - 1)).astype(np.int64))
        if fresh:
            counters += np.bincount(np.concatenate(fresh), minlength=CELLS)
        if prints:
            n, table = len(prints), np.vstack(folds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("key"), _signed(prints), pa.array(sizes, pa.int64()),
                 pa.array(bits, pa.binary()), *[pa.array(table[:, i]) for i in range(FOLDS)],
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "key", "fp", "n", "bits", *_FOLD_NAMES, "chunk", "counts"])
    full = np.flatnonzero(counters.reshape(-1, CHUNK).any(axis=1))
    if len(full):
        counts = np.minimum(counters, 65535).astype(np.uint16).reshape(-1, CHUNK)
        n = len(full)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.binary())]
            + [pa.nulls(n, pa.int64())] * FOLDS
            + [pa.array(full.astype(np.int32)), pa.array([counts[i].tobytes() for i in full], pa.binary())],
            names=["doc_id", "key", "fp", "n", "bits", *_FOLD_NAMES, "chunk", "counts"])


_DESCRIBED = ("doc_id long, key long, fp long, n long, bits binary, "
              + ", ".join(f"{s} long" for s in _FOLD_NAMES) + ", chunk int, counts binary")


def _add_up(batches):
    """Sum the counters of each chunk, one batch at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(text_of(batch, "chunk"), text_of(batch, "counts")):
            own = sums.setdefault(chunk, np.zeros(CHUNK, dtype=np.int64))
            own += np.frombuffer(counts, np.uint16)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sums.values()],
                      pa.binary())], names=["chunk", "counts"])


def _counters(described: DataFrame) -> np.ndarray:
    """The summed counters: CELLS numbers, whatever the input."""
    parts = described.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    total = np.zeros((CELLS // CHUNK, CHUNK), dtype=np.uint32)
    for row in parts.mapInArrow(_add_up, "chunk int, counts binary").collect():
        total[row.chunk] = np.frombuffer(row.counts, np.uint32)
    return total.reshape(-1)


def rare_first(tokens: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """The set in the common order: count, then hash."""
    count = counters[(tokens & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
    key = (count << np.uint64(32)) | (tokens >> np.uint64(32))
    return tokens[np.argsort(key, kind="stable")]


def hot_shares(counters: np.ndarray, hot_rows: int) -> np.ndarray:
    """Tasks among which the sets of a shingle are dealt, by counter: 1 but for counters far above the mean."""
    limit = max(hot_rows, 4 * int(counters.mean()))
    return -(-counters.astype(np.int64) // limit).clip(max=-1)


def _prefixes(batches, width: int, similarity: int, shared, hot_rows: int):
    """(token, fp, place, share): the prefix shingles of each set, once per task and set. ``share`` is 0, or for a hot
    shingle 1 and more, by the set."""
    cache, seen, counters = WordHashes(), set(), shared.value
    parts = hot_shares(counters, hot_rows)
    for batch in batches:
        tokens, prints, places, shares = [], [], [], []
        for text in text_of(batch, "text"):
            own = _token_set(text, width, cache)
            size = len(own)
            if not size:
                continue
            fp = _fingerprint(own)
            if fp in seen:
                continue
            seen.add(fp)
            length = size - least_overlap(size, similarity) + 1
            first = rare_first(own, counters)[:length]
            dealt = parts[(first & np.uint64(CELLS - 1)).astype(np.int64)]
            tokens.append(first)
            shares.append(np.where(dealt > 1, 1 + np.uint64(fp) % dealt.astype(np.uint64), 0).astype(np.int32))
            prints.append(np.full(length, fp, dtype=np.uint64))
            places.append(np.arange(length, dtype=np.int64) | (size << 32))
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(tokens)), _signed(np.concatenate(prints)),
                 pa.array(np.concatenate(places)), pa.array(np.concatenate(shares))],
                names=["token", "fp", "place", "share"])


def _may_link(n: Column, pos: Column, m: Column, other: Column, similarity: int) -> Column:
    """Length and positional filter for two sets that share the shingle at these places."""
    long = F.lit(similarity) * F.greatest(n, m) <= 100 * F.least(n, m)
    rest = 1 + F.least(n - pos - 1, m - other - 1)
    return long & ((100 + similarity) * rest >= similarity * (n + m))


def _suffix_filter(batches, similarity: int):
    """Keep the pairs whose parities still allow the similarity."""
    for batch in batches:
        keep = []
        for n, m, one, two in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "bits", "other"))):
            a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
            size = min(len(a), len(b))
            apart = int(np.bitwise_count(fold_bits(a, size) ^ fold_bits(b, size)).sum())
            keep.append((100 + similarity) * (n + m - apart) >= 2 * similarity * (n + m))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _set_bytes(batches, width: int):
    """(fp, tokens): the whole sets of documents, as sorted 64-bit numbers, once per task and set."""
    cache, seen = WordHashes(), set()
    for batch in batches:
        prints, sets = [], []
        for text in text_of(batch, "text"):
            own = _token_set(text, width, cache)
            fp = _fingerprint(own)
            if fp not in seen:
                seen.add(fp)
                prints.append(fp), sets.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([_signed(prints), pa.array(sets, pa.binary())],
                                         names=["fp", "tokens"])


def _verify(batches, similarity: int):
    """Count what the two sets share; sets of unique numbers, so equal neighbours are shared."""
    for batch in batches:
        keep = []
        for one, two in zip(text_of(batch, "tokens"), text_of(batch, "other")):
            both = np.sort(np.concatenate([np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= similarity * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_facts(rows: DataFrame, *facts: Column) -> DataFrame:
    """Rows with aggregates over all rows of their shingle."""
    return rows.join(rows.groupBy("token").agg(*facts), "token")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: int,
           scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link."""
    one = classes.select(F.col("fp").alias("a"), "n", "bits")
    two = classes.select(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))
    near = scratch.settle(pairs.join(one, "a").join(two, "b").mapInArrow(
        partial(_suffix_filter, similarity=similarity), "a long, b long"))
    wanted = near.select(F.col("a").alias("fp")).union(near.select(F.col("b").alias("fp"))).distinct()
    places = wanted.join(classes.select("fp", "key"), "fp").select("key")
    sets = scratch.settle(docs.join(places, "key").select("text").mapInArrow(
        partial(_set_bytes, width=width), "fp long, tokens binary"))
    left = sets.select(F.col("fp").alias("a"), "tokens")
    right = sets.select(F.col("fp").alias("b"), F.col("tokens").alias("other"))
    linked = near.join(left, "a").join(right, "b").mapInArrow(
        partial(_verify, similarity=similarity), "a long, b long")
    return scratch.settle(linked.distinct())


def ngram_components(documents: DataFrame, width: int = WIDTH,
                     similarity: int = SIMILARITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id, text).

    Runs jobs when called; the result reads one settled narrow table.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    with Scratch(spark) as scratch:
        described = scratch.settle(docs.mapInArrow(partial(_describe, width=width), _DESCRIBED))
        shared = spark.sparkContext.broadcast(_counters(described))
        rows = described.filter("chunk IS NULL").select("doc_id", "fp", "n")
        classes = scratch.settle(
            described.filter("chunk IS NULL").groupBy("fp").agg(
                F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"),
                F.first("n").alias("n"), F.first("bits").alias("bits"),
                *[F.first(s).alias(s) for s in _FOLD_NAMES]))

        prefixes = docs.mapInArrow(
            partial(_prefixes, width=width, similarity=similarity, shared=shared, hot_rows=hot_rows),
            "token long, fp long, place long, share int")
        # at most about ``hot_rows`` rows a window; hot shingles need no test, one set alone pairs with nothing
        dealt = W.partitionBy("token", "share")
        shared_only = prefixes.withColumn("_low", F.min("fp").over(dealt)).withColumn(
            "_high", F.max("fp").over(dealt)).filter("share > 0 OR _low <> _high").dropDuplicates(
            ["token", "share", "fp"])
        index = scratch.settle(shared_only.select(
            "token", "fp", F.shiftright("place", 32).alias("n"),
            F.col("place").bitwiseAND(0xFFFFFFFF).alias("pos")))

        # first round: every set with the most copied one that has the shingle
        ranked = index.join(classes.select("fp", "doc_id", "copies"), "fp")
        best = F.min(F.struct((-F.col("copies")).alias("few"), "doc_id", "fp", "n", "pos")).alias("_best")
        stars = _with_facts(ranked, best).filter(
            (F.col("fp") != F.col("_best.fp"))
            & _may_link(F.col("n"), F.col("pos"), F.col("_best.n"), F.col("_best.pos"), similarity))
        tried = scratch.settle(stars.select(
            F.least("fp", "_best.fp").alias("a"), F.greatest("fp", "_best.fp").alias("b")).distinct())
        links = _links(tried, classes, docs, width, similarity, scratch)
        labels = components(links, scratch)

        # second round: what is left between different components
        placed = index.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "label", F.coalesce("label", "fp")).join(classes.select("fp", *_FOLD_NAMES), "fp")
        mixed = _with_facts(placed, F.min("label").alias("_low"), F.max("label").alias("_high")).filter(
            "_low <> _high").drop("_low", "_high")
        one = scratch.settle(mixed)
        two = one.select("token", *[F.col(c).alias(f"o_{c}") for c in one.columns if c != "token"])
        apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"o_{s}"))) for s in _FOLD_NAMES), F.lit(0))
        both = F.col("n") + F.col("o_n")
        pairs = one.join(two, "token").filter(
            (F.col("fp") < F.col("o_fp")) & (F.col("label") != F.col("o_label"))
            & _may_link(F.col("n"), F.col("pos"), F.col("o_n"), F.col("o_pos"), similarity)
            & ((100 + similarity) * (both - apart) >= 2 * similarity * both))
        rest = scratch.settle(
            pairs.select(F.col("fp").alias("a"), F.col("o_fp").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
        more = _links(rest, classes, docs, width, similarity, scratch)
        final = components(links.union(more), scratch)

        member = classes.select("fp", "doc_id").join(
            final.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "label", F.coalesce("label", "fp"))
        least = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        ids = member.select("fp", "label").join(least, "label").select("fp", "component_id")
        result = scratch.settle(rows.join(ids, "fp").select(
            "doc_id", F.col("n").alias("n_shingles"), "component_id"), keep=True)
        shared.destroy()
        return result
