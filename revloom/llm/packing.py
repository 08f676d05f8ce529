"""Packing documents into token sequences by minimum bin slack.

* **Pieces.** A document is its ids and one end id. Only a document above ``limit`` is cut: every piece but the first
  is ``limit`` ids long, the first holds what is left.
* **Plan.** Pieces are counted by length: at most ``limit`` numbers, whatever the corpus. Bin after bin starts from the
  longest length left and is filled by a subset-sum over the lengths and counts left: bit s of a whole number says that
  sum s can be reached, a shift adds a length. Lengths enter from long to short and the search ends at a full bin, so
  short pieces stay for later gaps. The fullest combination found is taken out; while its lengths last it stays a
  fullest one, so it is taken as often as the counts allow in one step. Every step halves the count of one length at
  least: the steps are at most ``limit`` times the logarithm of the pieces, and a bin has few distinct lengths.
* **Placing.** Pieces of one length are numbered over range partitions (:func:`with_position`), so a length that a third
  of all pieces share is spread. The plan, bounded as above, says which numbers go to which sequence.

Null text is an empty text: one piece that holds the end id. Null and repeated doc_ids and repeated rows are documents
of their own. Any two pieces of one length may change places: ties are left open. An empty table gives no rows. Other
columns are ignored. Texts are encoded in stretches cut between a word and a following blank, where byte-level
tokens never join; memory is bounded by the ids of one document, at four bytes each.
"""

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from revloom.plans.order import with_position
from revloom.plans.runtime import Scratch

LIMIT = 2048
END = 0
STRETCH = 1 << 20
# ids gathered before a batch of pieces is handed on
FLUSH = 1 << 20
# a position takes this many bits beside its length in one sort key
POSITION_BITS = 40
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts by a ``tokenizers`` file, without special tokens around the text.

    A plain byte-level BPE whose merges stand in the order of their ids runs on the same vocabulary in ``tiktoken``,
    which takes a third of the time for the same ids (tested on every code point); all others, and texts that it
    refuses, on ``tokenizers``.
    """

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.fast = self._same_vocabulary(json.load(file))
        self.cuttable = self.fast is not None

    @staticmethod
    def _same_vocabulary(spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split.get("add_prefix_space") and not spec.get("normalizer")
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                    "end_of_word_suffix", "ignore_merges"))
                 and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
        if not plain:
            return None
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {word: i for word, i in model["vocab"].items() if word not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
            return None
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items()}
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens=added)

    def _ids(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all")
            except Exception:  # a pattern engine that gives up on this text; the other one decides
                pass
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= STRETCH or not self.cuttable:
            return np.asarray(self._ids(text), dtype="<u4")
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            parts.append(np.asarray(self._ids(text[at:end]), dtype="<u4"))
            at = end
        return np.concatenate(parts)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many ids."""
    first = (length - 1) % limit + 1
    return [(0, first)] + [(start, limit) for start in range(first, length, limit)]


def _pieces(batches, path: str, limit: int, end: int, with_ids: bool):
    encode = encoder(path)
    rows, held = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            ids = np.append(encode.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
            for piece, (start, length) in enumerate(cuts(len(ids), limit)):
                own = ids[start:start + length]
                rows.append((doc, piece, start, length, zlib.crc32(own.tobytes()),
                             own.astype(np.int32) if with_ids else None))
            held += len(ids)
            if held >= FLUSH:
                yield _piece_batch(rows, batch.schema.field(0), with_ids)
                rows, held = [], 0
        if rows:
            yield _piece_batch(rows, batch.schema.field(0), with_ids)
            rows, held = [], 0


def _piece_batch(rows, doc_field: pa.Field, with_ids: bool) -> pa.RecordBatch:
    docs, pieces, starts, lengths, sums, ids = zip(*rows)
    columns = {"doc_id": pa.array([d.as_py() for d in docs], doc_field.type), "piece": pa.array(pieces, pa.int32()),
               "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
               "ids_crc32": pa.array(sums, pa.int64())}
    if with_ids:
        columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def document_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END,
                    with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(
        partial(_pieces, path=tokenizer, limit=limit, end=end, with_ids=with_ids), schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Uses of each length in a combination that fills ``room`` most; ``lengths`` ascend and have a count."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in reversed(lengths[:bisect_right(lengths, room)]):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, part = left - take, part * 2
        if reach >> room:
            break
    at, uses = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            uses[length] = uses.get(length, 0) + take
            at -= length * take
    return uses


def bins(counts: dict[int, int], limit: int = LIMIT):
    """(number of bins, uses of each length) until all are packed; fullest combination first for the longest left."""
    counts = {length: n for length, n in counts.items() if n}
    lengths = sorted(counts)
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        uses = fullest(lengths if counts[seed] else lengths[:-1], counts, limit - seed)
        counts[seed] += 1
        uses[seed] = uses.get(seed, 0) + 1
        times = min(counts[length] // n for length, n in uses.items())
        for length, n in uses.items():
            counts[length] -= n * times
            if not counts[length]:
                del lengths[bisect_left(lengths, length)]
        yield times, uses


class Plan:
    """Which piece of each length, by its number, goes where: sorted runs of numbers with one pattern each."""

    def __init__(self, counts: dict[int, int], limit: int = LIMIT):
        done, sequence, runs = dict.fromkeys(counts, 0), 0, []
        for times, uses in bins(counts, limit):
            offset = 0
            for length, n in sorted(uses.items(), reverse=True):
                runs.append(((length << POSITION_BITS) | done[length], sequence, n, offset))
                done[length] += n * times
                offset += n * length
            sequence += times
        if any(n >> POSITION_BITS for n in counts.values()):
            raise OverflowError(f"more than 2^{POSITION_BITS} pieces of one length")
        self.sequences = sequence
        table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
        self.keys, self.first, self.uses, self.offset = (np.ascontiguousarray(c) for c in table.T)

    def place(self, length: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and numbers from 0."""
        key = (length << POSITION_BITS) | position
        run = np.searchsorted(self.keys, key, side="right") - 1
        turn, place = np.divmod(key - self.keys[run], self.uses[run])
        return self.first[run] + turn, self.offset[run] + place * length


def _place(batches, shared):
    plan = shared.value
    for batch in batches:
        length, position = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                            for c in ("length", "position"))
        sequence, offset = plan.place(length, position - 1)
        kept = batch.drop_columns(["position"])
        yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def placed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (any columns, with ``length``) and their ``sequence_id`` and ``offset``. Read twice: settle first."""
    spark = pieces.sparkSession
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most limit rows
    shared = spark.sparkContext.broadcast(Plan(counts, limit))
    numbered = with_position(pieces.withColumn("_row", F.monotonically_increasing_id()), ["length"],
                             [F.col("_row")]).drop("_row")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "position")
    return numbered.mapInArrow(partial(_place, shared=shared), f"{kept}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place. Runs jobs."""
    with Scratch(docs.sparkSession) as scratch:
        path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        pieces = scratch.settle(document_pieces(docs, path, limit, end))
        return placed(pieces, limit)


def sequences(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; a group holds at most ``limit`` ids."""
    with Scratch(docs.sparkSession) as scratch:
        path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        pieces = scratch.settle(document_pieces(docs, path, limit, end, with_ids=True))
        return placed(pieces, limit).groupBy("sequence_id").agg(F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p.ids)).alias("ids"))
