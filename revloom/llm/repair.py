"""Repair of conversation structure by a parallel Viterbi search with rank convergence.

Rows of a conversation have one fault at most, the first that holds: ``blank`` (only white space), ``duplicate`` (role and
text stand in an earlier row), ``truncated`` (the last other character is none of ``.!?``). Edits: Keep (0), Rerole to
user or assistant (1), Delete (2; the only one for blank and duplicate rows), Insert an empty user or assistant row
anywhere (5); a truncated row that stays costs 5 more. The cheapest edits are found whose roles are nothing, or a system row
at most and then user and assistant in turn; of equally cheap ones the audit least in ASCII.

* **State.** E (nothing yet), S (system row), U (user row), A (assistant row); it may end in E or A.
* **Backward costs.** The cost from a row to the end is a vector of four numbers. Vectors that differ only by a constant
  act alike, and inserts keep their differences small, so there are few of them (:class:`Costs` lists them); a step
  takes a vector and a row to a vector and a constant.
* **Chunks.** Rows are numbered and cut into chunks of ``chunk`` rows. Every chunk starts at once from a speculative vector,
  that of the end. Fix-up passes then give each chunk the vector that its right neighbour arrived at; where it differs by
  more than a constant, the chunk is run again until old and new vector differ by a constant only; the rest of the chunk
  then stands. Passes end when no chunk changes. Each pass makes at least one more chunk of a run of chunks that do not
  converge final; usual rows converge within some rows, so that two or three passes do.
* **Tracing.** With the stitched vectors every row knows, for every state, the least letter among its cheapest
  edits. A chunk turns each state it may start in into one it ends in; these are strung together along a
  conversation, and every chunk writes its part of the audit.

Rows go by turn, nulls first; of equal turns by role, then by text (64 characters, then a digest). Null roles and texts are
one space. Repeated rows are rows. A null conversation id is an id like any other. Role initials other than s, u, a fit
nowhere and are re-roled or deleted. An empty table gives no rows. Other columns are ignored. A hot conversation is spread:
numbering by ranges, chunks by number; only its digest, if asked for, is one stream.
"""

import hashlib
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revloom.plans.order import with_position
from revloom.plans.runtime import Scratch

CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\f\r"
E, S, U, A = range(4)
CLASSES = "sua"  # initials by class; class 3 is any other
FINE, CUT, GONE = range(3)  # what a row may not or must: nothing, truncated, to be deleted
_KEEP = ({0: S, 1: U}, {1: U}, {2: A}, {1: U})
_NEXT = (U, U, A, U)  # where a re-roled or inserted row leads
_ROLE = {U: "u", A: "a"}


class Costs:
    """All normalised cost vectors that can occur, the steps between them, and the edit each step takes.

    Rows are codes: class * 3 + what is wrong with it.
    """

    def __init__(self):
        self.vectors, self.step, self.choice = [], [], []
        ids = {}

        def number(vector):
            if vector not in ids:
                ids[vector] = len(self.vectors)
                self.vectors.append(vector)
            return ids[vector]

        self.end = number(self._closed((0, 2 * INSERT, INSERT, 0)))
        at = 0
        while at < len(self.vectors):
            moves, choices = [], []
            for code in range(12):
                raw = self._closed(tuple(self._row(self.vectors[at], code, s) for s in range(4)))
                low = min(raw)
                moves.append((number(tuple(c - low for c in raw)), low))
                choices.append([self._letter(self.vectors[at], raw, code, s) for s in range(4)])
            self.step.append(moves)
            self.choice.append(choices)
            at += 1

    @staticmethod
    def _options(after, code, state):
        """(letter, cost, next state) of the edits that use up the row, letters ascending."""
        kind, wrong = divmod(code, 3)
        yield "D", DELETE + after[state], state
        if wrong != GONE:
            more = TRUNCATED if wrong == CUT else 0
            if kind in _KEEP[state]:
                to = _KEEP[state][kind]
                yield "K", KEEP + more + after[to], to
            yield "R", REROLE + more + after[_NEXT[state]], _NEXT[state]

    def _row(self, after, code, state):
        return min(cost for _, cost, _ in self._options(after, code, state))

    @staticmethod
    def _closed(v):
        """The same with inserts before the row."""
        u, a = min(v[U], INSERT + v[A]), min(v[A], INSERT + v[U])
        return (min(v[E], INSERT + u), min(v[S], INSERT + u), u, a)

    def _letter(self, after, raw, code, state):
        """(least letters of a cheapest way over this row, their roles, next state)."""
        letters, roles = "", ""
        while True:
            fits = {letter: to for letter, cost, to in self._options(after, code, state) if cost == raw[state]}
            if INSERT + raw[_NEXT[state]] == raw[state]:
                fits["I"] = _NEXT[state]
            letter = min(fits)
            letters += letter
            roles += _ROLE[fits[letter]] if letter in "IR" else "-"
            state = fits[letter]
            if letter != "I":
                return letters, roles, state

    def back(self, codes, end: int) -> tuple[int, int]:
        """(vector before the rows, constant) from the vector after them."""
        cost, step = 0, self.step
        for code in reversed(codes):
            end, more = step[end][code]
            cost += more
        return end, cost

    def again(self, codes, old: int, new: int, start: int, cost: int) -> tuple[int, int]:
        """:meth:`back` from ``new``, known to give (start, cost) from ``old``: up to where both differ by a constant."""
        step, moved = self.step, 0
        for code in reversed(codes):
            if old == new:
                return start, cost + moved
            old, less = step[old][code]
            new, more = step[new][code]
            moved += more - less
        return new, cost + moved

    def ahead(self, codes, end: int) -> list[int]:
        """Vector after every row."""
        out, step = [0] * len(codes), self.step
        for k in range(len(codes) - 1, -1, -1):
            out[k] = end
            end = step[end][codes[k]][0]
        return out

    def states(self, codes, end: int) -> list[int]:
        """State after the rows for each state before them."""
        now = [E, S, U, A]
        for code, after in zip(codes, self.ahead(codes, end)):
            row = self.choice[after][code]
            now = [row[s][2] for s in now]
        return now

    def trace(self, codes, end: int, state: int, last: bool):
        """(letters, role of each edit, rows used up before each); the last chunk also gets what must follow."""
        letters, roles, used = [], [], []
        for row, (code, after) in enumerate(zip(codes, self.ahead(codes, end))):
            letter, role, state = self.choice[after][code][state]
            letters += letter
            roles += role
            used += [row] * len(letter)
        while last and state in (S, U):
            state = _NEXT[state]
            letters.append("I")
            roles.append(_ROLE[state])
            used.append(len(codes))
        return letters, roles, used


@lru_cache(maxsize=1)
def costs() -> Costs:
    return Costs()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with set faults, chosen by the crc32 of ``conv_id:turn``; nulls but those of id and turn are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
        (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).alias("_h"))
    rows = rows.filter(F.col("_h") != 0).withColumn(
        "_n", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"))


def _key(column="conv_id"):
    """An id as text that is never null."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def _numbered(rows: DataFrame, scratch) -> DataFrame:
    """(_key, position, turn, role, text, class, blank, cut, digest), positions from 0."""
    plain = rows.select(
        _key().alias("_key"), "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    marked = plain.withColumn("_end", F.right(trimmed, F.lit(1))).select(
        "*", (F.col("_end") == "").alias("blank"), (~F.col("_end").isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)).alias("digest"),
        F.substring("text", 1, 64).alias("_head"), F.monotonically_increasing_id().alias("_row"))
    placed = with_position(marked, ["_key"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_head"),
                                              F.col("digest"), F.col("_row")])
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return scratch.settle(placed.select("_key", (F.col("position") - 1).alias("position"), "turn", "role", "text",
                                        kind.alias("class"), "blank", "cut", "digest"))


def _with_fault(numbered: DataFrame) -> DataFrame:
    """(_key, position, turn, class, fault) without texts. The first row of each text is found by a grouping and marked
    by its position, so that a text which fills a third of a table meets in no task."""
    firsts = numbered.groupBy("_key", "digest").agg(F.min("position").alias("position")).select(
        "_key", "position", F.lit(True).alias("first"))
    rows = numbered.select("_key", "position", "turn", "class", "blank", "cut").join(
        firsts, ["_key", "position"], "left")
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
             .when(F.col("cut"), "truncated"))
    return rows.select("_key", "position", "turn", "class", fault.alias("fault"))


def _chunked(faults: DataFrame, chunk: int) -> DataFrame:
    """(_key, chunk, codes): at most ``chunk`` rows in one list."""
    wrong = (F.when(F.col("fault").isin("blank", "duplicate"), GONE)
             .when(F.col("fault") == "truncated", CUT).otherwise(FINE))
    coded = faults.select("_key", "position", F.floor(F.col("position") / chunk).alias("chunk"),
                          (F.col("class") * 3 + wrong).cast("byte").alias("code"))
    return coded.groupBy("_key", "chunk").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "code"))), lambda r: r.code).alias("codes"))


def _each(batches, work, schema: pa.Schema):
    """Rows of Arrow batches through a function that gives tuples."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        made = [row for values in zip(*columns) for row in work(*values)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * len(schema), schema)], schema=schema)


_PLACE = [("_key", pa.string()), ("chunk", pa.int64())]


def _run(batches):
    def work(key, chunk, codes):
        found = costs()
        return [(key, chunk, found.end, *found.back(codes, found.end))]
    return _each(batches, work, pa.schema([*_PLACE, ("end", pa.int32()), ("start", pa.int32()), ("cost", pa.int64())]))


def _rerun(batches):
    def work(key, chunk, codes, end, start, cost, want):
        return [(key, chunk, want, *costs().again(codes, end, want, start, cost))]
    return _each(batches, work, pa.schema([*_PLACE, ("end", pa.int32()), ("start", pa.int32()), ("cost", pa.int64())]))


_RUN = "_key string, chunk long, end int, start int, cost long"


def _stitched(chunks: DataFrame, scratch) -> DataFrame:
    """(_key, chunk, end): the vector after each chunk of conversations with several. A job per fix-up pass."""
    place = ["_key", "chunk"]
    runs = scratch.settle(chunks.mapInArrow(_run, _RUN))
    while True:
        wanted = runs.select("_key", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("want"))
        stale = scratch.settle(runs.join(wanted, place).filter(F.col("want") != F.col("end")))
        if stale.isEmpty():
            return runs
        fixed = chunks.join(stale, place).select(*place, "codes", "end", "start", "cost", "want").mapInArrow(
            _rerun, _RUN)
        runs = scratch.settle(runs.join(stale.select(*place), place, "left_anti").unionByName(fixed))


def _ends(batches):
    def work(key, chunk, codes, end):
        return [(key, chunk, costs().states(codes, end))]
    return _each(batches, work, pa.schema([*_PLACE, ("states", pa.list_(pa.int32()))]))


def _string_states(batches):
    """The state each chunk starts in; chunks come sorted, one conversation after the other."""
    now = [None, E]

    def work(key, chunk, states):
        if key != now[0]:
            now[:] = key, E
        begin, now[1] = now[1], states[now[1]]
        return [(key, chunk, begin)]
    return _each(batches, work, pa.schema([*_PLACE, ("state", pa.int32())]))


def _trace(batches):
    def work(key, chunk, codes, end, state, last):
        found = costs()
        letters, roles, used = found.trace(codes, end, state, last)
        start, cost = found.back(codes, end)
        classes = [c // 3 for c in codes]
        illegal = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(classes, classes[1:]))
        cost += found.vectors[start][E] if chunk == 0 else 0
        return [(key, chunk, "".join(letters), letters, roles, used, cost, illegal)]
    return _each(batches, work, pa.schema([
        *_PLACE, ("audit", pa.string()), ("letters", pa.list_(pa.string())), ("roles", pa.list_(pa.string())),
        ("used", pa.list_(pa.int64())), ("cost", pa.int64()), ("illegal", pa.int64())]))


_TRACE = ("_key string, chunk long, audit string, letters array<string>, roles array<string>, used array<long>, "
          "cost long, illegal long")


def _traced(chunks: DataFrame, scratch) -> DataFrame:
    """(_key, chunk, audit, letters, roles, used, cost, illegal) of every chunk."""
    place = ["_key", "chunk"]
    long = scratch.settle(chunks.groupBy("_key").agg(F.max("chunk").alias("last")).filter(F.col("last") > 0))
    if long.isEmpty():
        told = chunks.select(*place, "codes", F.lit(costs().end).alias("end"), F.lit(E).alias("state"),
                             F.lit(True).alias("last"))
        crossing = None
    else:
        several = scratch.settle(chunks.join(long, "_key"))
        rows = several.select(*place, "codes")
        runs = _stitched(rows, scratch)
        ended = scratch.settle(rows.join(runs, place).select(*place, "codes", "end").mapInArrow(
            _ends, "_key string, chunk long, states array<int>"))
        begun = ended.repartition("_key").sortWithinPartitions(*place).mapInArrow(
            _string_states, "_key string, chunk long, state int")
        known = several.join(runs.select(*place, "end"), place).join(begun, place)
        told = chunks.join(long, "_key", "left_anti").select(
            *place, "codes", F.lit(costs().end).alias("end"), F.lit(E).alias("state"), F.lit(True).alias("last")
        ).unionByName(known.select(*place, "codes", "end", "state", (F.col("chunk") == F.col("last")).alias("last")))
        kind = lambda at: F.floor(F.element_at("codes", at) / 3)
        after = rows.select("_key", (F.col("chunk") - 1).alias("chunk"), kind(1).alias("right"))
        crossing = rows.select(*place, kind(-1).alias("left")).join(after, place).select(
            *place, (~F.struct("left", "right").isin(*[
                F.struct(F.lit(a).cast("long").alias("left"), F.lit(b).cast("long").alias("right"))
                for a, b in ((0, 1), (1, 2), (2, 1))])).cast("long").alias("over"))
    traced = told.mapInArrow(_trace, _TRACE)
    if crossing is not None:
        traced = traced.join(crossing, place, "left").withColumn(
            "illegal", F.col("illegal") + F.coalesce("over", F.lit(0))).drop("over")
    return scratch.settle(traced)


class Repair:
    """Faults, audits and repaired rows of a table (conv_id, turn, role, text). Runs jobs; tables stay until closed."""

    def __init__(self, rows: DataFrame, scratch: Scratch, chunk: int = CHUNK):
        self.kind, self.chunk = rows.schema["conv_id"].dataType.simpleString(), chunk
        self.numbered = _numbered(rows, scratch)
        self.faults = scratch.settle(_with_fault(self.numbered))
        self.traced = _traced(scratch.settle(_chunked(self.faults, chunk)), scratch)

    def _conv(self):
        return F.when(F.col("_key") != "", F.expr("substring(_key, 2)").cast(self.kind)).alias("conv_id")

    def _rows(self) -> DataFrame:
        """Rows that are kept, re-roled or inserted: (_key, chunk, place, edit, role, text)."""
        each = self.traced.select("_key", "chunk", F.posexplode(F.arrays_zip("letters", "roles", "used")).alias(
            "place", "e")).filter(F.col("e.letters") != "D").select(
            "_key", "chunk", "place", F.col("e.letters").alias("edit"), F.col("e.roles").alias("to"),
            F.when(F.col("e.letters") != "I", F.col("chunk") * self.chunk + F.col("e.used"))
            # a number that no row has, another one for each insert
            .otherwise(-1 - F.col("chunk") * self.chunk - F.col("place")).alias("position"))
        own = self.numbered.select("_key", "position", "role", "text")
        named = F.when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant").otherwise(F.col("role"))
        return each.join(own, ["_key", "position"], "left").select(
            "_key", "chunk", "place", "edit", named.alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def repaired(self) -> DataFrame:
        """(conv_id, chunk, place, edit, role, text): the repaired rows, in order of chunk and place."""
        return self._rows().select(self._conv(), "chunk", "place", "edit", "role", "text")

    def digests(self) -> DataFrame:
        """(_key, repaired_sha256) of ``role:text`` joined by line ends; a stream per conversation."""
        return self._rows().select("_key", "chunk", "place", "role", "text").repartition("_key").sortWithinPartitions(
            "_key", "chunk", "place").select("_key", "role", "text").mapInArrow(
            _digest, "_key string, repaired_sha256 string")

    def report(self, asked: DataFrame) -> DataFrame:
        """A row per conv_id of ``asked``: gaps, faults, illegal neighbours, cost, audit and digest."""
        turns = self.faults.filter(F.col("turn").isNotNull()).groupBy("_key", "turn").agg(F.lit(1).alias("_")).groupBy(
            "_key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
        found = self.faults.groupBy("_key").agg(*[
            F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        audits = self.traced.groupBy("_key").agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda c: c.audit), "").alias("audit"))
        out = asked.select(_key().alias("_key")).distinct()
        for part in (turns, found, audits, self.digests()):
            out = out.join(part, "_key", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return out.select(
            self._conv(), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _digest(batches):
    schema = pa.schema([("_key", pa.string()), ("repaired_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        done = []
        for now, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], schema=schema)


def repair_report(rows: DataFrame, asked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """:meth:`Repair.report` as a written table."""
    with Scratch(rows.sparkSession) as scratch:
        return scratch.settle(Repair(rows, scratch, chunk).report(asked), keep=True)


def repaired_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """:meth:`Repair.repaired` as a written table."""
    with Scratch(rows.sparkSession) as scratch:
        return scratch.settle(Repair(rows, scratch, chunk).repaired(), keep=True)
