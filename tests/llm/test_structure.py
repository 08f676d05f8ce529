"""Whitening, packing and conversation repair against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revloom.llm import packing, repair, whitening
from revloom.llm.queries import llm_queries
from revloom.plans.runtime import Scratch

SF = "/root/testdata/sf0.001"


# ---- whitening

def _check_whitened(rows, found, k=4):
    usable = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in usable}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    a = (fit * n - sums).astype(float) / n
    _, singular, vectors = np.linalg.svd(a, full_matrices=True)
    values, vectors = np.zeros(a.shape[1]), vectors.T
    values[:len(singular)] = np.where(singular > 1e-11 * singular[0], singular, 0) ** 2 / n
    k = min(k, len(values))
    assert len(found) == len(usable) * k
    assert Counter((r.vec_id, int(r.deviation)) for r in found) == Counter(
        {key: k * c for key, c in Counter((i, int(((np.array(x, dtype=object) * n - sums) ** 2).sum()))
                                          for i, x in usable).items()})
    live = [c for c in range(k) if values[c] > 0]
    for c in range(k):
        own = [r for r in found if r.component == c + 1]
        assert all(r.n == n for r in own) and len({r.explained for r in own}) == 1
        if c in live:
            assert own[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert all(r.identity_error <= 1e-9 for r in own)
            if all(abs(values[c] - v) > 1e-6 * values[0] for d, v in enumerate(values) if d != c):
                told = Counter((i, round(abs(float((np.array(x, dtype=object) * n - sums).astype(float) @ vectors[:, c]) / n
                                             / values[c] ** 0.5), 6)) for i, x in usable)
                assert told == Counter((r.vec_id, round(abs(r.whitened), 6)) for r in own)
        else:
            assert all(r.whitened is None and r.explained == 0 for r in own)


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [9, 4, 2, 1, .5, .2]]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(200)] + [(3, rows[3][1]), (None, rows[5][1])]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5),
           (904, []), (905, [1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit("x"))
    _check_whitened(rows, whitening.whiten(frame).collect())
    assert whitening.whiten(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["one", "same", "constant", "few", "wide", "rank", "near"])
def test_whitening_degenerate(spark, kind):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 5)) * 3
    data = {"one": base[:1], "same": np.repeat(base[:1], 9, axis=0), "constant": np.where([1, 1, 1, 1, 0], base, 2.0),
            "few": base[:3], "wide": rng.normal(size=(50, 2)),
            "rank": np.floor(256 * base[:, :2]) / 256 @ np.array([[1, 0, 2, 0, 1], [0, 1, 1, 3, 0.0]]),
            "near": base * [1e6, 1e4, 1, 1, 1]}[kind]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    _check_whitened(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())


def test_whitening_of_large_entries(spark):
    """Sums and deviations stay exact beyond 64 bits; entries beyond whole numbers of 64 bits are held."""
    rows = [(i, [float(2 ** 50 + i), -float(i * i)]) for i in range(20)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _check_whitened(rows, found)
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 2.0])]
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 6


def test_shifted_cholesky_survives_bad_conditions():
    """Condition 1e12: one unshifted Cholesky of the Gram matrix is lost, the passes are not."""
    rng = np.random.default_rng(1)
    a = np.linalg.qr(rng.normal(size=(500, 8)))[0] @ np.diag(10.0 ** -np.arange(0, 16, 2)[:8].clip(max=12)) @ np.linalg.qr(
        rng.normal(size=(8, 8)))[0]
    q, whole = a, np.eye(8)
    for step in range(whitening.MAX_PASSES):
        r, done = whitening.next_factor(q.T @ q, len(a), step == 0)
        if done:
            break
        q, whole = whitening.solve(q, r), r @ whole
    assert done and np.allclose(q.T @ q, np.eye(8), atol=1e-12)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(np.linalg.svd(whole, compute_uv=False)[:6], s[:6], rtol=1e-4)


# ---- packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_tokenizers():
    slow, encode = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    assert encode.fast is not None
    texts = ["", " ", "a  b\n\n c", "<|endoftext|>x <|endoftext|>", "it's we'll 123 ÄÖ ß 你好 　x\u0085y\x1cz", "\n" * 500 + "x", "ab" * 5000]
    texts += ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2 .{chr(c)}. \n{chr(c)}{chr(c)}  {chr(c)}" for c in range(at, at + 97))
              for at in range(1, 0x3000, 97)]
    for text in texts:
        assert encode.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_long_texts_are_encoded_whole(monkeypatch):
    slow, encode = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    monkeypatch.setattr(packing, "STRETCH", 50)
    for text in ("word  two\n\nthree 's it's " * 300, "x" * 3000, " " * 3000 + "a", "a " * 500 + "\n" * 300, "é<|endoftext|> " * 90):
        assert encode.ids(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), max_size=12), st.integers(0, 60))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    uses = packing.fullest(sorted(counts), counts, room)
    assert sum(length * n for length, n in uses.items()) == max(sums)
    assert all(0 < n <= counts[length] for length, n in uses.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_bins_are_those_of_one_at_a_time(counts):
    """Taking a combination as often as it lasts fills every bin as far as a search per bin."""
    fills, left = [], dict(counts)
    while left:
        seed = max(left)
        left[seed] -= 1
        sums = {0: ()}
        fill = max_fill(left, 64 - seed)
        fills.append(seed + fill)
        uses = packing.fullest(sorted(k for k, n in left.items() if n), left, 64 - seed)
        for length, n in uses.items():
            left[length] -= n
        left = {k: n for k, n in left.items() if n}
    taken = [sum(k * n for k, n in uses.items()) for times, uses in packing.bins(counts, 64) for _ in range(times)]
    assert sorted(taken) == sorted(fills)


def max_fill(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    return max(sums)


def _check_packed(docs, found, limit):
    slow = Tokenizer.from_file(TOKENIZER)
    told = Counter()
    for doc, text in docs:
        ids = _ids(slow, text)
        first = (len(ids) - 1) % limit + 1
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), limit)], [*range(first, len(ids) + 1, limit)])):
            told[doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert told == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    used = {}
    for r in found:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    return len(used), -(-sum(r.length for r in found) // limit)


def test_packing_of_odd_rows(spark):
    docs = [(1, "a b c"), (2, None), (3, ""), (None, "x y"), (None, "x y"), (1, "a b c"), (4, "word " * 700),
            (5, "many words of a long text " * 2000), *[(100 + i, "same text again") for i in range(300)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("x"))
    found = packing.pack(frame, limit=128).collect()
    count, least = _check_packed(docs, found, 128)
    assert count <= least + 1
    whole = packing.sequences(frame, limit=128).collect()
    slow = Tokenizer.from_file(TOKENIZER)
    assert sum(len(r.ids) for r in whole) == sum(len(_ids(slow, t)) for _, t in docs)
    assert packing.pack(frame.limit(0)).count() == 0


def test_packing_of_the_table(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    found = llm_queries()["op12_bin_slack_packing"].run(spark, SF).collect()
    count, least = _check_packed([(r.doc_id, r.text) for r in frame.collect()], found, packing.LIMIT)
    assert count <= least * 1.01 + 1


# ---- conversation repair

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        h = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if h == 4:
            role = "user"
        if h in (1, 2):
            text = "" if h == 1 else re.sub("[.!?]", "", text)
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) by a memoised search over strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64],
                                       hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else
                      "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @lru_cache(None)
    def best(i, roles, inserts):
        """Cheapest (cost, audit) from row i on; ``roles`` is "", "s", "u" or "a"."""
        options = []
        if i == len(rows) and roles in ("", "a"):
            options.append((0, ""))
        if inserts < 4:
            to = "a" if roles == "u" else "u"
            cost, rest = best(i, to, inserts + 1)
            options.append((5 + cost, "I" + rest))
        if i < len(rows):
            cost, rest = best(i + 1, roles, 0)
            options.append((2 + cost, "D" + rest))
            if faults[i] not in ("blank", "duplicate"):
                more, to = 5 * (faults[i] == "truncated"), "a" if roles == "u" else "u"
                cost, rest = best(i + 1, to, 0)
                options.append((1 + more + cost, "R" + rest))
                own = initials[i]
                if own == to or (own == "s" and roles == ""):
                    cost, rest = best(i + 1, own, 0)
                    options.append((more + cost, "K" + rest))
        return min(options, default=(10 ** 9, ""))

    cost, audit = best(0, "", 0) if rows else (0, "")
    told, i, last = [], 0, ""
    for letter in audit:
        to = "a" if last == "u" else "u"
        name = {"a": "assistant", "u": "user"}[to]
        if letter == "I":
            told.append((name, ""))
            last = to
            continue
        if letter != "D":
            told.append((name if letter == "R" else rows[i][2], rows[i][3]))
            last = told[-1][0][0]
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in told)) and i == len(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), told


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _check_repair(spark, rows, damaged, found):
    asked = {r[0] for r in rows}
    assert len(found) == len(asked) and {r.conv_id for r in found} == asked
    for r in found:
        told, _ = brute_repair([d for d in damaged if d[0] == r.conv_id])
        assert tuple(r[c] for c in REPORT) == told, r.conv_id


def _random_conversations(seed, convs, most):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(convs):
        texts = ["Well. ", "no end", "", " \n", "Why?", "a!", "x.y"]
        for turn in range(rng.integers(0, most)):
            rows.append((conv if conv else None, int(turn) if rng.random() > .1 else None,
                         rng.choice(["user", "assistant", "system", "tool", None], p=[.4, .35, .1, .1, .05]),
                         None if rng.random() < .03 else f"{rng.integers(0, 9)}{rng.choice(texts)}" if rng.random() < .8 else str(rng.choice(texts))))
    return rows


@pytest.mark.parametrize("chunk", [4096, 4])
def test_repair_brute_force(spark, chunk):
    rows = _random_conversations(1, 60, 25)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(1))
    found = repair.repair_report(repair.damaged(frame), frame, chunk).collect()
    _check_repair(spark, rows, brute_damage(rows), found)
    assert repair.repair_report(repair.damaged(frame.limit(0)), frame.limit(0)).count() == 0


@pytest.mark.parametrize("role", ["user", "tool", None, "system"])
def test_repair_of_rows_that_do_not_converge(spark, role):
    """Runs of one role keep vectors apart over many chunks; so do blank rows."""
    rows = [(1, t, role, f"{t}.") for t in range(61)] + [(2, t, role, "" if t % 30 else "u.") for t in range(60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repair_report(frame, frame, 4).collect()
    _check_repair(spark, rows, [(c, t, r if r is not None else " ", x) for c, t, r, x in rows], found)


def test_repaired_rows(spark):
    rows = _random_conversations(2, 20, 20)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chunk in (4096, 5):
        found = {}
        for r in repair.repaired_rows(repair.damaged(frame), chunk).orderBy("chunk", "place").collect():
            found.setdefault(r.conv_id, []).append((r.role, r.text))
        damaged = brute_damage(rows)
        for conv in {r[0] for r in rows}:
            assert found.get(conv, []) == brute_repair([d for d in damaged if d[0] == conv])[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=60), st.lists(st.integers(0, 11), max_size=60))
def test_rerun_stops_where_vectors_run_alike(codes, after):
    found = repair.costs()
    end, _ = found.back(after, found.end)
    guess = found.back(codes, found.end)
    assert found.again(codes, found.end, end, *guess) == found.back(codes, end)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    found = llm_queries()["op13_conversation_repair"].run(spark, SF).collect()
    _check_repair(spark, rows, brute_damage(rows), found)


def test_long_text_in_a_conversation(spark):
    rows = [(1, 0, "user", "w " * 500_000), (1, 1, "assistant", " " * 1_000_000 + "." + " " * 1_000_000), (1, 2, "user", "." * 500_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    _check_repair(spark, rows, rows, repair.repair_report(frame, frame).collect())


def test_shared_folder_is_left_clean(spark):
    """Tables of a repair are removed, but the one that the result reads."""
    with Scratch(spark) as scratch:
        repair.Repair(spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string"),
                      scratch)
        assert len(scratch._paths) >= 4
