"""Operators on documents: brute force, odd rows and empty tables."""

import collections
import hashlib
import json
import base64
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from revloom.llm import decontaminate, licenses, mixing, ngram_join, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, fp long, label string"


@pytest.fixture(scope="module")
def docs(spark):
    def make(rows):
        return spark.createDataFrame(
            [(d, t, "en", s, len(t or ""), "x", 1, "y") for d, t, s in rows], SCHEMA)
    return make


def prose(rng, n):
    return " ".join(rng.choice("the of Re or ed er thst onre haed wh lynd esea tion in").strip() + str(rng.randint(0, 40))
                    if rng.random() < .7 else rng.choice(["the", "of", "and"]) for _ in range(n))


ODD = [(None, None, None), (None, "", "a"), (900, "", "a"), (901, None, "a"), (902, " \n\t ", None), (903, "One", "b"),
       (904, "one", "b"), (905, "two words", "b"), (905, "two words", "b"), (None, "null id here", "c")]


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    sets = [sets_of(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((row[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, hot_rows", [(1, ngram_join.HOT_ROWS), (2, ngram_join.HOT_ROWS), (2, 3)])
def test_ngram_components(docs, seed, hot_rows):
    rng = random.Random(seed)
    rows = list(ODD)
    for base in range(4):
        text = prose(rng, rng.randint(30, 160)).split()
        for k in range(14):
            words = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            rows.append((base * 100 + k, " ".join(words), "s"))
    rows += [(500 + k, "a common line that many texts have in them. " + prose(rng, 12), "s") for k in range(20)]
    got = sorted(map(tuple, ngram_join.ngram_components(docs(rows), hot_rows=hot_rows).collect()), key=str)
    assert got == brute_components(rows)


def test_parities_never_exclude_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 40, 700):
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 4 // 5], rng.integers(0, 1 << 62, n // 5, dtype=np.uint64)]))
        one, two = (np.frombuffer(ngram_join.parity_bits(x), np.uint8) for x in (a, b))
        size = min(len(one), len(two))
        apart = np.bitwise_count(ngram_join.fold_bits(one, size) ^ ngram_join.fold_bits(two, size)).sum()
        assert apart <= len(np.setxor1d(a, b))


BASE = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
        ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)]


def brute_secrets(text):
    spans = []
    for order, (kind, pattern, least) in enumerate(BASE):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                spans.append((m.start(), order, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


def der(tag, body):
    return bytes([tag, len(body)]) + body if len(body) < 128 else bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body


KEY = der(0x30, der(2, b"\0") + der(2, b"\x7f" * 64) + der(2, b"\1\0\1") + der(2, b"\x11" * 40))
TOKEN = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=")
TEXTS = ["é token = \"04dbebab91ab85687d33\" x", "secret=token: \"abcdefghijklmnop", "PASSWORD:'aaaaaaaaaaaa' AKIA" + "A1" * 9,
         "api_key=short apikey = long_enough_key", "ſecret=abcdefghijklmnop", "0123456789abcdef0 deadbeef",
         "k " + base64.b64encode(KEY).decode(), "k " + base64.b64encode(KEY[:-1]).decode(),
         "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(KEY).decode() + "-----END RSA PRIVATE KEY-----",
         f"{TOKEN}.eyJhIjoxfQ.sig eyJub3QianNvbg.abc.def", "AKIA", None, "", "x" * 100_000 + " token=abcdefghijkl"]


def test_secret_spans(docs):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + ODD
    found = secrets.secret_spans(docs(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text in enumerate(TEXTS):
        want = brute_secrets(text)
        assert by_id[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert by_id[i].n_assign + by_id[i].n_access + by_id[i].n_hex == len(want)
        assert set(want) <= set(by_id[i].spans.split(","))
    kinds = [{s.split(":")[0] for s in by_id[i].spans.split(",")} for i in range(len(TEXTS))]
    assert "key" in kinds[6] and "key" not in kinds[7] and "pem" in kinds[8] and "jwt" in kinds[9]
    assert by_id[9].n_confirmed == 1
    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 200_000).decode().rstrip("=")
    assert "jwt" not in [kind for *_, kind in secrets.find_secrets(f"{deep}.abc.def")]


def test_redaction_keeps_rows_and_columns(docs):
    rows = [(1, "a token = \"04dbebab91ab85687d33\" b", "s"), (2, "clean", "s"), (None, None, None)]
    out = {r.doc_id: r for r in secrets.redact_secrets(docs(rows)).collect()}
    assert out[1].text == "a [assign]\" b" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean" and out[None].text is None and out[1].token == "x"


def brute_align(item, window):
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = (rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert decontaminate.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def test_contaminated(spark, docs):
    rng = random.Random(7)
    items = [prose(rng, 25) for _ in range(6)]
    edited = items[1].split()
    edited[5:7], edited[14] = ["other"], "word"
    rows = ODD + [(1, prose(rng, 40) + " " + items[0] + "\n" + prose(rng, 40), "s"),
                  (2, prose(rng, 200) + " " + " ".join(edited), "s"), (3, prose(rng, 300), "s"),
                  (4, " ".join(items[0].split()[:8]) + " " + prose(rng, 60), "s")]
    rows += [(100 + k, items[2] + " " + prose(rng, 5), "s") for k in range(30)]
    test = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)] + [(9, None, 0), (10, "", 0), (11, "two words", 0)],
                                 "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(rows), test).collect()}
    assert found[(1, 0)] == 1.0 and 0.75 < found[(2, 1)] < 1 and found[(905, 11)] == 1.0
    assert {d for d, i in found if i == 2} == set(range(100, 130))
    assert not any(d in (3, 4) for d, _ in found)
    # blocks of items give the same
    parts = decontaminate.contaminated(docs(rows), test, block_words=40).collect()
    assert {(r.doc_id, r.item_id): r.score for r in parts} == found
    kept = decontaminate.remove_contaminated(docs(rows), test)
    assert kept.columns == docs([]).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in found}


def test_edited_copies_are_found(spark, docs):
    """Items that leaked only as edited, gapped or partial copies, against alignment with the whole text."""
    rng = random.Random(11)
    items, rows = [], []
    for i in range(40):
        item = prose(rng, 30).split()
        copy = list(item)
        if i % 4 == 3:
            copy = copy[:15 + i % 3] if i % 8 == 3 else [w for k, x in enumerate(copy) for w in ([x, "new"] if k % 2 else [x])]
        else:
            for k in rng.sample(range(30), (4, 7, 9)[i % 4]):
                copy[k] = f"edit{k}"
        items.append(" ".join(item))
        rows.append((i, prose(rng, 30) + " " + " ".join(copy) + " " + prose(rng, 30), "s"))
    # half of an item quoted everywhere
    rows += [(100 + k, prose(rng, 9) + " " + " ".join(items[0].split()[:16]), "s") for k in range(20)]
    test = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(rows), test).collect()}
    wanted = {}
    for doc, text, _ in rows:
        for i, item in enumerate(items):
            a, b = item.lower().split(), text.lower().split()
            # words that the text shares bound the score
            score = brute_align(a, b) if 2 * sum(w in b for w in a) >= len(a) else 0
            if score >= len(a):
                wanted[doc, i] = score / (2 * len(a))
    assert found == wanted and len([d for d, _ in found if d < 40]) >= 35


def test_licences(docs):
    rows = ODD + [(1, "x\nReleased under the MIT License.\ny", "s"),
                  (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the "
                      "License. You may obtain a copy of the License at:\n", "s"),
                  (3, "The MIT license is nice.", "s"), (4, "LICENSED UNDER CC BY-NC 4.0.", "s")]
    found = {r.doc_id: (r.licenses, r.sentences) for r in licenses.licences(docs(rows)).collect()}
    assert found == {1: ("MIT", "mit_notice"), 2: ("Apache-2.0", "apache_notice,apache_use,apache_copy"),
                     4: ("CC-BY-NC-4.0", "cc_by_nc_notice")}
    for sentence, _ in licenses.known_sentences():
        assert any(h in sentence for h in licenses.HINTS)


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) 2020, Somebody
All rights
reserved.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "-- ", "REM "])
def test_wrapped_licences(docs, leader):
    texts = [MIT, GPL, BSD, "Released under the MIT License\n" + MIT[MIT.index("Permission"):]]
    rows = [(i, "\n".join(leader + line if line else leader.rstrip() for line in t.split("\n")), "s") for i, t in enumerate(texts)]
    rows += [(10 + i, t.replace("\n", "\r\n"), "s") for i, (_, t, _) in enumerate(rows)]
    found = {r.doc_id: (r.licenses, r.sentences) for r in licenses.licences(docs(rows)).collect()}
    wanted = [("MIT", "mit_grant,mit_condition,as_is"), ("GPL-3.0-or-later", "gpl_or_later,gpl_no_warranty"),
              ("BSD-3-Clause,proprietary", "all_rights,bsd_redistribution,bsd_endorse"),
              ("MIT", "mit_notice,mit_grant,mit_condition,as_is")]
    assert found == {k + i: w for i, w in enumerate(wanted) for k in (0, 10)}


def brute_schedule(sources):
    """(source, block, slot) by stepping through the slots; asserts the deviation at each."""
    left, parts = {s: n for s, n, _ in sources}, {s: k for s, _, k in sources}
    done, out, at = collections.Counter(), [], 0
    while any(left.values()):
        active = sorted(s for s in left if left[s] > 0)
        total, count, t = sum(parts[s] for s in active), collections.Counter(), 0
        while True:
            ready = [((-(-(count[s] + 1) * total // parts[s])), i, s) for i, s in enumerate(active)
                     if count[s] * total // parts[s] <= t]
            source = min(ready)[2]
            out.append((source, done[source], at + t))
            count[source] += 1
            done[source] += 1
            left[source] -= 1
            t += 1
            assert all(abs(count[s] - Fraction(t * parts[s], total)) < 1 for s in active)
            if left[source] == 0:
                break
        at += t
    return out


@pytest.mark.parametrize("sources", [[("a", 5, 1)], [("a", 40, 7), ("b", 9, 2), ("c", 30, 1)],
                                     [("a", 20, 5)] + [(f"s{i}", 6, 1) for i in range(5)]])
def test_schedule(spark, sources):
    frame = spark.createDataFrame([(s, n, float(k)) for s, n, k in sources], "source string, blocks long, weight double")
    got = mixing.schedule(frame, sum(k for *_, k in sources)).collect()
    assert sorted((r.source, r.block, r.slot) for r in got) == sorted(brute_schedule(sources))
    assert all(r.release <= r.slot < r.deadline for r in got)


def test_mix_places_every_row(spark, docs):
    rows = ODD + [(i, "t", "hot" if i % 3 else "cold") for i in range(700)]
    got = mixing.mix(docs(rows), block_rows=7).collect()
    assert len(got) == len(rows) and len({(r.slot, r.place) for r in got}) == len(rows)
    assert len({r.slot for r in got}) == max(r.slot for r in got) + 1
    weights = spark.createDataFrame([("hot", 9.0), ("cold", None), ("gone", 5.0)], "source string, weight double")
    assert len(mixing.mix(docs(rows), weights).collect()) == len(rows)


def test_quality(spark, docs):
    rng = random.Random(9)
    good = [(i, prose(rng, 120), "s") for i in range(0, 240, 2)]
    bad = [(i, " | ".join(prose(rng, 60).upper().split()) + "!!", "s") for i in range(1, 240, 2)]
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(240)] + [(None, 1, 0), (5000, None, 0), (0, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = good + bad + ODD
    got = quality.quality_scores(docs(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    mine = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in mine]) > 0.95
    repeated = docs(good + bad + good[:1] * 50)
    assert quality.training_texts(repeated, labels, 20).count() == 40
    kept = quality.keep_good(docs(rows), labels)
    assert kept.columns == docs([]).columns


def test_empty_tables(spark, docs):
    empty = docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    test = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.ngram_components(empty).count() == 0
    assert secrets.secret_spans(empty).count() == 0
    assert decontaminate.contaminated(empty, test).count() == 0
    assert mixing.mix(empty).count() == 0
    assert quality.quality_scores(empty, labels).count() == 0
    assert licenses.licences(empty).count() == 0
    some = docs([(1, "a b c", "s")])
    assert quality.quality_scores(some, labels).first().score == 0.5
    assert decontaminate.contaminated(some, test).count() == 0
