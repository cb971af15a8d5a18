"""Every operator against its plain version, on the small tables and on awkward rows."""

import random
import subprocess
import sys
import textwrap
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from quillspark.llm import bytekit as bk
from quillspark.llm import queries
from quillspark.llm.decontaminate import decontaminate, drop_contaminated
from quillspark.llm.exact_dedup import CuckooFilter, LiveIndex, drop_exact_copies, exact_dedup
from quillspark.llm.language import _sample, fit, identify, keep_identified, quotas
from quillspark.llm.license import license_scan
from quillspark.llm.packing import CapacityTree, best_fit_decreasing, best_fit_pack, improve, pack_matrix, write_matrix
from quillspark.llm.quality import importance_resample
from quillspark.llm.simhash import drop_near_copies, link_cell, manhattan, near_duplicates, popcount, segment_counts
from quillspark.llm.substring_bytes import remove_repeated_bytes
from quillspark.llm.substring_words import remove_repeated_windows
from quillspark.llm.suffixsort import Scratch, repeated_starts, suffix_order
from quillspark.llm.tokens import Encoder

SMALL = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, key string, fp long"


def awkward():
    """Nulls, empties, ties, repeated rows, long texts, shared passages, odd characters."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "ñandú", "über", "MIT", "License"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))
    texts = [None, "", " \n\t ", "...", "one", "two words", "MIT License", "x" * 5000, "ab" * 3000, passage, passage, passage.upper()]
    for _ in range(40):
        before, after = (" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(200))) for _ in range(2))
        texts.append(f"{before} {passage} {after}" if rng.random() < 0.5 else before + "\n" + after)
    texts += [texts[20], texts[21] + " tail", "Released under the MIT License.\nApache License, general public license", "long " * 3000 + passage, "word\x0bother\x1cthird\xa0fourth"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, passage), (None, None), (3, "clash of ids " * 20), (20, texts[20])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en" if i % 2 else None, "s", 1, "a", 2, "b", 3) for i, (d, t) in enumerate(rows)], DDL)


def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def same(df, columns, expected):
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    want = Counter(expected)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.fixture(params=["small", "awkward", "empty"])
def rows(request, spark):
    return {"small": small, "awkward": lambda s: awkward(), "empty": lambda s: []}[request.param](spark)


def test_license_base(spark, rows):
    same(license_scan(frame(spark, rows)), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], [(d, *brute.base_places(t)) for d, t in rows])


def test_license_templates(spark):
    got = {r.doc_id: (r.labels, round(r.score, 3)) for r in license_scan(frame(spark, [(1, "a\nThis WORK is licensed under the GNU general public licence, version 3"), (2, "nothing here"), (3, "Redistribution and use in source & binary forms, with or without modification, are permitted"), (4, "mit license")])).collect()}
    assert got == {1: ("gpl", round(11 / 12, 3)), 2: ("", 0.0), 3: ("bsd", 1.0), 4: ("mit", 1.0)}


def test_license_wrapped(spark):
    mit = 'Copyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal'
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file"
    narrow = "\n".join("x y Redistribution and use in source and binary forms with or without modification are permitted".split())
    beside = "der mit te\nlicensed under the apache license version 2 0"
    apart = bsd.replace("\n", "\n" + "other words " * 20)
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(frame(spark, list(enumerate([mit, bsd, mpl, narrow, beside, apart, mit.replace("\n", "\r\n")])))).collect()}
    assert got == {0: ("mit", 1.0), 1: ("bsd", 1.0), 2: ("mpl", 1.0), 3: ("bsd", 1.0), 4: ("apache", 1.0), 5: ("", 0.0), 6: ("mit", 1.0)}


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
}


def test_license_sql(spark):
    import duckdb

    wrapped = [start + ("\n" + start).join(textwrap.wrap(t, 76 - len(start))) for t in NOTICES.values() for start in ("", " * ", "# ")]
    rows = awkward() + list(enumerate(wrapped, 200)) + [(300 + k, f"before\n{t}\nafter") for k, t in enumerate(wrapped)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    found = con.execute(queries.SQL["op2_license_scan"])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    same(license_scan(frame(spark, rows)), columns, want)
    labels = {r[columns.index("doc_id")]: r[columns.index("labels")] for r in want}
    assert [labels[200 + k] for k in range(len(wrapped))] == [label for label in NOTICES for _ in range(3)]


ITEMS = [(1, "w1 w2"), (2, None), (None, "one"), (2, "w1 w2"), (7, "...")]


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_decontaminate(spark, rows, limit):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()] + ITEMS + [(99, awkward()[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(frame(spark, rows), bench, limit)
    want = brute.decontaminate(rows, items)
    same(got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], want)


def test_decontaminate_drops(spark):
    bench = spark.createDataFrame([(99, awkward()[9][1])], "item_id long, text string")
    kept = {r.doc_id for r in drop_contaminated(frame(spark, awkward()), bench).collect()}
    assert 9 not in kept and 4 in kept
    assert drop_contaminated(frame(spark, awkward()), bench.limit(0)).count() == len(awkward())


def test_repeated_words(spark, rows):
    clean = rows
    same(remove_repeated_windows(frame(spark, clean)), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.repeated_words(clean))


def test_repeated_bytes(spark, rows):
    same(remove_repeated_bytes(frame(spark, rows)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeated_bytes(rows))


@pytest.mark.parametrize(("limit", "sent", "places"), [(0, 1 << 17, 1), (3, 1 << 17, 100_000), (3, 0, 2), (10_000, 0, 3)])
def test_hot_minimisers(spark, monkeypatch, limit, sent, places):
    monkeypatch.setattr("quillspark.llm.superkmer.HOT_PLACES", places)
    monkeypatch.setattr("quillspark.llm.superkmer.MAX_HOT_BROADCAST", sent)
    monkeypatch.setattr("quillspark.llm.superkmer.HOT_STRINGS", limit)
    monkeypatch.setattr("quillspark.llm.substring_bytes.HOT_STRINGS", limit)
    clean = awkward()
    same(remove_repeated_windows(frame(spark, clean)), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.repeated_words(clean))
    same(remove_repeated_bytes(frame(spark, clean)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeated_bytes(clean))


BLOCKS = [(4, 8), (16, 64), (1 << 16, 1 << 19)]


@pytest.mark.parametrize(("block", "held"), BLOCKS)
def test_suffix_order(block, held):
    rng = np.random.default_rng(1)
    for size, alphabet in ((1, 2), (50, 2), (400, 3), (2000, 5), (300, 1), (1500, 200)):
        text = np.append(rng.integers(1, alphabet + 1, size), 0).astype(np.uint16)
        order = suffix_order(text, 10**6, block, held).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize(("block", "held"), BLOCKS)
def test_repeated_starts(block, held):
    rng = np.random.default_rng(2)
    base = rng.integers(1, 4, 60)
    texts = [(np.append(rng.integers(1, alphabet + 1, size), 0), width) for size, alphabet, width in ((300, 2, 5), (300, 3, 4), (2000, 4, 6), (200, 1, 9), (3000, 30, 2))]
    texts.append((np.concatenate([np.tile(base, 12), [7], base, [6], np.full(100, 3), [0]]), 20))
    for text, width in texts:
        size = len(text) - 1
        strings = Counter(tuple(text[i : i + width]) for i in range(size - width + 1))
        want = [strings[tuple(text[i : i + width])] > 1 for i in range(size - width + 1)]
        with Scratch() as scratch:
            got = repeated_starts(text.astype(np.uint16), 31, width, scratch, block, held)
            assert got[: len(want)].tolist() == want


def test_sort_beyond_memory():
    """A text on disk of ten times the memory that the sort may allocate, names and recursion included."""
    code = """
import resource, sys, tracemalloc
import numpy as np
from quillspark.llm import bytekit as bk
from quillspark.llm.suffixsort import Scratch, bytes_level
with Scratch() as scratch:
    n = 4_000_000
    text = scratch.array(n, np.uint32)
    rng = np.random.default_rng(0)
    part = rng.integers(1, 5, 20_000)
    for at in range(0, n - 1, 60_000):
        chunk = np.concatenate([part, rng.integers(1, 5, 40_000)])[: n - 1 - at]
        text[at : at + len(chunk)] = chunk
    text[n - 1] = 0
    level = bytes_level(text, 5, 200, scratch, block=1024, held=8192)
    held = int(next(l.split()[1] for l in open("/proc/self/status") if l.startswith("VmData"))) << 10
    resource.setrlimit(resource.RLIMIT_DATA, (held + text.nbytes // 2, resource.RLIM_INFINITY))
    tracemalloc.start()
    places = repeated = 0
    for found, common in level.sorted():
        places += len(found)
        repeated += int((common >= 200).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    resource.setrlimit(resource.RLIMIT_DATA, (resource.RLIM_INFINITY,) * 2)
    hashes = np.sort(bk.grams(bk.prefix(text), 200)[:-1])
    same = hashes[1:] == hashes[:-1]
    print(places, repeated == same.sum(), peak * 10 < text.nbytes, level.spilled > n)
"""
    root = Path(__file__).resolve().parent.parent.parent
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=600, check=True).stdout.split()
    assert out == ["4000000", "True", "True", "True"]


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = []
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        want.append((d, keep, len(groups[t or ""]), d == keep, brute.sha((t or "").encode())))
    same(exact_dedup(frame(spark, rows)), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], want)
    kept = drop_exact_copies(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    # one row of each group, of the largest id
    left = {}
    for d, t in rows:
        left[t or ""] = max(left.get(t or "", -1), -1 if d is None else d)
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == Counter(left.items())


def test_cuckoo():
    rng = random.Random(3)
    keys = [rng.getrandbits(64) for _ in range(3000)]
    table = CuckooFilter(4000)
    assert all(table.insert(k) for k in keys) and all(k in table for k in keys)
    for k in keys[:1500]:
        assert table.delete(k)
    assert all(k in table for k in keys[1500:])
    assert sum(k in table for k in keys[:1500]) < 30


@pytest.mark.parametrize("held", [5, 300, 1 << 18])
def test_live_index(held):
    rng = random.Random(4)
    digests = [i.to_bytes(4, "big") * 8 for i in range(2000)]
    with Scratch() as scratch:
        index, want = LiveIndex(scratch, 8, held), {}
        for digest in digests + rng.choices(digests, k=3000):
            owner, count = rng.choice([None, rng.randrange(100)]), rng.randrange(1, 4)
            known = want.get(digest, (None, 0))
            want[digest] = max((x for x in (known[0], owner) if x is not None), default=None), known[1] + count
            index.offer(digest, owner, count)
        for digest in digests[::7]:
            index.remove(digest)
            del want[digest]
        index.remove(b"x" * 32)
        for digest in digests[::14]:
            index.offer(digest, 3, 1)
            want[digest] = 3, 1
        got = list(index.items())
        assert len(got) == len(want) and {d: (o, n) for d, o, n in got} == want
        assert index.resizes and (held > 300 or index.store.files)


def test_near_duplicates(spark, rows):
    same(near_duplicates(frame(spark, rows)), ["doc_id", "fingerprint", "component_id"], brute.near(rows))
    kept = drop_near_copies(frame(spark, rows))
    # one row of each component, of the least id
    assert Counter(r.doc_id for r in kept.collect()) == Counter(c for c, _ in {(c, g) for _, _, c, g in brute.near_groups(rows)})


def test_stages_keep_one_of_repeated_rows(spark, monkeypatch):
    rows = [(5, "x y z"), (5, "x y z"), (3, "x y z"), (3, "aaa bbb ccc ddd eee"), (1, "aaa bbb ccc ddd eee"), (3, "zzz yyy xxx www vvv"), (None, "only here"), (None, "only here"), (8, None), (9, "")]
    for limit in (1 << 19, 0):
        monkeypatch.setattr("quillspark.llm.common.MAX_BROADCAST_ROWS", limit)
        exact = Counter((r.doc_id, r.text) for r in drop_exact_copies(frame(spark, rows)).collect())
        assert exact == Counter([(5, "x y z"), (3, "aaa bbb ccc ddd eee"), (3, "zzz yyy xxx www vvv"), (None, "only here"), (9, "")])
        near = Counter((r.doc_id, r.text) for r in drop_near_copies(frame(spark, rows)).collect())
        assert near == Counter([(3, "x y z"), (1, "aaa bbb ccc ddd eee"), (3, "zzz yyy xxx www vvv"), (None, "only here"), (8, None)])


def test_near_copies_without_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a), (None, b), (7, c), (None, c), (9, "last words of all")]
    assert Counter((r.doc_id, r.text) for r in drop_near_copies(frame(spark, rows)).collect()) == Counter([(None, a), (None, b), (7, c), (9, "last words of all")])


def test_classes_without_ids_link_apart(spark, monkeypatch):
    # two null-only classes, each within two bits of another real one
    prints = [(1, 11, 0b1), (None, 12, 0b10), (2, 13, 0xFF0001 << 30), (None, 14, 0xFF0002 << 30), (None, 15, 1 << 62 | 0xFFF)]
    table = spark.createDataFrame(prints, "doc_id long, text_key long, fp long")
    monkeypatch.setattr("quillspark.llm.simhash.fingerprints", lambda docs: table)
    assert {(r.doc_id, r.fingerprint): r.component_id for r in near_duplicates(frame(spark, [])).collect()} == {
        (d, f"{fp:016x}"): c for (d, _, fp), c in zip(prints, [1, 1, 2, 2, None], strict=True)
    }


def test_decontaminate_drops_rows_without_ids(spark):
    passage = awkward()[9][1]
    bench = spark.createDataFrame([(99, passage)], "item_id long, text string")
    rows = [(None, passage), (None, "clean and without an id"), (4, passage), (4, "clean with a clashing id"), (None, None)]
    for limit in (1 << 24, 0):
        kept = drop_contaminated(frame(spark, rows), bench, limit).collect()
        assert Counter((r.doc_id, r.text) for r in kept) == Counter([rows[1], rows[3], rows[4]])


def test_link_cell_crowded():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 62, 6)
    fps = np.unique(np.concatenate([[c ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))] for c in centre]).astype(np.int64))
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in link_cell(fps):
        assert bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2
        up[find(i)] = find(j)
    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2:
                assert find(i) == find(j)


def test_link_cell_deep():
    # a dense group of distinct neighbours, a long chain, and many of one profile that are far apart
    rng = np.random.default_rng(6)
    dense = np.unique(np.concatenate([[5], [5 ^ (1 << a) for a in range(62)], [5 ^ (1 << a) ^ (1 << b) for a in range(62) for b in range(a)]])).astype(np.int64)
    chain = (7 << 50) ^ np.array([(1 << k) - 1 for k in range(0, 40)], dtype=np.int64)
    far = np.unique(np.array([sum(1 << (2 * k + int(x)) for k, x in enumerate(row)) for row in rng.integers(0, 2, (3000, 31))], dtype=np.int64))
    fps = np.unique(np.concatenate([dense, chain, far]))
    up = list(range(len(fps)))

    def find(up, i):
        while up[i] != i:
            i = up[i]
        return i

    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(popcount((fps[: i] ^ fps[i]).view(np.uint64)) <= 2).tolist():
            want[find(want, i)] = find(want, j)
    edges = link_cell(fps)
    for i, j in edges:
        assert bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2
        up[find(up, i)] = find(up, j)
    groups = lambda up: Counter(frozenset(g) for g in _groups([find(up, i) for i in range(len(fps))]))
    assert groups(up) == groups(want) and len(edges) == len(fps) - len(groups(want))


def _groups(roots):
    out = defaultdict(list)
    for i, r in enumerate(roots):
        out[r].append(i)
    return out.values()


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, 2000), rng.integers(0, 1 << 63, 2000)
    assert (manhattan(segment_counts(a), segment_counts(b)) <= popcount((a ^ b).view(np.uint64))).all()
    want = [sum(abs(bin(x >> s & 3).count("1") - bin(y >> s & 3).count("1")) for s in range(0, 64, 2)) for x, y in zip(a.tolist(), b.tolist())]
    assert manhattan(segment_counts(a), segment_counts(b)).tolist() == want


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = ["ΑΣ Σ İx <|endoftext|> <|ENDOFTEXT|>", "it's we'LL don't 12á éx", "a\xa0b\x85c d​e", "你好 мир ﬁ Ǆ ß ẞ", "１２ ½ ² Ⅷ", "\ttab\rreturn\x0bv\x1cfs"]


def test_packing(spark, rows, tokenizer):
    rows = rows + ([(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id at all")] * 40 + [(20, rows[-1][1])] if rows else [])
    want = Counter()
    for d, t in rows:
        want.update((d, k, *v) for (_, k), v in brute.pieces(tokenizer, [(d, t)]).items())
    got = best_fit_pack(frame(spark, rows), shard_bytes=1 << 16).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    # as few sequences as a plain best fit over all, but for one a shard
    whole = best_fit_decreasing([v[3] for v in want.elements()])
    assert not rows or -(-sum(v[3] for v in want.elements()) // 2048) <= len(sequences) <= len(whole) + 1 + sum(len(t or "") + 1 for _, t in rows) // (1 << 16)


def test_matrix_round_trip(spark, rows, tokenizer, tmp_path):
    found = Counter()
    write_matrix(pack_matrix(frame(spark, rows)), f"file://{tmp_path}/matrix")
    for r in spark.read.parquet(f"file://{tmp_path}/matrix").collect():
        ids, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, s, e in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[s:e].tolist() == list(range(e - s))
            found[doc, tuple(ids[s:e].tolist())] += 1
    want = Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((d, tuple(ids[i : i + 2048])) for i in range(0, len(ids), 2048))
    assert found == want


def test_encoder_is_exact():
    encoder = Encoder()
    pool = "abzABZÄßéÉıſKÅǅ'sтЖΔσΣİ<|>09_-.,!\n\t   \u0301\u0308\u200b中文\x1c\x85\r"
    dice = random.Random(5)
    for _ in range(3000):
        text = "".join(dice.choice(pool) for _ in range(dice.randint(0, 25)))
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_bins():
    rng = random.Random(6)
    for _ in range(20):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 150))]
        bins = best_fit_decreasing(lengths, 100)
        better = improve(bins, lengths, 100)
        for some in (bins, better):
            assert sorted(i for b in some for i in b) == list(range(len(lengths)))
            assert all(sum(lengths[i] for i in b) <= 100 for b in some)
        assert len(better) <= len(bins)
    assert len(improve([[0, 1], [2, 3], [4, 5]], [60, 20, 50, 20, 30, 10], 100)) == 2
    tree = CapacityTree(10)
    tree.add(4, 1)
    tree.add(7, 2)
    assert tree.take(5) == (7, 2) and tree.take(5) is None and tree.take(1) == (4, 1)


def test_bins_beside_a_stuck_one():
    # 17 fits nowhere and exchanges with nothing until the two other bins exchange 46 for 39
    assert len(improve([[0], [1, 2], [3, 4]], [17, 46, 40, 39, 52], 100)) == 2
    rng = random.Random(1)
    lengths = [rng.randint(400, 900) for _ in range(900)]
    bins = best_fit_decreasing(lengths)
    better = improve(bins, lengths)
    assert sorted(i for b in better for i in b) == list(range(900)) and max(sum(lengths[i] for i in b) for b in better) <= 2048
    assert len(bins) == 310 and len(better) <= 300


def exchange(bins, lengths, capacity):
    """Any move, one for one, two for one or one for two between two underfull bins that raises the squared fill."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, ours in enumerate(bins):
        for b, theirs in enumerate(bins):
            if a == b or capacity in (fill[a], fill[b]):
                continue
            mine, other = [lengths[i] for i in ours], [lengths[i] for i in theirs]
            for give in [(x,) for x in mine] + list(combinations(mine, 2)):
                for get in [(x,) for x in other] + (list(combinations(other, 2)) + [()] if len(give) == 1 else []):
                    more = sum(give) - sum(get)
                    if more > 0 and fill[b] + more <= capacity and more > fill[a] - fill[b]:
                        return a, b, give, get
    return None


def test_local_search_ends_where_no_pair_gains():
    rng = random.Random(12)
    for trial in range(300):
        capacity = rng.choice([20, 50, 100])
        lengths = [rng.randrange(1, capacity) for _ in range(rng.randrange(2, 25))]
        bins = best_fit_decreasing(lengths, capacity) if trial % 2 else [[i] for i in range(len(lengths))]
        better = improve(bins, lengths, capacity)
        assert sorted(i for b in better for i in b) == list(range(len(lengths))) and len(better) <= len(bins)
        assert len(better) == -(-sum(lengths) // capacity) or exchange(better, lengths, capacity) is None
    # a fuller bin gives to an emptier one
    lengths = [380] * 55 + [120, 610, 610, 610] * 11
    bins = [list(range(5 * i, 5 * i + 5)) for i in range(11)] + [list(range(55 + 4 * i, 59 + 4 * i)) for i in range(11)]
    assert exchange(bins, lengths, 2048) and exchange(improve(bins, lengths), lengths, 2048) is None


@pytest.mark.parametrize("ids", ["none", "one", "own"])
def test_repeated_rows(spark, ids):
    """Ten thousand equal rows cost what as many different ones do."""
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(400))
    rows = [({"none": None, "one": 7, "own": i}[ids], text) for i in range(10_000)] + [(20_000, "other " + text), (20_001, text[:150])]
    began = time.monotonic()
    got = Counter((r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeated_bytes(frame(spark, rows)).select("n_bytes", "n_removed", "n_spans").collect())
    n = len(text)
    assert got == {(n, n, 1): 10_000, (n + 6, n, 1): 1, (150, 0, 0): 1}
    got = Counter((r.n_words, r.n_removed) for r in remove_repeated_windows(frame(spark, rows)).select("n_words", "n_removed").collect())
    short = len(text[:150].split())
    assert got == {"none": {(400, 0): 10_000, (401, 0): 1, (short, 0): 1}, "one": {(400, 0): 10_000, (401, 400): 1, (short, 0): 1}, "own": {(400, 0): 1, (400, 400): 9_999, (401, 400): 1, (short, 0): 1}}[ids]
    assert time.monotonic() - began < 60


def test_clashing_names(spark):
    """Columns of the caller's that are called like the operators' own."""
    own = ["__none", "__id", "__text", "row", "k", "best", "root", "digest", "one", "pos", "size"]
    rows = awkward()
    docs = frame(spark, rows).select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(own)])
    bench = spark.createDataFrame([(99, awkward()[9][1])], "item_id long, text string")
    for out in (drop_exact_copies(docs), drop_near_copies(docs), drop_contaminated(docs, bench), drop_contaminated(docs, bench, broadcast_bytes=0)):
        assert out.columns == docs.columns
        got = out.collect()
        assert 0 < len(got) < len(rows) and all(tuple(r)[2:] == tuple(range(len(own))) for r in got)


def test_language(spark, rows):
    got = identify(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _ in rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    texts = {d: t for d, t in rows if d not in (None, 3)}
    for r in got:
        if r.doc_id in texts:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in identify(docs).collect() if r.held_out and truth[r.doc_id]]
    assert len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97
    lettered = sum(any(c.isalpha() for c in r.text or "") for r in docs.select("text").collect())
    assert keep_identified(docs).count() == lettered


def test_language_plain(spark):
    """Against plain sets of n-grams without a filter: the same language wherever the plain evidence is clear."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(5000 + i, t, None) for i, (_, t) in enumerate(awkward())]
    fold = lambda text: "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in (text or "").translate(brute.UPPER)).encode()
    grams = lambda b: [g for g in (b[i : i + 5] for i in range(len(b) - 4)) if b"  " not in g]
    counts = defaultdict(Counter)
    for d, t, lang in rows:
        if t and lang and zlib.crc32(str(d).encode()) % 5:
            counts[lang].update(grams(fold(t)))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    rate = lambda lang, g: counts[lang][g] / totals[lang]
    members = {g: {x for x in counts if rate(x, g) and rate(x, g) >= 0.25 * max(rate(y, g) for y in counts)} for c in counts.values() for g in c}
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    clear = 0
    for d, t, _ in rows:
        found = Counter(x for g in grams(fold(t)) for x in members.get(g, ()))
        if not any(c.isalpha() for c in t or ""):
            assert got[d].lang_pred == "und" and got[d].score == 0
        elif found:
            best = max(sorted(found), key=found.get)
            if 2 * found[best] > 1.1 * sum(found.values()) and 2 * found[best] > len(grams(fold(t))):
                clear += 1
                assert got[d].lang_pred == best and abs(got[d].score - found[best] / sum(found.values())) < 0.1
    assert clear > 150


def test_language_sample(spark):
    """Every language has its share of the labelled rows, however rare; repeated ids and rows don't exceed the bound."""
    rows = [(i, f"the cat and the dog number {i}", "en") for i in range(6000)] + [(10_000 + i, "le chat et le chien disent oui", "fr") for i in range(4)] + [(5, "the same again", "en")] * 3000
    docs = spark.createDataFrame([*rows, (20_000, "Oui", None), (20_001, "chien", None), (20_002, "ß", None)], "doc_id long, text string, lang string")
    for bound, few in ((20, 4), (3, 1)):
        sample, languages = _sample(docs, bound)
        n = Counter(r.lang for r in sample.collect())
        free = sum(zlib.crc32(str(10_000 + i).encode()) % 5 > 0 for i in range(4))
        assert languages == ["en", "fr"] and sum(n.values()) <= bound and n["fr"] == min(few, free) and n["en"] > 0
    got = {r.doc_id: r.lang_pred for r in identify(docs, fit(docs, 20)).filter("doc_id >= 20000").collect()}
    assert got == {20_000: "fr", 20_001: "fr", 20_002: "en"}
    assert quotas({"a": 5, "b": 1000, "c": 3}, 20) == {"c": 3, "a": 5, "b": 12} and quotas({}, 5) == {}


def test_many_languages(spark):
    """More languages than a word has bits, and more than any bound of old."""
    rows = [(10 * i + k, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{x}" for x in ("alpha", "beta", "gamma")), f"l{i:03}") for i in range(300) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    assert len(model.languages) > 256
    known = set(model.languages)
    got = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got if r.lang in known) / sum(r.lang in known for r in got) > 0.95


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = importance_resample(docs, labels, share=0.5).collect()
    assert len(got) == docs.count() and abs(sum(r.selected for r in got) - len(got) / 2) <= 1
    edge = sorted((r.gumbel_key for r in got if r.selected))[0]
    assert all(r.selected == (r.gumbel_key >= edge) for r in got)
    again = {r.doc_id: r.gumbel_key for r in importance_resample(docs.repartition(3), labels, share=0.5).collect()}
    assert again == {r.doc_id: r.gumbel_key for r in got}
    assert importance_resample(docs.limit(0), labels.limit(0)).count() == 0
    odd = importance_resample(frame(spark, awkward()), labels).collect()
    assert len(odd) == len(awkward())


def test_quality_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()] + [(5000 + i, t) for i, (_, t) in enumerate(awkward())]
    marks = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()] + [(5009, 1), (5009, 1), (None, 1), (7_777, 1)]
    good = {d for d, q in marks if q == 1}

    def buckets(text):
        w = [np.frombuffer(x.encode(), np.uint8) for x in brute.words(text)]
        h = [int(bk.span(bk.prefix(x), np.array([0]), np.array([len(x)]))[0]) for x in w]
        one = lambda v: int(bk.mix(np.array([v % 2**64], dtype=np.uint64))[0])
        return [x % 10_000 for x in h] + [one(a * 31 + one(b)) % 10_000 for a, b in zip(h, h[1:])]

    raw, target, of = np.zeros(10_000), np.zeros(10_000), [buckets(t) for _, t in rows]
    for (d, _), found in zip(rows, of, strict=True):
        for b in found:
            raw[b] += 1
            target[b] += d in good
    ratio = np.log((target + 1) / (target.sum() + 10_000)) - np.log((raw + 1) / (raw.sum() + 10_000))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.doc_id: r.key for r in table.selectExpr("doc_id", "xxhash64(doc_id, coalesce(text, '')) AS key").collect()}
    got = {r.doc_id: r for r in importance_resample(table, spark.createDataFrame(marks, "doc_id long, quality long"), share=0.3, seed=7).collect()}
    draws = {}
    for (d, _), found in zip(rows, of, strict=True):
        weight = sum(ratio[b] for b in found)
        uniform = ((int(bk.mix(np.array([(keys[d] + 7) % 2**64], dtype=np.uint64))[0]) >> 11) + 0.5) / 2**53
        draws[d] = weight - np.log(-np.log(uniform))
        assert got[d].n_grams == len(found) and abs(got[d].log_weight - weight) < 1e-6 and abs(got[d].gumbel_key - draws[d]) < 1e-6
    least = sorted(draws.values(), reverse=True)[round(0.3 * len(rows)) - 1]
    assert all(got[d].selected == (v >= least - 1e-9) for d, v in draws.items())


def test_every_query_is_there():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
