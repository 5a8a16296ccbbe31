"""Operators on documents against brute force, over the small table and over edge rows."""

from __future__ import annotations

import io
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tests.llm import plain

import public_tokenizers
from quaylight.llm import byte_bpe, language, licenses, media, near_dedup, packing, queries, repetition, substring_dedup

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * i % 977}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
EDGE = [
    (1, "", "en"), (2, " \t\n\r\x0b\x0c ", "en"), (3, None, "de"), (4, LONG, None), (5, LONG, "en"), (6, "one two", "en"), (7, "One TWO", "en"), (8, "one  two\n", "fr"),
    (9, f"before {PASSAGE} after", "en"), (10, f"other words {PASSAGE} and an end {PASSAGE}", "en"), (11, f"İstanbul ﬁne é ＡＢＣ 漢字かな 🙂🙂 x y z {PASSAGE}", "en"),
    (12, "a b a b a b a b a b a b a b a b a b a b a b a b", "en"), (13, "#tag *bold* $5 100% a&b | <x>\nline one\nline one\n \nline one \nline one", "en"),
    (14, "12345 3.14 don't we'll I'm <|endoftext|> <|startoftext|> </w> ’s \x00 \x85 　 ÀÉÎ ǅ ß ẞ Ω ẛ̣", "en"), (15, "x" * 5000, "en"), (16, "é" * 700 + " " * 900 + "\n" * 20, "fr"),
]


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string")
    clashes = ["repeat_id", "Repeat_Marks", "repeat_whole", "__repeat_id", "__repeat_marks", "gone", "__gone", "lot", "salt", "node", "key", "ids", "n", "uid", "bucket", "places", "marks", "rep", "component", "s", "score", "at", "total", "part", "h1"]
    return docs.withColumns({c: F.lit("clash") for c in clashes}).cache()


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def texts(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["edge", "table"])
def test_repetition(which, request):
    docs = request.getfixturevalue(which)
    got = rows(repetition.repetition_verdicts(docs))
    for d, t in texts(docs):
        want = plain.base_numbers(t)
        assert {k: got[d][k] for k in want} == want, d
        assert not (got[d]["kept"] and want["base_failed"])
        w = plain.words(t)
        if len(w) <= 400:
            hit, longest = plain.repeats(w, 8)
            assert got[d]["longest_repeat_words"] == longest
            assert got[d]["repeated_chars"] == sum(len(w[i]) for i in hit)
    assert repetition.keep_good(docs).columns == docs.columns


@pytest.mark.parametrize("which", ["edge", "table"])
@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(which, size, percent, request):
    docs = request.getfixturevalue(which)
    got = {d: (r["n_shingles"], r["component_id"]) for d, r in rows(near_dedup.near_duplicate_groups(docs, size, percent)).items()}
    want = plain.groups(texts(docs), size, percent)
    assert got == want
    kept = near_dedup.keep_one_of_each(docs, size, percent)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert kept.columns == docs.columns


def test_near_duplicates_in_one_large_group(spark):
    """Near copies of one text, each changed a little: chains, far members and rare elements all occur."""
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(120)]
    made = []
    for d in range(260):
        w = list(base if d < 200 else made[d - 200][1].split())
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, len(w)))] = f"n{d}"
        made.append((d, " ".join(w)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {d: (r["n_shingles"], r["component_id"]) for d, r in rows(near_dedup.near_duplicate_groups(docs, 3, 85)).items()}
    assert got == plain.groups(made, 3, 85)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_in_mixed_groups(spark, seed):
    """Groups whose members mostly aren't linked with any pivot: chains, families of one text and lists of shared changes."""
    rng = np.random.default_rng(seed)
    made: list[tuple[int, str]] = []
    for g in range(4):
        base = [f"g{g}v{i}" for i in range(60)]
        families = [[f"f{g}_{k}_{i}" if rng.random() < 0.2 else w for i, w in enumerate(base)] for k in range(12)]
        for w in families:
            for _ in range(8):
                w = list(w)
                for _ in range(int(rng.integers(0, 3))):
                    w[int(rng.integers(0, 60))] = f"n{rng.integers(0, 6)}"
                made.append((len(made), " ".join(w[: int(rng.integers(50, 61))])))
    order = rng.permutation(len(made))
    made = [(int(d), made[k][1]) for k, d in enumerate(order)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {d: (r["n_shingles"], r["component_id"]) for d, r in rows(near_dedup.near_duplicate_groups(docs, 2, 80)).items()}
    assert got == plain.groups(made, 2, 80)


def test_components(spark, tmp_path):
    """A long path, a star, a ring and a pair under shuffled names; a path takes few rounds."""
    from quaylight.sources.scratch import Scratch

    names = np.random.default_rng(4).permutation(6000).tolist()
    path = [(names[i], names[i + 1]) for i in range(3999)]
    star = [(names[4000], names[4000 + i]) for i in range(1, 900)]
    ring = [(names[5000 + i], names[5000 + (i + 1) % 500]) for i in range(500)]
    links = spark.createDataFrame([*path, *star, *ring, (names[5998], names[5999]), (names[5999], names[5998])], "a long, b long")
    scratch = Scratch(spark, "components")
    written: list[str] = []
    put = scratch.put
    scratch.put = lambda name, df: written.append(name) or put(name, df)
    got = {r["node"]: r["component"] for r in near_dedup.components(links, scratch).collect()}
    for part in (names[:4000], names[4000:4900], names[5000:5500], names[5998:]):
        assert {got[x] for x in part} == {min(part)}
    assert len(got) == 4000 + 900 + 500 + 2
    assert sum("up" in x for x in written) <= 2 + np.log2(4000)


def test_superminhash():
    """Against a plain version of one set at a time; estimates lie closer to the truth than independent hashes would."""
    size, mask = 64, (1 << 64) - 1

    def one(elements):
        out = [mask] * size
        for e in elements:
            order = list(range(size))
            for j in range(size):
                r = int(near_dedup.mix(np.array([(e + (j + 1) * 0x9E3779B97F4A7C15) & mask], np.uint64))[0])
                k = j + (r >> 40) % (size - j)
                order[j], order[k] = order[k], order[j]
                out[order[j]] = min(out[order[j]], (j << 40) | (r & ((1 << 40) - 1)))
        return out

    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 64, 90, dtype=np.uint64)
    docs = np.repeat([0, 1, 2, 3], [1, 7, 0, 82])
    got = near_dedup.superminhash(docs, hashes, 4, size)
    assert [r.tolist() for r in got] == [one(hashes[docs == d].tolist()) for d in range(4)]
    errors = []
    for _ in range(300):
        h = rng.integers(0, 1 << 64, 90, dtype=np.uint64)
        a, b = near_dedup.superminhash(np.repeat([0, 1], 60), np.concatenate([h[:60], h[30:]]), 2, size)
        errors.append((a == b).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.015 and np.var(errors) < 0.9 * (1 / 3) * (2 / 3) / size


@pytest.mark.parametrize("which", ["edge", "table"])
@pytest.mark.parametrize("window", [5, 20, 50])
def test_substrings(which, window, request):
    docs = request.getfixturevalue(which)
    got = rows(substring_dedup.removal_digests(docs, window))
    want = plain.removed(texts(docs), window)
    for d, (w, gone) in want.items():
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), len(gone), plain.sha(left)), d
    cut = rows(substring_dedup.remove_repeats(docs, window))
    for d, (w, gone) in want.items():
        assert plain.words(cut[d]["text"]) == [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("which", ["edge", "table"])
def test_bpe(which, request):
    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.load(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = rows(byte_bpe.bpe_digests(docs, path, public_tokenizers.PATTERN))
    for d, t in texts(docs):
        ids = library.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == plain.sha(np.array(ids, "<u4").tobytes()), d
        assert got[d]["decoded_sha256"] == plain.sha(t or "")
    both = byte_bpe.decode_column(byte_bpe.encode_column(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert both.filter(~F.decode("decoded", "UTF-8").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


@pytest.mark.parametrize("which", ["edge", "table"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, end_id=1).collect()
    of, placed = {}, {}
    for r in pieces:
        of.setdefault(r["doc_id"], []).append(r)
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for parts in placed.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
        sizes.append(sum(n for _, n in parts))
    assert max(sizes) <= 2048 and all(n & (n - 1) == 0 for n in sizes)
    for d, t in texts(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(of.pop(d), key=lambda r: r["start"])
        at = 0
        for r in parts:
            assert r["start"] == at and r["doc_tokens"] == len(ids), d
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()), d
            at += r["length"]
        assert at == len(ids)
    assert not of
    assert {r["n_tokens"] for r in packing.sequences(packing.pack(docs, path, end_id=1)).collect()} <= {1 << k for k in range(12)}


def test_added_tokens(spark):
    """Strings of added tokens inside words, next to each other, cut short, in capitals and beside signs that normalise."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(11)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "|>", "word", "don't", "'s", "é", "e\u0301", "\u0301", "ﬁ", " ", "\n", "7", "漢字", "<", ">", "|", "\u3000"]
    texts_ = ["".join(bits[k] for k in rng.integers(0, len(bits), int(rng.integers(1, 12)))) for _ in range(3000)]
    tokenizer = packing.FragmentTokenizer(path)
    ids, sizes = tokenizer.encode(pa.array(texts_))
    want = [e.ids for e in library.encode_batch(texts_, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    assert {49406, 49407} <= set(ids.tolist())


def test_hilbert_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    order = points[np.argsort(packing.hilbert_keys(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("which", ["edge", "table"])
def test_media(which, request):
    docs = request.getfixturevalue(which)
    pictures = media.text_pictures(docs)
    got, stored = rows(media.read_text_pictures(pictures)), rows(pictures)
    for d, t in texts(docs):
        raw = (t or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert media.read_netpbm(bytes(stored[d]["media"])).tobytes() == payload
        want = {"n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": plain.sha(payload), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(stored[d]["media"]), "media_sha256": plain.sha(bytes(stored[d]["media"]))}
        assert {k: got[d][k] for k in want} == want
        cells = direct_means(np.frombuffer(payload, np.uint8).reshape(-1, 64), 8, 9) if len(payload) < 20_000 else None
        if cells is not None:
            clear = np.abs(cells[:, :-1] - cells[:, 1:] - 1e-9) > 1e-7
            bits = np.unpackbits(np.frombuffer(bytes.fromhex(got[d]["feature"]), np.uint8)).reshape(8, 8)
            assert (bits == (cells[:, :-1] > cells[:, 1:] + 1e-9))[clear].all()
            assert (np.abs(np.load(io.BytesIO(got[d]["tile"])) - direct_means(np.frombuffer(payload, np.uint8).reshape(-1, 64), 32, 32)) <= 0.5 + 1e-6).all()
        assert got[d]["tile_sha256"] == plain.sha(bytes(got[d]["tile"]))


def test_pictures_round_trip(spark):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (13, 7), dtype=np.uint8), rng.integers(0, 256, (6, 9, 3), dtype=np.uint8)
    assert (media.read_bmp(media.write_bmp(grey)) == grey).all() and (media.read_bmp(media.write_bmp(colour)) == colour).all()
    assert (media.read_netpbm(media.write_pgm(grey)) == grey).all()
    assert (media.read_netpbm(b"P2 # c\n2 2\n9\n1 2\n3 9\n") == [[1, 2], [3, 9]]).all()
    assert (media.read_netpbm(b"P1\n3 1\n101\n") == [[1, 0, 1]]).all()
    assert (media.read_netpbm(b"P4\n3 1\n\xa0") == [[1, 0, 1]]).all()
    small = media.area_resize(grey, 5, 3)
    wide = np.kron(grey, np.ones((5, 3))).reshape(5, 13, 3, 7).mean((1, 3))
    assert np.allclose(small, wide)
    df = spark.createDataFrame([(1, bytearray(media.write_bmp(colour)), "x"), (2, None, "x"), (3, bytearray(b"P5\n9"), "x")], "id long, media binary, tile string")
    got = rows(media.media_tiles(df), "id")
    assert got[1]["height"] == 6 and got[1]["width"] == 9 and len(got[1]["dhash"]) == 16
    assert got[2]["tile"] is None and got[2]["media_error"] is None and got[3]["media_error"]


def direct_means(pixels, rows, columns):
    """Area means sample by sample: each cell's overlap with each sample."""
    height, width = pixels.shape[:2]
    over = lambda size, cells: np.array([[max(0.0, min(i + 1, (c + 1) * size / cells) - max(i, c * size / cells)) for i in range(size)] for c in range(cells)])
    a, b = over(height, rows), over(width, columns)
    return np.einsum("ri,ij...,cj->rc...", a, pixels.astype(float), b) * (rows * columns) / (height * width)


def test_tiles(spark, tmp_path):
    """White is 255 whatever the file's maximum, ink is dark, and broken files give a reason; tiles are read again as NPY."""
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (21, 10), dtype=np.uint8)
    media_ = {
        "white of 9": b"P2\n2 2\n9\n9 9 9 9\n", "all ink": b"P1\n2 2\n1111", "no ink": b"P4\n8 1\n\x00", "dark": b"P5\n2 1\n255\n\x00\x01", "deep": b"P5\n1 1\n65535\n\xff\xff", "grey": media.write_pgm(grey),
        "over": b"P2\n1 1\n255\n300\n", "below": b"P2\n1 1\n255\n-4\n", "over stored": b"P5\n1 1\n9\n\x0a", "huge": b"P5\n99999999999 99999999999\n255\n\x00", "short": b"P6\n3 3\n255\nab", "empty": b"",
        "palette": media.write_bmp(grey)[:46] + (4).to_bytes(4, "little") + media.write_bmp(grey)[50:],
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in media_.items()], "name string, media binary")
    media.write_tiles(media.media_tiles(df, rows=3, columns=4), str(tmp_path / "tiles"))
    got = rows(spark.read.parquet(str(tmp_path / "tiles")), "name")
    tile = lambda name: np.load(io.BytesIO(got[name]["tile"]))
    assert (tile("white of 9") == 255).all() and (tile("all ink") == 0).all() and (tile("no ink") == 255).all() and tile("dark").max() <= 1 and (tile("deep") == 255).all()
    assert (np.abs(tile("grey") - direct_means(grey, 3, 4)) <= 0.5 + 1e-9).all()
    for name in ("over", "below", "over stored", "huge", "short", "empty", "palette"):
        assert got[name]["tile"] is None and got[name]["media_error"], name
    cells = direct_means(grey, 8, 9)
    bits = "".join("1" if a > b + 1e-9 else "0" for r in cells for a, b in zip(r, r[1:], strict=False))
    assert got["grey"]["dhash"] == f"{int(bits, 2):016x}"


def test_broken_media():
    """Changed and cut files either decode or raise ValueError."""
    rng = np.random.default_rng(9)
    whole = [media.write_bmp(rng.integers(0, 256, (5, 6), dtype=np.uint8)), media.write_bmp(rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)), b"P2\n3 2\n20\n1 2 3 4 5 6\n", b"P1\n3 2\n101010\n", b"P4\n9 2\nabcd", media.write_pgm(np.ones((4, 4), np.uint8))]
    for _ in range(4000):
        data = bytearray(whole[rng.integers(0, len(whole))])
        for _ in range(int(rng.integers(1, 5))):
            data[int(rng.integers(0, min(60, len(data))))] = int(rng.integers(0, 256))
        try:
            media.npy_tile(*media.read_media(bytes(data[: int(rng.integers(0, len(data) + 1))]))[:1], 4, 4)
        except ValueError:
            pass


def test_language(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_codes(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)
    model = language.fit_language(edge)
    assert {r["lang_pred"] for r in language.predict_language(edge, model).collect()} <= {"und", "en", "de", "fr"}
    assert language.keep_known(edge, model).columns == edge.columns
    none = language.fit_language(edge.limit(0))
    assert {r["lang_pred"] for r in language.predict_language(edge, none).collect()} == {"und"}


def test_codewords():
    for n in range(2, 20):
        code = language.codewords(n).astype(int)
        assert len({tuple(x) for x in code}) == n
        if n > 2:
            assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_licenses(spark):
    docs = spark.createDataFrame([
        (1, "Released under the MIT License."), (2, "spdx-license-identifier: GPL-3.0-or-later"), (3, "Nothing here."), (4, None), (5, "All rights reserved. Released under the MIT license."),
        (6, "You may obtain a copy of the License at http://x"), (7, "Licensed under the Apache License, Version 2.0"),
        (8, "Copyright me\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\nEnd"),
    ], "doc_id long, text string")
    got = {d: (r["licenses"], r["verdict"]) for d, r in rows(licenses.scan_licenses(docs)).items()}
    assert got[1] == ("MIT", "permissive") and got[2] == ("GPL-3.0-or-later", "copyleft") and got[3] == got[4] == ("", "none")
    assert got[5] == ("MIT,proprietary", "restricted") and got[7] == ("Apache-2.0", "permissive")
    assert got[8] == ("GPL-3.0-or-later", "copyleft")


NOTICES = {
    "MIT": 'MIT License\n\nCopyright (c) 2020 Me\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def test_wrapped_notices(spark):
    """Full notices at several line widths, plain and in comments, between lines of code and prose."""
    want, made = {}, []
    for name, notice in NOTICES.items():
        for width in (30, 57, 72, 400):
            wrapped = ["\n".join(textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False)) for p in notice.split("\n\n")]
            body = "\n\n".join(wrapped)
            for style in ("{}", "# {}", " * {}", "// {}", "-- {}"):
                lines = "\n".join(style.format(x).rstrip() for x in body.split("\n"))
                text = {" * {}": f"/*\n{lines}\n */\nint main;", "{}": f"Some prose\n\n{lines}\n\nMore of it."}.get(style, f"{lines}\n\nimport x")
                want[len(made)] = name
                made.append((len(made), text))
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("s", "ids", "left", "hit0")})
    got = {d: r["licenses"] for d, r in rows(licenses.scan_licenses(docs)).items()}
    assert {d: (x, made[d][1]) for d, x in got.items() if x != want[d]} == {}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*made, (-1, None), (-2, ""), (-3, "\n\n\n"), (-4, "x " * 200_000 + "\nAll rights reserved")])
    sql = {r[0]: r for r in con.sql(f"SELECT doc_id, licenses, n_sentences, n_known FROM ({licenses.scan_sql()})").fetchall()}
    assert {d: x[1] for d, x in sql.items() if d >= 0} == got
    edge = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n\n\n"), (-4, "x " * 200_000 + "\nAll rights reserved"), (-4, "x " * 200_000 + "\nAll rights reserved")], "doc_id long, text string")
    assert {(r["doc_id"], r["licenses"], r["n_sentences"], r["n_known"]) for r in licenses.scan_licenses(edge).collect()} == {x for d, x in sql.items() if d < 0}


def test_empty_and_repeated(spark, edge):
    path = public_tokenizers.path("word_bpe_49k.json")
    for f in (repetition.repetition_verdicts, near_dedup.near_duplicate_groups, substring_dedup.removal_digests, licenses.scan_licenses, media.text_pictures, lambda d: packing.pack(d, path, 1)):
        assert f(edge.limit(0)).count() == 0
    loose = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    for f in (repetition.repetition_verdicts, near_dedup.near_duplicate_groups, substring_dedup.removal_digests, licenses.scan_licenses, media.text_pictures, lambda d: packing.pack(d, path, 1).filter("start = 0")):
        assert f(loose).count() == 4


def test_copies_of_one_id(spark):
    """Rows that share an id share places; a whole copy is told from another text of its id."""
    long_ = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, long_), (2, long_), (2, other), (3, other), (3, long_), (4, "  " + long_.replace(" ", "\n")), (5, long_ + " end")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.removal_digests(docs, 20).collect())
    assert got == [(1, 30, 0), (2, 30, 0), (2, 30, 30), (3, 30, 30), (3, 30, 30), (4, 30, 30), (5, 31, 30)]
