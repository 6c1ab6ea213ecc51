"""Archives, tokens, stores, classifiers, licences, leaks and the pipeline against brute force, round trips and held-out rows."""

import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DATA, rows_of
from llm_helpers import WORDS, prose
from strataflow.llm import bpe_automaton as bpe
from strataflow.llm import chunk_store, decontaminate, exact_dedup, license_rules, order_minhash, quality, registry, toxicity, warc
from strataflow.llm.common import shared_dir, table
from strataflow.llm.lexer import Lexer


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


# ---- archives


def test_warc_query_equals_sql(spark, duck):
    assert rows_of(warc.op3_warc_archive(spark, DATA).toPandas()) == rows_of(duck.execute(warc.OP3_SQL).df())


def test_warc_awkward_pages(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/ x\r\ny", big, 1), (2, None, big, 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", other, 1), (5, "u", other, 1), (None, "u", other, 1), (6, "u", "small", None), (7, "u", "small", 1), (8, "u", "c" * 999, 1), (9, "u", "c" * 999, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = shared_dir(spark, "warc")
    index = warc.write_archive(pages, folder, frame_bytes=2000, bundle_bytes=3000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(index, folder).collect()), key=repr)
    last = {big: 2, other: 5}
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and i != last[h]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert got == sorted(want, key=repr)
    one = warc.read_archive(index.filter("page_id = 7"), folder).collect()
    assert [bytes(r.payload) for r in one] == [b"small"]
    empty = shared_dir(spark, "warc")
    assert warc.read_archive(warc.write_archive(pages.limit(0), empty), empty).count() == 0


def test_bundles_are_seekable_zstandard(spark):
    import pyarrow.fs as pafs
    import zstandard

    folder = shared_dir(spark, "warc")
    index = warc.write_archive(table(spark, DATA, "pages"), folder, frame_bytes=10_000)
    path = index.first()["bundle"]
    data = pafs.LocalFileSystem().open_input_file(path).read()
    frames = warc.seek_table(pafs.LocalFileSystem().open_input_file(path), len(data))
    assert len(frames) > 1
    raw = b"".join(zstandard.ZstdDecompressor().decompress(data[s : s + n]) for s, n, _ in frames)
    assert raw.startswith(b"WARC/1.1\r\n") and len(raw) == sum(f[2] for f in frames)
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as whole:  # a plain reader skips the table
        assert whole.read() == raw


# ---- tokens


ODD = ["a", "th", "in", "ing", "'s", "'ll", "'", "S", "Σ", "İ", "ß", "é", "é", "́", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\xa0", " ", "​", "　", "1", "23", "½", "Ⅷ", "_", "-", "!", "<|endoftext|>", "<|startoftext|>", "<|", "日", "😀", "ﬁ", "\x00", "\x85", "ǅ", "क्ष", "aaa", "the"]


def test_automaton_is_the_library(library):
    spec = bpe.tokenizer_spec(bpe.vocabulary())
    lexers = bpe.automaton_lexer(spec, bpe.compiled(spec)), Lexer(spec, "<u2"), Lexer(spec, "<u2", most=50)
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(15))) for _ in range(3000)] + ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 18))) for _ in range(2000)]
    for lexer in lexers:
        for part in itertools.batched(texts, 100):
            offsets, ids = lexer.encode(list(part))
            for i, text in enumerate(part):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_characters_are_encoded_whole(library):
    spec = bpe.tokenizer_spec(bpe.vocabulary())
    text = "héllo wörld, it's <|endoftext|> 12"
    for lexer in (bpe.automaton_lexer(spec, bpe.compiled(spec)), Lexer(spec, "<u2")):
        lexer.known.add("é")
        lexer.odd.add("é")
        offsets, ids = lexer.encode(["plain", text, ""])
        assert offsets.tolist() == [0, 1, len(ids), len(ids)] and ids[1:].tolist() == library.encode(text, add_special_tokens=False).ids


def test_groups_encode_words_once_and_as_the_library(library):
    spec = bpe.tokenizer_spec(bpe.vocabulary())
    each_mark = spec.replace("[^\\\\s\\\\p{L}\\\\p{N}]+", "[^\\\\s\\\\p{L}\\\\p{N}]")  # another way of cutting runs of marks
    assert each_mark != spec
    rng = random.Random(6)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(15))) for _ in range(2000)] + ["", "!", "a!?", "it's", "don't.'s", "'", "''s", "x--", "--x", "é...", "12.", "_a_"]
    texts += [" ".join("".join(rng.choice("etaon") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "", ".", ",", "?!"]) for _ in range(40)) for _ in range(500)]
    for one in (spec, each_mark):
        whole = type(library).from_str(one)
        for most in (1, 10**9):
            lexer, met = Lexer(one, "<u2"), []
            encode = lexer.words
            lexer.words = lambda words, encode=encode, met=met: (met.extend(words), encode(words))[1]
            batches = [(i, list(part)) for i, part in enumerate(itertools.batched(texts, 100))]
            found = list(lexer.grouped([*batches, ("none", [])], most))
            assert [k for k, _, _ in found] == [k for k, _ in batches] + ["none"] and found[-1][1].tolist() == [0]
            for (_, part), (_, offsets, ids) in zip(batches, found[:-1], strict=True):
                for i, text in enumerate(part):
                    assert ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
            assert most == 1 or max(met.count(w) for w in ("etaon", "et", "?!", *met[::50])) <= 2  # once more if also in a piece cut by the library
    assert list(Lexer(spec, "<u2").grouped([])) == []


def test_small_automata_are_greedy_merging():
    def merged(word, merges):
        parts = list(word)
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    rng = random.Random(1)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(rng.randrange(1, 9)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        vocab = {t: i for i, t in enumerate(tokens)}
        machine = bpe.Automaton(vocab, merges)
        for n in range(1, 7):
            for word in map("".join, itertools.product("abc", repeat=n)):
                assert [tokens[i] for i in machine.encode(word.encode())] == merged(word, merges), (merges, word)
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def brute_tokens(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_encoding_and_decoding(spark, library, awkward, nothing):
    path = bpe.vocabulary()
    once = lambda d: bpe.digests(bpe.encode_documents(d, path, decode=True))
    twice = lambda d: bpe.digests(bpe.decode_documents(bpe.encode_documents(d, path), path))
    for run, docs in ((once, awkward), (twice, awkward), (once, table(spark, DATA, "documents"))):
        assert sorted(map(tuple, run(docs).collect()), key=repr) == brute_tokens(library, [(r.doc_id, r.text) for r in docs.collect()])
    assert once(nothing).count() == twice(nothing).count() == 0
    odd = spark.createDataFrame([(1, [320, 10**6, None, -1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode_documents(odd, path).collect()} == {1: "a</w>", 2: ""}


def brute_store(library, rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_store(spark, library, awkward, nothing):
    docs = table(spark, DATA, "documents")
    got = sorted(map(tuple, chunk_store.op8_chunk_store(spark, DATA).collect()))
    assert got == brute_store(library, [(r.doc_id, r.text) for r in docs.collect()])
    folder = shared_dir(spark, "store")
    chunk_store.write_store(awkward, folder, bpe.vocabulary(), kind="<u4")
    digests = chunk_store.read_digests(spark, folder, "<u4").collect()
    want = brute_store(library, [(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in digests if r.doc_id) == sorted((i, n, c) for i, _, n, c in want if i)
    assert sorted(r.start for r in digests) == [0, *np.cumsum([r.n_tokens for r in sorted(digests, key=lambda r: r.start)])[:-1].tolist()]
    ids = {r.start: list(r.ids) for r in chunk_store.read_documents(spark, folder, "<u4").collect()}
    assert all(zlib.crc32(np.array(ids[r.start], "<u4").tobytes()) == r.ids_crc32 for r in digests)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    empty = shared_dir(spark, "store")
    chunk_store.write_store(nothing, empty, bpe.vocabulary())
    assert chunk_store.read_digests(spark, empty).count() == 0


def test_store_detects_damage(spark):
    folder = shared_dir(spark, "store")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([prose(1, 900), "one chunk", "another", "", prose(2, 50), "last"])], "doc_id long, text string")
    chunk_store.write_store(docs.repartition(3), folder, bpe.vocabulary())
    sound = {r.doc_id for r in chunk_store.read_digests(spark, folder).collect()}
    assert sound == set(range(6))
    one = spark.read.parquet(f"{folder}/recipes").filter("doc_id = 1").first()
    part = one["part"]

    def damaged(table_name, change, match):
        bad = shared_dir(spark, "store")
        for name in ("chunks", "recipes", "manifest", "head"):
            rows = spark.read.parquet(f"{folder}/{name}")
            rows = change(rows) if name == table_name else rows
            rows.write.partitionBy(*["part"] * (name == "recipes")).parquet(f"{bad}/{name}")
        for read in (chunk_store.read_digests, chunk_store.read_documents):
            with pytest.raises(Exception, match=match):
                read(spark, bad).collect()

    damaged("chunks", lambda d: d.withColumn("ids", F.concat("ids", F.lit(b"\0\0"))), "damaged")
    others = F.col("address") != F.lit(bytes(one["addresses"][0]))  # than that of a document of one chunk
    damaged("chunks", lambda d: d.filter(others), "are stored")
    damaged("chunks", lambda d: d.filter(others).unionByName(d.filter(others).limit(1)), "absent")
    damaged("recipes", lambda d: d.filter("doc_id != 1"), "follow|manifest")
    damaged("recipes", lambda d: d.filter("doc_id != 5"), "follow|manifest")
    damaged("recipes", lambda d: d.filter(f"part != {part}"), "manifest")
    damaged("recipes", lambda d: d.withColumn("start", F.expr("start + if(doc_id = 5, 1, 0)")), "follow|manifest")
    damaged("recipes", lambda d: d.withColumn("doc_id", F.expr("if(doc_id = 5, 7, doc_id)")), "manifest")
    damaged("recipes", lambda d: d.withColumn("addresses", F.expr("reverse(addresses)")), "root")
    damaged("recipes", lambda d: d.withColumn("sizes", F.expr("if(size(sizes) > 1, transform(sizes, (x, i) -> if(i = 0, x + 1, if(i = 1, x - 1, x))), sizes)")), "another size")
    damaged("recipes", lambda d: d.withColumn("n_chunks", F.expr("n_chunks + if(doc_id = 0, 1, 0)")), "root")
    damaged("chunks", lambda d: d.unionByName(d.limit(1)), "are stored")
    damaged("manifest", lambda d: d.filter(f"part != {part}"), "head")
    damaged("head", lambda d: d.limit(0), "head")


def test_cuts_are_content_defined():
    ids = np.random.default_rng(0).integers(0, 49_000, 20_000)
    ends = chunk_store.cuts(ids)
    moved = chunk_store.cuts(np.concatenate([ids[:5000], [7, 8, 9], ids[5000:]]))
    assert ends[-1] == 20_000 and np.diff(ends, prepend=0).max() <= chunk_store.MAX_CHUNK
    assert len(set((ends + 3).tolist()) & set(moved.tolist())) > 0.7 * len(ends[ends > 5000])
    assert chunk_store.cuts(np.zeros(9000, int)).tolist()[-1] == 9000 and len(chunk_store.cuts(np.array([1]))) == 1


# ---- classifiers


def labelled(spark, scored, column):
    return scored.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").select("held_out", "predicted", "score", F.col(column).alias("label")).toPandas()


def test_quality_on_held_out_rows(spark):
    rows = labelled(spark, quality.op2_quality_rff(spark, "/root/testdata/sf0.01"), "quality")
    held = rows[rows.held_out]
    assert len(held) > 50 and (held.predicted == held.label).mean() > 0.95
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(spark, toxicity.op4_toxicity_chain(spark, "/root/testdata/sf0.01"), "toxic")
    held = rows[rows.held_out]
    assert (held.predicted == held.label).mean() > 0.9 and held[held.label == 0].predicted.mean() < 0.05


@pytest.mark.parametrize("score, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_on_awkward_rows(spark, awkward, nothing, score, label):
    labels = spark.createDataFrame([(i, i % 2, None) for i in (1, 2, 3, 3, 5, 9, 13)] + [(None, 1, 1), (4, None, 0)], f"doc_id long, {label} int, extra int")
    got = score(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert score(nothing, labels).count() == 0
    assert {r.score for r in score(awkward, labels.limit(0)).collect()} == ({0.5} if label == "quality" else {0.0})
    assert {r.held_out for r in got if r.doc_id == 1} == {zlib.crc32(b"1") % 3 == 1}


def test_labels_lang_and_source_are_no_inputs(spark):
    docs = table(spark, DATA, "documents")
    a = quality.quality_scores(docs, table(spark, DATA, "labels")).toPandas().set_index("doc_id")["score"].sort_index()
    b = quality.quality_scores(docs.withColumn("lang", F.lit("xx")), table(spark, DATA, "labels").withColumn("quality", F.when(quality.remainder("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))).toPandas().set_index("doc_id")["score"].sort_index()
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_isotonic_regression_pools():
    x, y = quality.pooled(np.array([1.0, 2, 3, 4]), np.array([0.0, 5, 1, 8]), np.array([10.0, 10, 10, 10]))
    assert (np.diff(y) >= 0).all() and len(y) == 3
    x, y = quality.pooled(np.array([1.0, 2]), np.array([900.0, 1]), np.array([1000.0, 1]))
    assert (np.diff(y) >= 0).all()
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        weight = rng.integers(1, 50, n).astype(float)
        x, y = quality.pooled(np.sort(rng.normal(size=n)), np.floor(rng.random(n) * (weight + 1)), weight)
        assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 < y.min() and y.max() < 1


def test_quality_equals_one_matrix(spark):
    """Sums by partition, folds and calibration against one matrix in memory."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    body, offsets = np.frombuffer(b"".join(t for _, t in texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for _, t in texts])])
    stats = np.vstack([quality.text_stats.doc_stats(body[a:b], np.array([0, b - a])) for a, b in itertools.pairwise(offsets)]).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i, _ in texts])
    on = np.array([known.get(i) is not None for i, _ in texts]) & (fold != 1)
    y = np.array([known.get(i) or 0 for i, _ in texts], float)
    mean, scale = stats[on].mean(0), stats[on].std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    z = quality.expanded(stats, mean, scale)

    def ridge(rows):
        penalty = quality.RIDGE * rows.sum() * np.eye(z.shape[1])
        penalty[-1, -1] = 1e-9 * rows.sum()
        return np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ y[rows])

    raw = np.where(fold == 0, z @ ridge(on & (fold == 2)), z @ ridge(on & (fold == 0)))
    cell = np.clip(np.floor((raw + 1) / 3 * quality.BINS), 0, quality.BINS - 1)
    cells = sorted((raw[on & (cell == c)].mean(), y[on & (cell == c)].sum(), float((on & (cell == c)).sum())) for c in set(cell[on]))
    x, p = quality.pooled(*map(np.array, zip(*cells, strict=True)))
    want = np.clip(np.interp(z @ ridge(on), x, p), 0, 1)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert np.abs(want - np.array([got[i] for i, _ in texts])).max() < 1e-6


# ---- licences and leaks


def test_license_query_equals_sql(spark, duck):
    assert rows_of(license_rules.op7_license_rules(spark, DATA).toPandas()) == rows_of(duck.execute(license_rules.OP7_SQL).df())


def test_license_sentences_over_lines_and_odd_blanks(spark):
    """Notices wrapped as files wrap them, against a search of word lists that shares no code."""
    assert all(re.search(license_rules.WORDS, x) for x in license_rules.numbered()[0])
    rules = license_rules.RULES
    rows, want = [], {}
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "Apache-2.0"):
        for variant in rules[name]:
            for width, lead in ((70, ""), (76, " * "), (40, "# ")):
                text = f"Copyright 2020 Someone\n{lead}\n" + f"\n{lead}\n".join(textwrap.fill(x, width, initial_indent=lead, subsequent_indent=lead) for x in variant) + f"\n{lead}\nint main;"
                rows.append((len(rows), text))
    for blank in ("  ", "\t", "\u00a0", "\n", "\r\n"):
        rows.append((len(rows), f"Mine.\n\nAll rights{blank}reserved."))
    rows.append((len(rows), "All rights\n\nreserved. Not all rights\nreserved."))
    for i, text in rows:
        parts, part = [], []
        for line in text.lower().split("\n"):
            if not any(c.isascii() and c.isalnum() for c in line):
                parts, part = [*parts, part], []
                continue
            bits = re.split(r"(?<=[.!?;])[ \t\r]+|(?<=[.!?;])$", line)
            for bit in bits[:-1]:
                parts, part = [*parts, [*part, bit]], []
            part = [*part, bits[-1]] if bits[-1] else part
        words = [re.findall("[a-z0-9]+", " ".join(p)) for p in [*parts, part]]
        words = [w for w in words if w]
        known = [w for w in words if any(w == re.findall("[a-z0-9]+", x.lower()) for variants in rules.values() for v in variants for x in v)]
        places = [(n, k, k + len(v)) for n, variants in rules.items() for v in variants for s in [[re.findall("[a-z0-9]+", x.lower()) for x in v]] for k in range(len(known)) if known[k : k + len(s)] == s]
        inner = lambda p: any(q[1] <= p[1] and p[2] <= q[2] and q[2] - q[1] > p[2] - p[1] for q in places)
        want[i] = sorted({p[0] for p in places if not inner(p)})
    got = {r.doc_id: r.licenses for r in license_rules.license_findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: n for i, n in want.items() if n} and sum(map(bool, want.values())) >= len(rows) - 1


def test_license_notices_as_files_hold_them(spark):
    two = license_rules.RULES["BSD-2-Clause"][0]
    prose = "We walked along the river and talked about the harvest of last year. "
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    cases = [
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint x;", ["MPL-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
        (f"1. {two[0]}\n2. {two[1]}", ["BSD-2-Clause"]),
        (f"{two[0]}\n{prose * license_rules.GAP}\n{two[1]}", ["BSD-2-Clause"]),
        (f"{two[0]}\n{prose * (license_rules.GAP + 1)}\n{two[1]}", []),
        (f"{two[0]}\n{prose * 180}\n{two[1]}", []),
        (f"{two[0]}\n{'word ' * 2500}\n{two[1]}", []),
        ("## License\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", ["MIT"]),
        ("This project is licensed under the MIT License, see LICENSE.txt.", ["MIT"]),
        ("The parser of the neighbours is not licensed under the MIT License", []),
        ("// SPDX-License-Identifier: Apache-2.0\npackage main", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", []),
        (apache, ["Apache-2.0"]),
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_rules.license_findings(docs).collect()}
    assert [got.get(i, []) for i in range(len(cases))] == [want for _, want in cases]
    assert len({name for name, _ in license_rules.variants()}) >= 30


def test_license_rules(spark, awkward, nothing):
    texts = {name: " intro.\n" + "\n".join(seq) + "\nend." for name, variants in license_rules.RULES.items() for seq in variants[:1]}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_rules.license_findings(docs).collect()}
    assert all(name in got[i] for i, name in enumerate(texts))
    broken = spark.createDataFrame([(1, "\n".join(reversed(license_rules.RULES["BSD-2-Clause"][0]))), (2, "Released  under the MIT\tLICENSE!!! Then more.")], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_rules.license_findings(broken).collect()}
    assert got == {1: [], 2: ["MIT"]}
    two, three = (license_rules.RULES[n][0] for n in ("BSD-2-Clause", "BSD-3-Clause"))
    nested = spark.createDataFrame([(None, "\n".join(three)), (2, "\n".join(two)), (2, "\n".join([*three, *two])), (3, "word " * 200_000 + "\n\n" + "\n".join(two)), (4, None)], "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.licenses) for r in license_rules.license_findings(nested.withColumn("trail", F.lit(1)).withColumn("licenses", F.lit("x"))).collect())
    assert got == [("2", ["BSD-2-Clause"]), ("2", ["BSD-2-Clause", "BSD-3-Clause"]), ("3", ["BSD-2-Clause"]), ("None", ["BSD-3-Clause"])]
    assert license_rules.license_findings(awkward).count() == 0 and license_rules.license_findings(nothing).count() == 0


def brute_overlaps(docs, items, window=decontaminate.WINDOW, subs=decontaminate.SUBSTITUTIONS):
    import regex

    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    out = set()
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            n, need = min(window, len(v)), (len(v) if len(v) < window else window - subs)
            if v and any(sum(a == b for a, b in zip(w[p : p + n], v[q : q + n], strict=False)) >= need for p in range(len(w) - n + 1) for q in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_masks_hit_every_window_with_two_substitutions():
    for i, j in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(all(m == "0" or s + k not in (i, j) for k, m in enumerate(mask)) for mask in decontaminate.MASKS for s in range(decontaminate.WINDOW - len(mask) + 1))


@pytest.mark.parametrize("limit", [decontaminate.SEED_ROWS, 1])
def test_leaks(spark, awkward, nothing, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SEED_ROWS", limit)
    rng = random.Random(4)
    items = [(k, prose(500 + k, rng.choice([5, 7, 8, 9, 12, 13, 20, 40]))) for k in range(12)] + [(50, None), (51, ""), (52, prose(500, 20))]
    docs = []
    for d in range(40):
        words = prose(900 + d, 60).split()
        item = rng.choice(items[:12])[1].split()
        cut = item[: rng.choice([len(item), max(1, len(item) - 2), 10])]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            cut[rng.randrange(len(cut))] = rng.choice(WORDS)
        at = rng.choice([0, 20, 60])
        docs.append((d, ", ".join(words[:at] + cut + words[at:]).upper() if d % 2 else " ".join(words[:at] + cut + words[at:])))
    docs.append((None, items[8][1]))
    bench = spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, doc_id double")
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame, bench).collect()}
    want = brute_overlaps(docs, items)
    assert got == want and len(want) > 8
    clean = decontaminate.decontaminated(frame, bench)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.overlaps(nothing, bench).count() == 0 and decontaminate.overlaps(frame, bench.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "word"), (2, None), (None, "word"), (1, "lonely words without a number")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.first_word, r.end_word) for r in decontaminate.overlaps(awkward, odd).collect()} == {(9, 1, 0, 1), (10, 1, 0, 1), (None, 1, 0, 5)}


def test_leaks_with_clashing_columns_many_places_and_no_ids(spark):
    from strataflow.llm import common

    bench = spark.createDataFrame([(1, "cat"), (2, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    long_text = "dog " + "cat " * 100_000
    rows = [(1, long_text, 7, 8, 9, 10), (2, "dog", 7, 8, 9, 10), (None, "dog", 7, 8, 9, 10), (None, "a cat", 7, 8, 9, 10), (None, " ".join(f"w{i}" for i in range(20)), 7, 8, 9, 10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id int, _None int, _salt int, mark int")
    got = {tuple(r) for r in decontaminate.overlaps(frame, bench).collect()}
    assert got == {(1, 1, 1, 100_001), (None, 1, 1, 2), (None, 2, 0, 20)}
    clean = decontaminate.decontaminated(frame, bench)
    assert clean.columns == frame.columns and [tuple(r) for r in clean.collect()] == [rows[1]]
    # beyond the broadcast the salt is named apart from the columns too
    small = spark.createDataFrame([(7,)], "_id int")
    assert common.lookup_join(frame, small, ["_id"], "inner", ["doc_id"], most=0).select(*frame.columns).exceptAll(frame).isEmpty()


def test_leaks_on_the_table(spark):
    docs, bench = table(spark, DATA, "documents"), table(spark, DATA, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontaminate(spark, DATA).collect()}
    assert got == brute_overlaps([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_leaks_equal_sql(spark):
    """Items of all lengths, substitutions, and spans at the ends of texts."""
    import duckdb

    rng = random.Random(12)
    items = [(k, prose(700 + k, rng.choice([1, 2, 3, 4, 6, 9, 13, 30]))) for k in range(14)]
    docs = []
    for d in range(60):
        cut = rng.choice(items)[1].split()
        cut = cut[: rng.choice([len(cut), 12, 15])]
        for _ in range(rng.choice([0, 1, 2, 3])):
            cut[rng.randrange(len(cut))] = rng.choice(WORDS)
        words = prose(800 + d, 40).split()
        at = rng.choice([0, 13, 40])
        docs.append((d, "; ".join(words[:at] + cut + words[at:])))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    con.register("benchmark", bench.toPandas())
    want = con.execute(decontaminate.OP10_SQL).df()
    assert len(want) > 15 and rows_of(decontaminate.overlaps(frame, bench).toPandas()) == rows_of(want)


def test_leaks_query_equals_sql(spark, duck):
    assert rows_of(decontaminate.op10_decontaminate(spark, DATA).toPandas()) == rows_of(duck.execute(decontaminate.OP10_SQL).df())


# ---- pipeline


def test_pipeline(spark, library):
    import corpus_pipeline

    docs = table(spark, DATA, "documents").toPandas()
    bad = quality.op2_quality_rff(spark, DATA).filter("predicted = 0").toPandas()["doc_id"]
    left = docs[~docs.doc_id.isin(bad)]
    left = left.sort_values("doc_id").drop_duplicates("text", keep="last")
    classes = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(left[["doc_id", "text"]])).collect()}
    left = left[[classes[i] == i for i in left.doc_id]]
    bench = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    leaks = {d for d, _ in brute_overlaps(list(zip(left.doc_id, left.text, strict=True)), bench)}
    left = left[~left.doc_id.isin(leaks)]
    got = sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()), key=repr)
    assert got == brute_tokens(library, list(zip(left.doc_id.tolist(), left.text, strict=True)))


def test_stages_on_awkward_rows(spark, awkward, nothing):
    import corpus_pipeline

    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            path = shared_dir(spark, "stage")
            stage(spark, docs, DATA).write.parquet(path)
            out = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            docs = out
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) == 10
    assert exact_dedup.exact_groups(awkward).count() == awkward.count()
