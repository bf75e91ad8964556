"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from support import database, rows

from quillspark.llm import byte_bpe, chat, components, hnsw, mixing, mixing_lm, near_text, pii, pivot_join, queries, shared, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    data = [(k, t, "en", more.get("source", "s"), len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


ODD = ["", None, " ", "a", "a", "<|endoftext|> it's 12345", "日本語 ünï 😀\n\n x", "word " * 3000, "x" * 3000]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    mine, other = queries.queries()[name](spark, FOLDER).toPandas(), database(FOLDER).execute(queries.oracle_sql()[name]).df()
    assert rows(mine) == rows(other)


# -- 1 byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path(queries.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, encoding):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(documents(spark, ODD).selectExpr("-1 - doc_id", "text"))
    docs = docs.selectExpr("*", "1 as n_tokens", "2 as ids_sha256")
    found = byte_bpe.encode_documents(docs, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found.collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_long_pieces_and_full_memory(encoding, monkeypatch):
    vocab = byte_bpe.Vocabulary(public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aäbc1 !") for _ in range(500)) for _ in range(50)] + ["ab" * 5000, "é" * 999, "x" * 64, "y" * 65]
    monkeypatch.setattr(byte_bpe, "CACHE", 100)
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    for text, row in zip(texts, byte_bpe.round_trip(vocab, texts, True)):
        assert row[3] == encoding.encode_ordinary(text)


# -- 2 WARC


def test_warc_salvage_of_damaged_files():
    records = [warc.record("response", k, f"http://h/{k}", f"body {k} WARC/1.1\r\n".encode() * 50, "d", None) for k in range(5)]
    plain = b"".join(records)
    broken = bytearray(plain)
    at = len(records[0]) + len(records[1]) // 2
    broken[at] ^= 255
    found = warc.salvage(bytes(broken))
    assert [h["warc-record-id"] for _, h, _ in found.records] == [f"<urn:page:{k}>" for k in (0, 2, 3, 4)]
    assert [(a, b) for a, b, _ in found.gaps] == [(len(records[0]), len(records[0]) + len(records[1]))]
    members = [warc.member(r) for r in records]
    packed = bytearray(b"junk" + b"".join(members)[:-5])
    cut = 4 + len(members[0]) + 20
    packed[cut : cut + 4] = b"\0\0\0\0"
    found = warc.salvage(bytes(packed))
    assert [h["warc-record-id"] for _, h, _ in found.records] == [f"<urn:page:{k}>" for k in (0, 2, 3, 4)]  # the last one is whole, though its member is cut
    assert len(found.gaps) == 3 and found.gaps[0][:2] == (0, 4) and found.gaps[-1][1] == len(packed)
    assert warc.salvage(b"").records == [] and warc.salvage(b"nothing here").gaps == [(0, 12, "no version line")]


def test_warc_members_of_several_records_and_damaged_plain_files():
    records = [warc.record("response", k, f"http://h/{k}", f"body {k} ".encode() * 50, "d", None) for k in range(6)]
    ids = lambda found: [h["warc-record-id"][10:-1] for _, h, _ in found.records]
    whole = warc.salvage(warc.member(b"".join(records[:3])) + warc.member(records[3]))
    assert ids(whole) == ["0", "1", "2", "3"] and not whole.gaps
    # a bad record within a sound member, and a member cut after its second record
    bad = bytearray(b"".join(records[:3]))
    bad[len(records[0]) + 5] ^= 255
    found = warc.salvage(warc.member(bytes(bad)) + warc.member(records[3]))
    assert ids(found) == ["0", "2", "3"] and len(found.gaps) == 1 and f"bytes {len(records[0])} to" in found.gaps[0][2]
    import os as system

    large = warc.record("response", 9, "u", system.urandom(50_000), "d", None)
    packed = warc.member(b"".join(records[:2]) + large)
    found = warc.salvage(packed[:-30_000] + warc.member(records[3]))
    assert ids(found) == ["0", "1", "3"] and found.gaps[0][:2] == (0, len(packed) - 30_000)
    broken = bytearray(packed)
    broken[20_000:20_010] = b"\xff" * 10
    assert set(ids(warc.salvage(bytes(broken) + warc.member(records[4])))) >= {"0", "1", "4"}
    # a plain file whose first version line is damaged and whose bodies are gzip members
    bodies = [warc.record("response", k, "u", warc.member(b"html %d" % k * 20), "d", None) for k in range(4)]
    found = warc.salvage(b"XXXX" + b"".join(bodies)[4:])
    assert ids(found) == ["1", "2", "3"] and found.gaps == [(0, len(bodies[0]), "no version line")]


def test_warc_round_trip_edges(spark):
    long = "<p>é</p>" * 300
    pages = spark.createDataFrame([(1, "u", long, 0), (2, "u\r\nX: y", long, 0), (3, None, None, 0), (4, "u", "", 0), (None, "u", long, 0), (-5, "u", "short", 0), (6, "u", "short", 0)], "page_id long, url string, html string, size int")
    found = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(found) == 7
    assert (found[2].record_type, found[1].record_type, found[1].refers_to, found[None].refers_to) == ("response", "revisit", 2, 2)
    assert found[1].payload_bytes == len(long.encode()) and found[1].payload_digest == hashlib.sha1(long.encode()).hexdigest()
    assert found[3].payload_bytes == 0 and found[-5].record_type == found[6].record_type == "response"
    assert warc.round_trip(pages.where("false")).count() == 0


# -- 3 toxicity


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = queries.op3_toxicity(spark, folder).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def test_toxicity_edges(spark):
    rng = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna"]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" grumblefoo" if k % 3 == 0 else "") for k in range(200)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    asked = ["grumblefoo", "grumblefoos here", "lorem ipsum", "", None, "lorem " * 20000 + "Grumblefoo!"]
    scored = {r.id: r.score for r in toxicity.score(documents(spark, asked).selectExpr("*", "lang as score"), model).selectExpr("row.doc_id as id", "score").collect()}
    assert scored[0] > 0.5 and scored[1] > 0.5 and scored[5] > 0.5 and max(scored[2], scored[3], scored[4]) < 0.5
    assert toxicity.score_documents(docs, labels.where("false")).where("score is null").count() == 0
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0
    clash = docs.selectExpr("*", "1 as score", "2 as toxicity_score", "3 as row")
    kept = toxicity.without_toxic(clash, labels)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {k for k in range(200) if k % 3}


def test_toxicity_reads_long_words_whole():
    one, other = (set(toxicity.distinct_parts("a" * 80 + middle + "b" * 80)) for middle in ("badword", "goodone"))
    grams = lambda parts: {row for part in parts for row in toxicity.bag(part)}
    assert grams(one) != grams(other) and grams(["badword"])  # its n-grams without the marks of word ends
    inner = {row for n in toxicity.GRAMS for k in range(7 - n + 1) for row in [zlib.crc32("badword"[k : k + n].encode()) % toxicity.BUCKETS]}
    assert inner <= grams(one)


def test_toxicity_score_is_that_of_a_plain_sum():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -0.5)
    for text in ("One two, three-four one", "x", "", "!!!", "y" * 200):
        words = [[np.mean([model.rows[row] for row in toxicity.bag(part)]) for part in toxicity.parts_of(word)] for word in set(text.lower().split())]
        values = [max(parts) for parts in words if parts]
        expected = model.bias + (max(values) + np.mean(values) if values else 0)
        assert toxicity.text_logits([text], model, text)[0] == pytest.approx(expected, rel=1e-4)


# -- 4 language model


def test_workers_keep_the_memory_of_one_operator_only(spark):
    toxicity.text_logits(["some words"], toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0), "key")
    assert toxicity._known
    near_text.shingles("other words", 5)
    assert near_text._words and not toxicity._known
    toxicity.text_logits(["some words"], toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0), "key")
    assert toxicity._known and not near_text._words
    shared.release()
    assert not toxicity._known

    def left(batches):  # after the tasks of a worker
        yield from (pa.RecordBatch.from_pydict({"n": [len(near_text._words)]}) for _ in batches)

    near_text.describe(documents(spark, ["a b c", "d e"]), 5, "doc_id", "text").coalesce(1).collect()
    assert {r.n for r in spark.range(8).mapInArrow(left, "n long").collect()} == {0}


def test_mixing_lm_base_and_model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "THE the \x85 "), (-3, "THE the \x85 ")], "doc_id long, text string"))
    out = {r.doc_id: r for r in mixing_lm.score_documents(docs.selectExpr("*", "1 as n", "2 as word")).collect()}
    counts, held = {}, {}
    for r in docs.collect():
        held[r.doc_id] = zlib.crc32(str(r.doc_id).encode()) % 7 == 2
        if not held[r.doc_id]:
            for w in [*(r.text or "").encode().lower().split(), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in docs.collect():
        words = [*(r.text or "").encode().lower().split(), b""]
        got = out[r.doc_id]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (held[r.doc_id], len(words), sum(w in counts for w in words), n)
        assert got.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words))
        assert got.score < 0 and got.bits_per_byte == pytest.approx(-got.score * math.log2(10) / (len((r.text or "").encode()) + 1))
    assert mixing_lm.score_documents(docs.where("false")).count() == 0


def trained():
    rng = random.Random(8)
    texts = [[*(rng.choice([b"the", b"of", b"stone", b"water", b"x%d" % rng.randint(0, 60)]) for _ in range(40)), b""] for _ in range(120)]
    counts = {}
    for text in texts:
        for word in text:
            counts[word] = counts.get(word, 0) + 1
    common = sorted((w for w in counts if counts[w] > 60), key=lambda w: (-counts[w], w))
    n = np.array([counts[w] for w in common])
    ordered, number = mixing_lm.in_order(common, n, sum(counts.values()) - int(n.sum()))
    of_number = np.full(len(ordered), sum(counts.values()) - n.sum())
    of_number[number - 1] = n
    codes, tables = mixing_lm.Codes(ordered, of_number), mixing_lm.tables_for(5000)
    learner = mixing_lm.Learner(tables)
    for part in mixing_lm.parts(texts, codes, 200):
        learner.step(0, *mixing_lm.number_choices(codes, tables, part.ids, part.first, part.lead)[:3])
        learner.step(1, *mixing_lm.letter_choices(codes, tables, part.spelled)[:3])
    model = mixing_lm.Model(mixing_lm.codes_of(learner.counts).view(np.uint16), learner.weights, learner.refined)
    return texts, codes, tables, model


def test_mixing_lm_is_a_distribution():
    _, codes, tables, model = trained()
    ids = np.arange(1, len(codes.sizes))
    for before in (codes.number[b"the"], codes.spelled):
        total = 0.0
        for one in ids.tolist():
            total += 10 ** model.logs(0, *mixing_lm.number_choices(codes, tables, np.array([before, one]), np.array([True, False]), 1))[0]
        assert 0.999 < total <= 1 + 1e-6  # numbers of the greatest length that no word has keep a little
    slots, shares, bits, _ = mixing_lm.letter_choices(codes, tables, [bytes([b]) for b in range(256)])
    sizes = np.stack([codes.letter_sizes, np.full(256, codes.letter_sizes[32])], axis=1).ravel()
    assert (10 ** model.logs(1, slots, shares, bits, sizes)[::2]).sum() == pytest.approx(1, abs=1e-4)


def test_mixing_lm_equals_a_mixer_of_single_choices():
    texts, codes, tables, model = trained()
    text = texts[3] + texts[4]
    ids = np.array([codes.number.get(w, codes.spelled) for w in text])
    first = np.zeros(len(ids), bool)
    first[[0, len(texts[3])]] = True
    slots, shares, bits, sizes = mixing_lm.number_choices(codes, tables, ids, first, 0)
    # the contexts of each word, one by one
    for k in range(len(ids)):
        begin = k if first[k] else max(j for j in range(k) if first[j])
        own = ids[begin:k].tolist()
        last = next((i for i in reversed(own) if i < mixing_lm.FREQUENT), 0)
        again = mixing_lm.number_choices(codes, tables, np.array([last, *own[-2:], ids[k]] if own else [ids[k]]), np.array([True, *[False] * (1 + len(own[-2:]))] if own else [True]), 1 + len(own[-2:]) if own else 0)[0]
        at = int(sizes[:k].sum())
        assert all((again[t] == slots[t][at : at + sizes[k]]).all() for t in (range(4) if len(own) > 1 else (0, 1)))
    total = 0.0
    for k in range(len(bits)):
        zeros, ones = zip(*((float(mixing_lm.VALUES[c & 255]), float(mixing_lm.VALUES[c >> 8])) for c in (int(model.levels[s[k]]) for s in slots)))
        level = [min(7, int(z + o).bit_length()) * 2 + (min(z, o) > 0) for z, o in zip(zeros, ones)]
        gate = (level[0] * 16 + level[1]) * 3 + min(level[2] // 2, 2)
        mixed = sum(float(model.weights[t, gate]) * math.log((o + 0.3) / (z + 0.3)) for t, (z, o) in enumerate(zip(zeros, ones))) + float(model.weights[4, gate]) * float(shares[k]) + float(model.weights[5, gate])
        mixed = min(11.99, max(-11.99, mixed))
        at = (mixed + 12) * 32 / 24
        low = int(at)
        table = model.refined[gate * 33 + low] * (1 - at + low) + model.refined[gate * 33 + low + 1] * (at - low)
        final = (mixed + float(table)) / 2
        total += math.log10(1 / (1 + math.exp(-final if bits[k] else final)))
    assert model.logs(0, slots, shares, bits, sizes).sum() == pytest.approx(total, rel=1e-4)


def test_mixing_lm_does_not_depend_on_the_parts(monkeypatch):
    texts, codes, tables, model = trained()
    texts = [*texts[:5], [*(w for t in texts[5:20] for w in t[:-1]), b"never", b""], [b""]]
    found = []
    for size in (7, 100, 10_000):
        monkeypatch.setattr(mixing_lm, "SCORE_WORDS", size)
        found.append(mixing_lm.scored_texts(codes, tables, model, np.zeros(len(codes.sizes)), texts))
    for other in found[1:]:
        assert np.allclose(other.logs, found[0].logs) and (other.known == found[0].known).all() and other.rest == found[0].rest
    assert found[0].rest[5][b"never"] == 1


def test_mixing_lm_beats_the_base(spark):
    rows = mixing_lm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and np.mean([r.score > r.base_score for r in rows]) > 0.8


def test_mixing_lm_shares_of_choices():
    _, codes, _, _ = trained()
    spread = np.exp(codes.shares)  # ones over zeros at each choice's node; their product gives a word its share in training
    chance = np.where(codes.bits > 0, spread / (1 + spread), 1 / (1 + spread))
    words = np.array([chance[a : a + n].prod() for a, n in zip(codes.starts[1:], codes.sizes[1:])])
    assert words.sum() == pytest.approx(1, abs=2e-3) and words[codes.number[b"the"] - 1] == pytest.approx(24 / 123, rel=0.2)


def test_mixing_lm_rare_words(spark):
    words = spark.createDataFrame([(b"once", 1), (b"also", 1), (b"twice", 2)], "word binary, n long")
    spelled = spark.createDataFrame([(b"new", -4.0)], "word binary, spelling double")
    tail = spark.createDataFrame([("a", b"once", 2), ("a", b"new", 1), ("b", b"twice", 1)], "row string, word binary, k long")
    out = {r["row"]: r for r in mixing_lm.rare_words(tail, words, spelled, 100, 2, 4).collect()}
    # unknown: (2 + 1) / (4 + 2); of the other half each occurrence has a quarter
    assert out["a"].rest_score == pytest.approx(2 * math.log10(0.5 / 4) + math.log10(0.5) - 4) and out["b"].rest_score == pytest.approx(math.log10(0.5 * 2 / 4))
    assert (out["a"].rest_known, out["b"].rest_known) == (2, 1) and out["a"].rest_base == pytest.approx(2 * math.log10(0.02) - 2)


def test_mixing_lm_packs_counts():
    counts = np.array([0, 1, 255, 256, 2**31 - 1, 70_000], np.int32)
    assert (mixing_lm.unpacked(*mixing_lm.packed(counts)) == counts).all()


def test_mixing_lm_reads_texts_in_order(spark):
    phrase = "the quick brown fox jumps over a lazy dog today".split()
    docs = spark.createDataFrame([(k, " ".join(phrase)) for k in range(40)] + [(-1, " ".join(phrase)), (-2, " ".join(phrase[::-1]))], "doc_id long, text string")
    found = {r.doc_id: r for r in mixing_lm.score_documents(docs).collect()}
    assert found[-1].base_score == pytest.approx(found[-2].base_score) and found[-1].score > found[-2].score + 1


def test_mixing_lm_splits_as_plain_tokens():
    rng = random.Random(5)
    signs = [*map(chr, range(40)), *"ABCxyzÄß\x85\xa0\u2003K😀İ"]
    texts = [None, "", " ", "\x1c \x1d", "a", *("".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(2000))]
    for own in (pa.array(texts), pa.array(texts).slice(900), pa.array([None, ""]), pa.array([], pa.string())):
        words, starts = mixing_lm.split(own)
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(starts[:-1], starts[1:])] == [[*mixing_lm.tokens(text), b""] for text in own.to_pylist()]


def test_mixing_lm_learns_without_spelled_words_and_from_counts_before():
    texts, codes, tables, _ = trained()
    texts = [[*text[:5], b"never", b""] for text in texts]
    words, starts = pa.array([w for text in texts for w in text], pa.large_binary()), np.cumsum([0, *map(len, texts)])
    own, other = (list(mixing_lm.parts([mixing_lm.numbered(words, starts, codes, spelled=k)], codes, 100)) for k in (True, False))
    assert all((a.ids == b.ids).all() and (a.first == b.first).all() and a.spelled and not b.spelled for a, b in zip(own, other, strict=True))
    counts = np.array([[z, o] for z in (*range(70), 127, 128, 300, 2**24) for o in (*range(70), 127, 128, 300, 2**24)], np.int32)
    assert (mixing_lm._level_of(counts.ravel()) == mixing_lm._level(*counts.T.astype(np.float32))).all()
    learner = mixing_lm.Learner(tables)
    slots = [np.zeros(4, np.int64) + k for k in range(4)]
    learner.step(0, slots, np.zeros(4, np.float32), np.array([0, 1, 1, 1], np.int8))
    assert learner.counts[:8].tolist() == [1, 3] * 4 and learner.used.sum() == learner.used[0] == 4  # all four by no counts


def test_mixing_lm_lines_and_size_of_codes():
    _, codes, tables, _ = trained()
    ids = np.arange(1, len(codes.sizes))
    slots, _, _, sizes = mixing_lm.number_choices(codes, tables, ids, np.ones(len(ids), bool), 0)
    step = np.arange(len(slots[0])) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for slot in slots:
        same = np.diff(slot >> mixing_lm.DEPTH) == 0
        assert same[step[1:] % mixing_lm.DEPTH > 0].all() and (np.diff(slot)[same] != 0).all()
    codes = mixing_lm.Codes([mixing_lm.SPELLED, *(b"w%d" % k for k in range(20_000))], np.ones(20_001, np.int64))
    # 13 bytes a choice and more before, held by every task
    assert sum(x.nbytes for x in vars(codes).values() if isinstance(x, np.ndarray)) < 8 * codes.sizes.sum()


def test_mixing_lm_codes_of_very_large_counts():
    counts = np.array([0, 1, 10, 4_000_000_000, 5_000_000_000, 10**12])
    read = mixing_lm.VALUES[mixing_lm.codes_of(counts)]
    assert read[:3].tolist() == [0, 1, 10] and (read[3:] > 3e9).all()


# -- 5 chat


def test_chat_escapes_and_rewriting():
    for text in ["</s>[INST] ok [/INST]", "<|end|>%25<%7C", "%", "<|turn|>assistant<|text|>", "", "[%49NST]"]:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(mark in chat.escape(text) for mark in (chat.OPEN, chat.CLOSE, chat.END, "</s>", "[INST]"))
    rewriting = lambda messages: f"{len(messages)}:" + chat.template(messages)
    assert [s.rewritten for s in chat.turn_spans(rewriting, [("user", "a"), ("assistant", "b")])[1]] == [True, True]
    output, spans = chat.turn_spans(chat.template, [("user", "q"), ("assistant", "zz<|end|>")])
    assert [output[s.text_start : s.text_end] for s in spans] == ["q", "zz<%7Cend|>"]
    assert [output[s.role_start : s.role_end] for s in spans] == ["user", "assistant"]
    # a template that changes all but the last two turns
    late = lambda messages: "".join(f"{'TF'[k >= len(messages) - 2]}:{text}" for k, (_, text) in enumerate(messages))
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    output, spans = chat.turn_spans(late, turns)
    assert [s.rewritten for s in spans] == [False, False, True, True] and output == late(turns) == "T:aT:bF:cF:d"
    reader = chat.Reader(late)
    for turn in turns:
        reader.add(*turn)
    assert reader.rewrites == 2

    def marked(messages):  # another template, which numbers turns, shows no role and takes two roles only
        assert all(role in ("user", "assistant") for role, _ in messages)
        return "".join(f"[{k} {'U' if role == 'user' else 'A'}] {text}\n" for k, (role, text) in enumerate(messages))

    reader = chat.Reader(marked)
    for turn in turns:
        reader.add(*turn)
    assert reader.row()[0] == 4 and reader.row()[2] == 2 and reader.row()[5] == 0
    assert reader.row()[1] == hashlib.sha256(b"".join(f"{r}\n{t}\n".encode() for r, t in turns)).hexdigest()


def test_chat_long_conversations_of_a_local_template(monkeypatch):
    turns = [(("user", "assistant")[k % 2], f"t{k}" * (k % 5)) for k in range(40)]
    found = []
    for whole in (1000, 3):
        monkeypatch.setattr(chat, "WHOLE", whole)
        reader = chat.Reader(chat.template)
        for turn in turns:
            reader.add(*turn)
        found.append(reader.row())
    assert found[0] == found[1] and found[0][4] == len(chat.template(turns))


def plain_turn(messages):
    return "".join(f"<{role}>{text}</{role}>" for role, text in messages)


def test_chat_reads_templates_that_do_not_escape():
    texts = ["100%25 sure <%7C", "x%2Fs> [%49NST]", ""]
    turns = [("assistant", t) for t in texts]
    reader = chat.Reader(plain_turn)
    for turn in turns:
        reader.add(*turn)
    expected = hashlib.sha256("".join(texts).encode()).hexdigest()
    assert reader.row()[2:4] == (sum(map(len, texts)), expected) and reader.row()[5] == 0


def test_chat_finds_rewriting_after_many_turns(monkeypatch):
    def late(messages):  # claims to be local, and rewrites once there are 650 turns
        return ("late:" if len(messages) >= 650 else "") + plain_turn(messages)

    late.local = True
    turns = [(("user", "assistant")[k % 2], f"turn {k} " + "x" * (k % 7)) for k in range(700)]
    monkeypatch.setattr(chat, "WHOLE", 200)
    found = {}
    for claim in (None, False):
        reader = chat.Reader(late, claim)
        for turn in turns:
            reader.add(*turn)
        found[claim] = reader.row()
    assert found[None] == found[False] and found[None][5] == 1


def test_chat_of_long_texts_takes_linear_time():
    text = "y" * 20_000
    reader = chat.Reader(chat.template)
    for k in range(512):  # 10 MB
        reader.add(("user", "assistant")[k % 2], text)
    assert reader.row()[:1] == (512,) and reader.row()[2] == 256 * 20_000
    assert reader.formatted_chars == len(chat.template([(("user", "assistant")[k % 2], text) for k in range(512)]))


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, "user", "hi", 0), (None, 0, "user", "x", 0), (2, 0, "assistant", "a" * 100000, 0), (2, 0, "assistant", "b", 0)], "conv_id long, turn long, role string, text string, n_turns int")
    found = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert found[1].n_turns == 2 and found[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\n").hexdigest()
    assert found[2].loss_chars == 100001 and found[None].loss_chars == 0 and found[1].rewrites == 0
    assert chat.format_conversations(turns.where("false")).count() == 0


# -- 6 and 10 vectors


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[0]
    x[60:80] = x[1] + rng.normal(size=(20, 8)) * 0.15
    data = [(k, v.tolist(), k % 2, 0) for k, v in enumerate(x)]
    data += [(1000, None, 0, 0), (1001, [0.0] * 8, 0, 0), (1002, [float("nan")] * 8, 0, 0), (1003, [None] * 8, 0, 0), (1004, [1e30] * 8, None, 0), (1050, x[0].tolist(), None, 0)]
    return x, data, spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rank int")


def test_hnsw_recall_and_scores(spark):
    x, data, df = vectors(spark)
    found = hnsw.nearest_vectors(df).collect()
    good = {r[0]: np.array(r[1], float) for r in data if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [k for k in sorted(good) if k % 50 == 0]
    hits = 0
    for q, rows_ in got.items():
        score = lambda k: float(good[q] @ good[k] / np.linalg.norm(good[q]) / np.linalg.norm(good[k]))  # noqa: B023, E731
        best = sorted(((-round(score(k), 12), k) for k in good if k != q))[:5]
        assert all(abs(s - score(v)) < 1e-12 for _, v, s in rows_)
        hits += len({k for _, k in best} & {v for _, v, _ in rows_})
    assert hits / (5 * len(got)) > 0.95
    assert [v for _, v, _ in sorted(got[0])] == [50, 51, 52, 53, 54]
    assert hnsw.nearest_vectors(df.where("false")).count() == 0
    assert len(hnsw.nearest_vectors(df.where("vec_id in (0, 1, 2)")).collect()) == 2


def test_pivot_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_join, "CELL", 20)
    x, data, df = vectors(spark)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2) & ~np.eye(300, dtype=bool)
    parent = list(range(300))
    for _ in range(300):
        new = [min([parent[k], *(parent[j] for j in np.flatnonzero(linked[k]))]) for k in range(300)]
        if new == parent:
            break
        parent = new
    found = {r.vec_id: r for r in pivot_join.near_vectors(df).collect()}
    for k in range(300):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (linked[k].sum(), parent[k], parent[k] == k)
    assert all(found[k].n_links == 0 and found[k].kept for k in (1000, 1001, 1002, 1003, 1004, 1050))
    assert pivot_join.near_vectors(df.where("false")).count() == 0


def test_pivot_forest_joins_what_is_linked():
    rng = np.random.default_rng(4)
    for density in (0.0, 0.02, 0.2, 1.0):
        linked = rng.random((40, 50)) < density
        rows, columns = np.arange(40), np.arange(30, 80)  # ten ids are on both sides
        a, b = pivot_join.forest(linked, rows, columns)
        parent = list(range(80))

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        def pieces(pairs):
            for k in range(80):
                parent[k] = k
            for x, y in pairs:
                parent[max(root(x), root(y))] = min(root(x), root(y))
            return [root(k) for k in range(80)]

        every = [(int(rows[i]), int(columns[j])) for i, j in zip(*np.nonzero(linked))]
        assert pieces(list(zip(a.tolist(), b.tolist()))) == pieces(every) and len(a) <= 90


def test_hnsw_recall_at_production_size(spark):
    """All embeddings of the largest test table, with the query's own parameters, against all pairs."""
    folder = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    found = {}
    for r in queries.op6_hnsw(spark, folder).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        score = (x * x[k]).sum(axis=1)
        score[k] = -2
        best = ids[np.lexsort((ids, -score))[:5]]
        mine = [v for _, v, _ in sorted(found[ids[k]])]
        hits, total = hits + len(set(best.tolist()) & set(mine)), total + 5
    assert hits / total >= 0.97


# -- 7 mixing


def test_mixing_targets_and_bounds(spark):
    rng = random.Random(4)
    data = [(k, "w " * rng.randint(0, 40), "en", rng.choice(["a", "b", "c", "c", "c", None]), 0) for k in range(3000)] + [(None, "w w", "en", "b", 0), (7, None, "en", "a", 0)]
    docs = spark.createDataFrame(data, DOCS).selectExpr("*", "'clash' as target")
    found = mixing.mix(docs).collect()
    assert len(found) == len(data) and all(0 <= r.taken <= 2 * r.size for r in found)
    by = {}
    for r in found:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    total = sum(s for s, _ in by)
    assert sum(t for _, t in by) == pytest.approx(min(1.5 * total, sum(2 * s for s, _ in by)))
    assert all(abs(sum(taken) - target) <= 40 for (_, target), taken in by.items())
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert all(again[r.doc_id, r.size] == r.taken for r in found)
    clash = docs.selectExpr("*", "'keep' as mix_source", "7 as mix_copies", "8 as row", "9 as class")
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and {(r.mix_source, r.mix_copies) for r in mixed.collect()} == {("keep", 7)}
    assert mixing.mix(docs.where("false")).count() == 0
    # long documents are likelier to get one copy more
    more = [(r.size, r.taken // r.size) for r in found if r.size and 0 < r.target < 2 * r.source_size]
    assert np.mean([n for size, n in more if size > 30]) > np.mean([n for size, n in more if size < 8])


# -- 8 personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            if kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255 or kind == "card" and 14 <= len(digits) <= 19 and luhn or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), n, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_pii_base_and_terms(spark):
    odd = ["a@b.c_d@e.f", "😀 a@b.co 1.2.3.4.5.6.7.8 1.2.3.256 001.02.3.0004 +1 (499) 555-6503", "4111 1111 1111 1111 4111-1111-1111-1112", None, "", "x" * 50000 + "@y" + ".z" * 2000, "1" * 20000, "a@b@c.d a@b.c@d.e +12", "12 34 567 " * 400 + "1-2 3-4"]
    told = [f"{w} meet Zorblax at zor@mail.com for lunch {k}" for k, w in enumerate(["one", "two", "three", "four"])]
    calm = [f"lunch with nobody number {k} meet for at" for k in range(40)]
    texts = odd + told + told + calm
    docs = documents(spark, texts).selectExpr("*", "lang as spans")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    for k, text in enumerate(texts):
        assert found[k].base_sha256 == hashlib.sha256(base_spans(text or "").encode()).hexdigest(), text
    assert found[9].spans == "term:9:16,email:20:32" and found[13].spans == found[9].spans
    assert all(found[k].spans == "" for k in range(17, len(texts)))
    clean = {r.doc_id: r for r in pii.scrub(documents(spark, texts)).collect()}
    assert clean[9].text == "one meet [TERM] at [EMAIL] for lunch 0" and clean[9].n_chars == len(clean[9].text)
    assert clean[3].text is None and clean[20].text == texts[20]
    assert pii.find(docs.where("false")).count() == 0
    odd = documents(spark, texts).selectExpr("*", "1 as pii_row", "2 as spans", "3 as row", "4 as base")
    assert pii.scrub(odd).columns == odd.columns


def test_pii_terms_far_from_the_entity_and_without_it(spark):
    gap = "calm words that say nothing at all of anybody who might be meant by this long line "
    texts = [f"Zorblax {gap} Li {gap} zor@mail.com {k} {gap} ZORBLAX" for k in range(9)] + ["we saw Zorblax alone"] + [f"{gap} {k}" for k in range(60)]
    found = {r.doc_id: r.spans for r in pii.find(documents(spark, texts)).collect()}
    mail, li = texts[0].index("zor@"), texts[0].index("Li")
    assert found[0] == f"term:0:7,term:{li}:{li + 2},email:{mail}:{mail + 12},term:{len(texts[0]) - 7}:{len(texts[0])}"
    assert found[9] == "term:7:14" and all(found[k] == "" for k in range(10, len(texts)))


def test_pii_two_texts_are_enough_and_copies_of_one_are_not(spark):
    two = ["here Zorblax has zor@mail.com", "there is Zorblax of zor@mail.com"] + ["Quux writes from quux@mail.com"] * 5
    texts = two + [f"here there is has of writes from plain text number {k}" for k in range(20)]
    found = {r.doc_id: r.spans for r in pii.find(documents(spark, texts)).collect()}
    assert found[0] == "term:5:12,email:17:29" and found[1] == "term:9:16,email:20:32"
    assert all("term" not in found[k] for k in range(2, len(texts)))


def test_pii_places_of_chosen_matches(spark):
    texts = ["one 😀 two  three", "", "one", " ".join(["two", "x"] * 200)]
    found = documents(spark, texts).select("doc_id", F.regexp_extract_all("text", F.lit(pii.TERM), F.lit(0)).alias("found"), F.split("text", pii.TERM, -1).alias("gaps"))
    found = found.withColumn("chosen", F.expr("filter(transform(found, (x, i) -> if(x = 'two', i, null)), i -> i is not null)"))
    out = found.select("doc_id", pii.places(F.col("found"), F.col("gaps"), chosen=F.col("chosen")).alias("places")).collect()
    for r in out:
        assert [tuple(p) for p in r.places] == [(m.start(), m.end(), "two") for m in re.finditer("two", texts[r.doc_id])]


def test_pii_terms_equal_brute_force(spark):
    rng = random.Random(6)
    names, mails = [f"name{chr(97 + k)}{chr(97 + k)}" for k in range(8)], [f"m{k}@x.org" for k in range(8)]
    texts = []
    for _ in range(250):
        words = [rng.choice(["some", "plain", "filler", "Text", "l\u00e9ger"]) for _ in range(rng.randint(0, 12))]
        k = rng.randrange(8)
        if rng.random() < 0.4:
            words += [mails[k], *([names[k]] if rng.random() < 0.9 else []), *([names[(k + 1) % 8].upper()] if rng.random() < 0.2 else [])]
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:20] + [None, ""]
    terms, entities = [], []
    for text in texts:
        mail = re.compile(PLAIN["email"])
        entities.append({m.lower() for m in re.findall(r"m\d@x\.org", text or "")})
        terms.append({w.lower() for w in re.findall(r"[^\W\d_]+", mail.sub(lambda m: " " * len(m[0]), text or ""))})
    n, telling = len(texts), set()
    for e in set().union(*entities):
        with_e = [t for t, own in zip(terms, entities) if e in own]
        for term in set().union(*with_e) if len(with_e) >= 3 else ():
            both, alone = sum(term in t for t in with_e), sum(term in t for t in terms)
            if both >= 3 and math.log(both / alone / (len(with_e) / n)) / math.log(n / len(with_e)) >= 0.8:
                telling.add(term)
    assert 0 < len(telling) < 9
    for r in pii.find(documents(spark, texts)).collect():
        text = texts[r.doc_id] or ""
        bare = re.sub(r"m\d@x\.org", lambda m: " " * len(m[0]), text)
        spans = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in re.finditer(r"m\d@x\.org", text)]
        spans += [(m.start(), 4, f"term:{m.start()}:{m.end()}") for m in re.finditer(r"[^\W\d_]+", bare) if m[0].lower() in telling]
        assert r.spans == ",".join(x for _, _, x in sorted(spans))


# -- 9 near-duplicates


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return sets, parent


def test_near_text_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 300))
    base, passage = [word() for _ in range(80)], [word() for _ in range(60)]
    texts = list(ODD)
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))]) for _ in range(100)]
    texts += ["One two three four", "one TWO three\tfour", "one two three four five"]
    sets, parent = brute_components(texts)
    docs = documents(spark, texts).selectExpr("*", "1 as id", "2 as component_id", "3 as n_shingles")
    found = {r.doc_id: r for r in near_text.near_duplicates(docs).collect()}
    for k in range(len(texts)):
        assert (found[k].n_shingles, found[k].component_id, found[k].kept) == (len(sets[k]), parent[k], parent[k] == k)
    assert near_text.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(1, 200).selectExpr("id as a", "id - 1 as b").union(spark.createDataFrame([(500, 501), (501, 500)], "a long, b long"))
    found = {r.id: r.component for r in components.connected_components(edges).collect()}
    assert set(found) == {*range(200), 500, 501} and {found[k] for k in range(200)} == {0} and found[501] == 500
