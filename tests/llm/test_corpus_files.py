"""Token files, Merkle manifest and alignment against plain versions, and on nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import merkle, queries, ranks, token_alignment, token_files
from quillspark.llm.shared import scratch_dir

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS, A, B = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", None, " ", "  ", "a", "a", "a ", " a", "a  b", "a \n b", "a\n b", "a;\r b", "tab\t\tx \r\n", "no break x　 y ᠎ z\x1c w\x85 v", "it's <|endoftext|> 12345", "<|startoftext|>a",
    "▁a b", "a ▁", "日本語 ünï 😀\n\n x", "é e ́x", "word " * 3000, "x" * 3000, "İstanbul ΣΑΣ", "</s> <s> <unk> <0x41>", "é.. ́. ². x², a_b_ (b) 's. o's' é. x<|endoftext|>, \"q\"...", "\0 nul", "a" + "\n" * 50 + " b",
]


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in zip(ids, texts)], DOCS)


def real_texts():
    import pyarrow.parquet as pq

    return pq.read_table(f"{FOLDER}/documents.parquet").column("text").to_pylist()


# -- ranks


def test_ranks_of_hot_groups_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randrange(40)) for _ in range(3000)] + [("z", 1)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        found = ranks.ranked(spark.createDataFrame(rows, "g string, x int"), "g", ["x"], "test").collect()
        assert not ranks.ranked(spark.createDataFrame([], "g string, x int"), "g", ["x"], "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by_group = {}
    for r in found:
        by_group.setdefault(r.g, []).append((r["rank"], r.x))
    for g, some in by_group.items():
        assert [k for k, _ in sorted(some)] == list(range(len(some)))
        assert [x for _, x in sorted(some)] == sorted(x for h, x in rows if h == g)


# -- 11 token files


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_equal_the_library(spark):
    texts = real_texts() + ODD
    docs = documents(spark, texts, [7 * k % 1009 for k in range(len(texts))]).selectExpr("*", "1 as n", "2 as ids", "3 as row_number")
    found = {r.doc_id: r for r in token_files.round_trip(docs, WORDS).collect()}
    start = 0
    for doc_id, ids in sorted(zip((7 * k % 1009 for k in range(len(texts))), plain_ids(texts))):
        assert found[doc_id] == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    assert len(found) == len(texts)


def test_token_files_of_ties_nulls_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 300)
    docs = documents(spark, ["b c", "a", None, "a", "q w e r"] * 40, [5, None, 5, 5, None] * 40)
    found = sorted(token_files.round_trip(docs, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 80 + [5] * 120
    assert [r.start for r in found] == np.r_[0, np.cumsum([r.n_tokens for r in found])[:-1]].tolist()
    assert sorted(r.ids_crc32 for r in found) == sorted(map(crc, plain_ids(["b c", "a", None, "a", "q w e r"] * 40)))
    empty = token_files.round_trip(docs.where("doc_id < 0"), WORDS)
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and not empty.collect()


def test_token_files_read_at_random(spark):
    folder = f"{scratch_dir(spark)}/corpus-of-test"
    texts = ["one two", "three", "", "four five six"]
    token_files.write_corpus(documents(spark, texts), folder, WORDS, end_id=70_000)  # needs four bytes
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/index").collect()]
    assert {r["width"] for r in rows} == {4}
    found = {}
    for row in rows:
        shard = token_files.Shard(folder, row, 4)
        assert not shard.ids.flags.writeable and shard.offsets.dtype == np.uint64
        found |= {shard.doc_ids[k].as_py(): shard[k].tolist() for k in range(len(shard))}
    assert found == {k: [*ids[:-1], 70_000] for k, ids in enumerate(plain_ids(texts))}


def test_token_files_of_many_shards_make_few_table_files(spark, monkeypatch):
    texts = [f"word {k} of many, {k * k}" for k in range(600)]
    folder = f"{scratch_dir(spark)}/corpus-of-many"
    place = Path(scratch_dir(spark).removeprefix("file://"))
    parts = lambda x: set(place.glob(f"{x}/part-*.parquet"))
    old = parts("token-*")
    with monkeypatch.context() as small:
        small.setattr(token_files, "SHARD_BYTES", 200)
        token_files.write_corpus(documents(spark, texts), folder, WORDS)
    shards = spark.read.parquet(f"{folder}/index").count()
    assert shards > 4 * spark.sparkContext.defaultParallelism
    assert len(parts("corpus-of-many/index")) == 1 and len(parts("token-*") - old) == 1  # a file for each shard before
    read = token_files.read_corpus(spark, folder)
    assert read.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism  # a task for each shard before
    found, start = {r.doc_id: r for r in read.collect()}, 0
    for k, ids in enumerate(plain_ids(texts)):
        assert found[k] == (k, start, len(ids), crc(ids))
        start += len(ids)
    assert len(found) == len(texts)


def test_token_files_forget_pieces(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 100)
    monkeypatch.setattr(token_files, "LONG", 8)
    encoder = token_files.Encoder(WORDS, 2)
    for text, ids in zip(ODD + real_texts()[:50], plain_ids(ODD + real_texts()[:50])):
        assert np.frombuffer(encoder.encode([text or ""])[0], "<u2").tolist() == ids[:-1]


def test_token_files_look_up_known_pieces_once():
    class Counted(token_files.Known):
        asked = []

        def __getitem__(self, piece):
            self.asked.append(piece)
            return super().__getitem__(piece)

    encoder = token_files.Encoder(WORDS, 2)
    encoder.encode(["the"])
    encoder.known, old = Counted(), encoder.known
    encoder.known.update(old)
    texts = ["the " * 50 + "zq\x01 neverword the", "the neverword, the"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [ids[:-1] for ids in plain_ids(texts)]
    assert Counted.asked.count(b"the") == 53


# -- 12 Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """Root, and each leaf's siblings by level as (side, digest)."""
    paths, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(of):
            other = at ^ 1
            paths[k].append((at & 1, level[other] if other < len(level) else None))
        level = [digest(*level[j : j + 2]) for j in range(0, len(level), 2)]
        of = [at // 2 for at in of]
    return level[0], paths


def fold(start, path):
    for left, other in path:
        start = digest(other, start) if left else digest(start, other or "")
    return start


def plain_manifest(rows):
    leaf = lambda r, n: digest(*map(field, (r[0], r[3], r[2], n, r[1])))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([y[2] for y in sorted(by_lang[x], key=lambda y: y[:3])]) for x in langs}
    root, tops = plain_tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        for (_, _, own, r), path in zip(sorted(by_lang[x], key=lambda y: y[:3]), trees[x][1]):
            path = path + top
            start = leaf(r, r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            folded = fold(start, path)
            out.append((r[0], own, trees[x][0], root, digest(*(s or "" for _, s in path)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 3, 64, 65, 700])
def test_manifest_equals_plain_trees(spark, size):
    rng = random.Random(size)
    langs = ["en"] * 6 + [None, "", "de", "é", "日", *(f"l{k}" for k in range(80))]
    rows = [(rng.choice([None, k, k, k, 3]), rng.choice([None, "", "x", "long " * 900, "ü"]), rng.choice(langs[: 1 + size]), rng.choice([None, "s"]), rng.choice([None, 5, -1, 2**63 - 1])) for k in range(size)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as tree", "2 as digest", "3 as rank")
    assert sorted(map(tuple, merkle.verify_documents(docs).collect()), key=str) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert not merkle.verify_documents(spark.createDataFrame([], DOCS)).collect()


# -- 13 alignment


def plain_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = {c: k for k, c in token_alignment._byte_signs().items()}
    rows, counts = [], {}
    for text in texts:
        row = None
        if text:
            one, other = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            one_bytes = [bytes(signs[c] for c in a.id_to_token(k)) for k in one]
            other_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in other]
            if b"".join(one_bytes) == b"".join(other_bytes) == (" " + text).encode():
                ends = [np.cumsum(list(map(len, x))).tolist() for x in (one_bytes, other_bytes)]
                links, j = [], 0
                for i, end in enumerate(ends[0]):
                    start = end - len(one_bytes[i])
                    while ends[1][j] <= start:
                        j += 1
                    k = j
                    while k < len(other) and ends[1][k] - len(other_bytes[k]) < end:
                        links.append((one[i], other[k]))
                        k += 1
                groups, at = [], [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [ends[0].index(cut) + 1, ends[1].index(cut) + 1]
                    groups.append((one[at[0] : to[0]], other[at[1] : to[1]]))
                    at = to
                for pair in links:
                    counts[pair] = counts.get(pair, 0) + 1
                row = one, other, links, groups
        rows.append(row)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        one, other, links, groups = row
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(one), len(other), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(listed.encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups)))
    return out


@pytest.mark.parametrize("most_pairs", [1 << 22, 10])
def test_alignment_equals_plain_walk(spark, most_pairs):
    texts = real_texts()[::3] + ODD
    docs = documents(spark, texts).selectExpr("*", "1 as n_a", "2 as row", "3 as pairs")
    found = token_alignment.align_documents(docs, A, B, most_pairs=most_pairs).orderBy("doc_id").collect()
    for text, mine, other in zip(texts, found, plain_alignment(texts)):
        assert tuple(mine)[1:] == other, text
    assert len(found) == len(texts)


def test_alignment_of_nothing_and_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_links, r.count_sum) for r in token_alignment.align_documents(docs, A, B).collect()) == [("1", 0, 0), ("1", 2, 4), ("None", 2, 4)]
    assert not token_alignment.align_documents(docs.where("doc_id > 1"), A, B).collect()


def test_alignment_in_small_blocks(monkeypatch):
    whole = token_alignment.Aligner(token_alignment.Tokenizers(A, B))
    texts = [t for t in ODD + real_texts()[:40] if t]
    sums = lambda own: [sum(own.stats[n].sum(axis=0) for k, n in own.read([t])).tolist()[:6] for t in texts]
    expected = sums(whole)
    monkeypatch.setattr(token_alignment, "BLOCK", 7)
    monkeypatch.setattr(token_alignment, "CHUNKS", 5)
    assert sums(token_alignment.Aligner(whole.tokenizers)) == expected


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = (rng.integers(0, 3, s) * (rng.random(s) < 0.4) for s in ((6, 9), (9, 5)))
        a, b = (token_alignment.Csr(np.r_[0, np.cumsum((m > 0).sum(1))], np.nonzero(m)[1], m[m > 0], m.shape[1]) for m in (x, y))
        dense = np.zeros((6, 5), int)
        p = token_alignment.product(a, b)
        dense[p.rows(), p.indices] = p.data
        assert (dense == x @ y).all()
        t = a.transposed()
        dense = np.zeros((9, 6), int)
        dense[t.rows(), t.indices] = t.data
        assert (dense == x.T).all()


def test_shared_groups_are_all_pairs_of_each_group():
    found = token_alignment.align(np.array([2, 3, 1, 4]), np.array([5, 2, 3]))
    assert found.links.indices.tolist() == [0, 0, 1, 1, 2] and found.links.data.tolist() == [2, 3, 1, 1, 3]
    assert sum((b.rows().size for b in found.shared_groups())) == 2 * 1 + 2 * 2


def test_new_queries_read_whole_tables(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op11_token_files", "op12_merkle", "op13_alignment"):
        assert queries.queries()[name](spark, FOLDER).count() == n
