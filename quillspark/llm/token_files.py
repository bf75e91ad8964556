"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A corpus is a folder.  Each shard has three files, all mapped into memory when read: ``ids-*.bin``, the ids of its documents end
to end, as little-endian unsigned integers of two bytes, or of four where the vocabulary needs them; ``offsets-*.bin``, as
unsigned 64-bit integers, where each of its documents starts in the whole corpus, and where the last one ends; and
``docs-*.arrow``, the documents' own ids.  The Parquet table ``index`` has a row for each shard: names of its files, counts, and
its base, the sum of all counts before it.

Ranges of ids make the shards; a task encodes the sorted documents of its range as it writes them.  A task names its files by an identifier of its own and
puts the name into its row of the index, so that a lost or repeated task leaves files that nothing refers to.  Tables with a row
for each shard are written as one file: on a local file system Hadoop starts a process for each file and folder it makes, and
until that process has loaded its program it counts with all memory of the executor's JVM.
"""

from __future__ import annotations

import contextlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, hold, materialize, scratch_dir

#: Bytes of text of a shard, about.
SHARD_BYTES = 128 << 20
#: Pieces in one half of a Python worker's memory, and bytes from which a piece is not kept there.
CACHE, LONG = 500_000, 200
#: Words that are encoded as one text.
JOINED = 1000
#: ASCII signs that may end a piece; the apostrophe is not among them, as it begins contractions.
SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Documents of one step while reading back.
READ_ROWS = 4096


class Known(dict):
    """Ids of pieces; notes those that it does not have in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> bytes:
        self.new.append(piece)
        return b""


class Encoder:
    """Ids, as bytes, of the pieces between ASCII white space.

    The tokenizer drops white space, none of its tokens or patterns reaches over it, and composition of characters does not
    either, so a text's ids are those of its pieces.  Nor do they reach from an ASCII letter or digit to the signs at a piece's
    end, apostrophes aside, so a new piece is looked for without these.  What is left the library encodes once, while it is
    remembered: pieces met since the memory was last half full, and those met in the half before.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.kind = Tokenizer.from_file(path), f"<u{width}"
        marks = [re.escape(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = re.compile(b"|".join(marks)).search if marks else lambda piece: None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        entries = self.tokenizer.get_vocab()
        #: whether a token ends a word; where none tells, words are encoded one by one
        self.ends = np.zeros(max(entries.values()) + 1, bool)
        self.ends[[k for token, k in entries.items() if suffix and token.endswith(suffix)]] = True
        self.known, self.older = Known(), {}

    def bare(self, piece: bytes) -> bytes:
        """The piece without the signs at its end; whole where these may belong to what stands before them."""
        stem = piece.rstrip(SIGNS)
        return stem if len(stem) < len(piece) and stem[-1:].isalnum() and not self.marked(piece) else piece

    def find_words(self, words: list[bytes]) -> bool:
        """Knows words of letters, encoded as one text and told apart by the tokens that end words; false where their normal
        forms have other signs, so that some word has more than one end."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return False
        width, packed = int(self.kind[2:]), ids.astype(self.kind).tobytes()
        to = (ends * width).tolist()
        self.known.update(zip(words, (packed[x:y] for x, y in zip([0, *to], to))))
        return True

    def remembered(self, piece: bytes) -> bool:
        """Whether the piece is known; moves it from the older half."""
        if piece in self.known:
            return True
        if (ids := self.older.get(piece)) is None:
            return False
        self.known[piece] = ids
        return True

    def learn(self, pieces: set[bytes]) -> None:
        if len(self.known) > CACHE:
            self.known, self.older = Known(), self.known
        made, new = {}, set()
        for piece in pieces:
            if not self.remembered(piece):
                stem = self.bare(piece)
                # ASCII letters in lower case, as the tokenizer takes them
                part = stem.lower() if stem.isalnum() else stem
                if part == piece:
                    new.add(piece)
                else:
                    made[piece] = part, piece[len(stem) :]
        new.update(x for x in {x for both in made.values() for x in both if x} - new if not self.remembered(x))
        words, rest = [], []
        for x in new:
            (words if len(x) <= LONG and x.decode().isalpha() else rest).append(x)
        for low in range(0, len(words), JOINED):
            if not self.find_words(some := words[low : low + JOINED]):
                rest += some
        found = self.tokenizer.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)
        self.known.update(zip(rest, (np.array(x.ids, self.kind).tobytes() for x in found)))
        for piece, (stem, signs) in made.items():
            self.known[piece] = self.known[stem] + (self.known[signs] if signs else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        out, again = [], []
        for k, text in enumerate(texts):
            before = len(self.known.new)
            pieces = text.encode().split()
            found = list(map(self.known.__getitem__, pieces))
            if len(self.known.new) > before:
                again.append((k, pieces, found))
                out.append(b"")
            else:
                out.append(b"".join(found))
        new, self.known.new = set(self.known.new), []
        if new:
            self.learn(new)
        for k, pieces, found in again:
            at = -1
            with contextlib.suppress(ValueError):  # until no gap is left; what is known is not looked up again
                while True:
                    at = found.index(b"", at + 1)
                    found[at] = self.known.get(pieces[at], b"")
            out[k] = b"".join(found)
        for piece in filter(lambda x: len(x) > LONG, new):  # not worth their memory
            self.known.pop(piece, None)
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """The encoder, loaded once in each Python worker."""
    hold(_encoders.clear)
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def width_of(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def mapped(folder: str, name: str) -> pa.Buffer:
    """A file's bytes: mapped into memory where the folder is mounted, else read."""
    system, path = _place(folder)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(f"{path}/{name}").read_buffer()
    with system.open_input_file(f"{path}/{name}") as file:
        return file.read_buffer()


class Shard:
    """One shard's arrays; ``shard[k]`` are the ids of its k-th document."""

    def __init__(self, folder: str, row: dict, width: int):
        self.base = row["base"]
        self.ids = np.frombuffer(mapped(folder, f"ids-{row['name']}.bin"), f"<u{width}")
        self.offsets = np.frombuffer(mapped(folder, f"offsets-{row['offsets']}.bin"), "<u8")
        self.doc_ids = pa.ipc.open_file(pa.BufferReader(mapped(folder, f"docs-{row['name']}.arrow"))).read_all().column(0)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        start, end = (int(x) - self.base for x in self.offsets[k : k + 2])
        return self.ids[start:end]


def write_corpus(docs: DataFrame, folder: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the corpus of ``docs`` into ``folder``, a place that driver and tasks share.

    Documents go by ascending id, null first, and rows of one id by a digest of their texts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    width = width_of(path, end_id)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    # some shards for each core, but none without work
    shards = max(1, -(-size["bytes"] // SHARD_BYTES), min(4 * spark.sparkContext.defaultParallelism, -(-size["rows"] // 1000)))
    keys = ["doc_id", "digest", "row_number"]
    rows = rows.withColumns({"digest": F.xxhash64("text"), "row_number": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, n_docs, n_ids = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0
        system, place = _place(folder)
        words, end = encoder(path, width), np.array([end_id], f"<u{width}").tobytes()
        with contextlib.ExitStack() as files:
            ids = index = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if ids is None:
                    system.create_dir(place, recursive=True)
                    ids = files.enter_context(system.open_output_stream(f"{place}/ids-{name}.bin"))
                    index = files.enter_context(system.open_output_stream(f"{place}/docs-{name}.arrow"))
                    index = files.enter_context(pa.ipc.new_file(index, pa.schema([("doc_id", batch.schema.types[0]), ("n", pa.int64())])))
                sizes = []
                for own in words.encode([text or "" for text in batch.column(1).to_pylist()]):
                    ids.write(own)
                    ids.write(end)
                    sizes.append(len(own) // width + 1)
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n"]))
                n_docs, n_ids = n_docs + len(sizes), n_ids + sum(sizes)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], names=["shard", "name", "n_docs", "n_ids"])

    written = rows.mapInArrow(write, "shard long, name string, n_docs long, n_ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, all of them in one file
    based = materialize(written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-bases")

    def offsets(row: dict) -> dict:
        system, place = _place(folder)
        sizes = pa.ipc.open_file(pa.BufferReader(mapped(folder, f"docs-{row['name']}.arrow"))).read_all().column(1).to_numpy()
        row["offsets"] = uuid.uuid4().hex
        with system.open_output_stream(f"{place}/offsets-{row['offsets']}.bin") as file:
            file.write((row["base"] + np.r_[0, np.cumsum(sizes)]).astype("<u8").tobytes())
        return row

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([offsets(row) for row in batch.to_pylist()])

    index = based.repartition(shards).mapInArrow(put, "shard long, name string, n_docs long, n_ids long, base long, offsets string")
    index.withColumn("width", F.lit(width)).repartition(1).write.parquet(f"{folder}/index")


def read_corpus(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a corpus whose ids are of type ``kind``; a task maps one shard after
    the other, of small ones several."""
    index = spark.read.parquet(f"{folder}/index")
    size = index.agg(F.coalesce(F.sum(F.col("n_ids") * F.col("width")), F.lit(0)).alias("bytes"), F.count("*").alias("shards")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row, row["width"])
                for low in range(0, len(shard), READ_ROWS):
                    places = range(low, min(len(shard), low + READ_ROWS))
                    crcs = [zlib.crc32(shard[k].astype("<u4").tobytes()) for k in places]
                    starts, ends = (shard.offsets[low + d : low + d + len(places)].astype(np.int64) for d in (0, 1))
                    own = shard.doc_ids.slice(low, len(places)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([own, pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(size["shards"], max(-(-size["bytes"] // SHARD_BYTES), 4 * spark.sparkContext.defaultParallelism)))
    return index.repartition(tasks).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from a corpus written to the shared folder and read back.

    A null text counts as empty: its end alone.  Rows with equal ids are documents of their own; a null id comes first.  Long
    texts are encoded whole.  Other columns are not read; an empty table gives no rows.
    """
    folder = f"{scratch_dir(docs.sparkSession)}/corpus-{uuid.uuid4().hex}"
    write_corpus(docs, folder, path, end_id, id_col, text_col)
    return read_corpus(docs.sparkSession, folder, docs.schema[id_col].dataType.simpleString())
