"""Token ids as Arrow files of equal-length sequences.

Documents in ascending id order are one stream of token ids, cut into sequences of a fixed length. A shard is an Arrow
IPC file whose batches hold a fixed-size list of ids and one of mask bits (false: padding after the shard's last id),
so sequence i is found by arithmetic and read without a copy from a memory map or a buffer. Each batch carries, as
its metadata, the documents that begin in it, so a shard is complete by itself. Shards are written by the tasks of one range
partitioned job under a temporary name and then renamed, so a task that runs again replaces its own files. A task ends a shard and begins the next
once it holds ``shard_ids`` ids, so shards are bounded but for one document; they are read back by ranges of batches, each by a task of its own, which
holds no more than a few batches and the document it is at.

The tokenizer is never trained here. Where white space only separates words (its description says so: the pre-tokenizer splits at it and keeps none
of it, and neither normalizer nor model joins across it), a word's ids don't depend on its neighbours and are looked up once. Any other
tokenizer encodes whole texts; ``whole_texts=True`` demands that.

Defined results: null and empty texts give the end id alone; whole texts of any length are encoded; repeated doc_ids are all written, ties ordered by
text; a null doc_id sorts first; an empty table gives no shard and no row; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import BATCH, CLEANUP, setting

_DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("start", "<i8"), ("n", "<i8")])


@dataclass(frozen=True)
class TokenFileConfig:
    tokenizer: str
    end_id: int
    length: int = 1024
    batch: int = 512
    whole_texts: bool = False
    memo: int = 300_000
    shard_ids: int = 1 << 28
    batches_per_task: int = 64


_WORD, _IDS = pa.large_string(), pa.large_binary()


def _pieces(kind: pa.DataType, ends: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """Consecutive pieces of a buffer as an array; ends begins with where the first one starts."""
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), data or pa.py_buffer(b"")])


def _ends(x: pa.Array) -> np.ndarray:
    """Where the pieces of an array of large strings or bytes begin in its buffer, and where the last one ends."""
    return np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)


class _Memo:
    """Ids of parts of words, as arrays of bounded size: what wasn't asked for during the last ``most`` new entries is forgotten."""

    def __init__(self, most: int, encode: Callable[[pa.Array], tuple[pa.Array, pa.Array]]) -> None:
        self.most, self.encode = most, encode
        self.now = self.before = (pa.array([], _WORD), pa.array([], _IDS))

    def __call__(self, parts: pa.Array) -> pa.Array:
        """Ids of different parts."""
        known, n = self.now, len(self.now[0])
        at = pc.index_in(parts, value_set=known[0]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = parts.take(pa.array(new))
            back = pc.index_in(missing, value_set=self.before[0]).fill_null(-1).to_numpy(zero_copy_only=False)
            seen = back >= 0
            words, ids = self.encode(missing.filter(pa.array(~seen)))
            again = pa.array(back[seen])
            known = self.now = tuple(pa.concat_arrays(x) for x in ((known[0], self.before[0].take(again), words), (known[1], self.before[1].take(again), ids)))
            at[new[seen]] = n + np.arange(len(again))
            order = pc.index_in(missing.filter(pa.array(~seen)), value_set=words).to_numpy()
            at[new[~seen]] = n + len(again) + order
        if len(known[0]) > self.most or known[0].nbytes > 100 * self.most:
            self.now, self.before = (pa.array([], _WORD), pa.array([], _IDS)), known
        return known[1].take(pa.array(at))


_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _separates_words(described: dict) -> bool:
    """Whether a tokenizer gives a text the ids of its words, one after the other, as its description shows.

    Known to do so: a pre-tokenizer whose first step drops white space, either by splitting at it or by taking out what matches a pattern of
    letters, numbers and others than white space, with a normalizer of case, white space and composition alone, and no added token that holds white space.
    """
    steps = lambda x, many: [] if x is None else [y for z in x[many] for y in steps(z, many)] if x["type"] == "Sequence" else [x]
    first = next(iter(steps(described["pre_tokenizer"], "pretokenizers")), {"type": None})
    pattern = str(first.get("pattern", {}).get("Regex", ""))
    drops = first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") or first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s\p{L}\p{N}]+" in pattern and r"\s" not in pattern.replace(r"[^\s\p{L}\p{N}]+", "")
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " " for x in steps(described["normalizer"], "normalizers"))
    whole = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in described["added_tokens"])
    return drops and plain and whole


class Encoder:
    """Ids of texts as bytes: 16 bits each where the vocabulary allows it, else 32.

    A text's words are looked up together, in Arrow's kernels: no Python object is made for a word, only for parts that are new. Where the tokenizer splits
    letters from punctuation (its pattern says so), a word is cut into what ends with a letter or digit and the ASCII punctuation behind it, and A-Z are lower-cased
    if the tokenizer does that.
    """

    def __init__(self, config: TokenFileConfig) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.config = config
        self.tokenizer = Tokenizer.from_file(config.tokenizer)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), config.end_id + 1) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([config.end_id], self.dtype).tobytes()
        self.memo = _Memo(config.memo, self._encode_parts)
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AbZ") == "abz"

        self.closes = self.bare = None
        self.cuts = False
        described = json.loads(self.tokenizer.to_str())
        self.whole_texts = config.whole_texts or not _separates_words(described)
        suffix = described["model"].get("end_of_word_suffix")
        if suffix and self.lower and "[\\\\p{L}]+" in json.dumps(described["pre_tokenizer"]):
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closes[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
            self.cuts = all("<|" in t["content"] for t in described["added_tokens"])
            described |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}}
            self.bare = Tokenizer.from_str(json.dumps(described))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words or parts, in an order of its own, and their ids. Those of letters alone, which neither normalizing nor splitting changes, are encoded as one text
        by the model itself; each ends with the only id that closes a word in it."""
        plain, rest = [], []
        for p in parts.to_pylist():
            (plain if self.bare is not None and p.isalpha() and (p.islower() if p.isascii() else p == p.lower() and is_normalized("NFC", p)) else rest).append(p)
        done, ids, sizes = [], [], []
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            here = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.closes[here]) + 1
            if len(ends) == len(some):
                done += some
                ids.append(here)
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest += some
        for at in range(0, len(rest), 2000):
            some = self._encode(rest[at : at + 2000])
            ids.append(np.frombuffer(b"".join(some), self.dtype))
            sizes.append(np.array([len(x) for x in some]) // self.dtype.itemsize)
        ends = np.concatenate([[0], *sizes]).cumsum() * self.dtype.itemsize
        return pa.array(done + rest, _WORD), _pieces(_IDS, ends, pa.py_buffer(b"".join(x.tobytes() for x in ids)))

    def _parts(self, words: pa.Array) -> pa.Array:
        """Two parts of each word, one after the other; the second one may be empty."""
        begins = _ends(words)
        core = pc.ascii_rtrim(words, characters=_TAIL)
        size = pc.binary_length(core).to_numpy().copy()
        tailed = np.flatnonzero(size < np.diff(begins))
        some = words.take(pa.array(tailed))
        last = pc.utf8_slice_codeunits(core.take(pa.array(tailed)), -1).dictionary_encode()
        letter = np.array([c.isalnum() and c.lower().isalnum() and is_normalized("NFC", c) for c in last.dictionary.to_pylist()], bool)[last.indices.to_numpy()]
        whole = tailed[~letter | pc.match_substring(some, "'").to_numpy(zero_copy_only=False) | pc.match_substring(some, "<|").to_numpy(zero_copy_only=False)]
        size[whole] = np.diff(begins)[whole]
        ends = np.empty(2 * len(words) + 1, np.int64)
        ends[::2], ends[1::2] = begins, begins[:-1] + size
        parts = _pieces(_WORD, ends, words.buffers()[2])
        return pc.if_else(pc.match_substring(parts, "<|"), parts, pc.ascii_lower(parts)) if self.lower else parts

    def _look_up(self, words: pa.Array) -> pa.Array:
        """Ids of different words."""
        if not self.cuts:
            return self.memo(words)
        parts = self._parts(words).dictionary_encode()
        ids = self.memo(parts.dictionary).take(parts.indices)
        return _pieces(_IDS, _ends(ids)[::2], ids.buffers()[2])

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text (null: none) with the end id."""
        if self.whole_texts:
            texts = [t or "" for t in (texts if isinstance(texts, list) else texts.to_pylist())]
            return [x + self.end for at in range(0, len(texts), 64) for x in self._encode(texts[at : at + 64])]
        rows = pc.ascii_split_whitespace((pa.array(texts, _WORD) if isinstance(texts, list) else texts.cast(_WORD)).fill_null(""))
        words = rows.flatten().dictionary_encode()
        if not len(words):
            return [self.end] * len(rows)
        ids = self._look_up(words.dictionary).take(words.indices)
        at = _ends(ids)[rows.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) + self.end for a, b in zip(at, at[1:], strict=False)]


_ENCODERS: dict[TokenFileConfig, Encoder] = {}


def encoder(config: TokenFileConfig) -> Encoder:
    """One encoder for each worker process, so that tasks that follow one another share what it has looked up."""
    if config not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[config] = Encoder(config)
    return _ENCODERS[config]


class ShardWriter:
    """Writes one shard; holds one batch of sequences at a time."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, config: TokenFileConfig) -> None:
        self.dtype, self.config = dtype, config
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, config.length)), ("mask", pa.list_(pa.bool_(), config.length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.buffer, self.docs = bytearray(), []
        self.size = config.length * config.batch
        self.written = self.count = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id or 0, doc_id is not None, self.count, n))
        self.count += n
        self.buffer += ids
        while self.count - self.written >= self.size:
            self._batch(self.size)

    def _batch(self, n: int) -> None:
        rows = -(-n // self.config.length)
        ids = np.zeros(rows * self.config.length, self.dtype)
        ids[:n] = np.frombuffer(bytes(self.buffer[: n * self.dtype.itemsize]), self.dtype)
        mask = np.arange(len(ids)) < n
        del self.buffer[: n * self.dtype.itemsize]
        here = [d for d in self.docs if d[2] < self.written + n]
        self.docs = self.docs[len(here) :]
        batch = pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.config.length) for x in (ids, mask)], schema=self.schema)
        self.writer.write_batch(batch, custom_metadata={b"documents": np.array(here, _DOC).tobytes()})
        self.written += n

    def close(self) -> None:
        if self.count > self.written:
            self._batch(self.count - self.written)
        self.writer.close()


class Shard:
    """Random access to a shard in a buffer, a memory map or a file; of the latter only the batches asked for are read."""

    def __init__(self, source: pa.Buffer | pa.NativeFile) -> None:
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches
        self._recent: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, a view of the file's bytes, and the documents that begin in it."""
        if i not in self._recent:
            got = self.file.get_batch_with_custom_metadata(i)
            ids = got.batch.column(0).flatten().to_numpy(zero_copy_only=True)
            self._recent = dict(list(self._recent.items())[-1:]) | {i: (ids, np.frombuffer(got.custom_metadata[b"documents"], _DOC))}
        return self._recent[i]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, a view of the file's bytes, and mask of sequence i."""
        rows = self.file.get_batch(0).num_rows
        batch = self.file.get_batch(i // rows)
        a = (i % rows) * self.length
        ids, mask = (batch.column(c).flatten()[a : a + self.length] for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start within the shard, ids of each document that begins in batches first to last - 1."""
        last = self.batches if last is None else min(last, self.batches)
        size = len(self.batch(0)[0]) if first < last else 0
        for i in range(first, last):
            ids, docs = self.batch(i)
            for doc, known, start, n in docs.tolist():
                end, parts = start + n, [ids[start - i * size : start - i * size + n]]
                for j in range(i + 1, -(-end // size)):
                    parts.append(self.batch(j)[0][: end - j * size])
                yield doc if known else None, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``most`` bytes of text (and 64 for each row), or of one row: the more words come together, the fewer are looked up twice."""
    held, size = [], 0
    for x in batches:
        ends = np.cumsum(pc.binary_length(x.column(1)).fill_null(0).to_numpy(zero_copy_only=False) + np.int64(64))
        at = past = 0
        while at < x.num_rows:
            to = max(int(np.searchsorted(ends, past + most - size, "right")), at if held else at + 1)
            if to > at:
                held.append(x.slice(at, to - at))
                size, past, at = size + int(ends[to - 1]) - past, int(ends[to - 1]), to
            if at < x.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_shards(docs: DataFrame, folder: str, config: TokenFileConfig) -> list[tuple[int, int, int, int, int]]:
    """Writes the shards and returns (task, part, documents, ids, batches) of each, in order. docs: doc_id, text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _opened(folder)
        task = TaskContext.get()
        shard, temporary = task.partitionId(), f"{path}/.{task.partitionId()}-{task.taskAttemptId()}"
        encode = writer = sink = None
        done: list[tuple[int, int, int, int, int]] = []
        n = 0

        def closed() -> None:
            writer.close()
            sink.close()
            name = f"{path}/{shard_name(shard, len(done))}"
            try:
                where.move(temporary, name)
            except OSError:  # a store that doesn't replace: what is there is the same shard by an earlier attempt
                where.delete_file(name)
                where.move(temporary, name)
            done.append((shard, len(done), n, writer.count, -(-writer.count // writer.size)))

        for x in _blocks(batches):
            encode = encode or encoder(config)
            for doc, ids in zip(x.column(0).to_pylist(), encode(x.column(1)), strict=True):
                if writer is None:
                    where.create_dir(path, recursive=True)
                    sink = where.open_output_stream(temporary)
                    writer, n = ShardWriter(sink, encode.dtype, config), 0
                writer.add(doc, ids)
                n += 1
                if writer.count >= config.shard_ids:
                    closed()
                    writer = None
        if writer is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(5)], ["shard", "part", "documents", "ids", "batches"])

    dealt = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_text")).repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    with setting(docs.sparkSession, BATCH, "500"), setting(docs.sparkSession, CLEANUP, "true"):
        return sorted(tuple(r) for r in dealt.mapInArrow(write, "shard bigint, part bigint, documents bigint, ids bigint, batches bigint").collect())


def shard_name(task: int, part: int) -> str:
    return f"ids-{task:06d}-{part:05d}.arrow"


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[int, int, int, int, int]], config: TokenFileConfig | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and the shard's number; start counts the ids of all documents before."""
    step = config.batches_per_task if config else TokenFileConfig.batches_per_task

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _opened(folder)
        for x in batches:
            for number, name, before, first in zip(*(c.to_pylist() for c in x.columns), strict=True):
                with where.open_input_file(f"{path}/{name}") as source:
                    rows = [(d, before + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), number) for d, s, ids in Shard(source).documents(first, first + step)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint"
    if not shards:
        return spark.createDataFrame([], schema)
    before, files, ranges = 0, [], 0
    for number, (task, part, _, n, batches) in enumerate(shards):
        files.append((number, shard_name(task, part), before, batches))
        before += n
        ranges += -(-batches // step)
    table = spark.createDataFrame(files, "shard bigint, name string, before bigint, batches bigint")
    asked = table.select("shard", "name", "before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("batches") - 1, F.lit(step).cast("bigint"))).alias("first"))
    return asked.repartition(ranges).mapInArrow(read, schema)
