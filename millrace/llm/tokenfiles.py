"""Token ids in binary files: frequency-ranked, byte-aligned, with the control bytes apart from the data.

An id is stored as its rank by falling frequency, in one to four bytes; two bits of a control byte
give the length of each of four ranks, so the frequent ids take a byte and a quarter. Control bytes and data
bytes of a block lie apart, and a block is decoded by table lookups of all its control bytes at once, without a loop.

A folder holds ``part-*`` files of blocks, in the order of their numbers, and ``manifest.json`` with the ids by rank,
and the documents and ids of every file. Tasks write files under names of their own attempt; the manifest is written by
the driver once all tasks are done and names only those of the attempts that count, so a lost executor or a second attempt leaves
nothing in the result. Paths are those of pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .bpe import byte_symbols
from .common import in_groups, scratch_path, whole_texts, written

MAGIC = b"MRTOKEN1"
#: Magic, documents, ids, bytes of the payload, crc32 of the payload.
HEAD = struct.Struct("<8sQQQI")
#: A block is closed once it has so many ids.
BLOCK_IDS = 1 << 18
#: Different ids that one set of files may have: the size of a vocabulary, which does not grow with the corpus.
MOST_IDS = 1 << 22
CODES = np.arange(256)[:, None] >> (2 * np.arange(4)) & 3
#: For each control byte: its four lengths' masks, where its four values begin, and the bytes of all four.
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[CODES]
BEGINS = np.cumsum(CODES + 1, axis=1) - CODES - 1
TOTALS = (CODES + 1).sum(axis=1)


def pack_lists(sizes: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, where each list's control bytes end, where its data bytes end) of lists of numbers below 2**32.

    The last four numbers of a list are filled up with zeros, so that each list has control bytes of its own.
    """
    groups = -(-sizes // 4)
    full = np.zeros(4 * int(groups.sum()), "<u4")
    full[_places(sizes, groups)] = values
    code = (full > 0xFF).astype(np.uint8) + (full > 0xFFFF) + (full > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = full.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    ends = np.cumsum(groups)
    return control.tobytes(), data.tobytes(), ends, np.append(0, np.cumsum(TOTALS[control]))[ends]


def _places(sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Where lists' numbers lie among the numbers of all their groups of four."""
    begins = 4 * (np.cumsum(groups) - groups) - (np.cumsum(sizes) - sizes)
    return np.repeat(begins, sizes) + np.arange(int(sizes.sum()))


def pack(values: np.ndarray) -> bytes:
    """One list's control bytes and then its data bytes."""
    return b"".join(pack_lists(np.array([len(values)]), values)[:2])


def unpack(raw: memoryview | bytes, n: int) -> tuple[np.ndarray, int]:
    """(n numbers, bytes used) of what ``pack`` made."""
    control = np.frombuffer(raw, np.uint8, -(-n // 4))
    sizes = TOTALS[control]
    used = len(control) + int(sizes.sum())
    data = np.append(np.frombuffer(raw, np.uint8, used - len(control), len(control)), np.zeros(3, np.uint8))
    at = (np.cumsum(sizes) - sizes)[:, None] + BEGINS[control]
    words = np.lib.stride_tricks.as_strided(data.view("V1").view(np.uint8), (max(0, len(data) - 3), 4), (1, 1))
    found = np.ascontiguousarray(words[at.ravel()]).view("<u4").ravel() & MASKS[control].ravel()
    return found[:n], used


def block(names: np.ndarray, known: np.ndarray, sizes: np.ndarray, control: bytes, data: bytes) -> bytes:
    """One block: documents' ids, which of them are not null, their sizes, and the control and data bytes of all their ranks."""
    body = names.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + pack(sizes) + control + data
    return HEAD.pack(MAGIC, len(names), int(sizes.sum()), len(body), zlib.crc32(body)) + body


def blocks_of(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, which are not null, sizes, ranks) of each block of an open file; a damaged block raises an error."""
    while head := file.read(HEAD.size):
        magic, docs, ids, size, crc = HEAD.unpack(head)
        body = memoryview(file.read(size))
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
            raise ValueError("a block of token ids is damaged")
        names, known = np.frombuffer(body, "<i8", docs), np.frombuffer(body, np.uint8, docs, 8 * docs)
        sizes, used = unpack(body[9 * docs :], docs)
        sizes = sizes.astype(np.int64)
        groups = -(-sizes // 4)
        ranks = unpack(body[9 * docs + used :], 4 * int(groups.sum()))[0][_places(sizes, groups)]
        if len(ranks) != ids:
            raise ValueError("a block of token ids is damaged")
        yield names, known.astype(bool), sizes, ranks


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    docs: int
    ids: int


def _at(path: str) -> tuple[fs.FileSystem, str]:
    found, inside = fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")
    return found, inside.rstrip("/")


class Writer(DataSourceArrowWriter):
    """Rows (doc_id, size, control, data) in their final order; ``table`` has the ids by rank."""

    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = _at(self.path)
        task = TaskContext.get()
        name, held, waiting, total = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", [], 0, [0, 0]
        with store.open_output_stream(f"{folder}/{name}") as file:

            def close() -> None:
                names, known, sizes = (np.concatenate(x) for x in list(zip(*held))[:3])
                file.write(block(names, known, sizes, *(b"".join(x) for x in list(zip(*held))[3:])))
                total[0], total[1] = total[0] + len(names), total[1] + int(sizes.sum())
                held.clear()

            for batch in iterator:
                ends = np.append(0, np.cumsum(batch.column(1).to_numpy().astype(np.int64)))
                a = 0
                while a < batch.num_rows:  # a batch may be far larger than a block
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_IDS, side="right")) - 1)
                    cut = batch.slice(a, b - a)
                    names = cut.column(0)
                    bytes_ = [b"".join(x.as_buffer() for x in cut.column(i)) for i in (2, 3)]
                    held.append((names.fill_null(0).to_numpy(), names.is_valid().to_numpy(zero_copy_only=False), np.diff(ends[a : b + 1]), *bytes_))
                    waiting += int(ends[b] - ends[a])
                    if waiting >= BLOCK_IDS:
                        close()
                        waiting = 0
                    a = b
            if held:
                close()
        return Part(task.partitionId(), name, *total)

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = _at(self.path)
        parts = sorted((m for m in messages if m and m.docs), key=lambda m: m.number)
        text = json.dumps({"by_rank": _ranks(self.table).tolist(), "parts": [[m.name, m.docs, m.ids] for m in parts]})
        with store.open_output_stream(f"{folder}/manifest.tmp") as file:
            file.write(text.encode())
        store.move(f"{folder}/manifest.tmp", f"{folder}/manifest.json")

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = _at(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{folder}/{m.name}")


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> np.ndarray:
    store, inside = _at(path)
    with store.open_input_stream(inside) as file:
        return np.frombuffer(file.read(), "<u4")


@dataclass
class Piece(InputPartition):
    name: str
    start: int


class Reader(DataSourceReader):
    """A task reads one file, block by block."""

    def __init__(self, path: str, binary: bool, most: int = 1 << 19):
        self.path, self.binary, self.most = path, binary, most
        store, folder = _at(path)
        with store.open_input_stream(f"{folder}/manifest.json") as file:
            found = json.loads(file.read())
        self.by_rank, self.parts = np.array(found["by_rank"], np.int32), found["parts"]

    def partitions(self) -> list[Piece]:
        ends = np.cumsum([0, *(p[2] for p in self.parts)]).tolist()
        return [Piece(p[0], start) for p, start in zip(self.parts, ends)] or [Piece("", 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = _at(self.path)
        start = partition.start
        with store.open_input_stream(f"{folder}/{partition.name}") as file:
            for names, known, sizes, ranks in blocks_of(file):
                ends = np.cumsum(np.append(0, sizes))
                ids = self.by_rank[ranks]
                a = 0
                while a < len(names):  # some MB at a time, whole documents
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + self.most, side="right")) - 1)
                    own, cut = (ends[a : b + 1] - ends[a]).astype(np.int32), ids[ends[a] : ends[b]]
                    if self.binary:
                        lists = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(4 * own), pa.py_buffer(cut.astype("<u4"))])
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(own), pa.array(cut))
                    columns = [pa.array(names[a:b], pa.int64(), mask=~known[a:b]), pa.array(start + ends[a:b]), pa.array(sizes[a:b]), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])
                    a = b
                start += int(ends[-1])


class TokenFiles(DataSource):
    """The format ``tokenfiles``; see ``write_tokens`` and ``read_tokens``."""

    @classmethod
    def name(cls) -> str:
        return "tokenfiles"

    def schema(self) -> str:
        return f"doc_id long, start long, n_tokens long, ids {'binary' if self.binary else 'array<int>'}"

    @property
    def binary(self) -> bool:
        return self.options.get("binary") == "true"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.binary)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["ranks"])


#: A blank that white space or the end follows: texts that hold one are cut with more care.
LOOSE = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
#: Marks that are a piece of their own between letters and a blank or the end.
MARKS = ".,;:!?)"
#: The bytes of a-z, A-Z and U+00C0 to U+023F, which are letters but for two; and the number of each byte's mark.
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() or 0x80 <= b <= 0xBF or 0xC3 <= b <= 0xC8 for b in range(256)])
SIGNS = (0xC397, 0xC3B7)
MARK_OF = np.array([MARKS.find(chr(b)) for b in range(256)])


def _joined(values: pa.Array, most: int = 256) -> list[str]:
    """Texts of up to ``most`` values each, every value with a blank before it."""
    ends = np.append(np.arange(0, len(values), most), len(values)).astype(np.int32)
    return [f" {x}" for x in pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), values), " ").to_pylist()]


def _slices(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin there and have those sizes, one after the other."""
    at = np.repeat((begins - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat.take(at)


class Words:
    """A byte-level tokenizer of the tokenizers library with a bounded cache of words.

    Such a tokenizer never joins what lies before a single blank and the blank with what follows it, so a text is cut there and every
    different run of a group of texts is encoded once: many runs make one text for the library, and ids that begin with a blank show where
    each run begins. Runs of Latin letters, with or without a mark after them, need no look for pieces and go straight to the library's model; all
    others, and texts that spell out a special token, go through the whole library. The first ``cache`` different words stay known until two
    thirds of a group's are not among them.
    """

    def __init__(self, path: str, cache: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.own, self.limit = Tokenizer.from_file(path), cache
        self.plain = Tokenizer(self.own.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        signs = byte_symbols()
        self.symbols = str.maketrans({chr(b): signs[b] for b in range(256)} | {" ": f" {signs[32]}"})
        vocab = self.own.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(signs[32])]] = True
        self.marks = self.library(list(MARKS))
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def library(self, texts: list[str], own=None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has)."""
        out, sizes = [np.zeros(0, np.int32)], []
        for at in range(0, len(texts), 32):
            for e in (own or self.own).encode_batch_fast(texts[at : at + 32], add_special_tokens=False):
                out.append(np.array(e.ids, np.int32))
                sizes.append(len(out[-1]))
        return np.concatenate(out), np.array(sizes, np.int64)

    def after_blanks(self, runs: pa.Array, own=None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has) of a blank and each run."""
        if any(" " in s for s in self.special):  # runs that are joined may spell it out
            return self.library([f" {x}" for x in runs.to_pylist()])
        texts = _joined(runs)
        if own:  # takes bytes by their symbols; those of ASCII letters are the letters
            texts = [x.replace(" ", self.symbols[32]) if x.isascii() else x.encode().decode("latin-1").translate(self.symbols) for x in texts]
        ids = self.library(texts, own)[0]
        begins = np.flatnonzero(self.opens[ids])
        assert len(begins) == len(runs)
        return ids, np.diff(np.append(begins, len(ids)))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has) of a blank and each of these different words of Latin letters."""
        names, flat, sizes = self.known
        at = pc.index_in(words, value_set=names)
        new = words.filter(at.is_null())
        more, their = self.after_blanks(new, self.plain)
        every = np.append(sizes, their)
        place = at.to_numpy(zero_copy_only=False).copy() if at.null_count else at.to_numpy()
        place = np.where(at.is_null(), len(sizes) - 1 + np.cumsum(at.is_null()), np.nan_to_num(place)).astype(np.int64)
        out = _slices(np.append(flat, more), (np.cumsum(every) - every).take(place), every.take(place)), every.take(place)
        room = self.limit - len(names)
        if room > 0:
            self.known = pa.concat_arrays([names, new.slice(0, room)]), np.append(flat, more[: their[:room].sum()]), np.append(sizes, their[:room])
        elif 3 * len(new) > 2 * len(words):
            self.forget()
        return out

    def runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has) of a blank and each of these different runs."""
        if not len(runs):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
        data = np.frombuffer(runs.buffers()[2], np.uint8)[: offsets[-1]]
        mark = MARK_OF[data[offsets[1:] - 1]]
        other = ~LETTER[data]
        other[:-1] |= np.isin(data[:-1] * np.uint16(256) + data[1:], SIGNS)
        other = np.append(0, np.cumsum(other, dtype=np.int32))
        simple = (other[offsets[1:] - (mark >= 0)] == other[offsets[:-1]]) & (np.diff(offsets) > (mark >= 0))
        stems = pc.ascii_rtrim(runs.filter(pa.array(simple)), characters=MARKS).dictionary_encode()
        parts = (self.words(stems.dictionary), self.after_blanks(runs.filter(pa.array(~simple))), self.marks, (np.zeros(0, np.int32), np.zeros(1, np.int64)))
        flat, sizes = (np.concatenate(x) for x in zip(*parts))
        first = np.cumsum([len(x[1]) for x in parts])
        # Each run is a word or anything else, and then a mark or nothing.
        pair = np.empty((len(runs), 2), np.int64)
        pair[simple, 0], pair[~simple, 0] = stems.indices.to_numpy(), first[0] + np.arange(len(runs) - int(simple.sum()))
        pair[:, 1] = np.where(simple & (mark >= 0), first[1] + mark, first[2])
        pair = pair.ravel()
        return _slices(flat, (np.cumsum(sizes) - sizes).take(pair), sizes.take(pair)), sizes.take(pair).reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array, last: list[int] = []) -> tuple[np.ndarray, np.ndarray]:
        """(ends of the texts' ids, all ids): each text's ids and then ``last``; a null counts as an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, LOOSE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        # Odd texts are a single part, encoded whole; the others' parts lose the blank before them.
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        counts, flat = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()
        first = np.cumsum(counts) - counts
        inner = np.ones(len(flat), bool)
        inner[first] = False
        coded = flat.filter(pa.array(inner)).dictionary_encode()
        whole = pc.if_else(pa.array(odd), texts, flat.take(pa.array(first))).to_pylist()
        ids, sizes = (np.concatenate(x) for x in zip(self.runs(coded.dictionary), self.library(whole), (np.array(last, np.int32), np.array([len(last)]))))
        # Which piece each part is: its run, its text's beginning or, after each text, ``last``.
        part = np.empty(len(flat), np.int32)
        part[inner], part[first] = coded.indices.to_numpy(), len(coded.dictionary) + np.arange(len(texts))
        part = np.insert(part, first + counts, len(sizes) - 1)
        size = sizes.take(part)
        found = _slices(ids, (np.cumsum(sizes) - sizes).take(part), size)
        ends = np.cumsum(size)
        return ends[np.cumsum(counts + 1) - 1] if len(texts) else ends, found


def _binary(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Lists of ids, which begin and end at ``offsets``, as their bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids.astype("<i4", copy=False))])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of lists of ids or of their bytes."""
    if pa.types.is_list(column.type):
        return column.offsets.to_numpy(), column.values.to_numpy()
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4 if len(column) else np.zeros(1, np.int32)
    return offsets, np.frombuffer(column.buffers()[2] or b"", "<i4", int(offsets[-1]))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    return Words(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", end: int | None = None, binary: bool = False) -> DataFrame:
    """df with the array column ``ids``: each whole text's ids without special tokens added, and then ``end`` if one is given.

    With ``binary`` the ids of a text are little-endian 32-bit numbers in a row.
    ``path`` is a byte-level tokenizer file that every executor can open. A null or empty text has no ids of its own; repeated
    rows and an empty table stay as they are. A column named like ``ids`` is replaced.
    """
    df = whole_texts(df)
    last = [] if end is None else [end]

    @F.arrow_udf("binary" if binary else "array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            slices = [pa.array([], pa.binary() if binary else pa.list_(pa.int32()))]
            for group in in_groups(batch, 8 << 20):
                ends, found = own.encode(group, last)
                slices.append(_binary(np.append(0, ends), found) if binary else pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found)))
            yield pa.concat_arrays(slices)

    return df.withColumn(ids, run(F.col(text).cast("string")))


def frequencies(df: DataFrame, ids: str = "ids") -> DataFrame:
    """(id, n) of all ids in the arrays of df, or in their bytes; each task adds its own up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            offsets, ids = _lists(batch.column(0))
            ids = ids[offsets[0] : offsets[-1]]
            for at in range(0, len(ids), 1 << 20):
                own = np.bincount(ids[at : at + (1 << 20)])
                if len(own) > len(total):
                    total = np.append(total, np.zeros(len(own) - len(total), np.int64))
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return df.select(F.col(ids).alias("ids")).where("ids is not null").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> None:
    """Write the arrays ``ids`` (not negative; or binary, little-endian 32-bit numbers in a row) of df to the new folder ``path`` in ascending order of ``id_col``.

    Null ids of documents come first. Rows that share one are ordered by the size and a digest of their ids, so the files' contents are the
    same in every run. A null array counts as an empty one; an empty table gives a folder without files. Other columns
    are left out. More than ``MOST_IDS`` different ids raise an error.
    """
    spark = df.sparkSession
    raw = df.schema[ids].dataType.typeName() == "binary"
    given = F.coalesce(ids, F.lit(b"")) if raw else F.coalesce(ids, F.array().cast("array<int>")).cast("array<int>")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), given.alias("ids"))
    size = F.floor(F.octet_length("ids") / 4).cast("int") if raw else F.size("ids")
    # The number of a row keeps apart equal rows, of which there may be many, when ranges are cut.
    rows = written(rows.select("*", size.alias("_n"), F.xxhash64("ids").alias("_digest"), F.monotonically_increasing_id().alias("_row")), "ids", compression="zstd" if raw else None)
    counts = frequencies(rows)
    ranked = counts.orderBy(F.desc("n"), "id").limit(MOST_IDS + 1).select("id").collect()
    if len(ranked) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} different token ids: not those of a vocabulary")
    table = scratch_path(spark, "ranks")
    for folder in (path, table.rsplit("/", 1)[0]):
        store, inside = _at(folder)
        store.create_dir(inside, recursive=True)
    store, inside = _at(table)
    with store.open_output_stream(inside) as file:
        file.write(np.array([r[0] for r in ranked], "<u4").tobytes())
    spark.dataSource.register(TokenFiles)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = _ranks(table)
        rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank))
        for batch in batches:
            offsets, ids = _lists(batch.column(4))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_IDS, side="right")) - 1)
                *packed, ends, tails = pack_lists(np.diff(offsets[a : b + 1]).astype(np.int64), rank_of[ids[offsets[a] : offsets[b]]])
                made = [pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.append(0, e).astype(np.int32)), pa.py_buffer(x)]) for x, e in zip(packed, (ends, tails))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), *made], ["doc_id", "_n", "_digest", "_row", "control", "data"])
                a = b

    # Packed before they are sorted: a shuffle of some bytes and a half for each id.
    packed = rows.select("doc_id", "_n", "_digest", "_row", "ids").mapInArrow(coded, "doc_id long, _n int, _digest long, _row long, control binary, data binary")
    ordered = packed.repartitionByRange("doc_id", "_n", "_digest", "_row").sortWithinPartitions("doc_id", "_n", "_digest", "_row")
    ordered.select("doc_id", F.col("_n").cast("long").alias("size"), "control", "data").write.format("tokenfiles").option("ranks", table).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """doc_id, start (how many ids there are before the document), n_tokens and ids of every document that ``write_tokens`` left under ``path``; the ids of a document are an array or, with ``binary``, little-endian 32-bit numbers in a row."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("tokenfiles").option("binary", str(binary).lower()).load(path)

