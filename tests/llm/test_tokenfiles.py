"""Token files: the coding against plain numbers, the encoder against the library, files against their rows."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import entries
from millrace.llm import tokenfiles as T

HOME = "/root/testdata/sf0.001"
ODD = ["", None, "  ", "a  b", " \n x\n\ny  z \t q", "x<|endoftext|> y", "it's  \x1c y \x85z", "é　b c　 d", "a " * 50, "\n", "1 2 3 !! ??", " lead", "trail ", "don't, (x) été, naïve! ab ", "x  y  z", "of, of", "x" * 5000, "ſ K ª ² ǅ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(entries.BYTE_BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_pack(values):
    raw = T.pack(np.array(values, np.uint32))
    assert len(raw) == -(-len(values) // 4) + sum(max(1, -(-v.bit_length() // 8)) for v in values) + -len(values) % 4
    found, used = T.unpack(raw + b"more", len(values))
    assert found.tolist() == values and used == len(raw)


def test_encoder(library):
    texts = pq.read_table(f"{HOME}/documents.parquet", columns=["text"])["text"].to_pylist() + ODD
    expected = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    for cache in (500_000, 100):  # also one that is always full
        own = T.Words(entries.BYTE_BPE, cache=cache)
        for _ in range(2):
            ends, ids = own.encode(pa.array(texts, pa.string()), [2])
            assert [ids[a:b].tolist() for a, b in zip(np.append(0, ends), ends)] == expected
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 0]


def test_runs_are_encoded_together(library):
    """Few calls for many words that occur once, and the library's own ids whatever stands beside a blank."""
    rng = np.random.default_rng(3)
    signs = list("abcXYZ") + ["é", "ß", "ȿ", "ɀ", "×", "÷", "Ġ", "ñ", "1", "'", "'s", ".", ",", "\n", "\t", "\u00a0", "\u0301", "中", "😀", "<|endoftext|>", "***"]
    texts = [" ".join("".join(rng.choice(signs, rng.integers(1, 7))) for _ in range(rng.integers(0, 60))) for _ in range(400)]
    texts += ["  a", "a ", "é. ×. é× ÷", "a\n b\n\n c", *(f"w{i} v{i} {'éxy'[i % 3]}{'abc' * (i % 5)}" for i in range(2_000))]
    own, calls = T.Words(entries.BYTE_BPE, cache=300), []
    plain = own.library
    own.library = lambda batch, *a: calls.append(len(batch)) or plain(batch, *a)
    for _ in range(2):
        ends, ids = own.encode(pa.array(texts, pa.string()), [2])
        assert [ids[a:b].tolist() for a, b in zip(np.append(0, ends), ends)] == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    # The texts' beginnings, and some of many runs each.
    assert sum(calls) < 2 * (len(texts) + 60)


def test_query(spark, library):
    docs = sorted(pq.read_table(f"{HOME}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    expected, start = [], 0
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, entries.op13_token_files(spark, HOME).collect())) == expected


def test_files(spark, tmp_path):
    rows = [(5, [7, 7, 300]), (None, [1]), (3, []), (3, None), (3, [9] * 2000), (5, [7, 7, 300]), (None, None), (2**40, [70_000, 7])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("IDS_", F.lit(1)).repartition(3)
    T.write_tokens(df, str(tmp_path / "t"))
    found = T.read_tokens(spark, str(tmp_path / "t")).orderBy("start", "n_tokens").collect()
    assert [(r.doc_id, r.ids) for r in found] == [(None, []), (None, [1]), (3, []), (3, []), (3, [9] * 2000), (5, [7, 7, 300]), (5, [7, 7, 300]), (2**40, [70_000, 7])]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    # Frequent ids take one byte, and a fourth of one of control.
    assert sum(os.path.getsize(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t") if f.startswith("part")) < 2020 * 1.25 + 1000
    part = next(f for f in sorted(os.listdir(tmp_path / "t")) if f.startswith("part") and os.path.getsize(tmp_path / "t" / f) > 300)
    raw = bytearray((tmp_path / "t" / part).read_bytes())
    raw[-5] ^= 1
    (tmp_path / "t" / part).write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        T.read_tokens(spark, str(tmp_path / "t")).collect()
    T.write_tokens(df.limit(0), str(tmp_path / "none"))
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    """A task that fails once writes a file that the manifest doesn't name."""
    df = spark.createDataFrame([(i, [i % 5] * 10) for i in range(100)], "doc_id long, ids array<int>")
    T.write_tokens(df, str(tmp_path / "t"))
    (tmp_path / "t" / "part-000000-999").write_bytes(b"rest of a lost attempt")
    assert T.read_tokens(spark, str(tmp_path / "t")).agg(F.sum("n_tokens")).first()[0] == 1000


def test_binary_ids(spark, tmp_path):
    rows = [(5, [7, 7, 300]), (None, [1]), (3, []), (3, None), (3, [9] * 2000), (5, [7, 7, 300]), (2**40, [70_000, 7])]
    rows = [(i, None if x is None else bytearray(np.array(x, "<i4").tobytes())) for i, x in rows]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3)
    for name, own in (("some", df), ("none", df.limit(0))):
        T.write_tokens(own, str(tmp_path / name))
        found = T.read_tokens(spark, str(tmp_path / name), binary=True).collect()
        assert sorted((r.doc_id or 0, bytes(r.ids)) for r in found) == sorted((r.doc_id or 0, bytes(r.ids or b"")) for r in own.collect())
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    lists = T.encode(texts, entries.BYTE_BPE, end=2).collect()
    assert [bytes(r.ids) for r in T.encode(texts, entries.BYTE_BPE, end=2, binary=True).collect()] == [np.array(r.ids, "<i4").tobytes() for r in lists]
