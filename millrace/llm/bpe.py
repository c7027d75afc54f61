"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree are its adjacent pairs, keyed by (merge rank, position); the root is
the leftmost pair of lowest rank. Merging it changes three leaves, each a point update along
one path, until the root says that no pair can merge. Many words run side by side: a tree
level is one array operation over all of them.

The tokenizer file (word-end BPE with byte-level symbols) stays outside: its path is a
parameter that every executor must be able to open.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused, whole_texts

NEVER = np.int64(1) << 60
#: Pieces of more bytes than this are merged one by one, in plain lists: an array operation for each of their merges would cost more.
LONG = 512
#: Separators for str.split() that are not white space in Unicode; texts that hold one are split by the pattern.
ODD = regex.compile(r"[\x1c-\x1f]")
BLANKS = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary, its merges and a bounded cache of encoded words."""

    def __init__(self, path: str, cache: int = 150_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        signs = byte_symbols()
        self.inner = np.array([vocab[c] for c in signs], np.int64)
        self.last = np.array([vocab[c + suffix] for c in signs], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.limit, self.known = cache, {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; NEVER for pairs that do not merge. A negative id pairs with nothing."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], NEVER)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece (the UTF-8 of one pre-token), as 32-bit numbers."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._alone(pieces[i])
        sizes[sizes > LONG] = 0
        for width in np.unique(1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)):
            rows = np.flatnonzero((sizes > 0) & (sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            step = max(1, (1 << 17) // int(width))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                part = part.tolist()
                for i, ids in zip(part, self._merge([pieces[i] for i in part], sizes[part], int(width))):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width)
        # One spare place at the end of each row takes what falls off its ends.
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(column < sizes[:, None] - 1, self.inner[raw], np.where(column == sizes[:, None] - 1, self.last[raw], -1))
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        before = np.tile(np.append(np.arange(-1, width - 1), width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), NEVER, np.int64)
        leaf = self.ranks(ids[:, :width], ids[:, 1:])
        tree[:, width:] = np.where(leaf < NEVER, leaf * width + column, NEVER)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NEVER)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root % width, root // width
            right = after[rows, at]
            following, previous = after[rows, right], before[rows, at]
            new = self.merged[rank]
            ids[rows, at], ids[rows, right] = new, -1
            after[rows, at], before[rows, following] = following, at
            before[:, width], after[:, width] = width, width
            keyed = self.ranks(new, ids[rows, following])
            behind = self.ranks(ids[rows, previous], new)
            changed = [(at, np.where(keyed < NEVER, keyed * width + at, NEVER)), (right, np.full(len(rows), NEVER)), (np.where(previous < width, previous, at), np.where(previous < width, np.where(behind < NEVER, behind * width + previous, NEVER), np.where(keyed < NEVER, keyed * width + at, NEVER)))]
            for place, value in changed:
                tree[rows, width + place] = value
            for place, _ in changed:
                node = width + place
                for _ in range(width.bit_length() - 1):
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < NEVER]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.order.tolist()))

    def _alone(self, piece: bytes) -> bytes:
        """The ids of one long piece, with a tree of its own."""
        n, rank_of, merged, never = len(piece), self.rank_of, self.merged.tolist(), int(NEVER)
        size = 1 << (n - 1).bit_length()
        ids = self.inner[np.frombuffer(piece, np.uint8)].tolist()
        ids[-1] = int(self.last[piece[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(at: int) -> int:
            right = after[at]
            rank = rank_of.get(ids[at] << 20 | ids[right]) if right < n else None
            return never if rank is None else rank * size + at

        tree = [never] * size + [key(i) for i in range(n)] + [never] * (size - n)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, value: int) -> None:
            i = at + size
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    return
                tree[i] = least

        while tree[1] < never:
            rank, at = divmod(tree[1], size)
            right = after[at]
            ids[at], ids[right], after[at] = merged[rank], -1, after[right]
            if after[at] < n:
                before[after[at]] = at
            put(right, never)
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def split(self, word: str) -> list[bytes]:
        """The pre-tokens of one run of non-blank characters."""
        if word.isascii():
            word = word.lower()
        else:  # letter by letter: a final sigma is no other letter here
            word = "".join(map(str.lower, unicodedata.normalize("NFC", word)))
        if word.isalpha():
            return [word.encode()]
        return [p.encode("utf-8", "replace") for p in self.pieces.findall(word)]

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache lacks; an overfull cache is emptied first."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = words
        parts = {word: self.split(word) for word in new}
        distinct = list({p for mine in parts.values() for p in mine})
        ids = dict(zip(distinct, self.encode_pieces(distinct)))
        for word, mine in parts.items():
            self.known[word] = ids[mine[0]] if len(mine) == 1 else b"".join(map(ids.__getitem__, mine))

    def runs(self, text: str) -> list[str | int]:
        """A text as runs of non-blank characters, with the ids of special tokens that it spells out."""
        parts = self.specials.split(text) if self.specials and "<|" in text else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif ODD.search(part):
                out += [x for x in BLANKS.split(part) if x]
            else:
                out += part.split()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; a null encodes like the empty text."""
        out, at = [], 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars < 500_000):
                text = texts[at] or ""
                group.append(self.runs(text))
                chars += len(text)
                at += 1
            self.learn({w for words in group for w in set(words) if isinstance(w, str)})
            for words in group:
                try:
                    out.append(b"".join(map(self.known.__getitem__, words)))
                except KeyError:  # special tokens among the words
                    out.append(b"".join(self.known[w] if isinstance(w, str) else np.int32(w).tobytes() for w in words))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one blank, as the library does without a decoder; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the array column ``ids`` of each whole text's token ids, without special tokens added.

    With ``decoded``, also the column of that name that ``decode`` would make of the ids, from the same
    pass. A null or empty text has no ids and decodes to the empty text. The strings of special tokens inside a
    text count as those tokens, as in the library. A column of either name is replaced; all others stay as they are.
    """
    df = whole_texts(df)
    both = decoded is not None
    kinds = [("i", pa.list_(pa.int32()))] + [("d", pa.string())] * both

    @F.arrow_udf("struct<i: array<int>, d: string>" if both else "struct<i: array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            slices = []
            for at in range(0, len(batch), 1000):  # Python objects of few rows at a time
                parts = own.encode(batch.slice(at, 1000).to_pylist())
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))]
                if both:
                    columns.append(pa.array([own.decode(np.frombuffer(p, np.int32).tolist()) for p in parts], pa.string()))
                slices.append(pa.StructArray.from_arrays(columns, [k for k, _ in kinds]))
            yield pa.concat_arrays(slices) if slices else pa.array([], pa.struct(kinds))

    name = unused(df, "bpe")
    made = {ids: F.col(name)["i"]} | ({decoded: F.col(name)["d"]} if both else {})
    return df.withColumn(name, run(F.col(text).cast("string"))).withColumns(made).drop(name)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the column ``text``: the tokens of ``ids`` joined by blanks, special ones kept; null ids give the empty text."""
    df = whole_texts(df)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(path)
        for batch in batches:
            ends = batch.offsets.to_numpy()
            flat = batch.values.to_numpy(zero_copy_only=False)
            valid = batch.is_valid().to_numpy(zero_copy_only=False)
            yield pa.array([own.decode(flat[a:b].tolist()) if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], valid)], pa.string())

    return df.withColumn(text, run(F.col(ids).cast("array<int>")))
