"""Language-model scores by online logistic context mixing over binary decisions.

A text is its lower-cased words and one end. The ``top`` most frequent training words, the end and
an escape have Huffman codes; a word outside them is the escape and then its letters, eight bits each.
If an earlier word of the same text was followed by something, a first bit says whether that comes again.
Every bit of a code is mixed: predictors by the node of the code's tree alone, hashed by the node and the
last frequent word, and hashed by the node and the previous word give their log odds, which weights
chosen by depth and confidence combine; weights are updated online within the text, and an adaptive map
refines the result. A word outside the ``top`` is likely by its exact count, and, for what the training texts leave
to new words, by its letters, which use the counts of the corpus' distinct words.

Counts come from all training texts: word counts by a distributed sum, the hashed tables
as sums of fixed-size blocks. Exact counts of words outside the ``top`` reach the texts by a join, never a broadcast.
The tables of contexts have ``SLOTS`` slots whatever the corpus, and contexts that share a slot are not told apart.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_groups, runs, whole_texts, written

#: Depths that have weights of their own; all below share the last one's.
DEPTHS = 24
CLASSES = 2_048
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
LETTER_SLOTS = 1 << 18
BLOCK = 1 << 15
#: Blocks that are added in one group.
FAN = 64
GATES = DEPTHS * 3
#: Log odds are kept in steps; what a byte of a slot stands for, and how often its slot was seen (0, some, often).
STEP = 0.14
ODDS = np.where(np.arange(256) == 0, 0, (np.arange(256) % 128 - 64) * STEP).astype(np.float32)
SEEN = np.where(np.arange(256) == 0, 0, np.where(np.arange(256) < 128, 1, 2)).astype(np.int32)
#: Weights to start with for (node, frequent word, previous word), by how often the last was seen.
START = np.array([[0.3, 0.7, 0.0], [0.1, 0.65, 0.25], [0.0, 0.5, 0.5]], np.float32)
#: Cells of the adaptive map, what a bit's probability is in the middle of each, and how many bits that counts for at first.
CELLS = 24
CENTRES = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS / 2 + 0.5) / 2))
PRIOR = 40.0
#: How many rare words' spelling a task remembers.
SPELLINGS = 300_000
#: How many texts are scored side by side.
SIDE = 512
#: Weights change after every 2**BLOCK_BITS bits of a text, by RATE for each bit; beyond its first SETTLED bits, after four times as many.
BLOCK_BITS = 6
SETTLED = 4_096
RATE = 0.02


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in a row, how many each text has): A-Z lower-cased, split at blank and tab to carriage return; null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = np.flatnonzero(sizes == 1)
    blank = blank[pc.binary_length(flat).to_numpy(zero_copy_only=False)[np.cumsum(sizes)[blank] - 1] == 0]
    if len(blank):
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        sizes[blank] = 0
    return flat, sizes


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each symbol's code, nodes, bits): the inner nodes from the root to each symbol and the bits that follow them, symbol by symbol; a single symbol has no bits."""
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    n = len(heap)
    parent, bit = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    made = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = made
        bit[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], made))
        made += 1
    root, symbol, at, levels = made - 1, np.arange(n), np.arange(n), []
    while True:
        live = at != root
        symbol, at = symbol[live], at[live]
        if not len(at):
            break
        levels.append((symbol, parent[at] - n, bit[at]))
        at = parent[at]
    size = np.bincount(np.concatenate([x[0] for x in levels]), minlength=n) if levels else np.zeros(n, np.int64)
    ends = np.cumsum(size)
    nodes, bits = np.zeros(size.sum(), np.uint32), np.zeros(size.sum(), np.uint8)
    for up, (symbol, node, b) in enumerate(levels):
        nodes[ends[symbol] - 1 - up] = node
        bits[ends[symbol] - 1 - up] = b
    return size, nodes, bits


@dataclass
class Code:
    """The coded words, then the end and the escape, with their training counts and codes; ``outside`` counts the training tokens outside them, ``once`` the words seen once."""

    names: pa.Array
    counts: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    begin: np.ndarray
    base: np.ndarray
    total: int
    distinct: int
    outside: int
    once: int

    @classmethod
    def build(cls, rows: list[tuple[bytes, int]], texts: int, total: int, distinct: int, once: int) -> Code:
        """``rows``: the top words by falling count; ``total`` and ``distinct`` count all training tokens, ends included.

        The escape counts for what is outside the top and, for new words, for those seen ``once``.
        """
        counts = np.array([c for _, c in rows] + [texts, 0], np.int64)
        use = np.maximum(counts, 1)
        outside = int(total - counts[:-1].sum())
        use[-1] = max(1, outside + once)
        size, nodes, bits = huffman(use)
        weight = np.repeat(use, size)
        seen, ones = np.bincount(nodes, weight, len(use)), np.bincount(nodes, weight * bits, len(use))
        odds = np.log((ones + 0.4) / (seen - ones + 0.4)).astype(np.float32)
        return cls(pa.array([w for w, _ in rows], pa.binary()), counts, size, nodes, bits, (np.cumsum(size) - size).astype(np.int32), odds, total, distinct, outside, once)

    @property
    def end(self) -> int:
        return len(self.counts) - 2

    @property
    def escape(self) -> int:
        return len(self.counts) - 1

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token: the class of the last frequent word before it in its text, and the previous token (the end at a start)."""
        previous = np.append(self.end, ids[:-1])
        previous[first] = self.end
        frequent = np.where((previous < CLASSES - 1) & (previous < self.end), previous + 1, 0)
        start = np.zeros(len(ids), bool)
        start[first] = True
        seen = np.maximum.accumulate(np.where((frequent > 0) | start, np.arange(len(ids)), 0))
        return frequent[seen], previous

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many bits each token has, where all bits of all tokens stand among all codes' bits)."""
        size = self.size.take(ids)
        stops = np.cumsum(size)
        at = np.repeat(self.begin.take(ids) - (stops - size), size)
        at += np.arange(len(at))
        return size, at

    @cached_property
    def packed(self) -> np.ndarray:
        """For all codes' bits one number: the node, then in eight bits six times the depth (DEPTHS - 1 at most) and the bit itself."""
        depth = np.arange(len(self.nodes), dtype=np.int32)
        depth -= np.repeat(self.begin, self.size)
        np.minimum(depth, DEPTHS - 1, out=depth)
        out = self.nodes.astype(np.uint32 if len(self.counts) < 1 << 24 else np.uint64)
        out <<= 8
        out |= depth.astype(np.uint8) * np.uint8(6) + self.bits
        return out


def spread(context: np.ndarray) -> np.ndarray:
    """A 32-bit number for each context, to be joined with a node's."""
    return context.astype(np.uint32) * np.uint32(0x9E3779B1)


def slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of each bit by its context (see ``spread``) and its node (times an odd number); ``context`` is overwritten."""
    context += node
    context ^= context >> np.uint32(15)
    context *= np.uint32(0x2C1B3C6D)
    context >>= np.uint32(32 - SLOT_BITS)
    return context


def _letters(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, byte with the closing blank, three bytes before it as one number) for each letter of words."""
    data = np.frombuffer(b" ".join(group) + b" ", np.uint8).astype(np.int64)
    close = np.flatnonzero(data == 32)
    sizes = np.diff(np.append(-1, close))
    owner = np.repeat(np.arange(len(group)), sizes)
    at = np.arange(len(data)) - np.repeat(np.append(0, close[:-1] + 1), sizes)
    before = np.zeros(len(data), np.int64)
    for k in (1, 2, 3):
        inside = at >= k
        before[inside] |= data[np.flatnonzero(inside) - k] << (8 * (k - 1))
    return owner, data, before


def _letter_slots(data: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each of the eight bits: the bits, and their slots under one, two and three bytes of context."""
    for d in range(8):
        node = 1 << d | data >> (8 - d)
        slots = []
        for order in (1, 2, 3):
            key = ((before & ((1 << (8 * order)) - 1)) * 3 + order) * 256 + node
            slots.append((key.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - 18)).astype(np.int64))
        yield data >> (7 - d) & 1, slots


def _blocks(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tables of counts below 2**31 as rows (table, block, counts up to 255, places of larger ones, their rest), without blocks of zeros."""
    for t, table in enumerate(tables):
        for b in range(0, len(table), BLOCK):
            part = table[b : b + BLOCK]
            if part.any():
                large = np.flatnonzero(part > 255)
                cells = (np.minimum(part, 255).astype(np.uint8), large.astype(np.int32), (part[large] - 255).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([b // BLOCK], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], ["t", "b", "n", "at", "rest"])


def _summed(parts: DataFrame, sizes: list[int], tasks: int) -> list[np.ndarray]:
    """The sums of tables that ``tasks`` tasks give as blocks; what reaches the driver has the fixed size of the tables.

    No group holds more than FAN blocks: neighbouring tasks' blocks are added first, then the sums, and so on.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for n, at, rest in zip(table["n"], table["at"], table["rest"]):
            total += np.frombuffer(n.as_buffer(), np.uint8)
            total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(rest.as_buffer(), np.int64)
        large = np.flatnonzero(total > 255)
        cells = (np.minimum(total, 255).astype(np.uint8), large.astype(np.int32), total[large] - 255)
        return pa.table({"t": table["t"][:1], "b": table["b"][:1], "s": table["s"][:1], **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("n", "at", "rest"), cells)}})

    parts = parts.withColumn("s", F.spark_partition_id())
    while True:
        parts = parts.withColumn("s", F.floor(F.col("s") / FAN).cast("int")).groupBy("t", "b", "s").applyInArrow(add, "t int, b int, s int, n binary, at binary, rest binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    out = [np.zeros(n, np.int64) for n in sizes]
    for row in parts.toLocalIterator():
        part = out[row["t"]][row["b"] * BLOCK : (row["b"] + 1) * BLOCK]
        part += np.frombuffer(row["n"], np.uint8)
        part[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["rest"], np.int64)
    return out


@dataclass
class Model:
    """A code with the log odds of its hashed contexts: a byte a slot, by STEP around 64; by word, 0 is a slot never seen and those seen often go around 192."""

    code: Code
    by_class: np.ndarray
    by_word: np.ndarray
    letter_odds: list[np.ndarray]
    letter_trust: list[np.ndarray]

    @classmethod
    def build(cls, code: Code, tables: list[np.ndarray], letters: list[np.ndarray]) -> Model:
        odds = [np.log((t[1::2] + 0.4) / (t[::2] + 0.4)) for t in tables]
        seen = tables[1][::2] + tables[1][1::2]
        step = lambda x: np.clip(np.rint(x / STEP), -63, 63).astype(np.int16)
        by_class = (step(odds[0]) + 64).astype(np.uint8)
        by_word = np.where(seen == 0, 0, step(odds[1]) + np.where(seen < 30, 64, 192)).astype(np.uint8)
        shares = [np.log((t[1::2] + 0.1) / (t[::2] + 0.1)).astype(np.float32) for t in letters]
        trust = [((n := t[::2] + t[1::2]) / (n + 3.0)).astype(np.float32) for t in letters]
        return cls(code, by_class, by_word, shares, trust)

    def spelled(self, group: list[bytes]) -> np.ndarray:
        """log2 probability of each word's letters and its close: longer contexts count as far as they were seen."""
        out = np.zeros(len(group))
        for at in range(0, len(group), 20_000):
            owner, data, before = _letters(group[at : at + 20_000])
            kinds = pa.array(before << 8 | data).dictionary_encode()  # a letter after the same three costs the same
            which, kinds = kinds.indices.to_numpy(), kinds.dictionary.to_numpy()
            data, before = kinds & 255, kinds >> 8
            bits = np.zeros(len(kinds), np.float32)
            for bit, slots in _letter_slots(data, before):
                mixed, rest = np.zeros(len(kinds), np.float32), np.ones(len(kinds), np.float32)
                for order in (2, 1, 0):
                    trust = self.letter_trust[order][slots[order]]
                    mixed += rest * trust * self.letter_odds[order][slots[order]]
                    rest *= 1 - trust
                mixed *= 1 - 2 * bit.astype(np.float32)
                bits -= np.maximum(mixed, 0) + np.log(1 + np.exp(-np.abs(mixed)))
            out[at : at + 20_000] = np.bincount(owner, bits.take(which), len(group[at : at + 20_000])) / np.log(2)
        return out

    def score(self, ids: np.ndarray, same: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log2 probability of each text's tokens without what follows an escape, which tokens are coded and not guessed); ``same``: numbers that tell rare words apart; ``starts``: texts' first tokens."""
        n, texts = len(ids), len(starts)
        size = np.diff(np.append(starts, n))
        owner = np.repeat(np.arange(texts), size)
        out = np.zeros(texts)
        classes, previous = self.code.contexts(ids, starts)
        # What followed the last earlier token equal to the previous one, in this text.
        before = np.append(-1, same[:-1])
        before[starts] = -1
        pair = owner * (before.max() + 2) + before + 1
        order = np.argsort(pair, kind="stable")
        twin = (pair[order][1:] == pair[order][:-1]) & (before[order][1:] >= 0)
        guess = np.full(n, -1)
        guess[order[1:][twin]] = same[order[:-1][twin]]
        tried = np.flatnonzero(guess >= 0)
        hit = guess[tried] == same[tried]
        # The share of guesses that came true so far in the text, and of the last one, in log odds.
        tries = np.arange(len(tried))
        first = np.searchsorted(tried, starts)
        own = owner[tried]
        past = tries - first[own]
        total = np.append(0, np.cumsum(hit))
        hits = total[:-1] - total[first[own]]
        last = np.where(past > 0, np.append(False, hit[:-1]), False)
        share = (hits + 0.05) / (past + 1.0)
        odds = np.log(share / (1 - share)) + np.where(last, 2.0, 0.0)
        out -= np.bincount(own, np.logaddexp(0, np.where(hit, -odds, odds)), texts) / np.log(2)
        coded = np.ones(n, bool)
        coded[tried[hit]] = False
        spelt, coded = coded, np.flatnonzero(coded)
        ids, classes, previous, owner = ids[coded], classes[coded], previous[coded], owner[coded]
        out += self._mixed(ids, classes, previous, owner, texts)
        return out, spelt

    def _features(self, packed: np.ndarray, ids: np.ndarray, classes: np.ndarray, previous: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
        """For all ``total`` bits of all tokens in order: (twice its gate, by depth and confidence, and the bit itself, log odds by node, steps of log odds by class, steps by word)."""
        code = self.code
        marks, by_class, by_word = (np.empty(total, np.uint8) for _ in range(3))
        base = np.empty(total, np.float32)
        end = 0
        for a in range(0, len(ids), 8_192):  # arrays that a processor's cache holds
            cut = slice(a, a + 8_192)
            size, at = code.places(ids[cut])
            to = slice(end, end := end + len(at))
            found = packed.take(at)
            node = (found >> 8).astype(np.uint32)
            base[to] = code.base.take(node.astype(np.int64))
            odd = node * np.uint32(0x85EBCA6B)
            by_class[to] = self.by_class.take(slot(np.repeat(spread(classes[cut]), size), odd).astype(np.int64))
            word = self.by_word.take(slot(np.repeat(spread(previous[cut]), size), odd).astype(np.int64))
            by_word[to] = word
            seen = word >> 7  # as SEEN has it
            seen += word > 0
            marks[to] = found.astype(np.uint8) + 2 * seen
        return marks, base, by_class, by_word

    def _mixed(self, ids: np.ndarray, classes: np.ndarray, previous: np.ndarray, owner: np.ndarray, texts: int, block: int = BLOCK_BITS, rate: float = RATE) -> np.ndarray:
        """log2 probabilities of each text's bits, SIDE texts side by side, 2**block bits of each at a time (four times as many beyond SETTLED) with weights updated after them."""
        out, packed = np.zeros(texts), self.code.packed
        cuts = np.searchsorted(owner, np.append(np.arange(0, texts, SIDE), texts))
        for at, a, b in zip(range(0, texts, SIDE), cuts, cuts[1:]):
            sizes = np.bincount(owner[a:b] - at, self.code.size[ids[a:b]], min(SIDE, texts - at)).astype(np.int64)
            out[at : at + SIDE] = self._walked(sizes, self._features(packed, ids[a:b], classes[a:b], previous[a:b], int(sizes.sum())), block, rate)
        return out / np.log(2)

    def _walked(self, sizes: np.ndarray, features: tuple[np.ndarray, ...], block: int, rate: float) -> np.ndarray:
        """Natural log probabilities of texts of so many bits."""
        marks, base, by_class, by_word = features
        texts, steps = len(sizes), CELLS
        out, most = np.zeros(texts), int(sizes.max(initial=0))
        begins = np.cumsum(sizes) - sizes
        weights = [np.tile(x, texts * DEPTHS) for x in START.T]
        seen_as = np.tile(np.column_stack([PRIOR * (1 - CENTRES), PRIOR * CENTRES]).ravel().astype(np.float32), texts)  # zeros and ones in each cell
        end = 0
        while end < most:
            begin, end = end, end + (1 << block if end < SETTLED else 4 << block)
            live = np.flatnonzero(sizes > begin)
            size = np.minimum(sizes[live], end) - begin
            starts = np.cumsum(size) - size
            spot = np.repeat(begins[live] + begin - starts, size)
            spot += np.arange(len(spot))
            mark = marks.take(spot)
            y = mark & 1
            x = (base.take(spot), ODDS.take(by_class.take(spot).astype(np.int64)), ODDS.take(by_word.take(spot).astype(np.int64)))
            own = np.repeat(live * GATES, size)
            own += mark >> 1
            mixed = x[0] * weights[0].take(own)
            mixed += x[1] * weights[1].take(own)
            mixed += x[2] * weights[2].take(own)
            np.clip(mixed, -12, 12, out=mixed)
            p = np.exp(-mixed)
            p += 1
            np.reciprocal(p, out=p)
            mixed *= 2
            mixed += steps / 2
            cell = np.clip(mixed, 0, steps - 1, out=mixed).astype(np.int64)
            cell += np.repeat(live * steps, size)
            refined = seen_as[1::2] / (seen_as[::2] + seen_as[1::2])
            final = refined.take(cell)
            final += p
            final *= np.float32(0.5)
            one = y.astype(np.float32)
            final = np.abs(1 - one - final, out=final)  # of the bit that is there
            out[live] += np.add.reduceat(np.log(final, out=final), starts, dtype=np.float64)
            miss = np.subtract(one, p, out=p)
            miss *= np.float32(rate)
            for w, v in zip(weights, x):
                np.add.at(w, own, miss * v)
            cell *= 2
            cell += y
            np.add.at(seen_as, cell, np.float32(1))
        return out


def word_counts(df: DataFrame, text: str = "text", most: int = 16_000_000) -> DataFrame:
    """(word binary, n long) over all of df's texts; each task adds up about ``most`` bytes of text at a time before its shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.Array]) -> pa.RecordBatch:
            found = pa.concat_arrays(held).cast(pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        held, size = [], 0
        for batch in batches:
            for group in in_groups(batch.column(0), most):
                held.append(words(group)[0])
                size += group.nbytes
                if size >= most:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(code: Code, group: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """(symbols of all tokens, texts' first tokens, the words under the escapes in order)."""
    flat, sizes = words(group)
    flat = flat.cast(pa.binary())
    found = pc.fill_null(pc.index_in(flat, value_set=code.names), -1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 1) - 1
    ids = np.full(len(found) + len(sizes), code.end, np.int64)
    inside = np.ones(len(ids), bool)
    inside[ends] = False
    ids[inside] = np.where(found < 0, code.escape, found)
    return ids, ends - sizes, flat.filter(pa.array(found < 0)).dictionary_encode()


def train(df: DataFrame, text: str = "text", top: int = 100_000) -> tuple[Model, DataFrame]:
    """(model, table of (word, n)) from all of df's texts; the table is exact and stays distributed, the model has a fixed size."""
    df = whole_texts(df)
    spark = df.sparkSession
    counts = written(word_counts(df, text), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    ends = df.count()
    rows = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(top).toLocalIterator()]
    code = Code.build(rows, ends, sums[0] + ends, sums[1] + (ends > 0), sums[2])
    shared = spark.sparkContext.broadcast(code)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables, tokens = shared.value, [np.zeros(2 * SLOTS, np.int32) for _ in range(2)], 0
        packed = own.packed
        for batch in batches:
            for group in in_groups(batch.column(0), 2_000_000):
                ids, starts, _ = _ids(own, group)
                if tokens + len(ids) >= 1 << 31:  # a task of that many tokens counts in several tables
                    yield from _blocks(tables)
                    tables, tokens = [np.zeros(2 * SLOTS, np.int32) for _ in range(2)], 0
                tokens += len(ids)
                classes, previous = own.contexts(ids, starts)
                for a in range(0, len(ids), 16_384):  # arrays that a processor's cache holds
                    cut = slice(a, a + 16_384)
                    size, at = own.places(ids[cut])
                    found = packed.take(at)
                    node, bit = (found >> 8).astype(np.uint32) * np.uint32(0x85EBCA6B), found & 1
                    for table, context in zip(tables, (classes, previous)):
                        at = slot(np.repeat(spread(context[cut]), size), node).astype(np.int64)
                        at *= 2
                        at += bit
                        np.add.at(table, at, np.int32(1))
        yield from _blocks(tables)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * LETTER_SLOTS, np.int64) for _ in range(3)]
        for batch in batches:
            found = batch.column(0).to_pylist()
            for at in range(0, len(found), 50_000):
                _, data, before = _letters(found[at : at + 50_000])
                for bit, slots in _letter_slots(data, before):
                    for table, slot in zip(tables, slots):
                        table += np.bincount(2 * slot + bit, minlength=2 * LETTER_SLOTS)
        yield from _blocks(tables)

    schema = "t int, b int, n binary, at binary, rest binary"
    texts, names = df.select(F.col(text).cast("string").alias("text")), counts.select("word")
    seen = _summed(texts.mapInArrow(contexts, schema), [2 * SLOTS] * 2, texts.rdd.getNumPartitions())
    spelled = _summed(names.mapInArrow(letters, schema), [2 * LETTER_SLOTS] * 3, names.rdd.getNumPartitions())
    return Model.build(code, seen, spelled), counts


def score(df: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """id_col, ``keep``, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every text.

    ``score`` is the model's log10 probability of the tokens (words and one end; a null text has the end alone),
    ``base_score`` that of add-one counts, and ``n_known`` counts tokens with a training count. A repeated row is
    scored each time; an empty table gives no rows.
    """
    df = whole_texts(df)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>, coded array<int>, letters array<double>"

    @F.arrow_udf(f"struct<{schema}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        code = own.code
        logs = np.log10(code.counts + 1.0)
        singles, lists = (pa.int64(), pa.int64(), pa.float64(), pa.float64()), (pa.binary(), pa.int32(), pa.int32(), pa.float64())
        names = ("n_tokens", "n_known", "base", "score", "rare", "times", "coded", "letters")
        kind = pa.struct(list(zip(names, (*singles, *map(pa.list_, lists)))))
        spelling: dict[bytes, float] = {}
        for batch in batches:
            out = [pa.array([], kind)]
            # Texts of like size go through their blocks together; rows leave in the order they came in.
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            for cut in runs(sizes[order], 1_000_000):
                group = batch.take(pa.array(order[cut]))
                ids, starts, rare = _ids(code, group)
                texts = len(starts)
                owner = np.repeat(np.arange(texts), np.diff(np.append(starts, len(ids))))
                fresh, number = rare.dictionary.to_pylist(), rare.indices.to_numpy().astype(np.int64)
                rare_at = np.flatnonzero(ids == code.escape)
                same = ids.copy()
                same[rare_at] = number + len(code.counts)
                found, coded = own.score(ids, same, starts)
                if len(spelling) > SPELLINGS:
                    spelling = {}
                new = [w for w in fresh if w not in spelling]
                if new:
                    spelling.update(zip(new, own.spelled(new).tolist()))
                letters = np.fromiter(map(spelling.__getitem__, fresh), np.float64, len(fresh))
                # A rare word of a text once, with how often it is there and how often coded: a guess that was right needs neither count nor letters.
                pair = owner[rare_at] * len(fresh) + number
                by_pair = np.argsort(pair, kind="stable")
                pair, first = np.unique(pair[by_pair], return_index=True)
                times = np.diff(np.append(first, len(by_pair)))
                often = np.add.reduceat(coded[rare_at][by_pair].astype(np.int64), first) if len(first) else times
                place = pa.array(np.searchsorted(pair, np.arange(texts + 1) * len(fresh)), pa.int32())
                which = pair % max(1, len(fresh))
                known = ids != code.escape
                several = (rare.dictionary.take(pa.array(which)), *map(pa.array, (times, often, letters[which])))
                single = (
                    np.bincount(owner, minlength=texts).astype(np.int64),
                    np.bincount(owner, known & (code.counts[ids] > 0), texts).astype(np.int64),
                    np.bincount(owner, np.where(known, logs[ids], 0.0), texts),
                    found * np.log10(2),
                )
                out.append(pa.StructArray.from_arrays([*map(pa.array, single), *(pa.ListArray.from_arrays(place, x.cast(k)) for x, k in zip(several, lists))], names))
            yield pa.concat_arrays(out).take(pa.array(np.argsort(order)))

    rows = df.select(F.col(id_col), *keep, F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), run(F.col(text).cast("string")).alias("m"))
    names = [c for c in rows.columns if c not in ("n_bytes", "m")]
    rows = written(rows.select(*names, "n_bytes", F.monotonically_increasing_id().alias("_row"), "m.*"), "scored")
    pairs = rows.select("_row", F.explode(F.arrays_zip("rare", "times", "coded", "letters")).alias("x")).select("_row", F.col("x.rare").alias("word"), "x.times", "x.coded", "x.letters")
    # What follows the escape: a known word by its count, any word by its letters in the share of new ones.
    fresh = float(model.code.once + 1)
    after = F.when(F.col("n").isNull(), F.col("letters") * F.lit(float(np.log10(2))) + F.lit(float(np.log10(fresh)))).otherwise(F.log10(F.col("n") + F.lit(fresh) * F.pow(F.lit(2.0), "letters")))
    counted = (
        pairs.join(counts, "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("n").isNull(), 0).otherwise(F.col("times"))).alias("more_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more_base"),
            F.sum(F.col("coded") * (after - F.lit(float(np.log10(model.code.outside + fresh))))).alias("more_score"),
        )
    )
    total, distinct = model.code.total, model.code.distinct
    norm = float(np.log10(total + distinct + 1))
    return (
        rows.drop("rare", "times", "coded", "letters")
        .join(counted, "_row", "left")
        .withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
        .select(
            *names,
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
            "score",
            "n_bytes",
            F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )
