"""Language-model scoring by logistic context mixing.

A text is its words, lower-cased A-Z, and one end. A word that the training
texts hold more than once is a walk down a Huffman tree of such words; any
other is the walk of an escape, then its bytes and a blank, each a walk down a
tree of bytes. Every step of a walk is a bit to predict. Hashed contexts give
each bit predictions from counts over all training texts: for words, the class
of the text so far, the word before, the two words before; for bytes, one, two
or three bytes before and the class, and the word so far.

A prediction is one of LEVELS of confidence. Weights picked by a gate mix them
in the logistic domain, and a last table moves the result to what came
true where the same ones met. Both are learned on all training texts: each is
predicted from the counts of the other half alone, so that its own words don't
flatter the long contexts, and its outcomes are counted by what the contexts
said. Those are sums of whole numbers, so the model is the same however rows
are dealt. The bits' probabilities multiply to the token's.

While a text is scored the model goes on adapting to it: it is mixed with what
the text has held so far, in several shares at once, of which those that have
predicted the text best so far weigh most.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .runtime import Shared, materialise, remove, shared_dir

#: Most words that have a walk of their own; others are spelt, and their counts enter the byte contexts.
FREQUENT = 1 << 17
#: Kinds of text a word may stand in: by the last byte over 127 before it in its document, 0 if none.
CLASSES = 17
#: Contexts of bytes (words have one less); least and most bits of a context's slots: the slots grow with the training tokens between them.
CONTEXTS, LEAST_BITS, MOST_BITS = 4, 14, 21
#: Added to either count of a slot; logits of the levels and what parts them; code 0 is a slot never seen.
PRIOR = 0.4
LEVELS = np.array([0, -6.0, -3.5, -2.2, -1.25, -0.5, 0, 0.5, 1.25, 2.2, 3.5, 6.0])
EDGES = np.array([-4.7, -2.8, -1.7, -0.85, -0.2, 0.2, 0.85, 1.7, 2.8, 4.7])
CODES = len(LEVELS)
#: Steps of a walk are told apart as the first, up to the third, up to the sixth, and later ones; words and bytes apart.
DEPTHS, KINDS = 4, 2
GRID = CODES**CONTEXTS
#: Passes over the outcomes and outcomes in a step of the weights; weight of the mix against the outcomes of a cell.
PASSES, STEP, RATE, TRUST = 40, 4096, 0.02, 8.0
#: Least probability of a bit; shares in which a text's own earlier tokens are mixed in, each as likely at its start.
LEAST, SHARES = 1e-4, (0.0, 0.05, 0.15, 0.35, 0.7, 0.95)
#: Slots in a piece of the tables that is sent; tokens whose bits are looked at at once; bytes spelt for it; bytes of text.
PIECE, CHUNK, SPELT, SLICE = 1 << 15, 1 << 14, 1 << 17, 2 << 20
BLANK = 32
START_HASH, END_HASH = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
NODE_ODD, PLACE_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BYTE_MIX = flat.mix(np.arange(1, 257, dtype=np.uint64) * flat.M1)


class Walks:
    """Walk of each symbol down the Huffman tree of the weights: first entry and number of entries, each with its node's hash, and stage of depth and bit."""

    def __init__(self, weights: np.ndarray, base: int):
        n = len(weights)
        heap = [(int(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
        for new in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = new
            side[y] = 1
            heapq.heappush(heap, (a + b, new))
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        self.size = np.array(depth[:n], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.hash, self.step = np.zeros(int(self.size.sum()), np.uint64), np.zeros(int(self.size.sum()), np.uint8)
        at, here = self.size - 1, np.arange(n)
        stage = np.array([0, 1, 1, *[2] * 3, *[3] * 99])
        while (on := np.flatnonzero(at >= 0)).size:
            up = parent[here[on]]
            self.hash[self.first[on] + at[on]] = (up - n + base).astype(np.uint64) * NODE_ODD
            self.step[self.first[on] + at[on]] = stage[np.minimum(at[on], 99)] << 1 | side[here[on]]
            here[on] = up
            at[on] -= 1
        self.end = base + n - 1

    def events(self, symbol: np.ndarray, contexts: list[np.ndarray], shift: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each step of each symbol's walk: stage of depth, bit and the slots of the contexts; and the number of steps of each symbol."""
        size = self.size[symbol]
        end = np.cumsum(size)
        at = np.repeat(self.first[symbol] - (end - size), size)
        at += np.arange(len(at))
        step, node = self.step[at], self.hash[at]
        slots = []
        for c in contexts:
            slot = np.repeat(c, size)
            slot += node
            slot >>= shift
            slots.append(slot.view(np.int64))
        return size, step >> 1, step & np.uint8(1), slots


class Tokens:
    """The words of a batch of texts in order, each text's end after them."""

    def __init__(self, column: pa.Array):
        raw, off = flat.text_bytes(column)
        self.raw, self.n = flat.LOWER[raw], len(off) - 1
        start, end, row = flat.word_spans(self.raw, off)
        words = np.bincount(row, minlength=self.n) if len(row) else np.zeros(self.n, np.int64)
        self.at_word, self.at_end = np.arange(len(start)) + row, np.cumsum(words) + np.arange(self.n)
        size = len(start) + self.n

        def placed(of_words, of_ends, kind):
            out = np.empty(size, kind)
            out[self.at_word], out[self.at_end] = of_words, of_ends
            return out

        self.row = placed(row, np.arange(self.n), np.int64)
        self.word = placed(flat.word_hashes(self.raw, start, end), END_HASH, np.uint64)
        self.start, self.size = placed(start, off[1:], np.int64), placed(end - start, 0, np.int64)
        self.bytes = np.diff(off)
        if len(raw):
            high = np.concatenate([[-1], np.flatnonzero(self.raw > 127)])
            last = high[np.searchsorted(high, self.start) - 1]
            self.cls = np.where((last >= 0) & (last >= off[self.row]), (self.raw[last] & 15) + 1, 0).astype(np.uint64)
        else:
            self.cls = np.zeros(size, np.uint64)

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word before each token, and of the two before; a text begins with words of its own."""
        out = []
        for k in (1, 2):
            h = np.full(len(self.word), START_HASH, np.uint64)
            same = np.flatnonzero(self.row[k:] == self.row[:-k]) + k
            h[same] = self.word[same - k]
            out.append(h)
        return out[0], out[1]


def words_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of words as an Arrow array."""
    end = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(end.astype(np.int32).tobytes()), pa.py_buffer(flat.gather(raw, start, size).tobytes())])


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: every word of the training texts, the end not among them."""

    def run(batches):
        for b in flat.sliced(batches, 0, 2 * SLICE):
            raw, off = flat.text_bytes(b.column(0))
            raw = flat.LOWER[raw]
            start, end, _ = flat.word_spans(raw, off)
            if not len(start):
                continue
            _, first, count = np.unique(flat.word_hashes(raw, start, end), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([words_of(raw, start[first], (end - start)[first]), pa.array(count)], ["word", "c"])

    counts = docs.where("train").select("text").mapInArrow(run, "word binary, c long")
    return materialise(counts.groupBy("word").agg(F.sum("c").alias("c")))


class Mixer:
    """The model: the words that have walks, the context tables and the probabilities of what the contexts say together."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ends: int, others: int):
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        self.n, self.count, self.ends = len(words), counts.astype(np.int64), ends
        self.end, self.escape = self.n, self.n + 1
        self._file(flat.word_hashes(raw, np.cumsum(size) - size, np.cumsum(size)))
        self.words = Walks(np.concatenate([self.count, [max(ends, 1), max(others, 1)]]), 0)
        self.letters = Walks(np.bincount(raw, minlength=256) + 1, self.words.end)
        events = max(16 * (int(self.count.sum()) + ends + others), 2)
        self.bits = int(np.clip(int(events - 1).bit_length(), LEAST_BITS, MOST_BITS))
        self.codes: list[np.ndarray] = []
        self.log = np.full((KINDS * DEPTHS * GRID, 2), np.log10(0.5))

    def _file(self, hashes: np.ndarray) -> None:
        """An open table of the words' hashes, at most a quarter full; 0 is a free slot."""
        bits = max(8, (4 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        key, place = [0] * (1 << bits), [-1] * (1 << bits)
        for i, h in enumerate(hashes.tolist()):
            at = h >> (64 - bits)
            while key[at]:
                at = (at + 1) & ((1 << bits) - 1)
            key[at], place[at] = h, i
        self.key, self.at = np.array(key, np.uint64), np.array(place, np.int64)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word that has a walk, -1 of others."""
        at = (hashes >> self.shift).astype(np.int64)
        found = self.key[at]
        out = np.where(found == hashes, self.at[at], -1)
        on = np.flatnonzero((found != hashes) & (found != 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.key) - 1)
            found = self.key[at[on]]
            hit = found == hashes[on]
            out[on[hit]] = self.at[at[on[hit]]]
            on = on[~hit & (found != 0)]
        return out

    def symbols(self, t: Tokens) -> np.ndarray:
        out = self.place(t.word)
        out[out < 0] = self.escape
        out[t.at_end] = self.end
        return out

    def events(self, t: Tokens, symbol: np.ndarray, side: np.ndarray):
        """Bits of the tokens, a chunk at a time, with the tokens' sides (0 or 1).

        What is predicted is a word or a byte of a spelt one; bytes with the
        same contexts on the same side are one. Gives the tokens in order of
        what they hold, the first of them and their number for each that is
        predicted, its steps, and of each step the kind and stage, the bit and
        the slots of the contexts.
        """
        one, two = t.before()
        shift = np.uint64(64 - self.bits)
        for a in range(0, len(symbol), CHUNK):
            z = min(a + CHUNK, len(symbol))
            contexts = [(t.cls[a:z] + np.uint64(1)) * flat.M3, flat.mix(one[a:z] + flat.M1), flat.mix(one[a:z] * flat.M3 + flat.mix(two[a:z]))]
            size, stage, bit, slots = self.words.events(symbol[a:z], contexts, shift)
            token = np.arange(a, z)
            yield token, token, np.ones(z - a, np.int64), size, stage, bit, slots
        spelt = np.flatnonzero(symbol == self.escape)
        part = np.cumsum(t.size[spelt] + 1) // SPELT
        for some in np.split(spelt, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(spelt) else ():
            token, byte, contexts = self._spelling(t, some)
            key = flat.mix(contexts[-1] + (t.cls[token] << np.uint64(1) | side[token].astype(np.uint64)) * NODE_ODD) + byte.astype(np.uint64) * PLACE_ODD
            order = np.argsort(key)
            key, token = key[order], token[order]
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            edge = np.append(first, len(order))
            byte, contexts = byte[order[first]], [c[order[first]] for c in contexts]
            for i in range(0, len(first), CHUNK):
                z = min(i + CHUNK, len(first))
                size, stage, bit, slots = self.letters.events(byte[i:z], [c[i:z] for c in contexts], shift)
                yield token[edge[i] : edge[z]], token[first[i:z]], np.diff(edge[i : z + 1]), size, stage + np.uint8(DEPTHS), bit, slots

    def _spelling(self, t: Tokens, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """The bytes of the tokens and a blank after each: token, byte and contexts of each."""
        size = t.size[token] + 1
        first = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(token)), size)
        pos = np.arange(len(unit)) - first[unit]
        inside = pos < size[unit] - 1
        byte = np.where(inside, t.raw[np.where(inside, t.start[token][unit] + pos, 0)], BLANK).astype(np.int64)
        known = np.zeros(len(byte), np.uint64)
        contexts = []
        for k in (1, 2, 3):
            b = np.zeros(len(byte), np.uint64)
            b[k:] = byte[:-k]
            b[pos < k] = 0
            known |= b << np.uint64(8 * (k - 1))
            contexts.append(flat.mix(known | (t.cls[token][unit] + np.uint64(32 * k)) << np.uint64(24)))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(pos.max()), PLACE_ODD)]))
        total = np.cumsum(BYTE_MIX[byte] * power[pos]) - BYTE_MIX[byte] * power[pos]
        contexts.append(flat.mix(total - total[first][unit] + np.uint64(3)))
        return token[unit], byte, tuple(contexts)

    def cells(self, codes: list[np.ndarray], stage: np.ndarray) -> np.ndarray:
        cell = stage.astype(np.int32)
        for c in codes:
            cell *= CODES
            cell += c
        for _ in range(CONTEXTS - len(codes)):
            cell *= CODES
        return cell

    def learn(self, cell: np.ndarray, count: np.ndarray) -> None:
        """Weights by gate from the outcomes (count of bits 0 and 1) of the cells, a part after the other, and the probabilities of all cells."""
        every = np.arange(KINDS * DEPTHS * GRID)
        code = np.stack([every // CODES ** (CONTEXTS - 1 - k) % CODES for k in range(CONTEXTS)], 1)
        of_words = every < DEPTHS * GRID
        gate = every // GRID * 4 + (np.where(of_words, code[:, 1], code[:, 2]) > 0) + 2 * (np.where(of_words, code[:, 2], code[:, 3]) > 0)
        x = np.concatenate([LEVELS[code], np.full((len(every), 1), 0.3)], 1)
        n_gates = KINDS * DEPTHS * 4
        w = np.full((n_gates, CONTEXTS + 1), 0.3)
        w[:, -1] = 0
        m, v, step = np.zeros_like(w), np.zeros_like(w), 0
        order = np.random.default_rng(0).permutation(len(cell))
        whole = np.maximum(np.bincount(gate[cell], count.sum(1), n_gates), 1.0)
        for done in range(PASSES):
            for at in range(0, len(order), STEP):
                pick = order[at : at + STEP]
                g, xs, c = gate[cell[pick]], x[cell[pick]], count[pick]
                p = 1 / (1 + np.exp(-np.clip((xs * w[g]).sum(1), -12, 12)))
                error = c[:, 1] - c.sum(1) * p
                grad = np.stack([np.bincount(g, error * xs[:, k], n_gates) for k in range(xs.shape[1])], 1) / whole[:, None] * max(1.0, len(order) / STEP)
                step += 1
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
                w += RATE * (1 - done / PASSES) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        p = 1 / (1 + np.exp(-np.clip((x * w[gate]).sum(1), -12, 12)))
        seen = np.zeros((len(every), 2))
        seen[cell] = count
        p = np.clip((seen[:, 1] + TRUST * p) / (seen.sum(1) + TRUST), LEAST, 1 - LEAST)
        self.log = np.log10(np.stack([1 - p, p], 1))

    def log10(self, t: Tokens, symbol: np.ndarray) -> np.ndarray:
        """Log10 probability of each token."""
        out = np.zeros(len(symbol))
        table = self.log.ravel()
        for token, _, count, size, stage, bit, slots in self.events(t, symbol, np.zeros(len(symbol), np.int64)):
            cell = 2 * self.cells([c[s] for c, s in zip(self.codes, slots)], stage) + bit
            each = np.add.reduceat(table[cell], np.cumsum(size) - size)
            if len(token) > len(each):
                each = np.repeat(each, count)
            first = token.min()
            each = np.bincount(token - first, each)
            out[first : first + len(each)] += each
        return out


def adapted(t: Tokens, log: np.ndarray) -> np.ndarray:
    """Log10 probability of each text from those of its tokens, mixed online with the text's own earlier tokens.

    A share s gives a token (1 - s) of the model's probability and s of how
    often the text has held it so far. A text's probability is the mean over
    the shares of their products: as if each token were mixed by weights that
    follow how well the shares have done before it.
    """
    key = flat.mix(t.word + t.row.astype(np.uint64) * NODE_ODD)
    order = np.argsort(key, kind="stable")
    place = np.arange(len(order))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    before = np.empty(len(order), np.int64)
    before[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    begin = t.at_end - (np.bincount(t.row, minlength=t.n) - 1)
    again = np.flatnonzero(before)
    own = np.log10(before[again] / (again - begin[t.row[again]]))
    total = np.empty((len(SHARES), t.n))
    for k, share in enumerate(SHARES):
        each = log + np.log10(1 - share)
        if share:
            a, b = each[again], own + np.log10(share)
            high = np.maximum(a, b)
            each[again] = high + np.log10(1 + 10.0 ** (np.minimum(a, b) - high))
        total[k] = np.bincount(t.row, each, t.n)
    best = total.max(0)
    return best + np.log10((10.0 ** (total - best)).mean(0))


def levels(counts: np.ndarray) -> np.ndarray:
    """Codes of slots with these counts of bits 0 and 1."""
    n = counts.astype(np.float64)
    code = np.searchsorted(EDGES, np.log((n[..., 1] + PRIOR) / (n[..., 0] + PRIOR))) + 1
    return np.where(n.sum(-1) > 0, code, 0).astype(np.uint8)


def _packed(cells: np.ndarray) -> tuple[bytes, int]:
    """Counts in as few bytes each as the largest needs, compressed, and that number."""
    top = int(cells.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return pa.compress(cells.astype(f"u{width}").tobytes(), codec="zstd", asbytes=True), width


def _tallied(batches, model: Mixer):
    """Pieces of the counts of texts that come in order of their half; the tables of one half are held at a time."""
    slots = 1 << model.bits
    size, now = min(PIECE, slots), 0
    tables = [np.zeros(2 * slots, np.int32) for _ in range(CONTEXTS)]

    def pieces():
        for which, table in enumerate(tables):
            for part, piece in enumerate(table.reshape(-1, size, 2)):
                if piece.any():
                    cells, width = _packed(piece)
                    yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([part], pa.int32()), pa.array([now], pa.int32()), pa.array([cells], pa.binary()), pa.array([width], pa.int32()), pa.array([size], pa.int32())], ["which", "part", "half", "cells", "width", "slots"])
            table[:] = 0

    for b in flat.sliced(batches, 0, SLICE):
        cut = int(np.searchsorted(b.column(1).to_numpy(zero_copy_only=False), 1))
        for half, texts in ((0, b.column(0)[:cut]), (1, b.column(0)[cut:])):
            if not len(texts):
                continue
            if half != now:
                yield from pieces()
                now = half
            t = Tokens(texts)
            for _, _, count, steps, _, bit, found in model.events(t, model.symbols(t), np.zeros(len(t.row), np.int64)):
                times = np.repeat(count.astype(np.int32), steps)
                for table, s in zip(tables, found):
                    s <<= 1
                    s += bit
                    np.add.at(table, s, times)
    yield from pieces()


def _added(batches):
    """Codes of the sums of pieces of a half that come in order of (which, part): of either half and of both; one piece is held at a time."""
    now = total = None

    def out():
        a, b = total
        code = np.stack([levels(x) for x in (a, b, a + b)])
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([code.tobytes()], pa.binary())], ["which", "part", "codes"])

    for b in batches:
        for which, part, half, cells, width, slots in zip(*[c.to_pylist() for c in b.columns]):
            got = np.frombuffer(pa.decompress(cells, decompressed_size=2 * slots * width, codec="zstd"), f"u{width}").reshape(slots, 2)
            if now != (which, part):
                if now is not None:
                    yield out()
                now, total = (which, part), np.zeros((2, slots, 2), np.int64)
            total[half] += got
    if now is not None:
        yield out()


def gather_tables(docs: DataFrame, model: Mixer) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Codes of the contexts' slots from the counts of all training texts: of the two halves, one after the other, and of both.

    Each task sends the counts of its own texts once, in compressed pieces, so
    what is shuffled grows with the input; executors add them up, and the
    driver gets a byte a slot. A task's texts come in order of the half, so it
    holds the tables of one half at a time.
    """
    sent = Shared(docs.sparkSession, model)
    slots = 1 << model.bits
    size = min(PIECE, slots)

    def run(batches):
        return _tallied(batches, sent.value)

    parts = docs.where("train").select("text", "half").sortWithinPartitions("half").mapInArrow(run, "which int, part int, half int, cells binary, width int, slots int")
    summed = parts.repartition("which", "part").sortWithinPartitions("which", "part").mapInArrow(_added, "which int, part int, codes binary")
    halves, both = [np.zeros(2 * slots, np.uint8) for _ in range(CONTEXTS)], [np.zeros(slots, np.uint8) for _ in range(CONTEXTS)]
    path = shared_dir(docs.sparkSession)
    got = materialise(summed, path).toArrow()  # three bytes a slot, at most MOST_BITS of them a context
    for which, part, codes in zip(*(got[c].to_pylist() for c in ("which", "part", "codes"))):
        code = np.frombuffer(codes, np.uint8).reshape(3, size)
        for k, (to, at) in enumerate(((halves, 0), (halves, slots), (both, 0))):
            to[which][at + part * size : at + (part + 1) * size] = code[k]
    remove(docs.sparkSession, path)
    sent.unpersist()
    return halves, both


def gather_outcomes(docs: DataFrame, model: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """Cells of what the contexts say together, each text's from the counts of the other half, and how often either bit came true there, over all training texts."""
    sent = Shared(docs.sparkSession, model)

    def run(batches):
        m = sent.value
        slots = 1 << m.bits
        seen = np.zeros(2 * KINDS * DEPTHS * GRID, np.int64)
        for b in flat.sliced(batches, 0, SLICE):
            t = Tokens(b.column(0))
            other = (1 - b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))[t.row]
            for _, first, count, size, stage, bit, found in m.events(t, m.symbols(t), other):
                shift = np.repeat(other[first] * slots, size)
                for s in found:
                    s += shift
                cell = 2 * m.cells([c[s] for c, s in zip(m.codes, found)], stage) + bit
                np.add.at(seen, cell.astype(np.int64), np.repeat(count, size))
        count = seen.reshape(-1, 2)
        at = np.flatnonzero(count.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at, 0]), pa.array(count[at, 1])], ["cell", "n0", "n1"])

    parts = docs.where("train").select("text", "half").mapInArrow(run, "cell long, n0 long, n1 long")
    got = parts.groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().sort_by("cell")  # at most KINDS * DEPTHS * GRID rows
    sent.unpersist()
    return got["cell"].to_numpy(), np.stack([got["n0"].to_numpy(), got["n1"].to_numpy()], 1).astype(np.float64)


def train(docs: DataFrame, words: DataFrame, ends: int, n_words: int) -> Mixer:
    """Model of the training texts of docs (text, train, half), of which words has the counts."""
    top = words.where("c > 1").orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    counts = top["c"].to_numpy()
    model = Mixer([bytes(w) for w in top["word"].to_pylist()], counts, ends, n_words - int(counts.sum()))
    model.codes, both = gather_tables(docs, model)
    model.learn(*gather_outcomes(docs, model))
    model.codes = both
    return model


def score_texts(docs: DataFrame, model: Mixer, n_train: int, n_distinct: int) -> DataFrame:
    """rid, doc_id, word, k, n_tokens, n_known, base, score, n_bytes: a row a text, with the sums over ends and words that have walks, and a row for each other word of a text, with how often it occurs."""
    sent = Shared(docs.sparkSession, model)
    whole = n_train + 0.5 * (n_distinct + 1)

    def run(batches):
        m = sent.value
        counts = np.concatenate([m.count, [m.ends, 0]])
        base_of = np.log10((counts + 0.5) / whole)
        base_of[m.escape] = 0.0  # joined later
        for b in flat.sliced(batches, 1, SLICE):
            t = Tokens(b.column(1))
            symbol = m.symbols(t)
            doc_id = b.column(2)
            sums = [np.bincount(t.row, x, t.n) for x in (np.ones(len(symbol)), counts[symbol] > 0, base_of[symbol])]
            sums.append(adapted(t, m.log10(t, symbol)))
            rid = b.column(0).to_numpy()
            yield _score_rows(rid, doc_id, pa.nulls(t.n, pa.binary()), np.zeros(t.n, np.int64), sums, t.bytes)
            rare = np.flatnonzero(symbol == m.escape)
            _, first, count = np.unique(flat.mix(t.word[rare] + t.row[rare].astype(np.uint64) * NODE_ODD), return_index=True, return_counts=True)
            at = rare[first]
            if len(at):
                yield _score_rows(rid[t.row[at]], pa.nulls(len(at), doc_id.type), words_of(t.raw, t.start[at], t.size[at]), count, [np.zeros(len(at))] * 4, np.zeros(len(at), np.int64))

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "text", "doc_id")  # the number is used in this one pass only
    return materialise(numbered.mapInArrow(run, f"rid long, doc_id {kind}, word binary, k long, n_tokens long, n_known long, base double, score double, n_bytes long"))


def _score_rows(rid, doc_id, word, k, sums, n_bytes) -> pa.RecordBatch:
    columns = [pa.array(rid), doc_id, word, pa.array(k.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(float)), pa.array(sums[3].astype(float)), pa.array(n_bytes.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "word", "k", "n_tokens", "n_known", "base", "score", "n_bytes"])


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == 1, F.lit(False))


def language_scores(docs: DataFrame) -> DataFrame:
    """op6: base and model scores of every row of docs (doc_id, text), learned from those not held out.

    Words without a walk meet their counts in a join on the word, the others in
    a table of bounded size. Null and empty texts have the end alone; a null id
    is one more id; repeated rows are separate; without training rows N is 0
    and every bit has one half; an empty table gives an empty result.
    """
    half = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit(1)).cast("int")
    rows = docs.select("doc_id", "text", (~held_out()).alias("train"), half.alias("half"))
    words = count_words(rows)
    ends = rows.where("train").count()
    n_words, n_distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train, n_distinct = n_words + ends, n_distinct + (ends > 0)
    scored = score_texts(rows, train(rows, words, ends, n_words), n_train, n_distinct)
    rare = scored.where("word is not null").select("rid", "word", "k").join(words, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    whole = n_train + 0.5 * (n_distinct + 1)
    rare = rare.select("rid", F.when(c > 0, F.col("k")).otherwise(0).alias("n_known"), (F.col("k") * F.log10((c + 0.5) / F.lit(whole))).alias("base"))
    rare = rare.groupBy("rid").agg(F.sum("n_known").alias("r_known"), F.sum("base").alias("r_base"))
    out = scored.where("word is null").drop("word", "k").join(rare, "rid", "left")
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
