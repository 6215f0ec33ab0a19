"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import flat

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Segments that a task remembers; beyond, it forgets them and starts anew.
MEMO = 400_000
#: Bytes of text whose ids are gathered at once, and segments encoded at once.
SLICE, STEP = 2 << 20, 1 << 16
NONE = np.int32(1 << 30)


class PieceModel:
    """Tables of a BPE model: symbols, pair ranks and byte pieces.

    Only models with identity normalisation, a dummy prefix and byte fallback,
    of whose pieces none has a space mark after another character, are taken:
    then no merge crosses the start of a run of space marks.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if len(norm.precompiled_charsmap) or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model needs identity normalisation, a dummy prefix and byte fallback")
        self.strings = [p.piece for p in proto.pieces]
        self.decimals = _table([b"%d," % i for i in range(len(self.strings))])
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece has a space mark after another character")
        self.bytes = np.full(256, -1, np.int64)
        spelt = [p.replace(SPACE, " ").encode("utf-8") for p in self.strings]
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                spelt[i] = bytes([int(p.piece[3:5], 16)])
        self.spelt = _table(spelt)
        self.n = len(self.strings)
        symbol = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            symbol[c] = self.n + len(symbol) - len(ids)
        self.width = self.n + len(symbol) - len(ids) + 1
        chars = sorted((ord(c), s) for c, s in symbol.items() if len(c) == 1)
        self.char_code = np.array([c for c, _ in chars], np.int64)
        self.char_id = np.array([s for _, s in chars], np.int64)
        scores = sorted({proto.pieces[i].score for i in ids.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                if (a := symbol.get(p[:cut])) is not None and (b := symbol.get(p[cut:])) is not None:
                    pairs[a * self.width + b] = (rank[proto.pieces[i].score], i)
        # the pairs in an open table of at most a quarter full, its slots probed in order
        self.bits = max(8, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank, self.slot_id = np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        self.probes = 1
        for key, (r, i) in pairs.items():
            at, k = self._slot(np.array([key]))[0], 1
            while self.slot_key[at] >= 0:
                at, k = (at + 1) % size, k + 1
            self.slot_key[at], self.slot_rank[at], self.slot_id[at] = key, r, i
            self.probes = max(self.probes, k)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank NONE if it doesn't merge."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -2)
        at = self._slot(key)
        found = self.slot_key[at]
        rank, made = self.slot_rank[at], self.slot_id[at]
        bad = found != key
        rank[bad], made[bad] = NONE, -1
        on = np.flatnonzero(bad & (found >= 0))
        for _ in range(1, self.probes):
            if not len(on):
                break
            at[on] = (at[on] + 1) & (len(self.slot_key) - 1)
            found = self.slot_key[at[on]]
            hit = on[found == key[on]]
            rank[hit], made[hit] = self.slot_rank[at[hit]], self.slot_id[at[hit]]
            on = on[(found != key[on]) & (found >= 0)]
        return rank, made

    def encode_segments(self, text: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, flat, and the number of each; text holds them one after another, size their bytes.

        A segment is a run of spaces and what follows up to the next. Each
        round finds the least pair rank of each segment and merges its
        occurrences from the left at once, up to the first merge that makes a
        pair of that rank or a better one: a queue would take that pair next.
        """
        n_segments = len(size)
        code = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        code[code == 32] = ord(SPACE)
        leads = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        chars = np.diff(leads[np.concatenate([[0], np.cumsum(size)])])
        seg = np.repeat(np.arange(n_segments, dtype=np.int32), chars)
        at = np.minimum(np.searchsorted(self.char_code, code), len(self.char_code) - 1)
        sym = np.where(self.char_code[at] == code, self.char_id[at], -1 - code).astype(np.int32)  # below 0: a character without a piece
        out_sym, out_seg, out_at = [], [], []
        where = np.arange(len(sym), dtype=np.int32)
        rank, made = self._ranks(sym, seg, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.concatenate([first, [len(sym)]]))
            best = np.repeat(least, length)
            done = best == NONE
            if done.any():
                out_sym.append(sym[done]), out_seg.append(seg[done]), out_at.append(where[done])
                keep = ~done
                sym, seg, where, rank, made, best = sym[keep], seg[keep], where[keep], rank[keep], made[keep], best[keep]
                if not len(sym):
                    break
            take = self._leftmost(rank == best)
            take = self._until_better(take, sym, seg, made, best)
            stay = np.ones(len(sym), bool)
            stay[1:] = ~take[:-1]
            sym = np.where(take, made, sym)[stay]
            seg, where, rank, made, take = seg[stay], where[stay], rank[stay], made[stay], take[stay]
            new = np.flatnonzero(take)  # only pairs with a merged symbol have changed
            take[new[new > 0] - 1] = True
            new = np.flatnonzero(take)
            rank[new], made[new] = self._ranks(sym, seg, new)
        if not out_sym:
            return np.zeros(0, np.int64), np.zeros(n_segments, np.int64)
        sym, seg, where = map(np.concatenate, (out_sym, out_seg, out_at))
        order = np.argsort(where, kind="stable")
        return self._ids(sym[order], seg[order], n_segments)

    def _ranks(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that start at `at`; a segment's last symbol starts none."""
        rank, made = np.full(len(at), NONE, np.int32), np.full(len(at), -1, np.int32)
        inner = np.flatnonzero(at + 1 < len(sym))
        inner = inner[seg[at[inner]] == seg[at[inner] + 1]]
        rank[inner], made[inner] = self.pair(sym[at[inner]], sym[at[inner] + 1])
        return rank, made

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of each run of adjacent hits every other one, from its first: pairs that don't overlap."""
        index = np.arange(len(hit))
        start = hit.copy()
        start[1:] &= ~hit[:-1]
        run = np.maximum.accumulate(np.where(start, index, 0))
        return hit & ((index - run) % 2 == 0)

    def _until_better(self, take, sym, seg, made, best):
        """take, cut after the first merge of a segment that makes a pair of rank best or less."""
        at = np.flatnonzero(take)
        n = len(sym)
        new = made[at]
        stop = np.zeros(len(at), bool)
        nxt = at + 2
        ok = nxt < n
        ok[ok] = seg[nxt[ok]] == seg[at[ok]]
        stop[ok] |= self.pair(new[ok], sym[nxt[ok]])[0] <= best[at[ok]]
        prev = at - 1
        ok = prev >= 0
        ok[ok] = seg[prev[ok]] == seg[at[ok]]
        merged = np.zeros(len(at), bool)
        merged[1:] = take[np.maximum(at[1:] - 2, 0)] & (at[1:] - 2 == at[:-1])
        left = np.where(merged & ok, made[np.maximum(at - 2, 0)], sym[np.maximum(prev, 0)])
        stop[ok] |= self.pair(left[ok], new[ok])[0] <= best[at[ok]]
        if stop.any():
            s = seg[at]
            head = np.concatenate([[True], s[1:] != s[:-1]])
            before = np.cumsum(stop) - stop  # stops before this merge, over all segments
            base = np.maximum.accumulate(np.where(head, before, 0))
            take = take.copy()
            take[at[before - base > 0]] = False
        return take

    def _ids(self, sym: np.ndarray, seg: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        odd = (sym < 0) | (sym >= self.n)
        if odd.any():  # characters without a piece become the bytes of their UTF-8
            code_of = {int(s): int(c) for c, s in zip(self.char_code, self.char_id)}
            reps = {int(s): self.bytes[list(chr(-1 - int(s) if s < 0 else code_of[int(s)]).encode("utf-8"))] for s in np.unique(sym[odd])}
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(reps[int(s)]) for s in sym[odd]]
            start = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.int64)
            out[start[~odd]] = sym[~odd]
            for i in np.flatnonzero(odd):
                out[start[i] : start[i] + size[i]] = reps[int(sym[i])]
            sym, seg = out, np.repeat(seg, size)
        return sym, np.bincount(seg, minlength=n)

    def text_bytes(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts of `size` ids each, one after another, and n + 1 offsets; byte pieces become bytes, space marks spaces, the dummy prefix goes."""
        return _joined(ids, size, *self.spelt, drop_first=32)

    def numbers(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text in decimal, joined by commas, and n + 1 offsets."""
        raw, off = _joined(ids, size, *self.decimals)
        filled = off[1:] > off[:-1]
        keep = np.ones(len(raw), bool)
        keep[off[1:][filled] - 1] = False  # the last comma of each
        return raw[keep], off - np.concatenate([[0], np.cumsum(filled)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return self.text_bytes(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes().decode("utf-8", errors="replace")


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size


def _joined(ids, size, data, first, length, drop_first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The strings of the ids of each text, one after another, and n + 1 offsets; a text's first byte goes if it is drop_first."""
    raw = flat.gather(data, first[ids], length[ids])
    off = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(size)])]
    if drop_first is not None:
        filled = np.flatnonzero(off[1:] > off[:-1])
        gone = filled[raw[off[filled]] == drop_first]
        keep = np.ones(len(raw), bool)
        keep[off[gone]] = False
        less = np.zeros(len(off), np.int64)
        less[gone + 1] = 1
        raw, off = raw[keep], off - np.cumsum(less)
    return raw, off


class Encoder:
    """Encodes slices of texts segment by segment and remembers the segments it has seen, in bounded number.

    Arrow tells the segments of a slice apart by their bytes and finds those
    seen before, so each is encoded once; ids and texts are gathered flat.
    """

    def __init__(self, model: PieceModel, memo: int = MEMO):
        self.model, self.memo = model, memo
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.size = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _places(self, segments: pa.Array) -> np.ndarray:
        """Number of each segment among the known ones; new ones are encoded and noted."""
        new = segments.filter(pc.is_null(pc.index_in(segments, value_set=self.known)))
        if len(self.known) and len(self.known) + len(new) > self.memo:
            self._forget()
            new = segments
        parts = [(self.ids, self.size)]
        for at in range(0, len(new), STEP):
            part = pa.concat_arrays([new.slice(at, STEP)])
            raw, off = flat.text_bytes(part)
            ids, size = self.model.encode_segments(raw.tobytes(), np.diff(off))
            parts.append((ids.astype(np.int32), size))
        self.ids, self.size = (np.concatenate(x) for x in zip(*parts))
        self.known = pa.concat_arrays([self.known, new])
        return pc.index_in(segments, value_set=self.known).to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of each; null is empty."""
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        texts = pc.replace_substring(texts.fill_null(""), SPACE, " ")  # a space becomes a mark all the same
        begun = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
        raw, off = flat.text_bytes(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, begun))
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        space = raw == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(first)
        cuts = pa.py_buffer(np.concatenate([start, [len(raw)]]).astype(np.int32).tobytes())
        found = pa.Array.from_buffers(pa.binary(), len(start), [None, cuts, pa.py_buffer(raw)]).dictionary_encode()
        place = self._places(found.dictionary)[found.indices.to_numpy()]
        size = self.size[place]
        begin = np.cumsum(self.size) - self.size
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, off)]
        return flat.gather(self.ids, begin[place], size), np.diff(ends)


def default_model() -> str:
    """Path of the public model, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _strings(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded of every text, whole. Null and empty texts have no ids and decode to ''; repeated rows are separate rows; an empty table gives an empty result.

    A task holds the ids and texts of one slice of SLICE bytes (or of one
    longer text) and a bounded memo, whatever the size of Arrow's batches.
    """

    def run(batches):
        m = PieceModel(model)
        encoder = Encoder(m)
        for b in flat.sliced(batches, 1, SLICE):
            ids, size = encoder.encode(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, _strings(*m.text_bytes(ids, size))], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Map only, a slice at a time as in encode_texts. Null and empty texts have
    no ids; repeated rows are separate rows; an empty table gives an empty
    result.
    """

    def digests(raw: np.ndarray, off: np.ndarray) -> pa.Array:
        data = memoryview(raw)
        return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:])], pa.string())

    def run(batches):
        m = PieceModel(model)
        encoder = Encoder(m)
        for b in flat.sliced(batches, 1, SLICE):
            ids, size = encoder.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), digests(*m.numbers(ids, size)), digests(*m.text_bytes(ids, size))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
