"""Suffix-array dedup of long repeated byte strings, by a run-length index of the passages that may repeat.

A string of LENGTH bytes holds LENGTH - GRAM + 1 grams; that of the least hash,
the leftmost of equals, is its anchor. Equal strings have equal anchors, so each
start of a string belongs to one anchor, and an anchor's passage is the text of
the starts it owns. Anchors are grouped by hash: most stand alone, most others
always come with the same passage, of which all but the first are repeats. Where
one anchor has several passages, a run-length index over them tells which of
their starts repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .runtime import materialise, maybe_broadcast, remove, shared_dir

LENGTH, GRAM = 100, 32
#: Starts looked at in one go; bytes of the passages that one index is built over; passages of an anchor beyond which they are dealt anew by a second anchor, a third and so on, up to LEVELS.
SLICE, INDEX_BYTES, GROUP_MOST, LEVELS = 1 << 19, 1 << 19, 2000, 12
#: Bytes of texts whose repeats a task tells apart before anything is shuffled.
BATCH_BYTES = 24 << 20
POSITION = np.uint64((1 << 20) - 1)
ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) & (2**64 - 1) | 1) for j in range(8)]

ROW = "kind int, anchor long, passage long, ord long, lo long, size int"


def gram_hashes(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the GRAM bytes from each byte of raw on which so many follow; another one for each seed."""
    n = len(raw) - GRAM + 1
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(raw) - 7,), strides=(1,))
    g = eights * flat.M2
    g ^= g >> np.uint64(29)
    h = g[:n] * ODD[0]
    for j in range(1, GRAM // 8):
        h += g[8 * j : 8 * j + n] * ODD[j]
    h = flat.mix(h)
    return flat.mix(h + np.uint64(seed) * flat.M1) if seed else h


def anchors(raw: np.ndarray, off: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Anchor, passage hash, row, first owned start within the row and passage size, for every run of starts of one anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    end_of = off[1:]
    wide = LENGTH - GRAM + 1
    for a in range(0, len(raw) - LENGTH + 1, SLICE):
        b = min(a + SLICE, len(raw) - LENGTH + 1)
        h = gram_hashes(raw[a : b + LENGTH - 1], seed)
        key = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        low, step = key, 1
        while 2 * step <= wide:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: b - a], low[wide - step : wide - step + b - a])
        start = np.arange(a, b)
        row = np.searchsorted(off, start, side="right") - 1
        fits = start + LENGTH <= end_of[row]
        anchor = (low & POSITION).astype(np.int64)
        new = np.ones(b - a, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (fits[1:] != fits[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [b - a]]) - 1
        first, last = first[fits[first]], last[fits[first]]
        if not len(first):
            continue
        size = last - first + LENGTH
        at = anchor[first]
        p = flat.mix(h[first + size - GRAM] + (size.astype(np.uint64) << np.uint64(32)) + (at - first).astype(np.uint64))
        for j in range((2 * LENGTH) // GRAM):
            has = size >= GRAM * (j + 1)
            p[has] = flat.mix(p[has] ^ (h[first[has] + GRAM * j] * ODD[j % 8]))
        out.append((h[at], p, row[first], first + a - off[row[first]], size))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, zip(*out)))


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each doc, joined where they touch or overlap."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(fresh) - 1
    base = group * (int(hi.max()) + 1)  # spans of a later doc lie beyond all of an earlier one
    reach = np.maximum.accumulate(hi + base)
    new = fresh.copy()
    new[1:] |= lo[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], lo[first], (reach - base)[np.concatenate([first[1:], [len(doc)]]) - 1]


def _rows(kind, anchor, passage, ord_, lo, size) -> pa.RecordBatch:
    n = len(ord_)
    columns = [np.full(n, kind, np.int32), anchor.view(np.int64) if len(anchor) else np.zeros(n, np.int64), passage.view(np.int64) if len(passage) else np.zeros(n, np.int64), ord_, lo, size.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "anchor", "passage", "ord", "lo", "size"])


def _spans(ord_: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    d, a, b = merged(ord_, lo, lo + size)
    return _rows(1, flat.mix(d.astype(np.uint64)), np.zeros(0, np.uint64), d, a, b - a)


def _local(batches):
    """Kind 0: the first of each anchor and passage in a batch. Kind 1: spans that repeat an earlier one of the batch, byte by byte."""
    for b in flat.sliced(batches, 1, BATCH_BYTES):
        raw, off = flat.text_bytes(b.column(1))
        anchor, passage, row, lo, size = anchors(raw, off)
        start, ord_ = off[row] + lo, b.column(0).to_numpy()[row]
        order = np.lexsort((lo, ord_, passage, anchor))
        anchor, passage, ord_, lo, size, start = (x[order] for x in (anchor, passage, ord_, lo, size, start))
        first = np.ones(len(order), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (passage[1:] != passage[:-1])
        again = np.flatnonzero(~first)
        head = np.flatnonzero(first)[np.cumsum(first)[again] - 1] if len(again) else again
        other = again[~_equal(raw, start[again], size[again], start[head], size[head])]
        passage[other] = flat.mix(passage[other] + lo[other].astype(np.uint64))  # equal hashes of unequal bytes: passages of their own
        first[other] = True
        yield _rows(0, anchor[first], passage[first], ord_[first], lo[first], size[first])
        yield _spans(ord_[~first], lo[~first], size[~first])


def _equal(raw: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether n bytes from a equal m bytes from b, for each pair."""
    same = n == m
    for at in range(0, len(a), 1 << 15):
        x, y, size = (v[at : at + (1 << 15)] for v in (a, b, np.minimum(n, m)))
        off = flat.gather(raw, x, size) != flat.gather(raw, y, size)
        wrong = np.concatenate([[0], np.cumsum(off)])[np.concatenate([[0], np.cumsum(size)])]
        same[at : at + (1 << 15)] &= wrong[1:] == wrong[:-1]
    return same


def _grouped(batches):
    """Of rows in order of (anchor, passage, ord, lo): kind 1 as it is and for repeats of a passage; kind 2 for first passages of an anchor that has several.

    The state is the last row and one first passage held back until a second one comes.
    """
    last = held = None
    held_out = False
    for b in batches:
        kind, anchor, passage, ord_, lo, size = (c.to_numpy() for c in b.columns)
        if (kind == 1).any():
            yield b.filter(pa.array(kind == 1))
        at = np.flatnonzero(kind == 0)
        if not len(at):
            continue
        anchor, passage, ord_, lo, size = anchor[at], passage[at], ord_[at], lo[at], size[at]
        first = np.ones(len(at), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (passage[1:] != passage[:-1])
        first[0] = last is None or last != (anchor[0], passage[0])
        last = (anchor[-1], passage[-1])
        if (~first).any():
            yield _spans(ord_[~first], lo[~first], size[~first].astype(np.int64))
        f = [x[first] for x in (anchor, passage, ord_, lo, size)]
        if not len(f[0]):
            continue
        if held is not None:
            f = [np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, f)]
        same = f[0][1:] == f[0][:-1]
        several = np.zeros(len(f[0]), bool)
        several[1:] |= same
        several[:-1] |= same
        out = several.copy()
        if held is not None and held_out:
            out[0] = False  # it went out with an earlier batch
        held_out = bool(several[-1]) or (len(f[0]) == 1 and held is not None and held_out)
        held = [x[-1] for x in f]
        if out.any():
            yield _rows(2, f[0][out], f[1][out], f[2][out], f[3][out], f[4][out])


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of segments, each ended by a symbol of its own, with samples at its runs.

    For a text position i let phi(i) be the position of the suffix before that
    of i in order, and m(i) how far the two agree. Where the symbol before i
    differs from that before phi(i) a run begins; these positions, their phi and
    m are the samples. Any other i has phi(i) = phi(j) + i - j and
    m(i) = m(j) - (i - j) for the nearest sample j before it. Streamed in text
    order, that gives the matching statistics of every position.
    """

    def __init__(self, segments: list[bytes]):
        size = np.array([len(s) for s in segments], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size + 1)])
        self.n = int(self.start[-1])
        text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        ends = self.start[1:] - 1
        symbol = text.astype(np.int64) + len(segments)
        symbol[ends] = np.arange(len(segments))
        self.end = np.repeat(ends, size + 1)  # of the segment of each position
        order, rank = self._sorted(symbol)
        before = symbol[order - 1]  # the transform; position 0 follows the last symbol
        head = np.ones(self.n, bool)
        head[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(head)
        self.runs = len(heads)
        sampled = order[heads]
        above = np.where(heads > 0, order[heads - 1], -1)
        by_text = np.argsort(sampled)
        self.sample, self.above = sampled[by_text], above[by_text]
        self.agree = self._common(text, self.sample, self.above)

    @staticmethod
    def _sorted(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and ranks by prefix doubling; only groups not yet told apart are sorted again."""
        n = len(symbol)
        width = int(symbol.max()).bit_length()
        h = max(1, min(4, 62 // width))
        key = symbol.copy()
        for j in range(1, h):
            key <<= width
            key[: n - j] |= symbol[j:]
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        alone = new & np.concatenate([new[1:], [True]])
        slots = np.flatnonzero(~alone)
        while len(slots):
            at = order[slots]
            ahead = np.minimum(at + h, n - 1)
            key = rank[at] * (n + 1) + np.where(at + h < n, rank[ahead] + 1, 0)
            by = np.argsort(key, kind="stable")
            order[slots] = at[by]
            s = key[by]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            rank[at[by]] = np.maximum.accumulate(np.where(new, slots, 0))
            slots = slots[~(new & np.concatenate([new[1:], [True]]))]
            h *= 2
        return order, rank

    def _common(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes on which the suffixes at a and b agree, within their segments."""
        padded = np.concatenate([text, np.zeros(16, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(text) + 1,), strides=(1,))
        most = np.where(b >= 0, np.minimum(self.end[a] - a, self.end[b] - b), 0)
        got = np.zeros(len(a), np.int64)
        on = np.flatnonzero(most > 0)
        while len(on):
            x = eights[a[on] + got[on]] ^ eights[b[on] + got[on]]
            full = x == 0
            part = on[~full]
            if len(part):
                low = x[~full] & (~x[~full] + np.uint64(1))
                got[part] += np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8
            on = on[full]
            got[on] += 8
            on = on[got[on] < most[on]]
        return np.minimum(got, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """phi and m of every position, streamed from the samples."""
        at = np.zeros(self.n, np.int64)
        at[self.sample] = np.arange(len(self.sample))
        at = np.maximum.accumulate(at)
        gone = np.arange(self.n) - self.sample[at]
        return self.above[at] + gone, self.agree[at] - gone

    def groups(self, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose next `length` bytes occur elsewhere in the text too, and a number that equal strings share."""
        phi, m = self.statistics()
        up = np.arange(self.n)
        linked = m >= length
        up[linked] = phi[linked]
        while (up != (jump := up[up])).any():
            up = jump
        several = linked.copy()
        several[up[linked]] = True
        at = np.flatnonzero(several)
        return at, up[at]


def repeated_starts(segments: list[bytes], ord_: np.ndarray, lo: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """ord and start of every string of the segments that occurs earlier among them, by (ord, start)."""
    index = RunLengthIndex(segments)
    at, group = index.groups(length)
    seg = np.searchsorted(index.start, at, side="right") - 1
    doc, start = ord_[seg], lo[seg] + at - index.start[seg]
    order = np.lexsort((start, doc, group))
    g = group[order]
    later = np.zeros(len(g), bool)
    later[1:] = g[1:] == g[:-1]
    return doc[order][later], start[order][later]


def _indexed(batches):
    """Spans that repeat, of rows (anchor, ord, lo, text) in order of the anchor; an index is built over whole groups."""
    held: list[tuple] = []
    size = 0

    def flush():
        doc, start = repeated_starts([h[3] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held]))
        held.clear()
        return _spans(doc, start, np.full(len(doc), LENGTH))

    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if size >= INDEX_BYTES and held[-1][0] != row[0]:
                yield flush()
                size = 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush()


def ordered_rows(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of that name that orders documents: doc_id where it tells all rows apart, else a number by (doc_id, text), null ids last."""
    key = F.col("doc_id").cast("long")
    odd = docs.groupBy(key.alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn(name, key)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [key.asc_nulls_last(), F.col("text").asc_nulls_first()]
    return materialise(docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()))


def ordered_texts(docs: DataFrame) -> DataFrame:
    """ord, doc_id and text of docs."""
    return ordered_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), "ord")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """ord, spans (sorted, disjoint lo and hi in bytes) of the texts (ord, text) that hold repeats."""
    spark = texts.sparkSession
    first = texts.mapInArrow(_local, ROW)
    dealt = first.repartition("anchor").sortWithinPartitions("anchor", "passage", "ord", "lo")
    path = shared_dir(spark)
    found = materialise(dealt.mapInArrow(_grouped, ROW), path)
    open_ = found.where("kind = 2").select("anchor", "ord", "lo", "size")
    wanted = open_.groupBy("ord").agg(F.collect_list(F.struct("anchor", "lo", "size")).alias("wanted"))
    passages = texts.join(wanted, "ord").select("ord", "text", "wanted")  # both grow with the corpus: shuffled at every size

    def cut(batches):
        for b in flat.sliced(batches, 1):
            raw, off = flat.text_bytes(b.column(1))
            each = b.column(2)
            row = np.repeat(np.arange(b.num_rows), each.value_lengths().to_numpy())
            anchor, lo, size = (each.flatten().field(k).to_numpy() for k in range(3))
            yield _passages(anchor, b.column(0).to_numpy()[row], lo, flat.gather(raw, off[row] + lo, size.astype(np.int64)), size)

    passages = passages.mapInArrow(cut, PASSAGE)
    spans = found.where("kind = 1").select("ord", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    few, more = by_anchors(passages, open_)
    from_index = few.repartition("anchor").sortWithinPartitions("anchor", "ord", "lo").mapInArrow(_indexed, ROW)
    spans = spans.union(from_index.select("ord", "lo", (F.col("lo") + F.col("size")).alias("hi")))
    for part in more:
        spans = spans.union(part)
    return materialise(spans.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")))


def by_anchors(passages: DataFrame, open_: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """passages (anchor, ord, lo, passage) with no more than GROUP_MOST of an anchor, and spans of repeats met on the way.

    An anchor that very many passages share, say of a common phrase, is told
    apart by a second anchor of another hash, then a third: equal strings have
    equal anchors by every hash, so they stay together. Of equal passages
    that come out the first alone goes on.
    """
    few, spans = [], []
    counts = open_.groupBy("anchor").agg(F.count("*").alias("n"))
    for seed in range(1, LEVELS + 1):
        many = materialise(counts.where(F.col("n") > GROUP_MOST).select("anchor"))
        n = many.count()
        if not n:
            break
        passages = materialise(passages)
        few.append(passages.join(maybe_broadcast(many, 8, n), "anchor", "left_anti"))
        hot = passages.join(maybe_broadcast(many, 8, n), "anchor", "left_semi")
        dealt = materialise(hot.mapInArrow(_dealt_anew(seed), PASSAGE))
        first = materialise(dealt.groupBy("anchor", "passage").agg(F.min(F.struct("ord", "lo")).alias("e"), F.count("*").alias("n")))
        again = dealt.join(first.where("n > 1").drop("n"), ["anchor", "passage"]).where((F.col("ord") != F.col("e.ord")) | (F.col("lo") != F.col("e.lo")))
        spans.append(again.select("ord", "lo", (F.col("lo") + F.octet_length("passage")).alias("hi")))
        passages = first.select("anchor", "e.ord", "e.lo", "passage")
        counts = passages.groupBy("anchor").agg(F.count("*").alias("n"))
    for part in few:
        passages = passages.union(part)
    return passages, spans


def _dealt_anew(seed: int):
    def run(batches):
        for b in flat.sliced(batches, 3):
            raw, off = flat.text_bytes(b.column(3))
            anchor, _, row, lo, size = anchors(raw, off, seed)
            old, ord_, at = (b.column(k).to_numpy()[row] for k in range(3))
            both = flat.mix(anchor + old.view(np.uint64) * flat.M3).view(np.int64)
            yield _passages(both, ord_, at + lo, flat.gather(raw, off[row] + lo, size), size)

    return run


PASSAGE = "anchor long, ord long, lo long, passage binary"


def _passages(anchor, ord_, lo, data: np.ndarray, size) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ord_), pa.array(lo), held], ["anchor", "ord", "lo", "passage"])


def join_spans(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["hi"])
        else:
            out.append([s["lo"], s["hi"]])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def find_repeats(ordered: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (doc_id, text, ord): texts with ord, a table (ord, doc_id, n_bytes, sha, copy) of all documents, and the spans of those that aren't copies."""
    texts = ordered.withColumn("text", F.coalesce("text", F.lit("")))
    facts = texts.select("ord", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    facts = materialise(facts)
    firsts = facts.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = materialise(facts.join(firsts, "sha").where(F.col("ord") != F.col("first")).select("ord"))
    n = copies.count()
    hint = maybe_broadcast(copies, 16, n)
    facts = facts.join(hint.withColumn("copy", F.lit(True)), "ord", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    own = texts.join(hint, "ord", "left_anti").where(F.octet_length("text") >= LENGTH).select("ord", "text")
    return texts, facts, repeated_spans(own)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """op9: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text).

    Equal texts are told by their digest: all but the first go whole, if they
    have LENGTH bytes, and take no further part. Null and empty texts keep
    nothing and lose nothing; rows of one doc_id are ordered by text, a null
    doc_id comes last; an empty table gives an empty result.
    """
    texts, facts, spans = find_repeats(ordered_texts(docs))
    n = spans.count()

    def removed(batches):
        for b in flat.sliced(batches, 1):
            out = []
            for ord_, text, found in zip(*[c.to_pylist() for c in b.columns]):
                raw, cuts = text.encode("utf-8"), join_spans(found)
                out.append((ord_, sum(z - a for a, z in cuts), len(cuts), hashlib.sha256(kept_bytes(raw, cuts)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["ord", "removed", "cuts", "left"])

    cut = texts.select("ord", "text").join(maybe_broadcast(spans, 200, n), "ord").mapInArrow(removed, "ord long, removed long, cuts long, left string")
    cut = materialise(cut)
    out = facts.join(maybe_broadcast(cut, 120, n), "ord", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    pick = lambda whole, part, none: F.when(F.col("copy"), whole).otherwise(F.coalesce(F.col(part), none))
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), "removed", F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), "cuts", F.lit(0)).cast("long").alias("n_spans"),
        pick(nothing, "left", F.col("sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeats cut out of text. Rows are told apart as in op9, so null and repeated ids are rows of their own.

    A cut may fall inside a character; what is left of it is dropped, since a
    column of strings holds whole characters. Rows stay, even with no text left.
    """
    ordered = ordered_rows(docs, "_ord")
    _, facts, spans = find_repeats(ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_ord").alias("ord")))
    whole = facts.where("copy").select("ord", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi"))).alias("spans"))
    spans = materialise(spans.select("ord", "spans").union(whole)).toDF("_ord", "_spans")
    names = docs.columns
    joined = ordered.join(maybe_broadcast(spans, 200), "_ord", "left").select(*names, "_spans")

    def run(batches):
        at = names.index("text")
        for b in flat.sliced(batches, at):
            text = [t if s is None or t is None else kept_bytes(t.encode("utf-8"), join_spans(s)).decode("utf-8", errors="ignore") for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            columns = [*b.columns[:at], pa.array(text, b.column(at).type), *b.columns[at + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)


#: The same in DuckDB, string by string: for tables whose strings it can list.
REPEATS_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n_bytes from documents),
s as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as held from (select doc_id, h, unnest(range(0, n_bytes - 99)) as i from d where n_bytes >= 100)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by held order by doc_id, i) as k from s) where k > 1),
f as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as new from r),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from f),
u as (select doc_id, min(i) as lo, max(i) + 100 as hi from g group by doc_id, run),
e as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since from u),
c as (select d.doc_id, any_value(d.h) as h, any_value(d.n_bytes) as n_bytes, coalesce(sum(hi - lo), 0)::bigint as n_removed, count(lo)::bigint as n_spans,
  coalesce(string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' order by lo), '') as kept, coalesce(max(hi), 0) as last from d left join e on d.doc_id = e.doc_id group by d.doc_id)
select doc_id, n_bytes::bigint as n_bytes, n_removed, n_spans, sha256(unhex(kept || substr(h, 2 * last + 1))) as kept_sha256 from c
"""
