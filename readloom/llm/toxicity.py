"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .runtime import Shared, materialise, remove, shared_dir

#: Slots for hashed terms.
SLOT_BITS = 20
#: Lengths in bytes of the word prefixes that are terms beside whole words: inflected insults share a stem.
PREFIXES = (4, 5, 6)
#: Bounds of the fit: labelled rows taken (in order of the md5 of their id) and terms kept.
LABELLED_ROWS, TERMS = 40_000, 16_384
#: Least likelihood ratio of a kept term, and least number of labelled texts that hold it. A term of a share COMMON of the
#: toxic texts may matter only together with another: it is kept, too, if its ratio among the texts of another such term is
#: large for the best of so many.
LEAST_G2, LEAST_TEXTS, COMMON = 12.0, 2, 0.05
#: Texts, and pairs of terms, that are looked at at once.
TEXTS, PAIRS = 1024, 1 << 20
FACTORS, EPOCHS, BATCH, RATE, DECAY = 6, 30, 512, 0.02, 2e-4
THRESHOLD = 0.3
#: Words end at any ASCII character but letters and digits.
BREAK = np.zeros(256, bool)
BREAK[:128] = [not chr(c).isalnum() for c in range(128)]


def term_slots(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of every term of every text: each word, lower-cased A-Z, and its longer prefixes."""
    raw = flat.LOWER[raw]
    starts, ends, row = flat.word_spans(np.where(BREAK[raw], np.uint8(32), raw), off)
    shift = np.uint64(64 - SLOT_BITS)
    salts = np.array(PREFIXES, np.uint64) * flat.M3
    slots, rows = [flat.word_hashes(raw, starts, ends) >> shift], [row]
    for n, salt in zip(PREFIXES, salts):
        has = ends - starts > n
        slots.append(flat.mix(flat.word_hashes(raw, starts[has], starts[has] + n) + salt) >> shift)
        rows.append(row[has])
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows)


def distinct_terms(slots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows << SLOT_BITS) | slots)
    return key & ((1 << SLOT_BITS) - 1), key >> SLOT_BITS


class FactorizationMachine:
    """score = sigmoid(b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the distinct known terms of a text."""

    def __init__(self, slots: np.ndarray, factors: int = FACTORS):
        rng = np.random.default_rng(0)
        self.index = np.full(1 << SLOT_BITS, -1, np.int32)
        self.index[slots] = np.arange(len(slots), dtype=np.int32)
        self.b, self.w = 0.0, np.zeros(len(slots))
        self.v = rng.normal(0, 0.05, (len(slots), factors))

    def raw_score(self, term: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins of n texts and their factor sums."""
        sums = np.stack([np.bincount(row, self.v[term, f], n) for f in range(self.v.shape[1])], 1) if len(self.w) else np.zeros((n, self.v.shape[1]))
        square = np.bincount(row, (self.v[term] ** 2).sum(1), n)
        return self.b + np.bincount(row, self.w[term], n) + 0.5 * ((sums**2).sum(1) - square), sums

    def fit(self, term: np.ndarray, row: np.ndarray, y: np.ndarray) -> FactorizationMachine:
        """Adam over batches of texts, row ascending; the same rows give the same model."""
        rng = np.random.default_rng(1)
        n = len(y)
        rate = min(max(y.mean(), 1e-6), 1 - 1e-6) if n else 1e-6
        self.b = float(np.log(rate / (1 - rate)))
        if not n or not len(self.w):
            return self
        start = np.searchsorted(row, np.arange(n + 1))
        state = [np.zeros_like(x) for x in (self.w, self.w, self.v, self.v)]
        mb = vb = 0.0
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                pick = order[at : at + BATCH]
                size = start[pick + 1] - start[pick]
                t = term[np.repeat(start[pick], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                r = np.repeat(np.arange(len(pick)), size)
                z, sums = self.raw_score(t, r, len(pick))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                gw = np.bincount(t, g[r], len(self.w)) + DECAY * self.w
                gv = np.stack([np.bincount(t, g[r] * (sums[r, f] - self.v[t, f]), len(self.w)) for f in range(self.v.shape[1])], 1) + DECAY * self.v
                gb = float(g.sum())
                step += 1
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                c1, c2 = 1 - 0.9**step, 1 - 0.999**step
                self.b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
                for x, gx, k in ((self.w, gw, 0), (self.v, gv, 2)):
                    state[k] = 0.9 * state[k] + 0.1 * gx
                    state[k + 1] = 0.999 * state[k + 1] + 0.001 * gx * gx
                    x -= RATE * (state[k] / c1) / (np.sqrt(state[k + 1] / c2) + 1e-8)
        return self

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        slots, rows = term_slots(raw, off)
        known = self.index[slots] >= 0
        slots, rows = distinct_terms(slots[known], rows[known])
        z, _ = self.raw_score(self.index[slots], rows, n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def likelihood_ratio(t: np.ndarray, c: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """G2 of terms that t of n1 toxic and c of n0 clean texts hold."""
    n = np.maximum(n1 + n0, 1)
    share = (t + c) / n

    def cell(count, expected):
        return np.where(count > 0, count * np.log(np.maximum(count, 1) / np.where(count > 0, expected, 1)), 0)

    return 2 * (cell(t, share * n1) + cell(c, share * n0) + cell(n1 - t, (1 - share) * n1) + cell(n0 - c, (1 - share) * n0))


def together(term: np.ndarray, row: np.ndarray, y: np.ndarray, common: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Of each asked term the largest likelihood ratio among the texts of one of the common terms; 0 of others. row ascends."""
    best = np.zeros(len(common))
    place = np.cumsum(common) - 1
    has = common[term]
    at, row = place[term[has]], row[has]
    n = int(common.sum())
    ask, where = np.flatnonzero(asked[common]), np.flatnonzero(asked & common)
    width = max(1, PAIRS // max(n, 1))
    cuts = np.searchsorted(row, np.arange(0, len(y) + TEXTS, TEXTS))
    whole = np.stack([np.bincount(at[y[row] == k], minlength=n) for k in (0, 1)])
    for a in range(0, len(ask), width):
        both = np.zeros((2, n, len(ask[a : a + width])), np.float32)  # whole numbers far below 2^24
        for i, (first, last) in enumerate(zip(cuts, cuts[1:])):
            held = np.zeros((min(TEXTS, len(y) - i * TEXTS), n), np.float32)
            held[row[first:last] - i * TEXTS, at[first:last]] = 1
            label = y[i * TEXTS : i * TEXTS + len(held)]
            for k in (0, 1):
                mine = held[label == k]
                both[k] += mine.T @ mine[:, ask[a : a + width]]
        best[where[a : a + width]] = likelihood_ratio(both[1].astype(float), both[0].astype(float), whole[1][:, None], whole[0][:, None]).max(0)
    return best


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, terms: int = TERMS) -> FactorizationMachine:
    """Fit on at most `rows` labelled texts; labels is (doc_id, toxic), without the rows to hold out.

    The labelled rows are taken in order of the md5 of their id, so the sample
    is the same in every run. Of a repeated id or text each row counts. Rows
    whose label is null are left out; without rows the score is near 0.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` rows of 12 bytes

    def slots(batches):
        for b in flat.sliced(batches, 1):
            got, row = distinct_terms(*term_slots(*flat.text_bytes(b.column(1))))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(got.astype(np.int32)))], ["doc_id", "toxic", "slots"])

    def counts(batches):
        both = np.zeros((2, 1 << SLOT_BITS), np.int64)
        for b in batches:
            each = b.column(1)
            got = each.flatten().to_numpy(zero_copy_only=False)
            label = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(each.offsets.to_numpy()))
            for k in (0, 1):
                both[k] += np.bincount(got[label == k], minlength=1 << SLOT_BITS)
        at = np.flatnonzero(both[1] > 0)  # a term of no toxic text says nothing here
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0, at]), pa.array(both[1, at])], ["slot", "clean", "toxic"])

    path = shared_dir(spark)
    seen = materialise(texts.mapInArrow(slots, "doc_id long, toxic int, slots array<int>"), path)
    totals = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    n = n0 + n1
    tally = seen.select("toxic", "slots").mapInArrow(counts, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))

    def cell(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(F.lit(0.0))

    share = (F.col("c") + F.col("t")) / F.lit(float(max(n, 1)))
    g2 = 2 * (cell(F.col("t"), share * n1) + cell(F.col("c"), share * n0) + cell(n1 - F.col("t"), (1 - share) * n1) + cell(n0 - F.col("c"), (1 - share) * n0))
    common = F.col("t") >= F.lit(COMMON * n1)
    good = tally.withColumn("g2", g2).where(((F.col("g2") >= LEAST_G2) | common) & (F.col("t") + F.col("c") >= LEAST_TEXTS)).orderBy(F.desc(common), F.desc("g2"), "slot").limit(terms)
    found = sorted((r["slot"], r["strong"], r["common"]) for r in good.select("slot", (F.col("g2") >= LEAST_G2).alias("strong"), common.alias("common")).collect())
    kept_slots, strong, often = (np.array([x[k] for x in found], kind) for k, kind in enumerate((np.int64, bool, bool)))
    index = spark.sparkContext.broadcast(FactorizationMachine(kept_slots).index)

    def known(batches):
        for b in batches:
            each = b.column(2)
            got, size = index.value[each.flatten().to_numpy(zero_copy_only=False)], np.diff(each.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)[got >= 0]
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(got[got >= 0]))], ["doc_id", "toxic", "terms"])

    sample = seen.mapInArrow(known, "doc_id long, toxic int, terms array<int>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    each = sample["terms"].combine_chunks()
    term = each.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(each)), each.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    y = sample["toxic"].to_numpy().astype(float)
    kept = strong | (together(term, row, y, often, ~strong) >= LEAST_G2 + 2 * np.log(max(int(often.sum()), 1)))
    has = kept[term]
    model = FactorizationMachine(kept_slots[kept]).fit((np.cumsum(kept) - 1)[term[has]], row[has], y)
    index.unpersist()
    remove(spark, path)
    return model


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """docs with a column toxicity, 0 to 1, of each whole text; null and empty texts get the score of no terms."""
    sent = Shared(docs.sparkSession, model)  # bounded by SLOT_BITS and TERMS
    names = docs.columns

    def run(batches):
        at, model_ = names.index("text"), sent.value
        for b in flat.sliced(batches, at):
            got = model_.scores(*flat.text_bytes(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*names, "toxicity"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("toxicity", DoubleType()))


def held_out(col: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score stays below the threshold, by a model of the same labels as the query's."""
    model = fit(docs, labels.select("doc_id", "toxic").where(~held_out()))
    return score(docs, model).where(F.col("toxicity") < threshold).drop("toxicity")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op8: a score for every text, learned without the held-out rows' labels."""
    model = fit(docs, labels.select("doc_id", "toxic").where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
