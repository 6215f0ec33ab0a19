"""Near duplicates by bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import flat
from .components import connected_components
from .runtime import materialise, maybe_broadcast, remove, shared_dir

#: Words of a shingle; a link needs PERCENT of the union shared.
SHINGLE, PERCENT = 5, 75
#: Values of a sketch. Its least LISTED enter the inverted lists, or two over a quarter of the set if that is less.
#: Linked sets of up to 4 * LISTED values always have two of these in common; larger ones at the threshold have
#: none with probability 1e-12, and one at most with 6e-11; more alike ones with less.
SKETCH, LISTED = 256, 20
#: Longer lists whose rows aren't one component, of passages that many texts share, give way to lists of two such values at once.
HOT = 200
#: Standard errors under the threshold at which the union sketch's estimate still lets a pair go on to the exact check.
ERRORS = 6.0
#: Rows of a list compared at once, and first bound on the partners of a row in another component in a round; rounds raise it until none is cut.
BLOCK, PARTNERS = 4096, 2
#: A pair is taken in the lists of its least common values, so many of them: one would do, but sketches hold halves of the values.
LEAST_COMMON = 3


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, lower-cased A-Z."""
    raw = flat.LOWER[raw]
    starts, ends, row = flat.word_spans(raw, off)
    values, rows = flat.shingle_hashes(flat.word_hashes(raw, starts, ends), row, len(off) - 1, size)
    if len(rows) and (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        values, rows = values[order], rows[order]
    cut = np.searchsorted(rows, np.arange(len(off)))
    for a, b in zip(cut[:-1], cut[1:]):
        v = np.sort(values[a:b])
        yield v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (a hash of the whole set), listed and sketch of each text.

    listed holds the LISTED least values, sketch the set's size and the upper halves of the SKETCH least.
    """

    def run(batches):
        for b in flat.sliced(batches, 1):
            n, h1, h2, listed, sketch = [], [], [], [], []
            for s in shingle_sets(*flat.text_bytes(b.column(1))):
                n.append(len(s))
                h1.append(flat.mix(s).sum(dtype=np.uint64).astype(np.int64))
                h2.append(flat.mix(s ^ flat.M1).sum(dtype=np.uint64).astype(np.int64))
                listed.append(s[: min(LISTED, len(s) // 4 + 2)].tobytes())
                sketch.append(np.concatenate([[min(len(s), 2**32 - 1)], s[:SKETCH] >> np.uint64(32)]).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(listed, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "listed", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, listed binary, sketch binary")


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the union sketch that both rows of a and b hold; short sketches are padded with the greatest value."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    top = np.iinfo(both.dtype).max
    real = both != top
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(real & ~again, 1)  # of each value among the distinct ones
    inside = real & (rank <= a.shape[1])
    union = np.minimum(rank[:, -1], a.shape[1])
    return (inside & again).sum(1) / np.maximum(union, 1)


def unpack(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values of each sketch, padded at the end, and the size of each set."""
    out = np.full((len(sketches), SKETCH), np.iinfo(np.uint32).max, np.uint32)
    size = np.zeros(len(sketches))
    for i, s in enumerate(sketches):
        v = np.frombuffer(s, np.uint32)
        size[i] = v[0]
        out[i, : len(v) - 1] = v[1:]
    return out, size


def least_estimate(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Least estimate of pairs of sets of these sizes that may be linked; over 1 where the sizes alone rule a link out.

    At the threshold the union has (na + nb) / (1 + PERCENT / 100) values, of
    which the union sketch is a sample without replacement: if it holds all,
    the estimate is exact.
    """
    t = PERCENT / 100
    share = np.minimum(1.0, SKETCH * (1 + t) / np.maximum(na + nb, 1))
    least = np.where(share < 1, t - 0.01 - ERRORS * np.sqrt(t * (1 - t) / SKETCH * (1 - share)), t - 1e-9)
    return np.where(np.minimum(na, nb) >= t * np.maximum(na, nb), least, 2.0)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values that each row of a and each row of b have in common: common values by products of slices, rarer ones pair by pair."""
    values, place = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    pa_, pb = place[: a.size], place[a.size :]
    ca, cb = np.bincount(pa_, minlength=len(values)), np.bincount(pb, minlength=len(values))
    use = (ca > 0) & (cb > 0) & (values != np.iinfo(a.dtype).max)
    often = use & (ca * cb > 256)
    row_a, row_b = np.repeat(np.arange(len(a)), a.shape[1]), np.repeat(np.arange(len(b)), b.shape[1])
    out, step, n = np.zeros((len(a), len(b)), np.float32), 1024, int(often.sum())
    column = np.where(often, np.cumsum(often) - 1, -1)
    for at in range(0, n, step):
        part = []
        for p, row, size in ((column[pa_], row_a, len(a)), (column[pb], row_b, len(b))):
            hit = (p >= at) & (p < at + step)
            m = np.zeros((size, min(step, n - at)), np.float32)
            m[row[hit], p[hit] - at] = 1
            part.append(m)
        out += part[0] @ part[1].T
    rare = use & ~often
    x, y = np.flatnonzero(rare[pa_]), np.flatnonzero(rare[pb])
    y = y[np.argsort(pb[y], kind="stable")]
    first = np.searchsorted(pb[y], pa_[x])
    size = cb[pa_[x]]
    i, j = np.repeat(row_a[x], size), row_b[flat.gather(y, first, size)]
    out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    return out


def common_rank(a: np.ndarray, b: np.ndarray, value: np.uint32) -> np.ndarray:
    """How many values less than this one each row of a and the row of b beside it have in common."""
    both = np.sort(np.concatenate([a, b], 1), 1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < value)).sum(1)


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, linked of pairs (a, b), decided on the full sets, which are made anew from the whole texts of the pairs alone."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def sets(batches):
        for b in flat.sliced(batches, 1):
            got = [s.tobytes() for s in shingle_sets(*flat.text_bytes(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(ids, 16), "doc_id", "left_semi")
    full = materialise(texts.mapInArrow(sets, "id long, items binary"))
    left, right = full.select(F.col("id").alias("a"), F.col("items").alias("x")), full.select(F.col("id").alias("b"), F.col("items").alias("y"))

    def check(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3)):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                few, many = sorted((len(u), len(v)))
                ok = 100 * few >= PERCENT * many
                if ok:
                    common = len(u) + len(v) - len(np.union1d(u, v))
                    ok = 100 * common >= PERCENT * (len(u) + len(v) - common)
                linked.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return materialise(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long, linked boolean"))


def star_candidates(lists: DataFrame, sketches: DataFrame) -> DataFrame:
    """a < b: each row of an inverted list (value, id, c) with two rows of the list, if their sketches are alike enough: that of the least id, and that whose own lists are the longest.

    Of near copies the latter is the one that has most in common with all.
    """
    weight = lists.groupBy("id").agg(F.sum("c").alias("weight"))
    head = lists.join(weight, "id").groupBy("value").agg(F.min("id").alias("x"), F.max_by("id", F.struct("weight", -F.col("id"))).alias("y"))
    pairs = lists.join(head, "value").select("id", F.explode(F.array_distinct(F.array("x", "y"))).alias("with")).where(F.col("id") != F.col("with"))
    pairs = pairs.select(F.least("id", "with").alias("a"), F.greatest("id", "with").alias("b")).distinct()
    x, y = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                (u, nu), (v, nv) = unpack(b.column(2).to_pylist()), unpack(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(estimates(u, v) >= least_estimate(nu, nv)))

    return materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def open_lists(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows (value, v1, v2, id, component, c) of lists (value, v1, v2, id) whose rows aren't all in one of the components parts."""
    return mixed_lists(lists.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")))


def mixed_lists(named: DataFrame) -> DataFrame:
    """The rows of the lists (value, v1, v2, id, component) that hold several components, with c, the rows of the list."""
    mixed = named.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where(F.col("lo") != F.col("hi"))
    return named.join(mixed.select("value", "c"), "value").select("value", "v1", "v2", "id", "component", "c")


def hot_pairs(rows: DataFrame) -> DataFrame:
    """value, v1, v2, id, component: lists of two values at once, of the lists in rows (value, id, component)."""
    common = rows.groupBy("id", "component").agg(F.sort_array(F.collect_set("value")).alias("v")).where(F.size("v") > 1)
    two = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, LISTED), lambda y: F.struct(F.xxhash64(x, y).alias("value"), x.alias("v1"), y.alias("v2")))))
    return common.select(F.explode(two).alias("p"), "id", "component").select("p.value", "p.v1", "p.v2", "id", "component")


def block_candidates(rows: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """value, a, b, cut: for rows of open lists their best `most` partners in each other component; cut tells that a row had more.

    A list longer than BLOCK is dealt over blocks, and each pair of blocks is a group of its own.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    r = rows.withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    r = r.join(sketches, "id")
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    r = r.select("value", "v1", "v2", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "id", "component", "sketch")

    def compare(group: pa.Table) -> pa.Table:
        ids, comp = group["id"].to_numpy(), group["component"].to_numpy()
        value, i, j = (group[c][0].as_py() for c in ("value", "i", "j"))
        keys = [np.uint32((v % (1 << 64)) >> 32) for c in ("v1", "v2") if (v := group[c][0].as_py()) is not None]
        second = group["second"].to_numpy(zero_copy_only=False)
        s, n = unpack(group["sketch"].to_pylist())
        order = np.argsort(n, kind="stable")  # only sets of about one size may be linked
        ids, comp, second, s, n = ids[order], comp[order], second[order], s[order], n[order]
        # rows of the commonest component aren't compared with one another
        names, held = np.unique(comp, return_counts=True)
        rest = comp != names[np.argmax(held)]
        every = np.arange(len(ids))
        if i == j:
            sides = [(every[rest], every)]
        else:
            sides = [(every[~second & rest], every[second]), (every[~second & ~rest], every[second & rest])]
        found: list[tuple[np.ndarray, ...]] = []
        size = (s != np.iinfo(np.uint32).max).sum(1)
        listed = np.minimum(LISTED, n.astype(np.int64) // 4 + 2)
        short = np.where(np.arange(LISTED) < listed[:, None], s[:, :LISTED], np.arange(LISTED, dtype=np.uint32) - np.uint32(LISTED) - (every * LISTED).astype(np.uint32)[:, None])
        for x, all_y in sides:
            for at in range(0, len(x), 256):
                xs = x[at : at + 256]
                y = all_y[np.searchsorted(n[all_y], PERCENT / 100 * n[xs[0]] - 1e-9) : np.searchsorted(n[all_y], n[xs[-1]] * 100 / PERCENT + 1e-9, side="right")]
                if not len(y):
                    continue
                common = shared(s[xs], s[y])
                na, nb = n[xs][:, None], n[y][None, :]
                least = least_estimate(na, nb) * np.maximum(size[xs][:, None], size[y][None, :])  # the union sketch is as large as either
                whole = SKETCH * (100 + PERCENT) >= 100 * (na + nb)  # both sets are held whole
                least = np.where(whole & (least <= SKETCH), PERCENT * (na + nb) / (100 + PERCENT) - 1e-6, least)
                p, q = np.nonzero((common >= least) & (comp[xs][:, None] != comp[y][None, :]))
                if i == j:
                    once = ~rest[y[q]] | (ids[xs[p]] < ids[y[q]])
                    p, q = p[once], q[once]
                for k in range(0, len(p), 1 << 14):
                    a, b = xs[p[k : k + (1 << 14)]], y[q[k : k + (1 << 14)]]
                    ok = np.ones(len(a), bool)
                    for key in keys:
                        ok &= common_rank(short[a], short[b], key) < LEAST_COMMON
                    a, b = a[ok], b[ok]
                    e = estimates(s[a], s[b])
                    ok = e >= least_estimate(n[a], n[b])
                    found.append((a[ok], b[ok], e[ok]))
        if not found or not sum(len(f[0]) for f in found):
            return pa.table({"value": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cut": pa.array([], pa.bool_())})
        a, b, e = map(np.concatenate, zip(*found))
        keep = np.zeros(len(a), bool)
        for side, far in ((a, b), (b, a)):
            order = np.lexsort((-e, comp[far], side))
            new = np.concatenate([[True], (side[order][1:] != side[order][:-1]) | (comp[far][order][1:] != comp[far][order][:-1])])
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            keep[order[rank < most]] = True
        lo, hi = np.minimum(ids[a], ids[b])[keep], np.maximum(ids[a], ids[b])[keep]
        return pa.table({"value": np.full(len(lo), value), "a": lo, "b": hi, "cut": np.full(len(lo), not keep.all())})

    return materialise(r.groupBy("value", "i", "j").applyInArrow(compare, "value long, a long, b long, cut boolean"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Texts of one shingle set form a class, so that copies never make pairs.
    Inverted lists of the classes' least values give candidates: first each
    row with two heads of its list, then, in lists that are not yet one
    component, rows of different components, the best first and more in each
    round until none is left out. Sketches filter them, full sets decide.
    So a group of near copies of any size costs a few pairs a row, and no link
    between components is passed over.

    Null and empty texts have an empty set and link with nothing; rows of one
    doc_id are one node; a null doc_id links with nothing; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    signed_path = shared_dir(spark)
    signed = materialise(signatures(docs), signed_path)
    key = ["n_shingles", "h1", "h2"]
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    heads = full.groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    head = F.col("doc_id") == F.col("class_id")
    placed = materialise(full.join(heads, key).select("doc_id", "n_shingles", "class_id", F.when(head, F.col("listed")).alias("listed"), F.when(head, F.col("sketch")).alias("sketch")))
    bare = materialise(signed.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles"))
    remove(spark, signed_path)
    sketches = placed.where("sketch is not null").select(F.col("class_id").alias("id"), "sketch")
    lists = inverted_lists(placed.where("sketch is not null").select(F.col("class_id").alias("id"), "listed"))
    tested = verify(docs, star_candidates(lists, sketches))
    parts = materialise(connected_components(tested.where("linked")))
    rows = materialise(open_lists(lists.select("value", F.col("value").alias("v1"), F.lit(None).cast("long").alias("v2"), "id"), parts))
    hot = F.col("c") > HOT
    pairs = materialise(hot_pairs(rows.where(hot)))
    todo = materialise(rows.where(~hot).union(mixed_lists(pairs)))
    most = PARTNERS
    while todo.limit(1).count():
        found = block_candidates(todo, sketches, most)
        fresh = materialise(found.select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        if fresh.limit(1).count():
            tested = materialise(tested.union(verify(docs, fresh)))
            parts = materialise(connected_components(tested.where("linked")))
        cut = found.where("cut").select("value").distinct()  # these lists alone may have more
        todo = materialise(open_lists(todo.select("value", "v1", "v2", "id").join(cut, "value"), parts))
        most *= 16
    n = parts.count()
    out = placed.drop("listed", "sketch").join(maybe_broadcast(parts.select(F.col("node").alias("class_id"), "component"), 24, n), "class_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    out = out.union(bare.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates of an earlier one; of rows of one doc_id the first by text stays. Rows without doc_id stay."""
    gone = materialise(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    kept = docs.join(maybe_broadcast(gone, 16), "doc_id", "left_anti")
    twice = materialise(kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    n = twice.count()
    if not n:
        return kept
    again = kept.join(maybe_broadcast(twice, 16, n), "doc_id", "left_semi").withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("_r = 1").drop("_r")
    return kept.join(maybe_broadcast(twice, 16, n), "doc_id", "left_anti").unionByName(again)


def inverted_lists(listed: DataFrame) -> DataFrame:
    """value, id, c: the lists of all values of (id, listed) that more than one row has, c rows."""

    def run(batches):
        for b in batches:
            got = [np.frombuffer(s, np.int64) for s in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(g) for g in got])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else np.zeros(0, np.int64)), pa.array(ids)], ["value", "id"])

    every = materialise(listed.select("id", "listed").mapInArrow(run, "value long, id long"))
    counts = every.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    return materialise(every.join(counts, "value").select("value", "id", "c"))


#: The same in DuckDB, by all shared shingles: for tables small enough for that.
NEAR_SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from t),
n as (select doc_id, count(*) as size from s group by doc_id),
k as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select k.a, k.b from k join n x on x.doc_id = k.a join n y on y.doc_id = k.b where 100 * shared >= 75 * (x.size + y.size - shared)),
e as (select a, b from l union all select b, a from l),
reach as (select a as doc_id, a as node from e union select r.doc_id, e.b from reach r join e on e.a = r.node),
c as (select doc_id, min(node) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.size, 0)::bigint as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""
