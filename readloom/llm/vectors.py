"""Near duplicates of embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import materialise, maybe_broadcast

THRESHOLD = 0.93
#: Rows of a tile, at most in expectation; leading dimensions of the first product; bytes of the sample that the rotation is fitted on.
TILE, LEAD, SAMPLE_BYTES = 2048, 16, 8 << 20
#: Bounds are widened by this, far over what rounding can do to a product of unit vectors.
SLACK = 1e-9


def valid(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: principal directions of the unit vectors, the widest first. Any orthogonal matrix gives right results."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return np.ascontiguousarray(np.linalg.eigh(unit.T @ unit)[1][:, ::-1])


def links(a: np.ndarray, b: np.ndarray, turn: np.ndarray, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) with cosine >= threshold; of one tile with itself each pair once.

    The product over the leading dimensions plus the product of the norms of
    the rest bounds the cosine; the pairs that it leaves go on to the next
    dimensions, and the last are decided on the vectors themselves.
    """
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    ra, rb = (a / na[:, None]) @ turn, (b / nb[:, None]) @ turn
    rest = lambda r, k: np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", r[:, k:], r[:, k:])))
    k = min(LEAD, a.shape[1])
    got = ra[:, :k] @ rb[:, :k].T
    open_ = got + rest(ra, k)[:, None] * rest(rb, k)[None, :] >= threshold - SLACK
    if same:
        open_ &= np.tri(len(a), len(b), -1, dtype=bool).T
    i, j = np.nonzero(open_)
    part = got[i, j]
    while k < a.shape[1] and len(i):
        upto = min(2 * k, a.shape[1])
        more, step = np.empty(len(i)), 1 << 16
        for at in range(0, len(i), step):
            s = slice(at, at + step)
            more[s] = np.einsum("ij,ij->i", ra[i[s], k:upto], rb[j[s], k:upto])
        part, k = part + more, upto
        keep = part + rest(ra, k)[i] * rest(rb, k)[j] >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
    exact, step = np.zeros(len(i), bool), 1 << 16
    for at in range(0, len(i), step):
        s = slice(at, at + step)
        exact[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) / (na[i[s]] * nb[j[s]]) >= threshold
    return i[exact], j[exact]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each index's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[i], root[j])
        np.minimum.at(low, root[j], root[i])
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        while (low != (jump := low[low])).any():
            low = jump
        if (low == root).all():
            return root
        root = low


def tiles(classes: DataFrame, turns: dict[int, np.ndarray], threshold: float, tile: int) -> DataFrame:
    """classes (class_id, label, vector, n) gathered into tiles of about `tile` rows: key parts, a box of the leading dimensions, members.

    A tile lies in a square of the first two rotated dimensions, as wide as two
    linked unit vectors can differ in one; a full square is split by a hash.
    """
    width = float(np.sqrt(2 - 2 * threshold)) + SLACK
    lead = min(LEAD, min(turns, default=LEAD))
    schema = "class_id long, n long, label string, dim int, c1 int, c2 int, lead array<double>, vector binary"

    def place(batches):
        for b in batches:
            vectors = b.column(2)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()
            size = np.diff(ends)
            dims, head = size.astype(np.int32), np.zeros((b.num_rows, max(2, lead)))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.stack([flat[ends[r] - ends[0] : ends[r + 1] - ends[0]] for r in at])
                r = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turns[int(d)]
                head[at, : min(r.shape[1], head.shape[1])] = r[:, : head.shape[1]]
            cell = np.floor(head[:, :2] / width).astype(np.int32)
            raw = [flat[ends[r] - ends[0] : ends[r + 1] - ends[0]].tobytes() for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), b.column(1), pa.array(dims), pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(list(head[:, :lead]), pa.list_(pa.float64())), pa.array(raw, pa.binary())],
                ["class_id", "n", "label", "dim", "c1", "c2", "lead", "vector"],
            )

    placed = materialise(classes.select("class_id", F.col("label").cast("string").alias("label"), "vector", "n").mapInArrow(place, schema))
    square = ["label", "dim", "c1", "c2"]
    counts = placed.groupBy(*square).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    dealt = placed.join(maybe_broadcast(counts, 64), square).withColumn("sub", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    box = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(lead) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    grouped = dealt.groupBy(*square, "sub").agg(F.sort_array(F.collect_list(F.struct("class_id", "n", "vector"))).alias("members"), *box)
    return materialise(grouped.withColumn("tile", F.concat_ws("/", F.to_json(F.array("label")), "dim", "c1", "c2", "sub")))


def tile_pairs(tiled: DataFrame, threshold: float) -> DataFrame:
    """a, b: tiles of one label and length in the same or touching squares whose boxes come near enough. Tiles, not rows, are paired."""
    lead = sum(c.startswith("lo") for c in tiled.columns)
    meta = tiled.drop("members")
    near = meta.withColumn("d1", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("d2", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.select("label", "dim", (F.col("c1") + F.col("d1")).alias("c1"), (F.col("c2") + F.col("d2")).alias("c2"), F.col("tile").alias("a"), *[F.col(f"{s}{k}").alias(f"a_{s}{k}") for k in range(lead) for s in ("lo", "hi")])
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"hi{k}"))
    far = sum((gap(k) * gap(k) for k in range(lead)), F.lit(0.0))
    return near.join(meta, ["label", "dim", "c1", "c2"]).where((F.col("a") <= F.col("tile")) & (far <= 2 - 2 * threshold + SLACK)).select("a", F.col("tile").alias("b"), "dim")


def compared(tiled: DataFrame, turns: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """class_id, links, root: from each pair of tiles one row a linked class, its linked vectors and the least class it hangs together with."""
    members = tiled.select("tile", "members")
    pairs = tile_pairs(tiled, threshold).join(members.select(F.col("tile").alias("a"), F.col("members").alias("ma")), "a")
    pairs = pairs.join(members.select(F.col("tile").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "dim", "ma", "mb")

    def unpack(items: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = items.field("vector")
        return items.field("class_id").to_numpy(), items.field("n").to_numpy(), np.frombuffer(b"".join(data.to_pylist()), np.float64).reshape(-1, dim)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                dim, same = batch.column(2)[k].as_py(), batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                ia, wa, a = unpack(batch.column(3)[k].values, dim)
                ib, wb, b = unpack(batch.column(4)[k].values, dim)
                i, j = links(a, b, turns[dim], same, threshold)
                if not len(i):
                    continue
                ids, place = np.unique(np.concatenate([ia[i], ib[j]]), return_inverse=True)
                weight = np.concatenate([wb[j], wa[i]])
                count = np.bincount(place, weight, len(ids)).astype(np.int64)
                root = ids[roots(len(ids), place[: len(i)], place[len(i) :])]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(root)], ["class_id", "links", "root"])

    n = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(pairs.repartition(n, "a", "b").mapInArrow(run, "class_id long, links long, root long"))


def vector_links(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows (vec_id, embedding, label).

    Equal vectors of a label form a class; classes are compared, and a link
    between two counts for each of their vectors. Vectors of different length
    or label, with a null label, null, zero, or with null or non-finite
    components link with nothing. Repeated ids are separate vectors, each with
    its own links; a component is named by its least id. Null ids come back as they are, linked with nothing. An empty table
    gives an empty result.
    """
    base = rows.select("vec_id", "label", F.col("embedding").alias("vector"))
    good = base.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & valid(F.col("vector")))
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("class_id", F.monotonically_increasing_id()))  # repeated ids may be the least of several classes
    turns: dict[int, np.ndarray] = {}
    for row in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*")).collect():  # one row a length of vectors
        d = row["d"]
        sample = classes.where(F.size("vector") == d).orderBy(F.xxhash64("least"), "least", "vector").limit(max(d, SAMPLE_BYTES // (8 * d))).select("vector").toArrow()["vector"].combine_chunks()
        turns[d] = rotation(sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
    found = compared(tiles(classes, turns, threshold, tile), turns, threshold)
    totals = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    classes = classes.join(totals, "class_id", "left").join(parts.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    classes = classes.withColumn("component", F.coalesce("component", "class_id"))
    roots = classes.groupBy("component").agg(F.min("least").alias("root"), F.count("*").alias("several")).where("several > 1").drop("several")
    classes = classes.join(roots, "component", "left")
    known = materialise(classes.select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "least").alias("component")))
    known = known.select(F.col("label").alias("k_label"), F.col("vector").alias("k_vector"), "links", "component")
    keyed = base.withColumn("ok", F.col("vec_id").isNotNull() & valid(F.col("vector")))
    out = keyed.join(known, F.col("ok") & (F.col("label") == F.col("k_label")) & (F.col("vector") == F.col("k_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: The same in DuckDB, by all pairs of a label: for tables small enough for that.
LINKS_SQL = r"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id < y.vec_id and len(x.v) = len(y.v)
  where list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.93),
e as (select a, b from l union all select b, a from l),
n as (select a as vec_id, count(*) as n_links from e group by a),
reach as (select a as vec_id, a as node from e union select r.vec_id, e.b from reach r join e on e.a = r.node),
c as (select vec_id, min(node) as component_id from reach group by vec_id)
select m.vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, m.vec_id) as component_id, coalesce(component_id, m.vec_id) = m.vec_id as kept
from embeddings m left join n on n.vec_id = m.vec_id left join c on c.vec_id = m.vec_id
"""
