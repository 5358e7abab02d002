"""Embedding near-dedup by a pivot-permutation index.

A bounded sample of vectors serves as pivots.  Every vector is described by its ``nearest`` closest pivots in
order of distance.  Inverted lists are kept by pivot: a vector is stored in the list of its closest pivot (its
home) and looks up the lists of all pivots in its description.  A stored vector and one that looks it up are
candidates if they share at least ``shared`` pivots and these stand at similar ranks: the displacement, summed
over the stored one's pivots, with ``nearest`` for one that the other lacks, is at most ``displaced`` times
``nearest`` squared.  Candidates are then verified by their cosine.

1. Only ids and descriptions go to the lists.  What comes back is, for each list, the vectors that have any
   candidate in it, not the pairs.
2. Only those fetch their vectors; a list is verified by matrix products.

A pair that meets in two lists counts in one of them, which both descriptions tell, so nothing is
deduplicated afterwards.  Long lists are cut into blocks, and pairs of blocks are spread over tasks; what
leaves a comparison is one row a vector with its number of links and the least vector it is linked with
there, not the pairs.  Lists are never capped.  Exact copies collapse first and count with their multiplicity.

There are four times as many pivots as the square root of the number of vectors, so that all lists together
grow by the power 1.5 up to MOST_PIVOTS, and with the square of the number beyond, some four million vectors.  Lists by
pairs of pivots (``levels`` 2) are shorter but find other pairs, so that is the caller's choice and never the
input's size.  Vectors of different lengths never meet; each length has its pivots, and one with
at most a block of vectors a single list.

The pivots are fitted on a bounded sample chosen by a hash of the vector (MOST_PIVOTS x FOUND vectors of a
length at most); every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lexaudit.llm._util import small_batches, written
from lexaudit.llm.graph import components

#: Pivots in a description, and what candidates have in common.
NEAREST, SHARED, DISPLACED = 8, 3, 0.75
#: Vectors in a block; of one length, so many need no pivots.
BLOCK = 1024
#: Pivots at least and at most; between, four times the square root of the number of vectors.  Pivots are
#: picked from at most FOUND times as many vectors.
LEAST_PIVOTS, MOST_PIVOTS, FOUND = 512, 8192, 4


def pivots_for(n: int) -> int:
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, int(4 * n**0.5)))


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of x far from one another: each next one is the farthest from those chosen."""
    if not len(x):
        return x
    chosen = [0]
    best = x @ x[0]
    while len(chosen) < min(n, len(x)):
        i = int(best.argmin())
        if best[i] > 1 - 1e-9:
            break
        chosen.append(i)
        best = np.maximum(best, x @ x[i])
    return x[chosen]


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def descriptions(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each unit vector, nearest first."""
    k = min(nearest, len(pivots))
    sim = x @ pivots.T
    part = np.sort(np.argpartition(-sim, k - 1, axis=1)[:, :k], axis=1)
    order = np.argsort(-np.take_along_axis(sim, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1).astype(np.uint16)


def list_names(d: np.ndarray, levels: int) -> np.ndarray:
    """Names of the lists that each description looks up; the first is its home."""
    d = d.astype(np.int64)
    if d.shape[1] < 3:  # too few pivots to tell vectors apart: one list
        return np.full((len(d), 1), -1, np.int64)
    if levels == 1:
        return d
    pair = [(np.minimum(d[:, i], d[:, j]) << 16) | np.maximum(d[:, i], d[:, j]) for i, j in combinations(range(d.shape[1]), 2)]
    return np.stack(pair, axis=1)


def similar(a: np.ndarray, b: np.ndarray, shared: int, displaced: float) -> np.ndarray:
    """Whether descriptions a[i] and b[j] share enough pivots at similar enough ranks."""
    k = a.shape[1]
    if k < 3:
        return np.ones((len(a), len(b)), bool)
    count = np.zeros((len(a), len(b)), np.uint8)
    apart = np.full((len(a), len(b)), k * k, np.int16)
    for i in range(k):
        for j in range(k):
            same = a[:, i, None] == b[None, :, j]
            count += same
            apart -= same * np.int16(k - abs(i - j))
    return (count >= min(shared, k)) & (apart <= displaced * k * k)


def here(stored: np.ndarray, looking: np.ndarray, ks: np.ndarray, kl: np.ndarray, levels: int) -> np.ndarray:
    """Whether pairs that meet in the home list of ``stored`` count there: row by row of descriptions and numbers.

    Of one home, the smaller number is the stored one.  Of two homes, each of which the other looks up, the
    pair counts in the smaller.
    """
    if stored.shape[1] < 3:
        return ks < kl
    own, other = list_names(stored, levels)[:, 0], list_names(looking, levels)[:, 0]
    both = (list_names(stored, levels) == other[:, None]).any(axis=1)
    return np.where(own == other, ks < kl, ~both | (own < other))


def _least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vectors the least one that links i[x] - j[x] connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows(dims, key, k, looks, ...) with lo and hi: every block of stored vectors of a list with every block of those that look it up.

    Lists without a pair are left out.
    """
    looks = F.col("looks")
    sizes = rows.groupBy("dims", "key").agg(F.count(F.when(~looks, 1)).alias("s"), F.count(F.when(looks, 1)).alias("l")).where("s > 0 AND l > 0")
    cut = lambda c: F.ceil(F.col(c) / block).cast("int")
    placed = rows.join(sizes.select("dims", "key", cut("s").alias("s"), cut("l").alias("l")), ["dims", "key"])
    own = F.pmod(F.xxhash64("k"), F.when(looks, F.col("l")).otherwise(F.col("s"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(looks, F.col("s")).otherwise(F.col("l")) - 1))
    dealt = placed.withColumn("own", own).withColumn("other", other)
    return dealt.withColumn("lo", F.when(looks, F.col("other")).otherwise(F.col("own"))).withColumn("hi", F.when(looks, F.col("own")).otherwise(F.col("other"))).drop("s", "l", "own", "other")


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED, displaced: float = DISPLACED, levels: int = 1, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, zero, empty, or hold null or non-finite components link with nothing: n_links 0,
    their own component; so do vectors of different lengths with each other.  Rows of one vec_id count as
    several vectors, each with its row.  A null vec_id has a row and links, but names a component only if there
    is no other id in it.  An empty table gives an empty one.  Vectors that are equal but for the sign of
    zeros are one class and linked whatever rounding makes of their cosine.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    # vectors of single precision move as they are and become doubles where they are compared
    kind = "float" if vectors.schema[embedding].dataType.elementType == FloatType() else "double"
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("x"))
    fits = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0), F.lit(False))

    # classes of equal vectors; -0 is 0
    tagged = v.withColumn("x", F.when(fits, F.transform("x", lambda c: F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)))).withColumn("c", F.when(F.col("x").isNotNull(), F.sha2(F.array_join("x", ","), 256)))
    classes = written(tagged.where("c IS NOT NULL").groupBy("c").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")), "vectors")
    # a number for each class, fixed by the written table
    numbered = written(classes.withColumn("k", F.monotonically_increasing_id()), "numbered")

    # one row a length; pivots for those with more than a block of vectors
    lengths = {r[0]: r[1] for r in numbered.groupBy(F.size("x")).count().collect()}
    wanted = {dims: pivots or pivots_for(n) for dims, n in lengths.items() if n > block}
    centres: dict[int, np.ndarray] = {}
    if wanted:
        # vectors with the smallest hashes, somewhat more than needed
        cuts = [(d, min(2**63 - 1, 2**63 * 3 * FOUND * p // lengths[d] - 2**63)) for d, p in wanted.items()]
        some = numbered.select(F.size("x").alias("dims"), F.xxhash64("c").alias("h"), "c", "x").join(F.broadcast(spark.createDataFrame(cuts, "dims int, cut long")), "dims").where("h <= cut")
        picked = some.select("dims", "h", "c", "x").toArrow().sort_by([("dims", "ascending"), ("h", "ascending"), ("c", "ascending")])
        at = picked.column("dims").to_numpy()
        for d, p in wanted.items():
            own = picked.slice(int(np.searchsorted(at, d)), min(int((at == d).sum()), FOUND * p)).column("x").combine_chunks()
            centres[d] = choose_pivots(_unit(_matrix(own, d)), p)
    sent = spark.sparkContext.broadcast(centres)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("x").value_lengths().to_numpy() if b.num_rows else []
            for dims in np.unique(sizes):
                own = b.filter(pa.array(sizes == dims))
                d = np.zeros((own.num_rows, 0), np.uint16)
                if int(dims) in sent.value:
                    d = descriptions(_unit(_matrix(own.column("x"), dims)), sent.value[int(dims)], nearest)
                names = list_names(d, levels)
                offsets = pa.array(np.arange(0, names.size + 1, names.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(names.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("k"), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(np.full(len(d), dims, np.int32)), lists], ["k", "d", "dims", "lists"])

    described = written(numbered.select("k", "x").mapInArrow(describe, "k long, d binary, dims int, lists array<long>"), "described")

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, descriptions, and places of the stored and the looking ones."""
        k, looks = t.column("k").to_numpy(), t.column("looks").to_numpy()
        d = np.frombuffer(b"".join(t.column("d").to_pylist()), np.uint16).reshape(len(k), -1)
        return k, d, np.flatnonzero(~looks), np.flatnonzero(looks)

    def candidates(t: pa.Table) -> pa.Table:
        k, d, s, a = sides(t)
        has = np.zeros(len(k), bool)
        for i in range(0, len(s), 256):
            p = s[i : i + 256]
            near = similar(d[p], d[a], shared, displaced) & (k[p][:, None] != k[a][None, :])
            has[p] |= near.any(axis=1)
            has[a] |= near.any(axis=0)
        return t.select(["dims", "key", "k", "looks"]).filter(pa.array(has))

    home = described.select("dims", F.element_at("lists", 1).alias("key"), "k", F.lit(False).alias("looks"), "d")
    asking = described.select("dims", F.explode("lists").alias("key"), "k", F.lit(True).alias("looks"), "d")
    met = _in_blocks(home.unionByName(asking), block).groupBy("dims", "key", "lo", "hi").applyInArrow(candidates, "dims int, key long, k long, looks boolean")
    met = written(met.distinct(), "candidates")

    def links(t: pa.Table) -> pa.Table:
        k, d, s, a = sides(t)
        n, dims = t.column("n").to_numpy(), t.column("dims")[0].as_py()
        x = _unit(_matrix(t.column("x").combine_chunks(), dims))
        # a vector may stand on both sides: one place for it
        numbers, place = np.unique(k, return_inverse=True)
        count, found = np.zeros(len(numbers), np.int64), []
        for i in range(0, len(s), 1024):
            u, w = np.nonzero(x[s[i : i + 1024]] @ x[a].T >= threshold)
            u, w = s[u + i], a[w]
            mine = (k[u] != k[w]) & here(d[u], d[w], k[u], k[w], levels)
            u, w = u[mine], w[mine]
            np.add.at(count, place[u], n[w])
            np.add.at(count, place[w], n[u])
            found.append((place[u], place[w]))
        least = _least_linked(len(numbers), *(np.concatenate([f[c] for f in found]) for c in (0, 1))) if found else np.arange(len(numbers))
        hit = np.flatnonzero(count)
        return pa.table({"k": numbers[hit], "links": count[hit], "to": numbers[least[hit]]})

    fetched = met.join(numbered.select("k", "n", "x"), "k").join(described.select("k", "d"), "k")
    pairs = _in_blocks(fetched.select("dims", "key", "k", "looks", "d", "n", "x"), block).groupBy("dims", "key", "lo", "hi")
    found = written(pairs.applyInArrow(links, "k long, links long, to long"), "links")
    comps = components(found.where("k <> to").select(F.col("k").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("k").agg(F.sum("links").alias("links"))
    own = numbered.select("k", "c", "n", "first_id").join(comps.withColumnRenamed("node", "k"), "k", "left").withColumn("g", F.coalesce("component", "k"))
    names = own.groupBy("g").agg(F.min("first_id").alias("component_id"))
    table = own.join(names, "g").join(counts, "k", "left").select("c", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = tagged.select("vec_id", "c").join(table, "c", "left")
    comp = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings; odd vectors, repeats, nulls and empty tables as near_vectors has them."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
