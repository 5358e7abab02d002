"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprints are made in Arrow batches on the executors; texts do not move.  Copies collapse to one
row a fingerprint before anything is compared.  For links at two or fewer differing bits a
fingerprint is cut into two segments of 32 bits.  Two linked fingerprints differ by (0, <=2),
(<=2, 0) or (1, 1) bits in them.  The table holds segments as they are, the probes the small Hamming
ball around each; in every case part of the other segment must also be equal and is taken into the
key, so that many fingerprints which share a whole segment do not meet in one bucket:

* (0, <=2): first segment equal and one of three parts of the second equal (mirrored for (<=2, 0));
* (1, 1): first segment with one of its zero bits set equals the other's, and one half of the second
  is equal.  Setting zero bits only is enough, as the link is seen from one of its two ends.

Matches are verified by the complete distance.  What is shuffled is 6 + 16 x 2 + 8 narrow rows a
distinct fingerprint on average; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import free_name, small_batches, written
from lexaudit.llm.graph import components

SEED = 42
#: Shingles whose bits are counted at once.
STEP = 65_536


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """64-bit SimHash, signed: a bit is set if it is in over half the XXH64 hashes of the text's word shingles.

    A-Z are lower-cased, words are what stands between ASCII white space, shingles repeat as they
    occur.  Fewer words than a shingle are one shingle; a null or blank text has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = words_in_shingle
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else iter([b" ".join(words)])
    total = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, total)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, STEP):
        part = hashes[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def with_fingerprint(docs: DataFrame, *, text: str = "text", name: str = "fingerprint", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the fingerprint (signed long) of every row."""
    small_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).cast("string").alias(free_name(docs.select(*keep), "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], prints], [*b.schema.names[:-1], name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, `{name}` long")


def _bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << n) - 1))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b for all distinct fingerprints fp at one or two differing bits."""
    fp = F.col("fp")
    hi, lo = _bits(fp, 32, 32), _bits(fp, 0, 32)

    def key(case: int, whole: Column, part: Column) -> Column:
        return F.struct(F.lit(case).alias("c"), whole.alias("w"), part.alias("p"))

    thirds = ((0, 11), (11, 11), (22, 10))
    exact = []
    for side, (s, o) in enumerate(((hi, lo), (lo, hi))):
        exact += [key(side * 3 + i, s, _bits(o, at, n)) for i, (at, n) in enumerate(thirds)]
    halves = [(6, _bits(lo, 0, 16)), (7, _bits(lo, 16, 16))]
    table = prints.select(fp, F.explode(F.array(*exact, *(key(c, hi, p) for c, p in halves))).alias("k"))
    # the ball: every zero bit of the first segment set in turn
    def ball(case: int, part: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        unset = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: hi.bitwiseAND(bit(i)) == 0)
        return F.transform(unset, lambda i: key(case, hi.bitwiseOR(bit(i)), part))

    balls = [ball(c, p) for c, p in halves]
    probes = prints.select(fp.alias("gp"), F.explode(F.concat(F.array(*exact), *balls)).alias("k"))
    # the six exact cases see a pair from both ends; keep it from one
    near = (F.col("fp") != F.col("gp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= 2) & ((F.col("k.c") > 5) | (F.col("gp") < F.col("fp")))
    return probes.join(table, "k").where(near).select(F.least("gp", "fp").alias("a"), F.greatest("gp", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id (smallest doc_id reachable by links) of every row.

    Null and blank texts share fingerprint 0, which links like any other.  Rows with a null doc_id
    take part and get a row, but never name a component unless nothing else is in it (then null).
    Rows that repeat are kept.  Extra columns are not carried.  An empty table gives an empty one.
    """
    prints = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), name="fp"), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    comps = components(links(classes.select("fp")))
    joined = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    names = joined.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named = written(joined.join(names, "c").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each near-duplicate group: that with its smallest doc_id; columns unchanged.

    groups gives doc_id and component_id of every row: near_duplicates, or shingles.similar_groups.
    Rows are told apart by doc_id and text, so that different texts under one doc_id are each in their own
    group; of repeated rows of both one is kept.  Rows without doc_id cannot be told apart by it and
    stay.  The texts move once, by doc_id, for the semi join and the removal of repeats together.
    """
    mark, row = free_name(docs, "_mark"), free_name(docs, "_row")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = marked.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", mark)).alias(row), "text")
    first = groups(rows, doc_id=row, text="text").where("doc_id = component_id").select("component_id.*").distinct()
    kept = marked.join(first, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
