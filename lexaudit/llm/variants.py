"""Spelling variants: words at distance one are found by a symmetric-delete join, and rare ones get a frequent form (op12).

Each word emits a key for itself and for every distinct text that is left when one of its code points is
deleted; words that share a key are candidates, and a pair counts if its edit distance is exactly one.  A key
is shared by no more words than the alphabet and a word's length allow, whatever the corpus holds, so
there is no hot key; counts are summed before the shuffle.  A key is a number, made for all deletions of
a word in one pass.  Words of more than INLINE code points are not copied into their keys but fetched for the
pairs that need them, so a very long run costs its length, not the square of it.

A word's form has at least FORM_TIMES its count, so chains of forms are short (the logarithm of the largest
count); they are followed by doubling, each round written to the shared folder.

Edge cases: a null or empty text has no runs; a null doc_id counts as an empty one; repeated rows count as
often as they are there; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import table, written
from lexaudit.llm.sql_text import CRC_TABLE, crc32

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many, by a hash of document and run, loses a code point.
DAMAGED = 31
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: Words up to this length travel with their keys.
INLINE = 64
#: Two hashes modulo primes under 2**31, side by side in one key.
PRIMES, BASES = (2147483647, 2147483629), (1_048_583, 1_500_450_271)
KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("length", pa.int32()), ("n", pa.int64()), ("word", pa.string())])


def counted(documents: DataFrame) -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH code points and LEAST_COUNT occurrences at least."""
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, key) for each word itself and each distinct text with one code point deleted.

    The hash of a text is the sum of its code points times powers of a base, so that of a deletion is the
    sum before the gap, and the sum after it taken down by one power.  Deletions within a run of one code point
    are the same text, and only the first counts.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    whole, gone = np.zeros(len(words), np.int64), np.zeros(int(first.sum()), np.int64)
    for prime, base in zip(PRIMES, BASES, strict=True):
        terms = (codes + 1) * _powers(base, prime, int(lengths.max(initial=1)))[place] % prime
        sums = np.concatenate([[0], np.cumsum(terms)])  # under 2**63 for 2**32 code points
        upto = lambda i: (sums[i] - sums[starts[owner]][first]) % prime  # noqa: B023, E731
        total = (sums[starts + lengths] - sums[starts]) % prime
        i = np.flatnonzero(first)
        after = (total[owner[i]] - upto(i + 1)) % prime * pow(base, -1, prime) % prime
        whole = whole << 31 | total
        gone = gone << 31 | (upto(i) + after) % prime
    return np.concatenate([np.arange(len(words)), owner[first]]), np.concatenate([whole, gone])


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in parts:
        ids, words, counts = (p[c].to_pylist() for c in ("id", "word", "n"))
        at = 0
        while at < len(words):  # about a million keys at once
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) < 1_000_000):
                size += len(words[end])
                end += 1
            owner, key = deletion_keys(words[at:end])
            take = pa.array(owner)
            column = lambda values, kind: pa.array(values[at:end], kind).take(take)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), column(ids, pa.int64()), column([len(w) for w in words], pa.int32()), column(counts, pa.int64()), column([w if len(w) <= INLINE else None for w in words], pa.string())], schema=KEYS
            )
            at = end


def _sharing(words: DataFrame) -> DataFrame:
    """Pairs of words(id, word, n) that share a key and differ by one in length at most: id, n and inline word of each."""
    keys = words.select("id", "word", "n").mapInArrow(_keys, "key long, id long, length int, n long, word string")
    a = keys.select("key", *(F.col(c).alias(f"a_{c}") for c in ("id", "length", "n", "word")))
    b = keys.select("key", *(F.col(c).alias(f"b_{c}") for c in ("id", "length", "n", "word")))
    return a.join(b, "key").where((F.col("a_id") != F.col("b_id")) & (F.abs(F.col("a_length") - F.col("b_length")) <= 1)).drop("key")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a_id, a_n, b_id, b_n, b_word), both ways, of words(id, word, n) that differ by one inserted, deleted or replaced code point."""
    near = F.levenshtein("a_word", "b_word", 1) == 1
    out = ["a_id", "a_n", "b_id", "b_n", "b_word"]
    inline = _sharing(words.where(F.length("word") <= INLINE))
    # a pair with a longer word has none shorter than INLINE
    longer = _sharing(words.where(F.length("word") >= INLINE)).where(F.greatest("a_length", "b_length") > INLINE).drop("a_word", "b_word")
    text = lambda s: words.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(f"{s}_word"))
    longer = longer.join(text("a"), "a_id").join(text("b"), "b_id")
    return inline.where(near).select(*out).unionByName(longer.where(near).select(*out))


def followed(links: DataFrame) -> DataFrame:
    """(word, root) of links(word, form) without cycles: the last form that is reached from each word."""
    roots = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("on"))
        roots = written(roots.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.drop("moved")
        roots = roots.drop("moved")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts; edge cases as stated above.

    form is the near word of largest count (ties: the smallest in code-point order) if that is FORM_TIMES
    the word's own at least, else null; root is the last form reached from the word, itself if none.
    """
    words = written(counted(documents).withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.min(F.struct((-F.col("b_n")).alias("less"), "b_word"))
    near = near_pairs(words).groupBy("a_id").agg(F.size(F.collect_set("b_id")).cast("long").alias("n_near"), best.alias("best"))
    found = words.join(near.withColumnRenamed("a_id", "id"), "id", "left")
    best_n = -F.col("best.less")
    formed: Column = best_n >= FORM_TIMES * F.col("n")
    found = written(found.select("word", F.when(formed, F.col("best.b_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, best_n).alias("form_n")), "forms")
    roots = followed(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spelling_variants of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT r, n, {crc32("doc || ':' || r")}::BIGINT AS h FROM run, crc),
counted AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed)
            WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
gone AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS key FROM (SELECT word, unnest(range(length(word))) AS i FROM counted)),
pair AS (SELECT a.word AS a, b.word AS b FROM gone a JOIN gone b USING (key, i) WHERE a.word <> b.word
         UNION SELECT g.word, c.word FROM gone g JOIN counted c ON g.key = c.word
         UNION SELECT c.word, g.word FROM gone g JOIN counted c ON g.key = c.word),
near AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, encode(b))) AS form, max(n) AS form_n FROM pair JOIN counted ON b = word GROUP BY a),
found AS MATERIALIZED (SELECT word, CASE WHEN form_n >= {FORM_TIMES} * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_TIMES} * n THEN form_n END AS form_n
          FROM counted LEFT JOIN near ON a = word),
walk(word, root) AS (SELECT word, word FROM found UNION ALL SELECT walk.word, found.form FROM walk JOIN found ON walk.root = found.word WHERE found.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM found JOIN (SELECT walk.word, walk.root FROM walk JOIN found ON walk.root = found.word WHERE found.form IS NULL) USING (word)
"""
