"""Byte-level BPE: encoding by a global shuffle of distinct words, decoding by the table of token bytes.

1. Texts are cut into pre-tokens by the pattern, block by block of a scan's partition.  A block has its
   distinct words, numbered as they first occur, and for each document the word numbers by position.
2. The words of all blocks are dealt into buckets by a hash of the word, so that equal words meet: each
   distinct word is merged into ids once, by the ranks, and its ids return to the blocks that hold it.
3. Blocks meet their words again, and documents are put together by position.  Decoding looks every id up
   in the table of token bytes, which is as long as the vocabulary and travels in a broadcast.

A word appears once a block however often it occurs, so a very common word weighs no more than others.
Words, ids and word numbers are packed by zstd, so what moves is less than the stored text; texts do not
move.  There is a bucket for every BUCKET_BYTES of text (summed up first), and a task for each, so that tasks stay as large when the input grows; a block has at most one row in each.
Blocks are bounded by ``block_bytes`` of text beside one very long document.  A block's name is made of its
place in the scan, so the documents must come from a scan that reads the same rows in the same order
each time; a check sum of its words ties the two readings together and fails the job where they differ.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexaudit.llm._util import small_batches

#: Bytes of text in a block.
BLOCK_BYTES = 16 * 1024 * 1024
#: Bytes of text for each bucket and each task that puts documents together; buckets at least.
BUCKET_BYTES, LEAST_BUCKETS = 16 * 1024 * 1024, 8
#: Words that are put together at once.
STEP = 400_000

#: The public pattern in terms of the standard library, whose matcher is faster.  Its classes of letters,
#: numbers and white space are the same but for some characters of SLOW; texts with any of those take the
#: general matcher.
FAST = r"'(?:[stmd]|re|ve|ll)| ?(?:[^\W\d_]+|\d+|(?:[^\s\w]|_)+)|\s+(?!\S)|\s+"
SLOW = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0558-\U0010ffff]")

_cache: dict[str, object] = {}


def pre_tokens(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    general = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return general
    fast, slow = re.compile(FAST).findall, SLOW.search
    return lambda text: general(text) if slow(text) else fast(text)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    key = f"encoding {zlib.crc32(data)} {pattern}"
    if key not in _cache:
        _cache[key] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(data), special_tokens={})
    return _cache[key]


def _token_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes in one array, and where each id's begin (with the end of the last)."""
    key = f"table {zlib.crc32(data)}"
    if key not in _cache:
        ranks = load_ranks(data)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        _cache[key] = (np.frombuffer(b"".join(tokens), np.uint8), starts)
    return _cache[key]


def gather(data: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs data[starts[i]:starts[i + 1]] for i in which, one after the other."""
    first = starts[which]
    n = starts[which + 1] - first
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return data[:0]
    at = np.ones(ends[-1], np.int64)
    keep = n > 0
    f, k, e = first[keep], n[keep], ends[keep]
    at[0] = f[0]
    at[e[:-1]] = f[1:] - (f[:-1] + k[:-1] - 1)
    return data[np.cumsum(at)]


def decode(ids: np.ndarray, data: bytes) -> bytes:
    """The bytes of the ids, by the table of token bytes."""
    return gather(*_token_table(data), ids.astype(np.int64)).tobytes()


class _Numbers(dict):
    """Numbers words as they first occur."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, block_bytes: int, numbered: bool) -> Iterator[tuple[int, dict[str, int], list, list[np.ndarray]]]:
    """(block, words by first occurrence, doc ids, word numbers of each document if numbered) of a partition."""
    find = pre_tokens(pattern)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    words: dict[str, int] = _Numbers()
    ids, docs, size, n = [], [], 0, 0
    for b in batches:
        for i, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            text = text or ""
            if ids and size + len(text) > block_bytes:
                yield part << 32 | n, words, ids, docs
                n += 1
                words, ids, docs, size = _Numbers(), [], [], 0
            size += len(text)
            ids.append(i)
            found = find(text)
            if numbered:
                docs.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            else:
                words.update(dict.fromkeys(found))
    if ids:
        yield part << 32 | n, words, ids, docs


def _dealt(words: dict[str, int], buckets: int) -> list[list[tuple[bytes, int]]]:
    """(word, number) of a block by bucket, sorted in each: the order in which ids come back."""
    out: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
    for number, word in enumerate(words):
        w = word.encode("utf-8", "surrogatepass")
        out[zlib.crc32(w) % buckets].append((w, number))
    for own in out:
        own.sort()
    return out


def _check_sum(words: dict[str, int]) -> int:
    return zlib.crc32("\x00".join(words).encode("utf-8", "surrogatepass"))


def _squeezed(numbers: np.ndarray, rest: bytes = b"") -> bytes:
    """Numbers by byte planes, and further bytes, packed by zstd."""
    n = numbers.astype("<u4")
    return zstandard.ZstdCompressor(level=3).compress(len(n).to_bytes(8, "little") + n.view(np.uint8).reshape(-1, 4).T.tobytes() + rest)


def _spread(data: bytes) -> tuple[np.ndarray, bytes]:
    """What _squeezed was given."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n)
    return planes.T.copy().view("<u4").ravel(), raw[8 + 4 * n :]


def distinct_words(docs: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """(bucket, block, check, words): the distinct words of every block, one row for each bucket that has any.

    A word's bucket is told by its hash.  Words are packed with their lengths; check is the block's sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, _, _ in _blocks(batches, pattern, block_bytes, False):
            total, kept, packed = _check_sum(words), [], []
            for bucket, own in enumerate(_dealt(words, buckets)):
                if own:
                    kept.append(bucket)
                    packed.append(_squeezed(np.fromiter((len(w) for w, _ in own), np.uint32, len(own)), b"".join(w for w, _ in own)))
            k = len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(np.full(k, block)), pa.array(np.full(k, total)), pa.array(packed, pa.binary())], ["bucket", "block", "check", "words"])

    return docs.mapInArrow(run, "bucket int, block long, check long, words binary")


def encoded_words(words: DataFrame, data, pattern: str, buckets: int) -> DataFrame:
    """(bucket, block, check, ids): each distinct word of a bucket is encoded once, for all blocks that hold it.

    The rows of a bucket stand together in one task, whose memory is that of the bucket's distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(data.value, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        last = None
        for b in batches:
            out = []
            for bucket, packed in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                lengths, raw = _spread(packed)
                ids, at = [], 0
                for n in lengths.tolist():
                    w = raw[at : at + n]
                    at += n
                    got = known.get(w)
                    if got is None:
                        got = known[w] = array("I", encode(w)).tobytes()
                    ids.append(got)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append(_squeezed(counts, _squeezed(np.frombuffer(b"".join(ids), "<u4"))))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["bucket", "block", "check", "ids"])

    return words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, block long, check long, ids binary")


def numbered_documents(docs: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """(block, check, lengths, numbers, places, doc_ids): every block's documents as packed word numbers, in one row.

    places has the number of each word in the order in which ids come back.
    """
    name = docs.schema["doc_id"].dataType.simpleString()
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, ids, arrays in _blocks(batches, pattern, block_bytes, True):
            places = np.fromiter((n for own in _dealt(words, buckets) for _, n in own), np.uint32, len(words))
            offsets = pa.array([0, len(ids)], pa.int32())
            columns = [
                pa.array([block]),
                pa.array([_check_sum(words)], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array([len(a) for a in arrays], pa.int64())),
                pa.array([_squeezed(np.concatenate(arrays))], pa.binary()),
                pa.array([_squeezed(places)], pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array([i.as_py() for i in ids], kind)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "check", "lengths", "numbers", "places", "doc_ids"])

    return docs.mapInArrow(run, f"block long, check long, lengths array<long>, numbers binary, places binary, doc_ids array<{name}>")


def buckets_for(docs: DataFrame) -> int:
    """One for every BUCKET_BYTES of text, LEAST_BUCKETS at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def encode_decode(docs: DataFrame, *, ranks_path: str, pattern: str = public_tokenizers.PATTERN, block_bytes: int = BLOCK_BYTES, word_buckets: int | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every whole text.

    A null text counts as empty: no tokens, the sums of nothing.  Repeated rows and null ids get a row
    each; columns other than doc_id and text are not carried; an empty table gives an empty one.  doc_id may
    have any type that can be grouped in Arrow batches.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    src = docs.selectExpr("doc_id", "CAST(text AS string) AS text")
    buckets = word_buckets or buckets_for(src)
    # as many tasks put documents together: both sides of the cogroup are spread alike
    words = encoded_words(distinct_words(src, pattern, block_bytes, buckets), data, pattern, buckets).repartition(buckets, "block")
    blocks = numbered_documents(src, pattern, block_bytes, buckets).repartition(buckets, "block")
    name = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def put_together(own: pa.Table, theirs: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in names]
        if not own.num_rows:
            raise ValueError("words of a block without documents: the two readings of the input differ")
        check = set(theirs.column("check").to_pylist()) or {_check_sum({})}
        if own.num_rows > 1 or {own.column("check")[0].as_py()} != check:
            raise ValueError("the words of a block differ: the input is not read in the same order each time")
        # the ids of word i at starts[i] : starts[i + 1]
        packed = theirs.sort_by("bucket").column("ids").to_pylist()
        parts = [(counts, _spread(rest)[0]) for counts, rest in map(_spread, packed)]
        none = [np.zeros(0, np.uint32)]
        counts = np.concatenate([c for c, _ in parts] or none).astype(np.int64)
        flat = np.concatenate([i for _, i in parts] or none)
        places = _spread(own.column("places")[0].as_py())[0].astype(np.int64)
        order = np.empty(len(places), np.int64)
        order[places] = np.arange(len(places))
        flat = gather(flat, np.concatenate([[0], np.cumsum(counts)]), order)
        starts = np.concatenate([[0], np.cumsum(counts[order])])
        numbers = _spread(own.column("numbers")[0].as_py())[0]
        lengths = np.array(own.column("lengths")[0].as_py(), np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        doc_ids = own.column("doc_ids")[0].as_py()
        # several documents at once, as far as STEP words go
        at = 0
        while at < len(doc_ids):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
            own_numbers = numbers[ends[at] : ends[to]].astype(np.int64)
            ids = gather(flat, starts, own_numbers)
            id_ends = np.concatenate([[0], np.cumsum(starts[own_numbers + 1] - starts[own_numbers])])[ends[at : to + 1] - ends[at]]
            data_bytes, token_starts = _token_table(data.value)
            text = gather(data_bytes, token_starts, ids.astype(np.int64))
            text_ends = np.concatenate([[0], np.cumsum(token_starts[ids.astype(np.int64) + 1] - token_starts[ids.astype(np.int64)])])[id_ends]
            for i in range(to - at):
                one, raw = ids[id_ends[i] : id_ends[i + 1]], text[text_ends[i] : text_ends[i + 1]]
                got = (doc_ids[at + i], len(one), hashlib.sha256(one).hexdigest(), hashlib.sha256(raw).hexdigest(), *([one, raw.tobytes()] if with_ids else []))
                for r, v in zip(rows, got, strict=True):
                    r.append(v)
            at = to
        types = [own.schema.field("doc_ids").type.value_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(r, t) for r, t in zip(rows, types, strict=False)], names)

    schema = f"doc_id {name}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * with_ids
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(put_together, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, encoded and decoded; nulls, empties, long texts, repeats and empty tables as encode_decode has them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))
