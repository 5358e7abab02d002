"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

How many sequences are needed depends only on how many pieces there are of each length, and there are
at most ``capacity`` lengths.  So the search runs on the histogram, whose size does not grow with the
data: best-fit decreasing gives the incumbent; then, around the largest remaining length, undominated
fillings of the rest of a sequence are enumerated, each is used as often as the counts allow, and
branches whose waste exceeds what a better packing could afford are cut.  The result is a list of
patterns (lengths and how often), at most a few thousand numbers.

Pieces get ranks within their length by hash buckets (counts by bucket, running sums over buckets, row
numbers within a bucket), so a length that a third of all rows share is spread over many tasks; length
and rank then determine sequence and offset by a binary search in the patterns.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaudit.llm._util import small_batches, written

CAPACITY = 2048
#: Steps of the search in all, and what a filling looked at costs in steps.  It bounds the driver's time, not
#: what is packed: every piece is packed by the best solution found.
NODES, COST = 2_000_000, 20
#: Frames of the search that keep their untried fillings; a frame's take some 150 KB.
LIVE = 32
#: Rows of one length meant for one bucket, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 64

Pattern = tuple[dict[int, int], int]
_encoders: dict[int, tiktoken.Encoding] = {}


# -- tokens ---------------------------------------------------------------------------------------


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks (which are the ids) of a byte-level BPE in the tokenizers library's JSON format, and its added tokens.

    Requires that ids follow the order of the merges, which makes merging by rank the same as merging by
    the list.  Added tokens are found in the text before it is cut into words, as that library does; those
    that strip white space or match whole words only are not supported.
    """
    model = json.loads(vocabulary)
    vocab, merges, added = model["model"]["vocab"], model["model"]["merges"], model.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("this vocabulary has added tokens of a kind that is not supported")
    special = {t["content"]: t["id"] for t in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    order = [vocab[a + b] for a, b in pairs]
    if order != sorted(order):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    back = _byte_characters()
    return {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}, special


def encoder(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    """One encoder a worker and vocabulary."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        ranks, special = ranks_of(vocabulary)
        _encoders[key] = tiktoken.Encoding(f"bpe-{key}", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    k = max(1, -(-n // capacity))
    first = n - (k - 1) * capacity
    return [(0, first), *((first + i * capacity, capacity) for i in range(k - 1))]


def pieces(docs: DataFrame, *, vocabulary: str, pattern: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, pattern).encode_to_numpy
        for b in batches:
            at, cols, ids = [], [[], [], [], []], []
            for row, text in enumerate(b.column(1).to_pylist()):
                t = np.append(encode(text or "", allowed_special="all"), end).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(t), capacity)):
                    at.append(row)
                    part = t[start : start + n]
                    for c, v in zip(cols, (k, start, n, zlib.crc32(part)), strict=True):
                        c.append(v)
                    if with_ids:
                        ids.append(part)
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


# -- search over the histogram --------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, whole groups of equal bins at a time."""
    open_: dict[int, list[Pattern]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                per = min(capacity // size, left)
                n, left = left // per, left % per
                open_.setdefault(capacity - per * size, []).append(({size: per}, n))
                continue
            group, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
            used = min(n, left)
            left -= used
            if n > used:
                open_.setdefault(room, []).append((group, n - used))
            open_.setdefault(room - size, []).append((group | {size: group.get(size, 0) + 1}, used))
    return [p for groups in open_.values() for p in groups]


def _reach(sizes: list[int], room: int) -> list[int]:
    """For every i the sums up to room (as bits) of any number of the first i sizes; a bound, as it ignores counts."""
    full = (1 << room + 1) - 1
    out = [1]
    for size in sizes:
        bits, step = out[-1], size
        while step <= room:
            bits |= bits << step & full
            step *= 2
        out.append(bits)
    return out


@dataclass
class Effort:
    """How many steps the search may still take."""

    left: int

    def spend(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left >= 0


def _exact(total: int, n: int, sizes: list[int], counts: list[int], reach: list[int], upto: int, effort: Effort, there: Callable[[int], bool], sums: frozenset[int]) -> Iterator[list[int]]:
    """All multisets of n of the first ``upto`` sizes (ascending) with this sum, none of them more often than it is there; the most even first.

    Left out are those in which some members add up to a size that is still there, as that one dominates them
    (it is larger than any member to come, so it stays there); sums are what the members chosen so far add up to.
    """
    # the largest member is no less than the mean, and leaves room for the others
    for i in range(bisect_left(sizes, -(-total // n), 0, upto), bisect_right(sizes, total - (n - 1) * sizes[0], 0, upto)):
        if not effort.spend():
            return
        size = sizes[i]
        if not counts[i] or any(there(s + size) for s in sums):
            continue
        if n == 1:
            yield [size]
        elif reach[i + 1] >> total - size & 1:
            counts[i] -= 1
            for rest in _exact(total - size, n - 1, sizes, counts, reach, i + 1, effort, there, sums | {size} | {s + size for s in sums}):
                yield [size, *rest]
            counts[i] += 1


def dominated(filling: list[int], room: int, counts: list[int], upto: list[int]) -> bool:
    """Whether another filling is at least as good whatever comes after.

    That is so if some of its sizes (or none) can be exchanged for one larger or equal size that is still
    there and fits: what was taken out fits wherever that size would have gone.  A size is not exchanged for
    itself.  counts is by size, upto the largest size there up to any sum (0 for none).
    """
    waste = room - sum(filling)
    sums = {0: 0}  # sum of some sizes -> how many they are, at most
    for k in filling:
        for s, n in list(sums.items()):
            sums[s + k] = max(sums.get(s + k, 0), n + 1)
    for s, n in sums.items():
        y = upto[s + waste]
        while y > s or y == s and n > 1:
            if counts[y] > filling.count(y):
                return True
            y = upto[y - 1]
    return False


def fillings(room: int, left: np.ndarray, effort: Effort | None = None) -> Iterator[list[int]]:
    """All undominated fillings of room by the sizes in left (counts by size): least waste, then fewest sizes, then most even first.

    They are made as they are asked for, and end where the effort is spent; left must stay as it is meanwhile.
    """
    effort = effort or Effort(1 << 62)
    if left[room]:  # one size that fits exactly dominates all else
        yield [room]
        return
    sizes = np.flatnonzero(left[: room + 1]).tolist()
    if not sizes:
        yield []
        return
    counts, reach, here = left[sizes].tolist(), None, left[: room + 1].tolist()
    place = {k: i for i, k in enumerate(sizes)}
    below = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0)).tolist()
    # less than the largest single size cannot be undominated
    for total in range(room, sizes[-1] - 1, -1):
        for n in range(1, total // sizes[0] + 1):
            if n == 2:  # by a look at all counts at once
                one = np.array(sizes)
                one = one[(one * 2 >= total) & (one <= total)]
                found = ([a, total - a] for a in one[left[total - one] > (one * 2 == total)].tolist())
            else:
                reach = reach or _reach(sizes, room)
                if not reach[-1] >> total & 1:
                    break
                found = _exact(total, n, sizes, counts, reach, len(sizes), effort, lambda s: s in place and counts[place[s]] > 0, frozenset())
            for filling in found:
                if not effort.spend(COST):
                    return
                if not dominated(filling, room, here, below):
                    yield filling
            if effort.left < 0:
                return


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns that hold every piece of the histogram, in as few bins as the search finds.

    Depth first: around the largest size left, each undominated filling in turn, as often as the counts allow;
    a branch ends where its waste leaves no room for a better packing than the incumbent.  What is untried is kept
    for the last LIVE frames; the others' fillings are made again when the search comes back to them.
    """
    incumbent = best_fit(counts, capacity)
    bins = lambda ps: sum(n for _, n in ps)
    total = sum(k * n for k, n in counts.items())
    least, best = -(-total // capacity), bins(incumbent)
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    # depth first; a frame holds its untried fillings, what was applied, the waste before it and how many were tried
    path: list[Pattern] = []
    frames: list[list] = []
    waste, effort = 0, Effort(nodes)

    def open_frame() -> None:
        top = int(np.flatnonzero(left)[-1])
        frames.append([top, around(top), None, waste, 0])
        if len(frames) > LIVE:
            frames[-1 - LIVE][1] = None

    def around(top: int, tried: int = 0) -> Iterator[list[int]]:
        """The fillings around top but the first so many, which were paid for before."""
        left[top] -= 1
        found = fillings(capacity - top, left.copy(), effort)
        left[top] += 1
        paid, effort.left = effort.left, 1 << 62
        for _ in range(tried):
            next(found)
        effort.left = paid
        return found

    if total:
        open_frame()
    while frames and best > least and effort.left >= 0:
        frame = frames[-1]
        if frame[2] is not None:  # take back what was applied
            pattern, n = path.pop()
            for k, c in pattern.items():
                left[k] += c * n
            waste, frame[2] = frame[3], None
        if frame[1] is None:  # left is what it was when the frame was opened, so they come in the same order
            frame[1] = around(frame[0], frame[4])
        filling = next(frame[1], None)
        if filling is None:
            frames.pop()
            continue
        frame[4] += 1
        effort.spend(COST)
        pattern: dict[int, int] = {}
        for k in (frame[0], *filling):
            pattern[k] = pattern.get(k, 0) + 1
        n = min(int(left[k]) // c for k, c in pattern.items())
        room = capacity - sum(k * c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= c * n
        path.append((pattern, n))
        frame[2] = True
        waste = frame[3] + room * n
        if waste > (best - 1) * capacity - total and left.any():
            continue
        if not left.any():
            if bins(path) < best:
                incumbent, best = list(path), bins(path)
            continue
        # best-fit of what is left may better the incumbent
        if np.count_nonzero(left) <= 32:
            rest = best_fit({int(k): int(left[k]) for k in np.flatnonzero(left)}, capacity)
            if bins(path) + bins(rest) < best:
                incumbent, best = path + rest, bins(path) + bins(rest)
        open_frame()
    return incumbent


@dataclass(frozen=True)
class Places:
    """Patterns as sorted arrays: for (length, rank) the last key not above it tells sequence and offset."""

    keys: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(patterns: list[Pattern]) -> Places:
        rows, used, base = [], {}, 0
        for pattern, n in patterns:
            at = 0
            for k, c in sorted(pattern.items(), reverse=True):
                rows.append((k << 44 | used.get(k, 0), c, base, at))
                used[k] = used.get(k, 0) + c * n
                at += k * c
            base += n
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 4)
        return Places(*(np.ascontiguousarray(cols[:, i]) for i in range(4)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = length << 44 | rank
        i = np.searchsorted(self.keys, want, "right") - 1
        n = want - self.keys[i]
        return self.sequence[i] + n // self.copies[i], self.offset[i] + n % self.copies[i] * length


# -- the operator ---------------------------------------------------------------------------------


def pack(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """parts(doc_id, piece, length, ...) with sequence_id and offset appended.

    Lengths are from 1 to capacity.  Sequences are numbered from 0 and each is filled from 0 without gaps.
    Repeated rows are packed one by one, a null doc_id is an id like any other, an empty table gives an
    empty one.  parts should be a stored table: it is read three times.
    """
    histogram = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a piece is empty or longer than a sequence")
    n_rows = sum(histogram.values())
    buckets = max(LEAST_BUCKETS, -(-n_rows // BUCKET_ROWS))
    places = parts.sparkSession.sparkContext.broadcast(Places.of(complete(histogram, capacity)))
    p = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(buckets)))
    spread = p.groupBy("length", "_b").count()
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece")
    ranked = p.withColumn("_n", F.row_number().over(within)).join(spread, ["length", "_b"])
    ranked = ranked.select(*parts.columns, (F.col("_before") + F.col("_n") - 1).cast("long").alias("_rank"))
    names = [*parts.columns, "sequence_id", "offset"]
    at = parts.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = places.value.find(b.column(at).to_numpy(), b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, vocabulary_path: str, pattern: str = public_tokenizers.PATTERN, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document.

    A document is its text's tokens and then ``end``; a null text counts as empty, so it is the end alone.
    Documents longer than a sequence are cut into full pieces, the first of which may be shorter.  Columns
    other than doc_id and text are not carried; repeated rows are packed one by one.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    parts = written(pieces(docs, vocabulary=vocabulary, pattern=pattern, capacity=capacity, end=end, with_ids=with_ids), "pieces")
    return pack(parts, capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of every sequence, from pack_documents(..., with_ids=True)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    g = packed.groupBy("sequence_id").agg(rows.alias("r"))
    return g.select("sequence_id", F.flatten(F.transform("r", lambda x: x["ids"])).alias("ids"), F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, packed; nulls, empties, long texts, repeats and empty tables as pack_documents has them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, vocabulary_path=public_tokenizers.path("byte_bpe_50k.json"))
