"""Best-fit packing of tokenised documents into fixed-length sequences.

Only two small things leave the executors: the histogram of piece lengths (at most ``capacity``
rows, whatever the corpus) and nothing else. The driver solves the packing on that histogram -
first the dominance reduction, then best fit of what remains - and returns *runs*: "pieces of
length L with ranks r0..r0+n go to sequences b0.., m in each, from offset o". Every piece knows its
rank within its length from a count per (file partition, length), so no task ever sees all pieces
of one length.

Edge cases: a null or empty text is one piece holding just the end id; equal lengths are ties and
are interchangeable; repeated rows are packed once each; an empty table gives no rows; further
columns of the input are ignored; texts of any length are cut into pieces, never truncated.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct space-separated words whose ids a worker remembers before it starts afresh.
CACHE_WORDS = 150_000

def byte_signs() -> dict[int, int]:
    """The sign by which a byte-level tokenizer writes each byte: itself if it prints, else the next
    free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


BYTE_SIGNS = byte_signs()

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)


@lru_cache(maxsize=4096)
def stays_letter(c: str) -> bool:
    """Whether the normaliser, too, ends c with a letter: some letters become one with a mark behind."""
    return c.isalpha() and unicodedata.normalize("NFC", c).lower()[-1].isalpha()


class WordIds(dict):
    """Little-endian 32-bit ids of a space-free word. The tokenizer's normaliser and pre-tokenizer
    never join text across white space, so a text's ids are its words' ids in order. Ids are
    remembered for lower-case words without a final comma or stop, in two generations: when the
    younger is full it becomes the older, so frequent words stay and memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and stays_letter(word[-2:-1]):  # the pre-tokenizer parts these from letters
            found = self[word] = self[word[:-1]] + self[word[-1]]
            return found
        if word.isascii() and (lower := word.lower()) != word:
            return self[lower]
        found = self.older.get(word)
        if found is None:
            if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):
                text = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)
                ids = [t.id for t in self.model.tokenize(text)]  # one pre-token as it stands
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        if text.isascii() or "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            text = text.lower()  # at once; signs whose case depends on more than themselves are left
        words = text.split()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space, the tokenizer doesn't
            words = text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


def word_ids(path: str, kept: dict = {}) -> WordIds:  # noqa: B006
    """One memory for all tasks of a worker."""
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenise(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece, with its place among the pieces of its length in its partition."""

    def run(stream):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, seen = word_ids(tokenizer or tokenizer_path()), TaskContext.get().partitionId(), Counter()
        for big in stream:
            for batch in common.batches(big):
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = words.of(text or "") + struct.pack("<I", END_ID)
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        length = len(cut) // 4
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(cut), part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=PIECES.names)

    return common.narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction on a histogram: for the items from long to short, the set with
    that item which dominates all others holding it, if one is proven to, is fixed as often as the
    counts allow; counts is left with the remainder. A set dominates if the contents of any other
    feasible set fit into its items' places:

    * nothing fits beside the item: the item alone;
    * one item fills the room exactly, or no two items fit together: the longest that fits;
    * no three fit together: the pair of the longest that fits and the longest that fits beside
      it, if no feasible pair has a longer second item.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(k for k, v in counts.items() if v)

    def take(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times))
        for k, v in Counter(items).items():
            counts[k] -= v * times
            if not counts[k]:
                lengths.remove(k)

    def longest(room: int, used: Counter) -> int:
        at = bisect.bisect_right(lengths, room) - 1
        while at >= 0 and counts[lengths[at]] - used[lengths[at]] <= 0:
            at -= 1
        return lengths[at] if at >= 0 else 0

    def smallest(k: int, used: Counter) -> list[int]:
        out: list[int] = []
        for x in lengths:
            out += [x] * min(k - len(out), counts[x] - used[x])
            if len(out) == k:
                break
        return out

    for item in list(reversed(lengths)):
        while counts[item]:
            own, room = Counter([item]), capacity - item
            first = longest(room, own)
            if not first:
                take((item,), counts[item])
                continue
            few = smallest(3, own)
            if first == room or len(few) < 2 or few[0] + few[1] > room:
                times = counts[item] // 2 if first == item else min(counts[item], counts[first])
                take((item, first), times)
                continue
            if len(few) < 3 or sum(few) > room:
                second = longest(min(room - first, first), own + Counter([first]))
                best_second = longest(min(room // 2, first), own)
                if second and second >= best_second:
                    take((item, first, second), min(counts[k] // v for k, v in Counter((item, first, second)).items()))
                    continue
            break
    return fixed


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, offset). Their number
    depends on the lengths that occur, of which there are ``capacity`` at most, not on the corpus."""
    counts = {k: v for k, v in histogram.items() if v}
    rank: Counter = Counter()
    runs: list[tuple[int, ...]] = []
    bins = 0

    def place(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], pieces, first, each, offset))
        rank[length] += pieces

    for items, times in reduce_by_dominance(counts, capacity):
        offset = 0
        for x in items:
            place(x, times, bins, 1, offset)
            offset += x
        bins += times
    rooms: dict[int, list[tuple[int, int]]] = {}  # free places: ranges of sequences
    order: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((first, n))

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                place(length, full * each, first, each, capacity - room)
                leave(room - each * length, first, full)
                left -= full * each
            if full < n and left:  # fewer pieces than would fill the next sequence
                place(length, left, first + full, each, capacity - room)
                leave(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if room < capacity:
                leave(room, first + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 6)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece. ``pieces`` must be a written table: it is read thrice."""
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan_packing(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))] if len(runs) else runs
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    step = int(max(histogram.values(), default=0)) + 1
    keys = runs[:, 0] * step + runs[:, 1]

    def look_up(stream):
        for batch in stream:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            found = runs[np.searchsorted(keys, length * step + rank, "right") - 1]
            nth, each = rank - found[:, 1], found[:, 4]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(found[:, 3] + nth // each), pa.array(found[:, 5] + nth % each * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    return assign(common.materialize(tokenise(docs, capacity, tokenizer), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
