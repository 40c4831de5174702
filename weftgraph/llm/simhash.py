"""Near-duplicate groups by 64-bit SimHash and a Gray-order hierarchical index.

1. A fingerprint per document, over whole texts (one Arrow pass, numpy bit counts).
2. Distinct fingerprints only go on: copies cost one row, however many there are.
3. Fingerprints within ``radius`` bits agree on two of ``radius + 2`` blocks at least, so each goes
   to the bucket of every pair of blocks (15 for radius 4, about 21 shared bits each): exact, and a
   bucket holds a two-millionth of the fingerprints. Buckets counted to hold more than ``LEAVES``
   are dealt anew by each of ``radius + 1`` blocks of their free bits, one of which is equal in
   each pair within the radius: exact again, and it ends as the fingerprints are distinct.
4. Within a task, buckets sorted by the Gray rank of their fingerprints form a hierarchy: an inner
   node stores the bits all its members share, and a search that descends from pairs of nodes adds
   up the differing shared bits, dropping whole groups beyond the radius. Pairs of nodes already
   known to be in one component are skipped too, so a dense cluster of n near copies costs about
   n steps instead of n * n, and leaves a star of n - 1 links.
5. Components of the stars by contraction.

Edge cases: a null text is empty; texts without words have fingerprint zero and link like others;
a null doc_id is a row with a null id whose group takes the smallest id that is not null (null if
there is none); repeated rows and ties give equal fingerprints, hence one group; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.components import component_labels

from . import common

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Children of an inner node; pairs of nodes expanded at once; fingerprints indexed at once.
FAN, PAIRS, LEAVES = 4, 1 << 16, 1 << 18

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; signed 64-bit."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n, counts = len(words) - shingle + 1, np.zeros(2048, np.int64)
    for at in range(0, n, 1 << 16):
        some = words[at : min(n, at + (1 << 16)) + shingle - 1]
        joined = map(b" ".join, zip(*(some[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(some) - shingle + 1)
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ _BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and its key if there is one."""
    keys = [F.col("doc_id").cast("long"), *([] if row is None else [row.alias("_row")])]
    names = ["doc_id", "_row"][: len(keys)]

    def run(stream):
        for big in stream:
            for batch in common.batches(big):
                found = [fingerprint(t, shingle) for t in batch.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*names, "fp"])

    return common.narrow(docs).select(*keys, common.text_bytes("text").alias("t")).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in the reflected Gray sequence: the xor of all its right shifts."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def cut(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of bits, as even as can be."""
    ends = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


def buckets(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bucket, fp) for every pair of the radius + 2 blocks."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    part = [F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)) for k in range(n)]
    keys = [F.lit(c << 48).bitwiseOR(F.shiftleft(part[i], 24)).bitwiseOR(part[j]) for c, (i, j) in enumerate(combinations(range(n), 2))]
    return nodes.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def finer(rows: DataFrame, radius: int) -> DataFrame:
    """(bucket, mask, fp): rows (mask, fp) under each mask with one more of the radius + 1 blocks of free bits."""

    def run(stream):
        for batch in stream:
            mask, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for m in np.unique(mask).tolist():
                own = pa.array(fp[mask == m])
                for block in cut([b for b in range(64) if not m >> b & 1], radius + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), signed((m | block) % 2**64))), own], names=["mask", "fp"])

    found = rows.select("mask", "fp").mapInArrow(run, "mask long, fp long")
    return found.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "mask", "fp")


def dealt(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bucket, fp), in buckets of ``LEAVES`` or fewer but for those whose hashes meet."""
    rows, most = buckets(nodes, radius), max(LEAVES, 1 << radius)
    if nodes.count() <= most:
        return rows
    blocks = cut(list(range(64)), radius + 2)
    pairs = F.array(*(F.lit(signed(a | b)) for a, b in combinations(blocks, 2)))
    level = rows.withColumn("mask", F.get(pairs, F.shiftright("bucket", 48).cast("int")))
    done = []
    while True:
        hot = common.materialize(level.groupBy("bucket").count().filter(F.col("count") > most).select("bucket"), "hot-buckets")
        n = hot.count()
        if not n:
            done.append(level.select("bucket", "fp"))
            return reduce(DataFrame.union, done)
        hot = F.broadcast(hot) if n <= common.FEW_ROWS else hot
        done.append(level.join(hot, "bucket", "left_anti").select("bucket", "fp"))
        level = common.materialize(finer(level.join(hot, "bucket"), radius), "finer-buckets")


class GrayIndex:
    """The hierarchy over fingerprints sorted by bucket and Gray rank; a root for each bucket."""

    def __init__(self, bucket: np.ndarray, fps: np.ndarray):
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        self.sizes = [np.diff(np.r_[first, len(fps)])]  # nodes of a bucket, by level
        self.every, self.some = [fps], [fps]  # bits set in all members, in any
        self.start: list[np.ndarray] = []  # of a node's children
        while self.sizes[-1].max(initial=1) > 1:
            n = self.sizes[-1]
            up = -(-n // FAN)
            offset = np.repeat(np.cumsum(n) - n, up)
            place = np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up)
            start = offset + place * FAN
            self.start.append(np.r_[start, n.sum()])
            self.every.append(np.bitwise_and.reduceat(self.every[-1], start))
            self.some.append(np.bitwise_or.reduceat(self.some[-1], start))
            self.sizes.append(up)
        self.labels = np.arange(len(fps))

    def shared(self, level: int, node: np.ndarray) -> np.ndarray:
        return ~(self.every[level][node] ^ self.some[level][node])

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union of the linked leaves' components; labels are the smallest leaf of each."""
        lab = self.labels
        while len(a):
            a, b = lab[a], lab[b]
            keep = a != b
            a, b = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
            np.minimum.at(lab, b, a)
            while not np.array_equal(up := lab[lab], lab):
                lab = up
        self.labels = lab
        self.low, self.high = [lab], [lab]
        for start in self.start:
            self.low.append(np.minimum.reduceat(self.low[-1], start[:-1]))
            self.high.append(np.maximum.reduceat(self.high[-1], start[:-1]))

    def components(self, radius: int) -> np.ndarray:
        """For each leaf the smallest leaf linked to it, directly or not, within its bucket."""
        top = len(self.start)
        if not top:
            return self.labels
        self.merge(np.empty(0, int), np.empty(0, int))
        roots = np.arange(len(self.every[top]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.uint64))]
        while stack:
            level, a, b, far, seen = stack.pop()
            if len(a) > PAIRS:
                stack += [(level, *(x[at : at + PAIRS] for x in (a, b, far, seen))) for at in range(0, len(a), PAIRS)]
                continue
            low, high = self.low[level], self.high[level]
            open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, far, seen = a[open_], b[open_], far[open_], seen[open_]
            start, level = self.start[level - 1], level - 1
            i, j = np.divmod(np.arange(FAN * FAN), FAN)
            ca, cb = start[a][:, None] + i, start[b][:, None] + j
            fits = (ca < start[a + 1][:, None]) & (cb < start[b + 1][:, None]) & (ca <= cb)
            row = np.nonzero(fits)[0]
            ca, cb, far, seen = ca[fits], cb[fits], far[row], seen[row]
            both = self.shared(level, ca) & self.shared(level, cb)
            far = far + np.bitwise_count((self.every[level][ca] ^ self.every[level][cb]) & both & ~seen)
            near = far <= radius
            if not level:
                near &= ca != cb
                self.merge(ca[near], cb[near])
                continue
            ca, cb, far, both = ca[near], cb[near], far[near], both[near]
            same = ca == cb
            stack += [(level, ca[~same], cb[~same], far[~same], both[~same])] if not same.all() else []
            stack += [(level, ca[same], cb[same], far[same], both[same])] if same.any() else []
        return self.labels


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst): for each bucket a star over each of its components; fingerprints are distinct."""

    def settled(own: np.ndarray, some: np.ndarray):
        if len(own) > 1:
            doubled = np.zeros(len(own), bool)
            doubled[1:] = own[1:] == own[:-1]
            doubled[:-1] |= doubled[1:]
            own, some = own[doubled], some[doubled]
            found = GrayIndex(own, some).components(radius) if len(own) else np.empty(0, int)
            linked = found != np.arange(len(found))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(some[linked].view(np.int64)), pa.array(some[found[linked]].view(np.int64))], names=["src", "dst"])

    def run(stream):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for batch in stream:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            total += batch.num_rows
            if total >= LEAVES and batch.num_rows and held[0][0][0] != held[-1][0][-1]:
                bucket, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                upto = int(np.searchsorted(bucket, bucket[-1]))
                yield from settled(bucket[:upto], fps[:upto])
                held, total = [(bucket[upto:], fps[upto:])], len(fps) - upto
        if total:
            yield from settled(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = dealt(nodes, radius).repartition("bucket").sortWithinPartitions("bucket", gray_rank(F.col("fp")))
    return rows.mapInArrow(run, "src long, dst long")


def rooted(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes, (fp, least) with a row for each fp, and the ``root`` of its group; written."""
    nodes = common.materialize(nodes, "prints")
    labels = common.materialize(component_labels(links(nodes.select("fp"), radius)), "labels")
    named = nodes.join(labels, nodes.fp == labels.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return common.materialize(named, "roots")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for a written table of (doc_id, fp)."""
    named = rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), radius)
    least = common.materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = common.materialize(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    return groups(common.materialize(fingerprints(docs, shingle), "fingerprints"), radius)


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group, unchanged: the first with the smallest doc_id, a null id being last."""
    own = common.numbered(docs)
    prints = common.materialize(fingerprints(own, shingle, F.col("_row")), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("least")
    first = rooted(prints.groupBy("fp").agg(least), radius).groupBy("root").agg(F.min("least").alias("least")).select("least._row")
    return common.without(own, common.materialize(prints.select("_row").join(first, "_row", "left_anti"), "copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
