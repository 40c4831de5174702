"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

The training words form nested classes: a code tree in which every inner node has ``FAN`` branches and
frequent words few nodes above them. log P(w | h) is the sum of the log probabilities of the branches
on the way to w, and each of these is a softmax given the history h: the node's own log shares (those
of add-one counts) plus three rows of weights, hashed from the node and the word before (bigram), the
one before that (skip), and both (trigram). Without weights the model is exactly the add-one base;
with them it remains a distribution over the known words and one unknown.

* Word counts come from the training texts, summed per task before the shuffle. All of the model is
  learnt from these texts: other texts are only scored.
* Words whose count reaches a threshold are the vocabulary that workers hold. The threshold is taken
  from a histogram of counts so that there are at most ``VOCABULARY`` of them: a proven bound.
  Rarer words are one leaf, within which they have add-one shares: they are counted per document and
  joined with the count table by word. As the word before, a rare word is told by a hash of its own.
* The number of rows grows with the training tokens, one for ``TOKENS_A_ROW`` of them, up to
  ``MOST_ROWS``: what a worker can hold. Further contexts share rows by their hash.
* Training goes in ``ROUNDS`` rounds. Each takes the documents of one residue of crc32(doc_id), sums
  observed and expected counts of every row's branches under the weights so far, and moves the
  weights towards the observed (iterative scaling, with a prior). Sums do not depend on how rows are
  dealt to tasks, so neither does the model, but for the last digits of a float. A round has as many
  tasks as there are cores, so what is shuffled does not grow with the partitions of the input.
* Scoring: one Arrow pass in sparse numpy batches.

Edge cases: a null text is empty and still has its end token; a null doc_id counts as the empty
text for the fold; repeated rows are scored and counted each; an empty table gives no rows; without
training rows all words are unknown; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 7, 2
VOCABULARY, FAN = 1 << 18, 16
ROUNDS, STEP, PRIOR = 3, 0.4, 4.0
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 512, 1 << 15, 1 << 19
#: Tokens worked on at once, rows of a message, distinct words a task counts before it hands them on,
#: tokens of a round that are worth a task.
BATCH, BLOCK, COUNTED, TASK = 1 << 16, 512, 300_000, 250_000
END = b""  # no word is empty
NEVER = -60.0


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over (t), written; the end token is the empty word."""

    def run(stream):
        def rows(found: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

        found: Counter = Counter()
        for big in stream:
            for batch in common.batches(big):
                for text in batch.column(0).to_pylist():
                    found.update(text.lower().split())
                found[END] += batch.num_rows
                if len(found) > COUNTED:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    part = train.select("t").mapInArrow(run, "word binary, c long")
    return common.materialize(part.groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0"), "words")


def threshold(counts: DataFrame, most: int = VOCABULARY) -> int:
    """The smallest power of 2 ** (1 / 8) such that at most ``most`` words have that count."""
    bands = counts.groupBy(F.floor(8 * F.log2("c")).alias("band")).agg(F.count("*").alias("n")).collect()
    total, least = 0, 1 << 62
    for band, n in sorted(((r.band, r.n) for r in bands), reverse=True):
        total += n
        if total > most:
            break
        least = int(np.ceil(2 ** (band / 8) - 1e-9))
    return least


def code_tree(mass: list[int], fan: int = FAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each leaf's code and the end, node and branch of each place, log shares of the
    nodes' branches (nodes, fan)) of the nested classes that give heavy leaves the shortest codes.
    ``mass`` descends but for its last leaf."""
    n = len(mass)
    leaves = sorted(range(n), key=lambda k: (mass[k], -k))
    sums: list[int] = []
    parent, branch = np.full(2 * n + 1, -1), np.zeros(2 * n + 1, np.int64)  # leaves, then nodes
    shares: list[list[int]] = []
    a, b, take = 0, 0, 2 + (n - 2) % (fan - 1) if n > 1 else 0
    while take:
        total, own = 0, []
        for k in range(take):
            if b >= len(sums) or a < n and mass[leaves[a]] <= sums[b]:
                child, weight, a = leaves[a], mass[leaves[a]], a + 1
            else:
                child, weight, b = n + b, sums[b], b + 1
            parent[child], branch[child] = len(sums), k
            own.append(weight)
            total += weight
        sums.append(total)
        shares.append(own)
        take = min(fan, n - a + len(sums) - b)
        take = take if take > 1 else 0
    bias = np.full((len(sums), fan), NEVER, np.float32)
    for node, own in enumerate(shares):
        bias[node, : len(own)] = np.log(np.array(own) / sums[node])
    depth = np.zeros(len(sums), np.int64)
    for node in range(len(sums) - 2, -1, -1):
        depth[node] = depth[parent[n + node]] + 1
    length = depth[parent[:n]] + 1 if len(sums) else np.zeros(n, np.int64)
    start = np.r_[0, np.cumsum(length)]
    nodes, branches = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.int8)
    at, item, live = start[1:] - 1, np.arange(n), length > 0
    while live.any():
        nodes[at[live]], branches[at[live]] = parent[item[live]], branch[item[live]]
        item, at = np.where(live, n + parent[item], item), at - 1
        live = live & (parent[item] >= 0)
    return start, nodes, branches, bias


def rows_for(tokens: int) -> int:
    """Rows of weights for so many training tokens, a power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, (tokens // TOKENS_A_ROW - 1).bit_length())))


class Model:
    """What workers need: the vocabulary's ids and counts and the nested classes. Weights (rows, FAN)
    come apart, as they change from round to round."""

    def __init__(self, words: list[bytes], c: np.ndarray, tokens: int, distinct: int):
        self.words, self.tokens, self.distinct = words, tokens, distinct
        self.log_count = np.log10(c + 1.0)
        self.rare_mass = int(tokens + distinct + 1 - (c + 1).sum())
        self.start, self.node, self.branch, self.bias = code_tree([int(x) + 1 for x in c] + [self.rare_mass])
        self.rows = rows_for(tokens)

    def prepare(self) -> "Model":
        self.ids = Ids(zip(self.words, range(len(self.words)), strict=True))
        self.depth = np.diff(self.start)
        return self

    def no_weights(self) -> np.ndarray:
        return np.zeros((self.rows, FAN), np.float32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ids of all texts with their ends, the tokens as contexts, first token of each text, rare
        words of each."""
        parts, rare, get = [], [], self.ids.__getitem__
        for text in texts:
            words = text.lower().split()
            words.append(END)
            ids = np.fromiter(map(get, words), np.int64, len(words))
            parts.append(ids)
            rare.append([words[k] for k in np.flatnonzero(ids < 0).tolist()])
        first = np.cumsum([0, *(len(p) for p in parts[:-1])])
        ids = np.concatenate(parts)
        context = ids.copy()
        context[ids < 0] = [(1 << 32) + zlib.crc32(w) for own in rare for w in own]
        return ids, context, first, rare

    @staticmethod
    def features(context: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hashes (3, n) of bigram, skip and trigram contexts; before a text stands a mark of its own."""
        one, two = np.r_[-2, context[:-1]], np.r_[-2, -2, context[:-2]][: len(context)]
        one[first] = two[first] = -2
        second = first + 1
        two[second[second < len(context)]] = -2
        one, two = one.astype(np.uint64), two.astype(np.uint64)
        with np.errstate(over="ignore"):
            a, b = one * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), two * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2)
            return np.stack([a, b, (a ^ (b >> np.uint64(7))) * np.uint64(0x165667B19E3779F9)])

    def decisions(self, ids: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, node, branch, rows (3, ..)) of every branch taken on the way to the tokens' words."""
        leaf = np.where(ids < 0, len(self.words), ids)
        n = self.depth[leaf]
        token = np.repeat(np.arange(len(leaf)), n)
        at = np.arange(len(token)) + np.repeat(self.start[leaf] - (np.cumsum(n) - n), n)
        node = self.node[at]
        with np.errstate(over="ignore"):
            mixed = features[:, token] + node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return token, node, self.branch[at], (mixed >> np.uint64(65 - self.rows.bit_length())).astype(np.int64)

    def exponents(self, weights: np.ndarray, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, their exponentials, the sums of those) of the branches, (n, FAN) and (n, 1)."""
        z = self.bias.take(node, 0)
        for row in rows:
            z += weights.take(row, 0)
        with np.errstate(over="ignore"):
            e = np.exp(z)
            total = e @ np.ones((FAN, 1), np.float32)
        if not np.isfinite(total).all() or not total.all():  # scores beyond what a float's exponent holds
            z -= z.max(1, keepdims=True)
            e = np.exp(z)
            total = e @ np.ones((FAN, 1), np.float32)
        return z, e, total

    def count(self, weights: np.ndarray, ids: np.ndarray, features: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        """Adds the branches taken, and those expected, to the counts (FAN, rows)."""
        for at in range(0, len(ids), BATCH):
            _, node, branch, rows = self.decisions(ids[at : at + BATCH], features[:, at : at + BATCH])
            _, e, total = self.exponents(weights, node, rows)
            p, flat = np.ascontiguousarray((e / total).T, np.float64), rows.ravel()
            np.add.at(observed.reshape(-1), np.tile(branch * np.int64(self.rows), 3) + flat, 1.0)
            for k in range(FAN):
                expected[k] += np.bincount(flat, np.tile(p[k], 3), self.rows)

    def log10_tokens(self, weights: np.ndarray, ids: np.ndarray, features: np.ndarray) -> np.ndarray:
        """log10 of the model's probability of each token; for a rare one only of the leaf of them all."""
        out = []
        for at in range(0, len(ids), BATCH):
            some = ids[at : at + BATCH]
            token, node, branch, rows = self.decisions(some, features[:, at : at + BATCH])
            z, _, total = self.exponents(weights, node, rows)
            out.append(np.bincount(token, z[np.arange(len(node)), branch] - np.log(total[:, 0]), len(some)) / np.log(10))
        return np.concatenate(out)


def unpacked(held) -> Model:
    """A worker's model; the broadcast value outlives its tasks, so it is prepared once."""
    model = held.value
    return model if hasattr(model, "ids") else model.prepare()


def train(docs: DataFrame, held, model: Model) -> np.ndarray:
    """The weights after one pass over the (t, round) of the training rows, a round after another."""
    spark, rows = docs.sparkSession, model.rows
    weights, tasks = model.no_weights(), min(spark.sparkContext.defaultParallelism, model.tokens // ROUNDS // TASK + 1)
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)

        def run(stream, sent=sent):
            own, observed, expected = unpacked(held), np.zeros((FAN, rows)), np.zeros((FAN, rows))
            for big in stream:
                for batch in common.batches(big, 512):
                    ids, context, first, _ = own.encode(batch.column(0).to_pylist())
                    own.count(sent.value, ids, own.features(context, first), observed, expected)
            both = np.stack([observed.T, expected.T], 2).astype(np.float32)  # (rows, FAN, 2)
            seen = [at for at in range(0, rows, BLOCK) if both[at : at + BLOCK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array([both[at : at + BLOCK].tobytes() for at in seen], pa.binary())], names=["first", "counts"])

        def move(stream):
            at, sums = None, None
            for batch in stream:
                out = []
                for first, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if first != at:
                        out += [(at, moved(sums))] if at is not None else []
                        at, sums = first, 0.0
                    sums = sums + np.frombuffer(counts, np.float32).reshape(-1, FAN, 2).astype(np.float64)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["first", "step"])
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([moved(sums)], pa.binary())], names=["first", "step"])

        part = docs.filter(F.col("round") == r).select("t").coalesce(tasks).mapInArrow(run, "first long, counts binary")
        steps = part.repartition("first").sortWithinPartitions("first").mapInArrow(move, "first long, step binary")
        weights = weights.copy()
        for row in steps.toLocalIterator():  # FAN * 4 bytes a row of weights in all
            found = np.frombuffer(row["step"], np.float32).reshape(-1, FAN)
            weights[row["first"] : row["first"] + len(found)] += found
        sent.unpersist()
    return weights


def moved(sums: np.ndarray) -> bytes:
    """By how much the weights of a block change, from its observed and expected counts."""
    return (STEP * np.log((sums[..., 0] + PRIOR) / (sums[..., 1] + PRIOR))).astype(np.float32).tobytes()


SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_rare long, rare array<struct<word:binary,tf:int>>"


def score_documents(docs: DataFrame, held, weights: np.ndarray) -> DataFrame:
    """Sums over the vocabulary's tokens of each row, and its rare words; written."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(stream):
        from pyspark import TaskContext

        own, nth = unpacked(held), TaskContext.get().partitionId() << 33
        log_count = np.r_[own.log_count, 0]  # -1: rare
        for big in stream:
            for batch in common.batches(big, 512):
                ids, context, first, rare = own.encode(batch.column(2).to_pylist())
                add = lambda x: np.add.reduceat(x, first)
                n = np.diff(np.r_[first, len(ids)])
                score = own.log10_tokens(sent.value, ids, own.features(context, first))
                counted = [Counter(r) for r in rare]
                ends = np.cumsum([0, *map(len, counted)]).astype(np.int32)
                pair = pa.StructArray.from_arrays([pa.array([w for c in counted for w in c], pa.binary()), pa.array([k for c in counted for k in c.values()], pa.int32())], names=["word", "tf"])
                row_ids = nth + np.arange(batch.num_rows)
                nth += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_ids), batch.column(0), batch.column(1), pa.array(n), pa.array(add((ids >= 0).astype(np.int64))), pa.array(add(log_count[ids])), pa.array(add(score)), pa.array([len(r) for r in rare], pa.int64()), pa.ListArray.from_arrays(ends, pair)],
                    names=[x.split()[0] for x in SCORED.split(", ")],
                )

    return common.materialize(docs.select(F.col("doc_id").cast("long"), "held_out", "t").mapInArrow(run, SCORED), "scored")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, counts and both scores of every row."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = common.narrow(docs).select("doc_id", (F.pmod(crc, F.lit(FOLDS)) == HELD_OUT).alias("held_out"), F.pmod(F.floor(crc / FOLDS), F.lit(ROUNDS)).alias("round"), common.text_bytes("text").alias("t"))
    learnt = docs.filter("NOT held_out")
    counts = word_counts(learnt)
    least = threshold(counts)
    tokens, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    top = counts.filter(F.col("c") >= least).orderBy(F.desc("c"), "word").toArrow()  # VOCABULARY rows at most
    model = Model(top["word"].to_pylist(), top["c"].to_numpy(), tokens, distinct)
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = score_documents(docs, held, train(learnt, held, model))
    rare = scored.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.tf")
    met = rare.join(counts.filter(F.col("c") < least), "word").groupBy("row_id").agg(F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(1))).alias("rare_log"))
    out = scored.drop("rare").join(met, "row_id", "left").fillna(0, ["rare_known"]).fillna(0.0, ["rare_log"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_log") - F.col("n_tokens") * log10(tokens + distinct + 1)).alias("base_score"),
        (F.col("score") + F.col("rare_log") - F.col("n_rare") * log10(model.rare_mass)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
