import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import packing


def unpack(histogram, capacity):
    runs = packing.plan_packing(histogram, capacity)
    spans, placed = defaultdict(list), Counter()
    for length, r0, n, b0, each, off in runs.tolist():
        assert r0 == placed[length]
        placed[length] += n
        for i in range(n):
            spans[b0 + i // each].append((off + i % each * length, length))
    assert placed == Counter({k: v for k, v in histogram.items() if v})
    for got in spans.values():
        at = 0
        for off, length in sorted(got):
            assert off == at
            at += length
        assert at <= capacity
    return len(spans)


def optimum(items, capacity):
    """Fewest bins by exhaustive search over the items, longest first."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_small_instances_are_near_the_optimum_and_the_reduction_never_costs_one(seed):
    rnd = random.Random(seed)
    items = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 10))]
    assert optimum(items, 20) <= unpack(Counter(items), 20) <= optimum(items, 20) + 1
    rest = dict(Counter(items))
    fixed = packing.reduce_by_dominance(rest, 20)
    left = [k for k, v in rest.items() for _ in range(v)]
    assert sum(n for _, n in fixed) + (optimum(left, 20) if left else 0) == optimum(items, 20)


def test_many_pieces():
    rnd = random.Random(5)
    items = [min(4096, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(30_000)]
    assert unpack(Counter(items), 4096) <= -(-sum(items) // 4096) + 3
    assert unpack({1: 1_000_000}, 4096) == -(-1_000_000 // 4096)
    assert len(packing.plan_packing({}, 4096)) == 0


def test_word_ids_equal_the_whole_texts(spark):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    texts = ["Hello  World\n\tit's 12 o'clock", "", " ", "École ÜBER é a ́b", "a<|endoftext|>b <|startoftext|> x", "　中文 テ x y\x1cz\x85q", "!!??'S 't", "İI ΑΣ ΣΑΣ", "x" * 5000]
    for t in texts:
        assert np.frombuffer(words.of(t), np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_word_ids_over_all_letters_and_marks():
    """Every letter and mark before, between and after what the shortcuts look at."""
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    signs = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LM"]
    lone = [c for c in signs if unicodedata.normalize("NFC", c) != c or c.lower() != c or not c.isalpha() or ord(c) < 0x3000]
    texts = [f"{c}. a{c}, {c}a" for c in lone] + [" ".join(f"{c}. a{c}," for c in signs[at : at + 500]) for at in range(0, len(signs), 500)]
    for t, got in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.of(t), np.uint32).tolist() == got.ids, t


def test_query_shape(spark):
    rows = [(1, "alpha beta " * 3000, "x"), (2, None, "y"), (2, "", "y"), (None, "short text", None), (5, "short text", "z")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, rank string"), 64).collect()
    whole = __import__("tokenizers").Tokenizer.from_file(packing.tokenizer_path())
    for doc_id, text, _ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        want = {(i, i * 64, len(ids[i * 64 : i * 64 + 64]), zlib.crc32(np.array(ids[i * 64 : i * 64 + 64], "<u4").tobytes())) for i in range(-(-len(ids) // 64))}
        assert want <= {(r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == doc_id}
    assert len(out) == sum(-(-(len(whole.encode(t or "", add_special_tokens=False).ids) + 1) // 64) for _, t, _ in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
