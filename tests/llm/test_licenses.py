import random

import numpy as np

from weftgraph.llm import licenses as lic


def shingle_set(words):
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(text, templates):
    """Names of the templates of which 0.8 lies in some run of as many shingles, at least."""
    words = lic._WORD.findall(text.lower())
    out = set()
    for name, t in templates.items():
        own = shingle_set(lic._WORD.findall(t.lower()))
        m = len(lic._WORD.findall(t.lower())) - 4
        sh = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        for at in range(max(1, len(sh) - m + 1)):
            if own and len(own & set(sh[at : at + max(1, m)])) / len(own) >= 0.8:
                out.add(name)
                break
    return out


def test_finds_what_brute_force_finds():
    rnd = random.Random(11)
    scanner, vocab = lic.Scanner(lic.TEMPLATES), [f"w{k}" for k in range(200)] + ["the", "License", "software", "under"]
    texts, names = [], list(lic.TEMPLATES)
    for k in range(300):
        body = [rnd.choice(vocab) for _ in range(rnd.randint(0, 400))]
        for name in rnd.sample(names, rnd.randint(0, 2)):
            t = lic.TEMPLATES[name].split()
            if k % 2 and len(t) > 40:
                t[rnd.randrange(len(t))] = "changed"
            at = rnd.randint(0, len(body))
            body[at:at] = t
        texts.append(" ".join(body).upper() if k % 5 == 0 else "\n".join(body))
    got = scanner.scan(texts)
    want = [brute(t, lic.TEMPLATES) for t in texts]
    assert [w - {n for n, *_ in g} for g, w in zip(got, want, strict=True)] == [set()] * len(texts)
    assert sum(len(w) for w in want) > 250
    for t, g in zip(texts, got, strict=True):
        for name, share, a, b in g:
            own, seen = shingle_set(lic._WORD.findall(lic.TEMPLATES[name].lower())), shingle_set(lic._WORD.findall(t[a:b].lower()))
            assert 0.8 <= share == len(own & seen) / len(own)


def test_long_text_in_segments_and_two_places(monkeypatch):
    monkeypatch.setattr(lic, "SEGMENT", 512)
    scanner = lic.Scanner(lic.TEMPLATES)
    text = " ".join(["x%d" % (k % 997) for k in range(5000)])
    for at in (0, 400, 511, 513, 1024, 4999):
        w = text.split()
        w[at:at] = lic.TEMPLATES["MIT-grant"].split()
        assert [m[0] for m in scanner.scan([" ".join(w)])[0]] == ["MIT-grant"], at
    two = f"{lic.TEMPLATES['MIT-notice']} y {lic.TEMPLATES['MIT-notice']}"
    assert [(m[0], two[m[2] : m[3]]) for m in scanner.scan([two])[0]] == [("MIT-notice", "Released under the MIT License")] * 2


def test_every_place_is_told():
    name, words = "t", [f"a{k}" for k in range(9)]  # five shingles, windows of 16
    scanner = lic.Scanner({name: " ".join(words)})
    for gap in (0, 1, 3, 7, 20):
        for before in range(20):
            text = " ".join(["x"] * before + (words + ["y"] * gap) * 4)
            got = scanner.scan([text])[0]
            assert [(share, text[a:b]) for _, share, a, b in got] == [(1.0, " ".join(words))] * 4, (gap, before)
    many = scanner.scan([" ".join(words * 20_000)])[0]
    assert len(many) == 20_000 and {m[1] for m in many} == {1.0}


def test_planted_places_are_found_apart():
    rnd = random.Random(12)
    for name in ("MIT-grant", "BSD-disclaimer", "GPL-header", "BSD-grant"):
        scanner, own = lic.Scanner({name: lic.TEMPLATES[name]}), lic._WORD.findall(lic.TEMPLATES[name].lower())
        for _ in range(60):
            body, want = [], []
            for _ in range(rnd.randint(1, 6)):
                body += [f"w{rnd.randrange(50)}" for _ in range(rnd.choice((0, 0, 2, 9, 90)))]
                part = list(own)
                if len(own) > 60 and rnd.random() < 0.6:
                    part[rnd.randrange(5, len(own) - 5)] = "changed"
                want.append((len(body), len(body) + len(part) - 1))
                body += part
                if rnd.random() < 0.3:  # a piece that is no place by itself
                    body += own[: len(own) // 2]
            found = {(at, size, n) for at, size, n in scanner.candidates(lic.shingle_hashes(body, scanner.known), np.array([0]))}
            assert [(a, b) for _, _, a, b in scanner.verify(body, found)] == want


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "released"), (4, "İ Released under the MIT License. İ"), (None, "Licensed under CC BY-NC 4.0."), (4, "Released under the MIT License!")]
    got = lic.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, license int")).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("4", "MIT-notice"), ("4", "MIT-notice"), ("None", "CC-BY-NC-4.0-notice")]
    short = {"two": "free text", "none": "..."}
    assert [m[0] for m in lic.Scanner(short).scan(["Free TEXT"])[0]] == ["two"]
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
