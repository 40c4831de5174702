import random
import re
import unicodedata

import pytest

from weftgraph.llm import pii


def kinds(text):
    return [(k, text[a:b]) for a, b, k, _ in pii.detect(text)]


def test_detection():
    t = 'Call +1 (017) 555-7713 or 212-555-0199, mail Foo.19@Mail5.example.com. Card 4111111111111111 and 4111 1111 1111 1111, IP 152.143.123.131### SSN 078-05-1120 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"!!'
    assert kinds(t) == [("PHONE", "+1 (017) 555-7713"), ("PHONE", "212-555-0199"), ("EMAIL", "Foo.19@Mail5.example.com"), ("CARD", "4111111111111111"), ("CARD", "4111 1111 1111 1111"), ("IP", "152.143.123.131"), ("SSN", "078-05-1120"), ("SECRET", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert kinds("9807915762804490 4111111111111112 Version 2.0. 1.2.3 300.1.1.1 1.2.3.4.5 2020-01-02 a@b x@y. @ 12345") == []
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == [("IBAN", "DE89 3704 0044 0532 0130 00")]
    assert kinds("Mr. John Smith met Frau Müller and Dr who; госпожа Иванова") == [("GIVEN_M", "John"), ("SURNAME", "Smith"), ("SURNAME", "Müller"), ("SURNAME", "Иванова")]


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutation_has_no_fixed_point(size):
    for attempt in (0, 1):
        got = [pii.moved(x, size, b"k", "t", attempt) for x in range(size)]
        assert sorted(got) == list(range(size))
        assert all(a != x for x, a in enumerate(got))


def test_surrogates_keep_type_and_format():
    t = 'Mr. John Smith, JOHN.smith-7@Mail5.example.com, +44 (017) 555-7713, 4111-1111-1111-1111, DE89 3704 0044 0532 0130 00, 10.0.0.1, Mr. Smith, господин Иванов и госпожа Иванова, token: "AB12cd34EF56ab78"'
    new, spans = pii.replace(t, {})
    assert [s["type"] for s in spans] == [k for k, _ in kinds(t)]
    assert {k for k, _ in kinds(new)} == {k for k, _ in kinds(t)}
    for (k, old), s in zip(kinds(t), spans, strict=True):
        got = new[s["start"] : s["end"]]
        assert got != old, k
        if k in ("EMAIL", "PHONE", "CARD", "IBAN", "SECRET"):
            assert len(got) == len(old) and all((a.isdigit() or a in "abcdefABCDEF") == (b.isdigit() or b in "abcdefABCDEF") if k == "SECRET" else a.isdigit() == b.isdigit() or k == "IBAN" for a, b in zip(got, old, strict=True))
    part = lambda i: new[spans[i]["start"] : spans[i]["end"]]
    assert part(1) == part(7) and part(2).endswith(".com") and part(2)[:4].isupper()
    assert part(9) == part(8) + "а"
    assert pii.replace(t, {}) == (new, spans) and pii.replace(t, {}, b"other")[0] != new
    assert pii.replace("nothing here", {}) == ("nothing here", [])


def resolved(spark, own):
    """The attempts of all, with what must hold checked: distinct surrogates, none of them an entity."""
    frame = spark.createDataFrame(own, "type string, canonical string")
    attempts = {(r.type, r.canonical): r.attempt for r in pii.other_attempts(frame).collect()}
    new = {(k, c): pii.surrogate(k, c, attempts.get((k, c), 0)) for k, c in own}
    assert len({(k, s) for (k, _), s in new.items()}) == len(set(own))
    assert not {(k, s) for (k, _), s in new.items()} & set(own)
    return attempts


@pytest.mark.parametrize("names", [["Արամ", "Անի", "Ա"], ["สมชาย", "สม", "ก"], ["राम", "सीता", "र"], ["王", "李", "王小明"], ["გიორგი", "ნ"], ["ⴰⵎⵏ"], ["ᚠᚢ"]])
def test_names_of_any_script(spark, names):
    resolved(spark, [("SURNAME", n) for n in names] + [("GIVEN_M", n) for n in names])
    for n in names:
        text, spans = pii.replace(f"Dr. {n} said", {})
        (s,) = spans
        new = text[s["start"] : s["end"]]
        assert text == f"Dr. {new} said" and new and n not in text
        assert [unicodedata.category(c) for c in new] == [unicodedata.category(c) for c in n] or len(n) == 1


def test_many_names_of_few_syllables(spark):
    made = sorted({pii._spoken(pii._number(b"names", k), pii._LATIN, 3) + "x" for k in range(25_000)})[:20_000]
    assert len(made) == 20_000 > 3 * len(pii._LATIN) ** 2
    attempts = resolved(spark, [("GIVEN_M", n) for n in made])
    assert max(attempts.values()) < 10


def test_small_rooms(spark):
    few = [("SURNAME", chr(0x561 + k)) for k in range(38)] + [("EMAIL", f"{c}@b.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("SECRET", f"!!!!!!!{k}") for k in range(10)] + [("SECRET", "!" * n) for n in (8, 9)]
    resolved(spark, few)
    numbers = [f"{k:04d}" for k in range(10_000)]  # all there are: a permutation without fixed points
    frame = spark.createDataFrame([("PHONE", n) for n in numbers], "type string, canonical string")
    assert pii.other_attempts(frame).count() == 0
    new = [pii.surrogate("PHONE", n) for n in numbers]
    assert sorted(new) == numbers and all(a != b for a, b in zip(new, numbers, strict=True))


def test_whole_operator_by_brute_force(spark):
    """Texts built from known entities: what comes out is the same text with one surrogate for each."""
    rnd = random.Random(11)
    own = {
        "EMAIL": [f"{u}{k}@{d}" for u in ("ann", "Bob.x", "c-d") for k in range(4) for d in ("firm.com", "Other.org")],
        "PHONE": [f"{rnd.randint(200, 999)}-{rnd.randint(200, 999)}-{k:04d}" for k in range(12)],
        "SSN": [f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{k:04d}" for k in range(12)],
        "IP": [f"10.{k}.{rnd.randint(0, 255)}.7" for k in range(12)],
        "NAME": ["Mr. Adam Stone", "Mr. Stone", "Mrs. Eve Stone", "Dr. Արամ", "Frau Müller", "Dr. สมชาย", "господин Петров"],
    }
    shapes = {"EMAIL": r"[\w.+-]+@\w+\.(?:com|org)", "PHONE": r"\d{3}-\d{3}-\d{4}", "SSN": r"\d{3}-\d\d-\d{4}", "IP": r"\d+(?:\.\d+){3}", "NAME": r"(?:Mr\.|Mrs\.|Dr\.|Frau|господин) .+"}
    docs, parts = [], []
    for d in range(300):
        picked = [(k := rnd.choice(list(own)), rnd.choice(own[k])) for _ in range(rnd.randint(0, 6))]
        parts.append(picked)
        docs.append((d, "".join(f"[{rnd.choice(['x', 'ü', '12'])}] {e} | " for _, e in picked), "keep"))
    found = {r.doc_id: r for r in pii.anonymise(spark.createDataFrame(docs, "doc_id long, text string, type string")).collect()}
    to: dict = {}
    for (d, text, _), picked in zip(docs, parts, strict=True):
        got = found[d].text
        plain = re.split("|".join(re.escape(f"] {e} | ") for _, e in picked), text) if picked else [text]
        new = re.fullmatch(r"\] (.*) \| ".join(map(re.escape, plain)), got).groups() if picked else ()
        assert found[d].type == "keep" and (picked or got == text)
        for (k, e), s in zip(picked, new, strict=True):
            assert re.fullmatch(shapes[k], s), (e, s)
            assert to.setdefault((k, e.lower()), s.lower()) == s.lower()
    assert len(set(to.values())) == len(to) and not {(k, s) for (k, _), s in to.items()} & set(to)
    mails = {e: s for (k, e), s in to.items() if k == "EMAIL"}
    assert len({(e.split("@")[1], s.split("@")[1]) for e, s in mails.items()}) == 2
    surname = {e: s.split()[-1] for (k, e), s in to.items() if k == "NAME"}
    assert surname["mr. adam stone"] == surname["mr. stone"] == surname["mrs. eve stone"]


def test_attempts_and_both_paths(spark, monkeypatch):
    rnd = random.Random(2)
    ips = [f"10.0.0.{k}" for k in range(20)]
    clash = pii.surrogate("IP", ips[0])  # an entity that another's surrogate would be
    texts = [f"from {rnd.choice(ips)} to {rnd.choice(ips)} x" for _ in range(50)] + [f"at {clash} and {ips[0]}", None, "", "plain " * 40_000]
    docs = spark.createDataFrame([(k if k != 3 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, type int")
    other = pii.other_attempts(pii.entities(docs)).collect()
    assert [(r.type, r.canonical, r.attempt) for r in other] == [("IP", ips[0], 1)]
    few = sorted(pii.anonymise(docs).collect(), key=str)
    monkeypatch.setattr(pii, "FEW", 0)
    assert sorted(pii.anonymise(docs).collect(), key=str) == few
    assert docs.columns == pii.anonymise(docs).columns
    got = {r.doc_id: r.text for r in few}
    assert got[51] is None and got[52] == "" and got[53] == texts[53] and clash not in " ".join(t or "" for t in got.values())
    assert len({e[3] for t in got.values() for e in pii.detect(t or "")}) == len({e[3] for t in texts for e in pii.detect(t or "")})
    assert pii.anonymise(docs.limit(0)).count() == 0


def test_numbers_beside_one_another():
    card, other = "4111 1111 1111 1111", "5555555555554444"
    for t, want in {
        f"{card} 123": [("CARD", card)], f"{other} 25 apples": [("CARD", other)], f"12 {other}": [("CARD", other)], f"1234 567 890 {card} 99 {other}": [("CARD", card), ("CARD", other)],
        "212-555-0199 123": [("PHONE", "212-555-0199")], f"212-555-0199 {card}": [("PHONE", "212-555-0199"), ("CARD", card)], "2223003122003222": [("CARD", "2223003122003222")], "2223003122003223 1": [],
        f"+49 30 1234567 {card}": [("PHONE", "+49 30 1234567"), ("CARD", card)], "9 1 2 3 " * 2000: [],
    }.items():
        assert kinds(t) == want, t
        new, spans = pii.replace(t, {})
        assert len(new) == len(t) and all(v not in new for _, v in want)
        assert [k for k, _ in kinds(new)] == [k for k, _ in want]


def test_international_numbers():
    for t in ("+49 30 1234567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+33.1.23.45.67.89", "+4930123456", "+1 212-555-0199", "+358 9 123 4567"):
        assert kinds(f"call {t}, or") == [("PHONE", t)], t
        new = pii.replace(f"call {t}, or", {})[0][5:-4]
        assert new != t and new[:3].strip() == t[:3].strip() and [c.isdigit() for c in new] == [c.isdigit() for c in t]
    assert kinds("+12345 +2020-01-02 +1.2345678 C++20 x+1234567890") == []
    assert kinds("+4111 1111 1111 1111") == [("CARD", "4111 1111 1111 1111")]
