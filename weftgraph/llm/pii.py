"""Personal data: detected entities get keyed surrogates of their own kind and format.

Found: e-mail addresses, phone numbers of ten digits or of 7 to 15 after a plus in any grouping,
payment cards (Luhn and issuer digits; beside other numbers as well), US social security numbers, IBANs (mod 97), IPv4 addresses, quoted credentials after
token, secret, password or key, and persons after a form of address.

Surrogates. Numbers, addresses and credentials are permuted among the strings of the same shape: a
keyed Feistel permutation P on the mixed-radix number of their signs, x -> P^-1(P(x) + step of the attempt).
That has no fixed point and, for one attempt, no two entities with one surrogate; separators, case,
script, top-level domain, country, issuer digit and check digits stay right. An address's user and
domain are permuted each by itself, so colleagues keep a common domain. Names are built from
syllables with an ending of their gender (Latin and Cyrillic) or permuted among the letters of their
script (any other); given names and surnames are mapped each by itself, so "Mr. John Smith" and "Mr.
Smith" stay one person.

Collision checks run over the distinct entities of all texts: of entities with equal surrogates all
but the first, and any whose surrogate is itself an entity of the texts, take the next attempt,
until there are none. There is no limit of attempts: names, addresses and credentials grow by a
syllable or sign with each, so their room exceeds any number of entities. Numbers of a fixed length
can't grow; where the texts hold more than half of all numbers of a shape, all of that shape stay at
attempt 0, which is a permutation and keeps them distinct, though a surrogate may then be another's
number. Entities with another attempt than 0 are sent to the workers if there are ``FEW`` at most,
else joined by document.

Edge cases: null texts stay null; texts without entities are unchanged; repeated rows and null ids
are rows like any; overlaps go to the earlier, then longer, entity; an empty table gives no rows;
all other columns stay as they are.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: For tests and examples; production passes a secret of its own.
KEY = b"weftgraph example key"
FEW, ROUNDS = 200_000, 8

_EMAIL = re.compile(r"[^\W_][\w.+-]{0,63}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.){1,8}[^\W\d_]{2,24}(?![\w-])")
_NUMBER = re.compile(
    r"""(?<![\w.])(?:
    (?P<IP>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?!\.?\d|\w)
    |(?P<SSN>\d{3}-\d{2}-\d{4})(?![\w-])
    |(?P<CARD>\d(?=(?:[ -]?\d){12}))
    |(?P<PHONE>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w)
    )""",
    re.X,
)
_LOCAL = re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)")
_RUN = re.compile(r"\d(?:[ -]?\d){12,18}")
_CARD = re.compile(r"[3-6]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720")
#: Digits of a card's groups as they are printed.
_PRINTED = re.compile(r"1[3-9]|4 4 4 4(?: [123])?|4 4 4 1|4 [456] [456]")
_PLUS = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{3}\)[ ]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\d)")
_E164 = re.compile(r"(?<![\w+])\+(?!\d{4}-\d\d-\d\d(?!\d)|\d+\.\d+(?![ .()/-]*\d))[1-9](?:[ .()/-]{0,3}\d){6,14}")
#: Country codes of one and of two digits; the others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_PAREN = re.compile(r"(?<![\w+(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)")
_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']([^"'\s]{8,256})["']""")
#: Forms of address and the gender they tell: male, female, none.
_TITLES = {"Mr": "M", "Herr": "M", "Señor": "M", "Sr": "M", "Monsieur": "M", "Mrs": "F", "Ms": "F", "Miss": "F", "Frau": "F", "Señora": "F", "Sra": "F", "Mme": "F", "Madame": "F", "Dr": "N", "Prof": "N", "господин": "M", "госпожа": "F"}
_TITLE = re.compile(r"\b(" + "|".join(sorted(_TITLES, key=len, reverse=True)) + r")\b\.?(?=[ ]+[^\W\d_])")
#: Vowel signs and accents that stand in names, as the inside of a class.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x3100)) if unicodedata.category(c) in ("Mn", "Mc"))
_WORD = rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*"
_NAME = re.compile(rf"[ ]+({_WORD}(?:[-'’]{_WORD})*)")
_DIGITS = [str(d) for d in range(10)]
#: Letters that are exchanged for one another, by script, as first and last code point.
_SCRIPTS = [(0x61, 0x7A), (0xDF, 0xF6), (0xF8, 0xFF), (0x3B1, 0x3C1), (0x3C3, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x63A), (0x641, 0x64A), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
_LATIN = [c + v for c in "bcdfghjklmnprstv" for v in "aeiou"]
_CYRILLIC = [c + v for c in "бвгдзклмнпрстх" for v in "аеиоу"]


def luhn(digits: str) -> int:
    """The sum modulo 10 that is 0 for a valid number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _lower(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _national(found: str) -> str:
    """The last ten digits of a phone number, at most those after the country code."""
    digits = _digits(found)
    return digits[_COUNTRY.match(digits).end() if found[0] == "+" else 0 :][-10:]


def _card(text: str, start: int, printed: bool) -> int:
    """The end of the longest card at start, grouped as cards are printed or else in any way; 0 if none."""
    if not (run := _RUN.match(text, start)):
        return 0
    for end in range(run.end(), start + 12, -1):
        if not text[end - 1].isdigit() or (after := text[end : end + 1]).isalnum() or after == "_":
            continue
        digits = _digits(part := text[start:end])
        if len(digits) < 13:
            break
        if luhn(digits) or not _CARD.match(digits) or digits[0] == "2" and len(digits) != 16:
            continue
        if not printed or _PRINTED.fullmatch(" ".join(str(len(g)) for g in re.split("[ -]", part))):
            return end
    return 0


def _numbers(text: str) -> list[tuple[int, int, str, str]]:
    """IP, SSN, CARD and PHONE. Where several numbers stand in a row, every one of them may start or
    end a card; a printed card goes before what would run into it."""
    found, at, cards = [], 0, []

    def clear(start: int, end: int) -> bool:
        return not any(_card(text, k, True) for k in range(start + 1, end) if text[k].isdigit() and text[k - 1] in " -")

    while m := _NUMBER.search(text, at):
        start, end, kind = m.start(), m.end(), m.lastgroup
        if kind == "CARD":
            plus = text[start - 1 : start] == "+"
            end = _card(text, start, True)
            if end and not (plus and len(_digits(text[start:end])) < 16):
                cards.append(start)
            elif (p := _LOCAL.match(text, start)) and clear(start, p.end()):
                kind, end = "PHONE", p.end()
            elif (end := 0 if plus else _card(text, start, False)) and not clear(start, end):
                end = 0
        if not end:
            at = start + 1  # the next number of the row
            continue
        own = text[start:end]
        found.append((start, end, kind, own if kind == "IP" else _national(own) if kind == "PHONE" else _digits(own)))
        at = end
    for m in _E164.finditer(text) if "+" in text else ():
        start, end = m.span()
        stop = next((c for c in cards if start < c < end), end)  # a card that follows is no part of it
        best = 0
        for k in range(start + 1, min(end, stop)):
            if not text[k].isdigit() or (after := text[k + 1 : k + 2]).isalnum() or after == "_":
                continue
            n = len(_digits(text[start : k + 1]))
            if n >= 7:
                best = k + 1
                if re.search(r"\d{6}$", text[start:best]) and after == " ":
                    break  # a long last group: what follows is another number
        if best and not _PLUS.match(text, start):
            found.append((start, best, "PHONE", _national(text[start:best])))
    found += [(m.start(), m.end(), "PHONE", _national(m[0])) for m in _PLUS.finditer(text)] if "+" in text else []
    return found


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities, in order and apart. Names come as one
    entity for each part: GIVEN_M, GIVEN_F, GIVEN_N, SURNAME."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "EMAIL", _lower(m[0])) for m in _EMAIL.finditer(text)]
    found += _numbers(text)
    if "(" in text:
        found += [(m.start(), m.end(), "PHONE", _digits(m[0])[-10:]) for m in _PAREN.finditer(text)]
    found += [(m.start(1), m.end(1), "SECRET", _lower(m[1])) for m in _SECRET.finditer(text)]
    for m in _IBAN.finditer(text):
        if _mod97(m[0].replace(" ", "")) == 1:
            found.append((m.start(), m.end(), "IBAN", m[0].replace(" ", "")))
    for m in _TITLE.finditer(text):
        parts: list[re.Match] = []
        while len(parts) < 3 and (p := _NAME.match(text, parts[-1].end() if parts else m.end())):
            small, capital = p[1][0].title() != p[1][0], p[1][0].isupper()
            if small or parts and not capital or p[1] in _TITLES:  # scripts without capitals: one word
                break
            parts.append(p)
        for p in parts:
            kind = "SURNAME" if p is parts[-1] else f"GIVEN_{_TITLES[m[1]]}"
            name = _lower(p[1])
            if kind == "SURNAME" and _TITLES[m[1]] == "F" and name.endswith("ва"):
                name = name[:-1]  # the female form of a Russian surname
            found.append((p.start(1), p.end(1), kind, name))
    out: list[tuple[int, int, str, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\0".join(map(str, parts)).encode(), "sha256"), "big")


def _feistel(x: int, size: int, key: bytes, what: str, back: bool) -> int:
    """A keyed permutation of range(size), walking cycles of one on a * b >= size."""
    a = int(size**0.5) + 1 if size < 1 << 100 else 1 << (size.bit_length() + 1) // 2
    b = -(-size // a)
    while True:
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            # alternately the high part is moved by the low one, and the low by the high
            high, low = divmod(x, b)
            if r % 2:
                low = (low + (-1 if back else 1) * _number(key, what, size, r, high)) % b
            else:
                high = (high + (-1 if back else 1) * _number(key, what, size, r, low)) % a
            x = high * b + low
        if x < size:
            return x


def moved(x: int, size: int, key: bytes, what: str, attempt: int) -> int:
    if size < 2:
        return x
    step = 1 + _number(key, what, size, "step", attempt) % (size - 1)  # never 0, so no string stays
    return _feistel((_feistel(x, size, key, what, False) + step) % size, size, key, what, True)


@lru_cache(maxsize=4096)
def _peers(c: str) -> str:
    """Letters or digits of c's script and case that stand near it, in order."""
    kind, script, first = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0], ord(c) & ~127
    near = (x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and _upper(x).lower() == x.lower())
    return "".join(x for x in near if _lower(x) == x and unicodedata.name(x, "").split(" ")[0] == script)


def _upper(c: str) -> str:
    """The capital, where that is one sign and leads back."""
    return u if len(u := c.upper()) == 1 and u.lower() == c else c


def _alphabet(c: str, hexadecimal: bool) -> tuple[int, int] | None:
    """(place, number) of a sign among those it may be exchanged for."""
    if c in "0123456789" or hexadecimal and c in "abcdef":
        return (int(c, 16), 16) if hexadecimal else (int(c), 10)
    if (found := next(((ord(c) - a, b - a + 1) for a, b in _SCRIPTS if a <= ord(c) <= b), None)) or not c.isalnum():
        return found
    near = _peers(c)
    return (near.index(c), len(near)) if c in near and len(near) > 1 else None


def _sign(place: int, c: str, hexadecimal: bool) -> str:
    if c in "0123456789" or hexadecimal and c in "abcdef":
        return "0123456789abcdef"[place]
    first = next((a for a, b in _SCRIPTS if a <= ord(c) <= b), None)
    return _peers(c)[place] if first is None else chr(first + place)


def shaped(text: str, what: str) -> tuple[list, int, int, str]:
    """(place and number of each sign, number of the text among those of its shape, how many there
    are, the shape)."""
    hexadecimal = what == "SECRET" and re.fullmatch("[0-9a-f]+", text) is not None
    places = [_alphabet(c, hexadecimal) for c in text]
    x, size, shape = 0, 1, "".join("#" if p and p[1] in (10, 16) else c if p is None else chr(0xE000 + p[1] % 4096) for p, c in zip(places, text, strict=True))
    for p in places:
        if p:
            x, size = x * p[1] + p[0], size * p[1]
    return places, x, size, shape


def permuted(text: str, key: bytes, what: str, attempt: int) -> str:
    """Another string of the same shape: digits for digits, letters for letters of the script. A text
    with nothing to exchange becomes syllables."""
    places, x, size, shape = shaped(text, what)
    hexadecimal = what == "SECRET" and re.fullmatch("[0-9a-f]+", text) is not None
    if size < 2:
        return _spoken(_number(key, what, text, attempt), _LATIN, max(4, len(text)) + attempt)
    x = moved(x, size, key, f"{what}/{shape}", attempt)
    out = list(text)
    for k in range(len(text) - 1, -1, -1):
        if p := places[k]:
            x, place = divmod(x, p[1])
            out[k] = _sign(place, text[k], hexadecimal)
    return "".join(out)


def _syllables(name: str, kind: str, key: bytes, attempt: int) -> str:
    if all(0x400 <= ord(c) < 0x530 or not c.isalpha() for c in name):
        parts, ends = _CYRILLIC, {"GIVEN_M": "н", "GIVEN_F": "на", "GIVEN_N": "", "SURNAME": "нов"}
    elif all(ord(c) < 0x250 or not c.isalpha() for c in name):
        parts, ends = _LATIN, {"GIVEN_M": "n", "GIVEN_F": "na", "GIVEN_N": "", "SURNAME": "r"}
    else:
        return permuted(name + next((c for c in reversed(name) if _alphabet(c, False)), "") * attempt, key, kind, attempt)
    return _spoken(_number(key, kind, name, attempt), parts, (2 if kind[0] == "G" else 3) + attempt) + ends[kind]


def _spoken(x: int, parts: list[str], n: int) -> str:
    """n syllables; x has 256 bits, which tell 40 apart."""
    out = ""
    for _ in range(min(n, 40)):
        x, k = divmod(x, len(parts))
        out += parts[k]
    return out


@lru_cache(maxsize=20_000)
def surrogate(kind: str, canonical: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Canonical form of the entity's surrogate."""
    if kind[0] == "G" or kind == "SURNAME":
        return _syllables(canonical, kind, key, attempt)
    if kind == "CARD":
        issuer = canonical[: 4 if canonical[0] == "2" else 1]
        body = issuer + permuted(canonical[len(issuer) : -1], key, f"CARD{issuer}", attempt)
        return body + str(-luhn(body + "0") % 10)
    if kind == "IP":
        x = 0
        for o in canonical.split("."):
            x = x << 8 | int(o)
        x = moved(x, 1 << 32, key, "IP", attempt)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "IBAN":
        rest = permuted(canonical[4:].lower(), key, f"IBAN{canonical[:2]}", attempt).upper()
        return f"{canonical[:2]}{98 - _mod97(canonical[:2] + '00' + rest):02d}{rest}"
    if kind == "EMAIL":
        user, _, domain = canonical.partition("@")
        stem, dot, tld = domain.rpartition(".")
        return permuted(user + "a" * attempt, key, "EMAIL", attempt) + "@" + permuted(stem, key, f"DOMAIN{tld}", 0) + dot + tld
    return permuted(canonical + "a" * attempt * (kind == "SECRET"), key, kind, attempt)


def room(kind: str, canonical: str) -> tuple[str, int]:
    """Shape and number (2 ** 62 at most) of the surrogates an entity of a fixed length may have;
    ("", 0) for those that grow."""
    if kind == "CARD":
        issuer = canonical[: 4 if canonical[0] == "2" else 1]
        return f"{issuer}/{len(canonical)}", 10 ** (len(canonical) - len(issuer) - 1)
    if kind == "IP":
        return "", 1 << 32
    if kind in ("SSN", "PHONE"):
        return str(len(canonical)), 10 ** len(canonical)
    if kind == "IBAN":
        _, _, size, shape = shaped(canonical[4:].lower(), kind)
        return canonical[:2] + shape, min(size, 1 << 62)
    return "", 0


def dressed(found: str, kind: str, new: str) -> str:
    """The surrogate in the format the entity was found in."""
    if kind in ("PHONE", "CARD", "SSN", "IBAN"):
        signs = [k for k, c in enumerate(found) if c.isalnum()][-len(new) :]
        out = list(found)
        for k, c in zip(signs, new, strict=True):
            out[k] = c
        return "".join(out)
    if kind[0] == "G" or kind == "SURNAME":
        if kind == "SURNAME" and new.endswith("ов") and _lower(found).endswith("ва"):
            new += "а"
        return "".join(map(_upper, new)) if found.isupper() and len(found) > 1 else _upper(new[:1]) + new[1:] if found[:1].isupper() else new
    if len(new) == len(found):
        return "".join(_upper(n) if f.isupper() else n for f, n in zip(found, new, strict=True))
    return new


def replace(text: str, attempts: dict, key: bytes = KEY) -> tuple[str, list[dict]]:
    """The text with surrogates, and their types and places in it."""
    out, spans, at, length = [], [], 0, 0
    for start, end, kind, canonical in detect(text):
        new = dressed(text[start:end], kind, surrogate(kind, canonical, attempts.get((kind, canonical), 0), key))
        out += [text[at:start], new]
        length += start - at
        spans.append({"type": kind, "start": length, "end": length + len(new)})
        length += len(new)
        at = end
    return ("".join([*out, text[at:]]) if spans else text), spans


def entities(docs: DataFrame) -> DataFrame:
    """The distinct (type, canonical) of all texts, written."""

    def run(stream):
        for big in stream:
            own: set[tuple[str, str]] = set()
            for text in big.column(0):
                own.update(e[2:] for e in detect(text.as_py() or ""))
            rows = sorted(own)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["type", "canonical"])

    return common.materialize(common.narrow(docs).select("text").mapInArrow(run, "type string, canonical string").distinct(), "entities")


def other_attempts(own: DataFrame, key: bytes = KEY) -> DataFrame:
    """(type, canonical, attempt) of the entities whose attempt is not 0, written: with them no two
    entities of a type have one surrogate, and none has a surrogate that is an entity (but for the
    shapes of which the texts hold over half)."""
    kinds = [("type", pa.string()), ("canonical", pa.string()), ("attempt", pa.int32()), ("free", pa.bool_()), ("surrogate", pa.string())]

    def run(stream):
        for batch in stream:
            new = [surrogate(k, c, a, key) for k, c, a in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(new, pa.string())], names=[k for k, _ in kinds])

    def measure(stream):
        for batch in stream:
            rooms = [room(k, c) for k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rooms], t) for k, t in enumerate((pa.string(), pa.int64())))], names=["type", "canonical", "shape", "room"])

    fixed = common.materialize(own.filter(F.col("type").isin("CARD", "IP", "SSN", "PHONE", "IBAN")).select("type", "canonical").mapInArrow(measure, "type string, canonical string, shape string, room long"), "rooms")
    crowded = common.materialize(fixed.groupBy("type", "shape", "room").agg(F.count("*").alias("n")).filter("2 * n > room").select("type", "shape"), "crowded")
    free = F.lit(False)
    state = own.select("type", "canonical", F.lit(0).alias("attempt"))
    if crowded.isEmpty():
        state = state.withColumn("free", free)
    else:
        full = fixed.join(crowded, ["type", "shape"]).select("type", "canonical", F.lit(True).alias("free"))
        state = state.join(full, ["type", "canonical"], "left").select("type", "canonical", "attempt", F.coalesce("free", free).alias("free"))
    real = own.select("type", F.col("canonical").alias("surrogate"), F.lit(True).alias("taken"))
    while True:
        made = common.materialize(state.mapInArrow(run, "type string, canonical string, attempt int, free boolean, surrogate string"), "surrogates")
        held = made.filter("NOT free").groupBy("type", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        first = common.materialize(held.join(real, ["type", "surrogate"], "left").filter("n > 1 OR taken").select("type", "surrogate", "first.canonical", "taken"), "collisions")
        if first.isEmpty():
            return made.filter("attempt > 0").select("type", "canonical", "attempt")
        clash = made.join(first.withColumnRenamed("canonical", "first"), ["type", "surrogate"], "left")
        again = ~F.col("free") & F.coalesce(F.col("taken") | (F.col("first") != F.col("canonical")), F.lit(False))
        state = clash.select("type", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt"), "free")


SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def anonymise(docs: DataFrame, key: bytes = KEY, spans: str | None = None) -> DataFrame:
    """docs with surrogates in ``text``; ``spans`` names a column for their types and places."""
    own = entities(docs)
    other = other_attempts(own, key)
    per_row = None
    if other.count() <= FEW:
        listed = {(r["type"], r["canonical"]): r["attempt"] for r in other.toLocalIterator()}
        held = docs.sparkSession.sparkContext.broadcast(listed)
    else:
        held = docs.sparkSession.sparkContext.broadcast({})
        docs, per_row = _attempts_by_row(docs, other)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + ([T.StructField(spans, SPANS)] if spans else []))
    text_at, names = docs.columns.index("text"), schema.names

    def run(stream):
        for big in stream:
            for batch in common.batches(big):
                attempts = batch.column(per_row).to_pylist() if per_row else [None] * batch.num_rows
                new = [(None, []) if t is None else replace(t, {(x["type"], x["canonical"]): x["attempt"] for x in a} if a else held.value, key) for t, a in zip(batch.column(text_at).to_pylist(), attempts, strict=True)]
                columns = list(batch.columns)
                columns[text_at] = pa.array([t for t, _ in new], pa.string())
                if spans:
                    columns.append(pa.array([s for _, s in new], pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, schema)
    return out.drop(per_row) if per_row else out


def anonymise_documents(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """anonymise, and n_chars, where there is one, counts the new text if the text changed."""
    out = anonymise(docs, key, spans="_entities")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_entities") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _attempts_by_row(docs: DataFrame, other: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that lists the attempts that matter in each row."""

    def run(stream):
        for big in stream:
            rows = [(r, k, c) for r, t in zip(*(x.to_pylist() for x in big.columns), strict=True) for k, c in {e[2:] for e in detect(t or "")}]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["_row", "type", "canonical"])

    numbered = common.materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    met = numbered.select("_row", "text").mapInArrow(run, "_row long, type string, canonical string").join(other, ["type", "canonical"])
    met = common.materialize(met.groupBy("_row").agg(F.collect_list(F.struct("type", "canonical", "attempt")).alias("_attempts")), "row-attempts")
    return numbered.join(met, "_row", "left").drop("_row"), "_attempts"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return anonymise(docs, spans="entities").select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")
