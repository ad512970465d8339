"""Personal data: found entities give way to keyed surrogates of the same type and format.

Found are e-mail addresses, telephone, card, account and social security numbers, IP addresses,
access keys and secrets, and names after a title. A surrogate is the entity under a keyed
permutation of all strings of its format: a Feistel network over the alphabets of its characters, so
digits stay digits, letters keep their script or Unicode page, case and, in names, vowels and consonants. Listed
given names move within the list of their gender. Check digits are valid where they were, IP
addresses stay in their kind of range. One key and one entity always give one surrogate, in all
documents, whatever the case it is written in; different entities cannot share one.

What a permutation cannot promise is that a surrogate is not the true value of somebody else in the
corpus. The distinct entities are therefore checked against each other as tables, and colliding ones
get the next permutation until no collision is left. After ``SAME`` permutations a name, e-mail
address, telephone number or secret becomes longer, by two characters more at each attempt, so small
formats cannot run out; if collisions were left after ``LAST`` attempts, the job would fail.

Null and empty texts become empty texts without entities. Repeated rows are replaced alike. Extra
columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import SLICE, lean, long, string as text_field, small_batches
from cohortlens.session import cut_lineage

KEY = b"surrogates"
ROUNDS = 10
#: Attempts that keep an entity's format, and those after which the job fails.
SAME, LAST = 6, 60
#: Rows of exceptions up to which they are sent to all executors.
SENT_ROWS = 100_000

# Frequent given names by gender, and titles of persons.
GIVEN = (
    "james john robert michael william david richard joseph thomas charles peter paul hans klaus jean "
    "pierre luis carlos juan antonio".split(),
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria julia ursula "
    "marie sophie lucia carmen isabel elena".split(),
)
TITLES = "Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Господин|Госпожа"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBERS = re.compile(
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w))"
    r"|(?P<account>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w.-])\d{4}([ -]?)\d{4}\4\d{4}\4\d{1,7}(?![\w-]))"
    r"|(?P<social>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<access>(?<!\w)AKIA[0-9A-Z]{16}(?!\w))"
    r"|(?P<hex>(?<!\w)(?=[0-9a-f]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w))"
)
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_SECRET = re.compile(
    r"(?:password|passwd|secret|token|api[_-]?key)\s?[:=]\s?[\"']?(?P<secret>[\w/+-]{8,})", re.IGNORECASE
)
_NAME = re.compile(
    rf"\b(?:{TITLES})\.? (?P<person>[^\W\d_][^\W\d_]+(?:[ -](?=[^\W\d_]+)[^\W\d_][^\W\d_]+){{0,2}})"
)

#: Texts in which this isn't found have no entities.
_LIKELY = rf"[0-9@]|AKIA|\b(?:{TITLES})\b"

KINDS = ("email", "secret", "ip", "account", "card", "social", "phone", "access", "hex", "person")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span("secret"), "secret") for m in _SECRET.finditer(text) if _looks_secret(m["secret"])]
    if re.search(r"\d|AKIA", text):
        found += [(*m.span(), m.lastgroup) for m in _NUMBERS.finditer(text)]
    for m in _NAME.finditer(text):
        words = re.split(r"([ -])", m["person"])
        if not words[0][0].isupper():
            continue
        # A name goes on as long as its words begin with a capital.
        taken = len(words[0])
        for sign, word in zip(words[1::2], words[2::2], strict=True):
            if not word[0].isupper():
                break
            taken += len(sign) + len(word)
        found.append((m.start("person"), m.start("person") + taken, "person"))
    found.sort(key=lambda f: (f[0], -f[1]))
    out, reached = [], 0
    for start, end, kind in found:
        if start >= reached:
            out.append((start, end, kind))
            reached = end
    return out


def _looks_secret(value: str) -> bool:
    return any(c.isdigit() for c in value)


# ---- permutations

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_ALPHABETS = (
    string.digits,
    string.ascii_lowercase,
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
)
_HEX = (string.digits + "abcdef",)
_SPOKEN = (string.digits, _VOWELS, _CONSONANTS, *_ALPHABETS[2:])


def _class(c: str) -> tuple[str, bool, bool]:
    upper = c.upper()
    return unicodedata.category(c), len(upper) == 1 and upper.lower() == c, upper == c


@cache
def _page(c: str) -> str:
    """The letters or digits like ``c`` among the 256 characters around it."""
    if not c.isalnum() or c != c.lower():
        return ""
    first = ord(c) & ~255
    near = (chr(i) for i in range(first, first + 256))
    return "".join(x for x in near if x.isalnum() and x == x.lower() and _class(x) == _class(c))


def _round(key: bytes, tweak: str, step: int, value: int, size: int) -> int:
    data = f"{tweak}\0{step}\0{value}".encode()
    width = (size.bit_length() + 7) // 8 + 8
    out, block = b"", 0
    while len(out) < width:
        out += hashlib.blake2b(data + b"\0%d" % block, key=key, digest_size=64).digest()
        block += 1
    return int.from_bytes(out[:width], "big") % size


def permute(value: int, left: int, right: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers below ``left * right``."""
    a, b = divmod(value, right)
    for step in range(ROUNDS):
        if step % 2:
            b = (b + _round(key, tweak, step, a, right)) % right
        else:
            a = (a + _round(key, tweak, step, b, left)) % left
    return a * right + b


def shuffled(text: str, alphabets: tuple[str, ...], key: bytes, tweak: str) -> str:
    """``text`` permuted among the strings of its format; other characters stay.

    Letters are permuted in lower case and get the case of their place, so that different cases of
    one string stay one.
    """
    places, letters, sizes = [], [], []
    for i, c in enumerate(text):
        low = c.lower()
        if len(low) != 1:
            continue
        alphabet = next((a for a in alphabets if low in a), None) or _page(low)
        if alphabet:
            places.append((i, alphabet, c != low))
            letters.append(alphabet.index(low))
            sizes.append(len(alphabet))
    if not places:
        return text
    form = "".join(str(alphabets.index(a)) if a in alphabets else f"<{a[0]}>" for _, a, _ in places)
    fixed = "".join(c.lower() for i, c in enumerate(text) if i not in {p for p, _, _ in places})
    half = len(sizes) // 2
    left = right = 1
    for s in sizes[:half]:
        left *= s
    for s in sizes[half:]:
        right *= s
    value = 0
    for digit, s in zip(letters, sizes, strict=True):
        value = value * s + digit
    value = permute(value, left, right, key, f"{tweak}|{form}|{fixed}")
    out = list(text)
    for (i, alphabet, upper), s in zip(reversed(places), reversed(sizes), strict=True):
        value, digit = divmod(value, s)
        out[i] = alphabet[digit].upper() if upper else alphabet[digit]
    made = "".join(out)
    return made.upper() if text != text.lower() and text == text.upper() else made


def _walk(value: str, step: Callable[[str], str], fits: Callable[[str], bool]) -> str:
    """Permutes until the result fits; a permutation again of the values that fit."""
    out = step(value)
    while not fits(out):
        out = step(out)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _country(phone: str) -> str:
    found = re.match(r"\+\d{1,3}(?=[ .(-])", phone)
    return found[0] if found else ""


def _ip_kind(octets: list[int]) -> str:
    a, b = octets[:2]
    if a == 10 or (a == 172 and 16 <= b < 32) or (a == 192 and b == 168):
        return "private"
    return "special" if a in (0, 127) or a >= 224 else "public"


def surrogate(entity: str, kind: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The entity's replacement; ``attempt`` chooses another permutation."""
    tweak = f"{kind}#{attempt}"
    more = 2 * max(0, attempt - SAME + 1)
    if kind == "email":
        local, domain = entity.split("@", 1)
        host, _, ending = domain.rpartition(".")
        changed = shuffled(f"{local}@{host}", _SPOKEN, key, tweak)
        longer = _longer(canonical(entity, kind), string.ascii_lowercase, more, key, tweak)
        return f"{changed.replace('@', longer + '@')}.{ending}"
    if kind == "ip":
        octets = [int(x) for x in entity.split(".")]
        sort = _ip_kind(octets)
        n = int.from_bytes(bytes(octets), "big")
        while True:
            n = permute(n, 1 << 16, 1 << 16, key, tweak)
            octets = list(n.to_bytes(4, "big"))
            if _ip_kind(octets) == sort:
                return ".".join(map(str, octets))
    if kind == "card":
        digits = re.sub(r"\D", "", entity)
        valid = _luhn(digits)
        changed = _walk(digits, lambda d: shuffled(d, _ALPHABETS, key, tweak), lambda d: _luhn(d) == valid)
        given = iter(changed)
        return re.sub(r"\d", lambda _: next(given), entity)
    if kind == "account":
        compact = entity.replace(" ", "")
        body = shuffled(compact[4:], _ALPHABETS, key, f"{tweak}{compact[:2]}")
        spelled = "".join(str(int(c, 36)) for c in body + compact[:2])
        check = 98 - int(spelled + "00") % 97
        given = iter(f"{compact[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(given) for c in entity)
    if kind == "phone":
        country = _country(entity)
        digits = re.sub(r"\D", "", entity[len(country) :])
        given = iter(shuffled(digits, _ALPHABETS, key, f"{tweak}{country}"))
        longer = _longer(canonical(entity, kind), string.digits, more, key, tweak)
        return country + re.sub(r"\d", lambda _: next(given), entity[len(country) :]) + longer
    if kind == "access":
        return entity[:4] + shuffled(entity[4:], _ALPHABETS, key, tweak)
    if kind == "hex" or (kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", entity)):
        return shuffled(entity, _HEX, key, f"hex#{attempt}")
    if kind == "person":
        *before, last = re.split("([ -])", entity)
        made = [_name(part, key, attempt) if part not in " -" else part for part in before]
        end = last[-1].lower()
        alphabet = next((a for a in _ALPHABETS[1:] if end in a), string.ascii_lowercase)
        longer = _longer(canonical(entity, kind), alphabet, more, key, tweak)
        return "".join([*made, _name(last, key, attempt, longer)])
    longer = _longer(entity, string.ascii_lowercase, more if kind == "secret" else 0, key, tweak)
    return shuffled(entity, _ALPHABETS, key, tweak) + longer


def _longer(entity: str, alphabet: str, n: int, key: bytes, tweak: str) -> str:
    """``n`` keyed characters for an entity whose format has no free value."""
    return "".join(alphabet[_round(key, f"{tweak}|{entity}", i, n, len(alphabet))] for i in range(n))


def _name(word: str, key: bytes, attempt: int, longer: str = "") -> str:
    """A part of a name: listed given names by gender, others by sound; never a listed name unless
    it was one. ``longer`` goes before the last letter."""
    low = word.lower()
    for gender, listed in enumerate(GIVEN):
        if low in listed:
            at = listed.index(low)
            while True:
                at = permute(at, 5, 5, key, f"given{gender}#{attempt}")
                if at < len(listed):
                    return _cased(listed[at][:-1] + longer + listed[at][-1], word)
    plain = {n for listed in GIVEN for n in listed}
    # The last letter often tells the gender, so it stays.
    out = _walk(
        low, lambda w: shuffled(w[:-1], _SPOKEN, key, f"name#{attempt}|{w[-1]}") + w[-1], lambda w: w not in plain
    )
    return _cased(out[:-1] + longer + out[-1], word)


def _cased(word: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def canonical(entity: str, kind: str) -> str:
    """The form in which different spellings of an entity are one."""
    if kind == "card":
        return re.sub(r"\D", "", entity)
    if kind == "phone":
        country = _country(entity)
        return f"{country} {re.sub(r'\D', '', entity[len(country) :])}".strip()
    if kind == "account":
        return entity.replace(" ", "")
    return entity.lower() if kind in ("email", "person", "hex") else entity


def replace(text: str, attempts: dict[str, int], key: bytes, known: dict) -> tuple[str, dict[str, int]]:
    """``text`` with surrogates, and the number of entities of each kind."""
    out, at, kinds = [], 0, {}
    for start, end, kind in find(text):
        entity = text[start:end]
        made = known.get((kind, entity))
        if made is None or attempts:
            attempt = attempts.get(f"{kind} {canonical(entity, kind)}", 0)
            made = surrogate(entity, kind, key, attempt)
            if not attempts:
                known[kind, entity] = made
        out += [text[at:start], made]
        at = end
        kinds[kind] = kinds.get(kind, 0) + 1
    out.append(text[at:])
    return "".join(out), kinds


# ---- tables


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of all texts, the entity in canonical form."""
    out = T.StructType([text_field("kind"), text_field("entity")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = {
                    (kind, canonical(text[a:b], kind))
                    for text in batch.column(0).slice(at, SLICE).to_pylist()
                    for a, b, kind in find(text)
                }
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], schema=to_arrow_schema(out)
                )

    return small_batches(docs).where(F.col("text").rlike(_LIKELY)).select("text").mapInArrow(lean(run), out).distinct()


def _with_surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    out = T.StructType([*rows.schema.fields, text_field("made")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, tries = (batch.column(i).to_pylist() for i in range(3))
            made = [
                canonical(surrogate(v, k, key, t), k) for k, v, t in zip(kinds, values, tries, strict=True)
            ]
            # A surrogate that holds its whole entity hides nothing; it collides like the entity itself.
            made = [v if v in m else m for v, m in zip(values, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.string())], schema=to_arrow_schema(out)
            )

    return rows.mapInArrow(lean(run), out)


def exceptions(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, attempt) of entities whose first surrogate collides; stored, often empty."""
    current = cut_lineage(
        _with_surrogates(found.select("kind", "entity", F.lit(0).alias("attempt")), key)
    )
    while True:
        # Somebody's true value, or another entity's surrogate (the smallest entity keeps it). A
        # surrogate equal to its own entity counts as a collision, too.
        true = current.select("kind", F.col("entity").alias("made")).distinct()
        taken = current.join(true, ["kind", "made"], "left_semi").select("kind", "entity")
        first = current.groupBy("kind", "made").agg(
            F.min("entity").alias("entity"), F.count(F.lit(1)).alias("n")
        )
        twice = (
            current.join(first.where("n > 1").select("kind", "made", F.col("entity").alias("first")), ["kind", "made"])
            .where("entity <> first")
            .select("kind", "entity")
        )
        again = cut_lineage(taken.unionByName(twice).distinct())
        if again.isEmpty():
            break
        if current.agg(F.max("attempt")).first()[0] >= LAST:
            raise RuntimeError(f"{again.count()} surrogates collide after {LAST} attempts")
        redone = current.join(again, ["kind", "entity"], "left_semi").select(
            "kind", "entity", (F.col("attempt") + 1).alias("attempt")
        )
        kept = current.join(again, ["kind", "entity"], "left_anti")
        current = cut_lineage(kept.unionByName(_with_surrogates(redone, key)))
    return current.where("attempt > 0").select("kind", "entity", "attempt")


def protect(
    docs: DataFrame, key: bytes = KEY, names: tuple[str, str] = ("n_entities", "kinds")
) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` replaced, plus their number and kinds of entities.

    ``names`` are those of the two new columns; columns of ``docs`` with these names are replaced.
    """
    odd = cut_lineage(exceptions(cut_lineage(entities(docs)), key))
    count = odd.count()
    rows = docs.withColumn("__attempts", F.lit(None).cast("string"))
    if count:
        rows = _with_attempts(docs, odd, count <= SENT_ROWS)

    passed = [c for c in docs.columns if c.lower() not in ("text", names[0].lower(), names[1].lower())]
    out = T.StructType(
        [*[docs.schema[c] for c in passed], text_field("text"), long(names[0]), text_field(names[1])]
    )
    n = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                if len(known) > 20_000:
                    known.clear()
                made = [
                    replace(text, json.loads(tries) if tries else {}, key, known)
                    for text, tries in zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i).cast(schema.types[i]) for i in range(n)],
                        pa.array([m[0] for m in made], pa.string()),
                        pa.array([sum(m[1].values()) for m in made], pa.int64()),
                        pa.array([",".join(f"{k}:{v}" for k, v in sorted(m[1].items())) for m in made], pa.string()),
                    ],
                    schema=schema,
                )

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return small_batches(rows).select(*passed, text, "__attempts").mapInArrow(lean(run), out)


def _with_attempts(docs: DataFrame, odd: DataFrame, few: bool) -> DataFrame:
    """``docs`` with the attempts of the exceptions in each text, found by its entities."""
    out = T.StructType([long("__of"), text_field("kind"), text_field("entity")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (h, kind, canonical(text[a:b], kind))
                for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for a, b, kind in find(text)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string()))],
                schema=to_arrow_schema(out),
            )

    # Equal texts have equal entities, so a text's hash can stand for it; a false match is harmless.
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    having = hashed.where(F.col("text").rlike(_LIKELY)).select("__hash", "text").mapInArrow(lean(run), out).distinct()
    tries = (
        having.join(F.broadcast(odd) if few else odd, ["kind", "entity"])
        .groupBy("__of")
        .agg(
            F.to_json(
                F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "entity"), "attempt")))
            ).alias("__attempts")
        )
    )
    tries = cut_lineage(tries)
    small = tries.count() <= SENT_ROWS
    return hashed.join(
        F.broadcast(tries) if small else tries, hashed["__hash"] == tries["__of"], "left"
    ).drop("__of", "__hash")
