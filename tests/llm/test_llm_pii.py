import random
import re

import pytest
import samples

from cohortlens.llm import pii

KEY = b"test"


@pytest.mark.parametrize(
    ("kind", "made"),
    [
        ("card", lambda r: "".join(r.choices("0123456789", k=16))),
        ("phone", lambda r: f"+1 ({r.randint(0, 999):03d}) 555-{r.randint(0, 9999):04d}"),
        ("ip", lambda r: ".".join(str(r.randint(0, 255)) for _ in range(4))),
        ("email", lambda r: f"{''.join(r.choices('abcdeé', k=4))}.{r.randint(0, 99)}@mail{r.randint(0, 9)}.example.com"),
        ("hex", lambda r: "".join(r.choices("0123456789abcdef", k=40))),
        ("access", lambda r: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOP0123456789", k=16))),
        ("social", lambda r: f"{r.randint(0, 999):03d}-{r.randint(0, 99):02d}-{r.randint(0, 9999):04d}"),
        ("person", lambda r: "".join(r.choices("abcdemnüж", k=3)).capitalize() + " " + r.choice(["Anna", "Paul", "Weber"])),
    ],
)
def test_surrogates_keep_type_and_format_and_stay_distinct(kind, made):
    rng = random.Random(1)
    given = {made(rng) for _ in range(3000)}
    out = {}
    for e in given:
        s = pii.surrogate(e, kind, KEY)
        assert s == pii.surrogate(e, kind, KEY) and len(s) == len(e) or kind in ("ip", "person")
        assert pii.surrogate(e, kind, b"other") != s or kind == "person"
        if kind not in ("ip", "person"):
            assert re.sub(r"\d", "0", re.sub("[a-fA-F]", "0", s) if kind == "hex" else re.sub("[^\\W\\d]", "0", s)) == re.sub(
                r"\d", "0", re.sub("[a-fA-F]", "0", e) if kind == "hex" else re.sub("[^\\W\\d]", "0", e)
            )
        out[pii.canonical(s, kind)] = e
        found = pii.find(f"token = {s}" if kind == "secret" else f"Mr {s} x" if kind == "person" else f"see {s} here")
        assert [k for _, _, k in found] == [kind]
    assert len(out) == len({pii.canonical(e, kind) for e in given})


def test_permutation_is_one():
    for left, right in ((10, 10), (7, 13), (1, 50), (26, 10)):
        assert sorted(pii.permute(i, left, right, KEY, "t") for i in range(left * right)) == list(range(left * right))


def test_details_of_kinds():
    valid = "4111 1111 1111 1111"
    made = pii.surrogate(valid, "card", KEY)
    assert pii._luhn(made.replace(" ", "")) and made[4] == " "
    account = pii.surrogate("DE89 3704 0044 0532 0130 00", "account", KEY)
    turned = account.replace(" ", "")[4:] + account[:4]
    assert int("".join(str(int(c, 36)) for c in turned)) % 97 == 1
    assert pii.surrogate("10.1.2.3", "ip", KEY).split(".")[0] in ("10", "172", "192")
    assert pii.surrogate("Maria", "person", KEY).lower() in pii.GIVEN[1]
    assert pii.surrogate("JOHN Smith", "person", KEY).split()[0].lower() in pii.GIVEN[0]
    russian = pii.surrogate("Иванова", "person", KEY)
    assert russian.endswith("а") and all("а" <= c <= "я" for c in russian.lower())
    assert pii.surrogate("a.B@Mail.com", "email", KEY).lower() == pii.surrogate("A.b@mail.com", "email", KEY).lower()


def test_texts_without_entities_stay(spark):
    for text in ("version 3.", "Licensed under CC BY-NC 4.0.", "1.2.3.4.5", "on 12-05 at 7", "a@b", "drives Mr", "x = 5"):
        assert pii.replace(text, {}, KEY, {}) == (text, {})


def test_tables_of_any_rows(spark):
    texts = [
        "mail a.b@x.com and A.B@X.com",
        "call +1 (017) 555-7713 or a.b@x.com",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"; password=e3b3ed3cc8548923d6',
        "Dear Mrs. Anna Weber, Mr Weber and Frau weber",
    ]
    docs = samples.documents(spark, [(100 + i, t) for i, t in enumerate(texts)])
    safe = pii.protect(docs, KEY, ("found", "what"))
    assert safe.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "text"]
    rows = {r["doc_id"]: r for r in safe.collect()}
    assert safe.count() == docs.count()
    one, two = rows[100]["text"].split()[1::2]
    assert one.lower() == two.lower() and one in rows[101]["text"] and "x.com" not in one
    assert (rows[102]["found"], rows[102]["what"]) == (2, "secret:2")
    assert rows[103]["what"] == "person:2" and "Weber" not in rows[103]["text"] and "weber" in rows[103]["text"]
    untouched = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 100}
    assert all(rows[i]["text"] == (t or "") and rows[i]["found"] == 0 for i, t in untouched.items())
    assert pii.protect(samples.empty(spark), KEY).count() == 0


def test_collisions_with_true_values_are_moved_on(spark):
    """Six digits leave a surrogate a fair chance to be somebody else's number."""
    rng = random.Random(4)
    numbers = sorted({f"+1 ({rng.randint(0, 99):02d}) {rng.randint(0, 99):02d}-{rng.randint(0, 99):02d}" for _ in range(4000)})
    docs = samples.documents(spark, [(1000 + i, f"call {n} now") for i, n in enumerate(numbers)])
    plain = {pii.surrogate(n, "phone", KEY) for n in numbers}
    assert plain & set(numbers)
    rows = [r["text"] for r in pii.protect(docs, KEY).collect() if r["doc_id"] is not None and r["doc_id"] >= 1000]
    made = [t.removeprefix("call ").removesuffix(" now") for t in rows]
    assert len(set(made)) == len(numbers)
    assert not set(made) & set(numbers)


def test_formats_without_free_values(spark):
    """All listed names occur, so each surrogate of a listed name is a true value."""
    given = [n.capitalize() for n in pii.GIVEN[0]]
    docs = samples.documents(spark, [(1000 + i, f"Mr {n} came") for i, n in enumerate(given)] + [(2000, "MR JOHN or Mr JOHN came")])
    rows = {r["doc_id"]: r["text"] for r in pii.protect(docs, KEY).collect() if r["doc_id"] is not None}
    made = [rows[1000 + i].split()[1] for i in range(len(given))]
    assert len(set(made)) == len(given) and not set(made) & set(given)
    assert rows[2000].split()[4] == made[given.index("John")].upper()


@pytest.mark.parametrize("entity", ["李明@例子.com", "さくら@れい.com", "محمد@مثال.com", "דוד@דוגמה.com", "สมชาย@ตย.com", "_@_.com", "١٢٣@٤٥.com"])
def test_letters_of_other_scripts_move(spark, entity):
    if entity != "_@_.com":
        made = pii.surrogate(entity, "email", KEY)
        changed = [a != b for a, b in zip(entity[:-4], made[:-4], strict=True)]
        assert sum(changed) >= 2 and [k for _, _, k in pii.find(made)] == ["email"]
        assert all(ord(a) >> 8 == ord(b) >> 8 for a, b in zip(entity, made, strict=True))
    docs = spark.createDataFrame([(1, f"write to {entity} now")], "doc_id long, text string")
    assert entity not in pii.protect(docs, KEY).first()["text"]
