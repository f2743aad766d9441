"""Personal data: base spans against plain matching, chosen spans on disguised data, trees against all splits."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rackmeter.llm import personal

ODD = [
    "a.b@c.de a@b.com_x@c.org @x.y x@y %@-.- a@b..c q@w.e.r.t@z.a", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00255.0.0.01 1.2.3 99999999999.1.1.1",
    "4111 1111-1111 1111 4111111111111112 4111111111111111 5 5- 5  4 49927398716 0000000000000 4222-2222-2222-2", "+1 (017) 555-7713 ++49 30 (1)2 +1 +12 +1-------2 +1(2)3.4-5 6 7 8 9)) +123456789012345678 + 1",
    None, "", "日本😀 a@b.cd 😀+44 20 7946 0958é", "x" * 3000 + "@" + "y" * 3000 + ".z", "1" * 5000, "+1" + "(" * 5000, "a@b" + ".c" * 5000,
    " ".join(f"user{i}@mail.example.com +1 (555) 01{i % 10}-{1000 + i}" for i in range(700)),
]


def plain(text):
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (pattern, check) in rules.items() for m in re.finditer(pattern, text or "") if check(m)]


def test_base_spans(spark):
    rng = random.Random(2)
    rows = list(enumerate(ODD)) + [(None, "no id 9.9.9.9"), (3, ODD[0]), (3, ODD[0])]
    rows += [(100 + i, "".join(rng.choice("0123456789  ..--+()@ab_é") for _ in range(rng.randint(0, 200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS key", "3 AS c", "4 AS held")
    got = personal.find_personal(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    expected = []
    for key, text in rows:
        spans = plain(text)
        joined = ",".join(f"{k}:{a}:{e}" for k, a, e in spans)
        expected.append((key, *[sum(s[0] == k for s in spans) for k in personal.KINDS], hashlib.sha256(joined.encode()).hexdigest()))
        assert any(r.doc_id == key and set(joined.split(",")) - {""} <= set(r.spans.split(",")) for r in got)
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[:6]) for r in got), key=order) == sorted(expected, key=order)


def text_of(rng, disguised):
    number = f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    name, host = f"jo.doe{rng.randint(10, 99)}", f"mail{rng.randint(1, 9)}"
    if disguised:
        return f"please call 1 {number} or write to {name} [at] {host} [dot] example [dot] com today", f"1 {number}", f"{name} [at] {host} [dot] example [dot] com"
    return f"please call +1 {number} or write to {name}@{host}.example.com today", None, None


@pytest.fixture(scope="module")
def disguises(spark):
    rng = random.Random(8)
    rows, hidden = [], {}
    for i in range(900):
        text, *found = text_of(rng, i % 60 == 0)
        noise = f" part no 12-34-{rng.randint(100, 999)}-56 and 20{rng.randint(10, 99)} 11 12 13 of it, look at noon.then"
        rows.append((i, noise + " über " + text))
        if found[0]:
            hidden[i] = {("phone", rows[-1][1].index(found[0]), found[0]), ("email", rows[-1][1].index(found[1]), found[1])}
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows), hidden


def test_trees_add_disguised_spans_and_nothing_else(disguises):
    docs, texts, hidden = disguises
    for row in personal.find_personal(docs).collect():
        base = {f"{k}:{a}:{e}" for k, a, e in plain(texts[row.doc_id])}
        extra = set(row.spans.split(",")) - base - {""}
        expected = {f"{k}:{a}:{a + len(m)}" for k, a, m in hidden.get(row.doc_id, ())}
        assert extra == expected


def test_redaction(disguises):
    docs, texts, hidden = disguises
    model = personal.train(personal.with_candidates(docs))
    some = docs.where("doc_id < 70").withColumn("other", F.lit(1))
    for row in personal.redacted(some, model).collect():
        assert len(row) == 3 and "555" not in row.text and "doe" not in row.text
        assert row.text.count("[phone]") == row.text.count("[email]") == 1 and row.text.endswith(" today")
    odd = docs.sparkSession.createDataFrame([(1, None), (2, ""), (3, "plain é"), (4, "a@b.cd 1.2.3.4")], "doc_id long, text string")
    assert [r.text for r in personal.redacted(odd, model).orderBy("doc_id").collect()] == [None, "", "plain é", "[email] [ip]"]


def test_first_split_is_the_best_one(spark):
    rng = random.Random(9)
    rows = [tuple([rng.randint(0, 1), *[rng.randint(0, 4) for _ in personal.FEATURES], rng.randint(1, 30)]) for _ in range(150)]
    rows = [(*r, r[-1] * (0.9 if r[3] > 2 else 0.2) - r[-1] * 0.5, r[-1] * 0.25) for r in rows]
    df = spark.createDataFrame(rows, ", ".join(["kind int", *[f"{f} int" for f in personal.FEATURES], "n long", "g double", "h double"]))
    grown = personal._grow(df, 2, 1.0, 1.0, 10)
    for kind in (0, 1):
        own = [r for r in rows if r[0] == kind]

        def gain(f, v):
            side = lambda low: [r for r in own if (r[1 + f] <= v) == low]
            part = lambda some: sum(r[-2] for r in some) ** 2 / (sum(r[-1] for r in some) + 1)
            return part(side(True)) + part(side(False)) - part(own)

        best = max((round(gain(f, v), 6), -f, -v) for f in range(len(personal.FEATURES)) for v in range(4))
        assert grown[kind][0][1] == (-best[1], -best[2])


def test_plan_is_native_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    found = personal.find_personal(empty)
    assert found.collect() == []
    plan = personal.with_candidates(empty)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
