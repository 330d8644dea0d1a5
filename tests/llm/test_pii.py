"""Pseudonyms: permutations with inverses, formats kept, equal values linked, clean texts untouched."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from brambling.llm import pii_feistel as p

KEY = "k1"


def column(spark, values, make) -> list:
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize("a,b", [(10, 10), (10, 100), (17, 4297 // 61)])
def test_feistel_is_a_permutation(spark, a, b):
    df = spark.range(a * b).select(p.feistel(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), KEY, F.lit("t")).alias("s"), "id")
    back = df.select("id", "s", p.feistel(F.col("s.l"), F.col("s.r"), F.lit(a), F.lit(b), KEY, F.lit("t"), inverse=True).alias("o"))
    rows = back.collect()
    assert len({tuple(r["s"]) for r in rows}) == a * b
    assert all(0 <= r["s"]["l"] < a and 0 <= r["s"]["r"] < b and r["o"]["l"] * b + r["o"]["r"] == r["id"] for r in rows)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def test_cards(spark):
    r = random.Random(1)
    cards = ["".join(r.choice("0123456789") for _ in range(r.choice([13, 15, 16, 19]))) for _ in range(80)]
    cards += [c[:-1] + str((int(c[-1]) - luhn(c)) % 10) for c in cards]
    new = column(spark, cards, lambda c: p.permute_card(c, KEY))
    assert all(len(a) == len(b) and luhn(a) == luhn(b) for a, b in zip(cards, new)) and sum(a == b for a, b in zip(cards, new)) <= 1
    assert column(spark, new, lambda c: p.permute_card(c, KEY, inverse=True)) == cards
    assert column(spark, cards, lambda c: p.permute_card(c, "other")) != new
    assert [x == 0 for x in map(luhn, cards)] == column(spark, cards, p.luhn_valid)


def test_dates(spark):
    days = [date(1900, 1, 1), date(2099, 12, 31), date(2024, 2, 29), *(date(1950, 1, 1) + timedelta(days=137 * k) for k in range(60))]
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y"):
        text = [d.strftime(form) for d in days]
        new = column(spark, text, lambda c: p.permute_date(c, KEY))
        assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) for a, b in zip(text, new))
        assert column(spark, new, lambda c: p.permute_date(c, KEY, inverse=True)) == text
    american = [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    new = column(spark, american, lambda c: p.permute_date(c, KEY))
    assert all(int(n[3:5]) > 12 and int(n[:2]) <= 12 for n in new)
    assert column(spark, new, lambda c: p.permute_date(c, KEY, inverse=True)) == american
    assert column(spark, ["2023-02-30", "31/31/2020"], lambda c: p.permute_date(c, KEY)) == ["2023-02-30", "31/31/2020"]


def test_addresses(spark):
    ips = ["0.0.0.0", "255.255.255.255", "10.1.2.3"]
    new = column(spark, ips, lambda c: p.permute_ip(c, KEY))
    assert all(all(0 <= int(o) < 256 for o in n.split(".")) for n in new)
    assert column(spark, new, lambda c: p.permute_ip(c, KEY, inverse=True)) == ips
    mails = column(spark, ["jo.smith42@a.example", "JO.smith42@A.example", "x@b.org"], lambda c: p.mask_mail(c, KEY))
    assert mails[0] == mails[1] and re.fullmatch(r"[a-z]{2}\.[a-z]{5}[0-9]{2}@masked\.example", mails[0]) and mails[2].endswith("@masked.example")


TEXT = "Call +1 (988) 555-2485 or 988-555-2485, card 4041-8949-7460-8795 / 4041894974608795, ssn 123-45-6789, at 70.123.182.155 on 2024-02-29; a.b@x.example."


def test_text(spark):
    df = spark.createDataFrame([(1, TEXT, "a"), (2, TEXT, "b"), (3, "Version 3.0 of 2020, 12:30, 1,000,000 and 5-4", "c"), (4, None, "d"), (5, "", "e")], "doc_id long, text string, found string")
    rows = {r["doc_id"]: r for r in p.pseudonymise(df, KEY, counts=True).collect()}
    assert rows[1]["text"] == rows[2]["text"] and rows[1]["found"] == "a"
    assert re.sub("[0-9]", "9", rows[1]["text"].split(";")[0]) == re.sub("[0-9]", "9", TEXT.split(";")[0]).replace(re.sub("[0-9]", "9", "70.123.182.155"), re.sub("[0-9]", "9", rows[1]["text"].split(" at ")[1].split(" ")[0]))
    assert rows[1]["pii"] == ["phone", "phone", "card", "card", "ssn", "ip", "date", "email"]
    for secret in ("555-2485", "4041", "6789", "70.123.182.155", "2024-02-29", "a.b@"):
        assert secret not in rows[1]["text"]
    cards = re.findall(r"card (\S+) / (\d+)", rows[1]["text"])[0]
    assert cards[0].replace("-", "") == cards[1] and rows[1]["text"].startswith("Call +1 (")
    assert rows[3]["text"] == "Version 3.0 of 2020, 12:30, 1,000,000 and 5-4" and rows[4]["text"] is None and rows[5]["text"] == ""


def test_documents(documents):
    """Every planted value is replaced; texts without any are untouched; the plan stays native."""
    done = p.pseudonymise(documents, KEY)
    assert not any(x in done._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Exchange"))
    old = {r["doc_id"]: r["text"] for r in documents.collect()}
    planted = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])|(?<!\w)\d{16}(?!\w)")
    for r in done.collect():
        values = planted.findall(old[r["doc_id"]])
        if values:
            assert not [v for v in values if v in r["text"]]
        elif not re.search("[0-9@]", old[r["doc_id"]]):
            assert r["text"] == old[r["doc_id"]]


def test_edges(edges, nothing):
    done = p.pseudonymise(edges, KEY)
    assert done.columns == edges.columns
    assert sorted(map(tuple, done.collect()), key=repr) == sorted(map(tuple, edges.collect()), key=repr)
    assert p.pseudonymise(nothing, KEY).count() == 0
    with pytest.raises(ValueError):
        p.pseudonymise(edges.drop("text"), KEY)
