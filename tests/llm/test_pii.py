"""Base spans against Python's regular expressions; discovery on a corpus made by hand."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from spendspark.llm import pii

# The patterns as the contract states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    random.seed(4)
    parts = ["a.b@c.de", "a@b.c_d@e.f", "x@y", "@z.a", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "00000001.2.3.255", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "4111111111111112", "41111111111111110000", "+1 (269) 555-3296", "+49.30.1234567", "+1", "+12 34", "é", "😀",
             "word", "\n", "1", "12 3", "+1((((5", "- ", " ", "4524132264652876", "a@b.c.d..e", "99999999999999999999.1.1.1"]
    rows = ["".join(random.choice(parts) + random.choice(["", " ", ".", "\t"]) for _ in range(random.randrange(25))) for _ in range(300)]
    return rows + [None, "", "a@b.c " * 300, "1" * 20000, "x" * 20000 + "@a.b", "a@b" + ".c" * 5000, "+1" + "(" * 5000 + "2345678"]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        wanted = brute(text)
        row = got[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), (text, wanted, row.spans)
        counts = [sum(w.startswith(k + ":") for w in wanted) for k in BASE]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert row.spans == ",".join(wanted) or row.spans.startswith(",".join([*wanted, "other:"]))


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please write to u{i}@mail.example.com without delay") for i in range(30)]
    rows += [(100, "please write to user-4711-x without delay"), (101, "see version 3.0 of it"), (102, "chapter 12 of it")]
    rows += [(103, "please write to user-4711-x without delay"), (None, "we saw user-4711-x."), (100, rows[30][1])]
    got = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.spans) for r in got if "other" in r.spans}
    assert found == {(100, "other:16:27"), (103, "other:16:27"), (None, "other:7:18")}
    assert len(got) == len(rows)


def test_neighbouring_words_are_found_in_the_whole_gap(spark):
    gaps = ["", " - ", "one Two, " + "." * 500, "x" * 200 + "Y!", "\n", "a" * 100_000, "é ü" + " " * 100_000 + "\n"]
    rows = spark.createDataFrame([(g,) for g in gaps], "gap string").select(
        "gap", pii.word(F.col("gap"), True).alias("last"), pii.word(F.col("gap"), False).alias("first")).collect()
    for row in rows:
        words = re.findall(r"[^\W\d_]+", row.gap.lower())
        assert (row.first, row.last) == ((words[0], words[-1]) if words else (None, None))


def test_masked_and_empty(spark):
    docs = spark.createDataFrame([(1, "to a@b.c, 1.2.3.4!"), (2, None), (3, "plain")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.masked(docs).collect()} == {1: "to <email>, <ip>!", 2: None, 3: "plain"}
    assert pii.report(docs.limit(0)).collect() == []
