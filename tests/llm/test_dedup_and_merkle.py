"""Line dedup, substring dedup and fingerprints against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from spendspark.llm import line_dedup, merkle, substring_dedup


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def chunks(text):
    lines = text.split("\n")
    hashes = [md5(line) for line in lines]
    out, held = [], []
    for i, line in enumerate(lines):
        held.append(line)
        if md5("".join(hashes[max(0, i - 1):i + 1]))[0] in "048c" or i == len(lines) - 1:
            out.append("\n".join(held))
            held = []
    return out


def brute_lines(rows):
    """rows in order; equal (id, text) share their fate."""
    seen, kept = {}, []
    for doc_id, text in rows:
        lost = []
        for place, chunk in enumerate(chunks(text or "")):
            if "\n" in chunk and seen.setdefault(chunk, (doc_id, place)) != (doc_id, place):
                lost.append(place)
        own = chunks(text or "")
        kept.append((doc_id, "\n".join(c for k, c in enumerate(own) if k not in lost) if lost else text, len(lost)))
    return kept


def documents():
    random.seed(9)
    line = lambda: " ".join(random.choice(["a", "bb", "é", "d4", ""]) for _ in range(random.randrange(5)))
    shared = [[line() + f" s{k} {i}" for i in range(12)] for k in range(5)]
    rows = []
    for i in range(60):
        parts = [line() for _ in range(random.randrange(6))] + random.choice(shared) + [line() for _ in range(random.randrange(6))]
        rows.append((i, "\n".join(parts)))
    return rows + [(70, None), (71, ""), (72, "\n\n\n"), (73, "one line"), (74, "one line"), (75, "\n".join(shared[0] * 3))]


def test_line_dedup_equals_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows + [rows[20]], "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("Key", F.lit(1))
    found = line_dedup.dedup(docs).collect()
    assert len(found) == len(rows) + 1
    got = {r.doc_id: (r.doc_id, r.text, r.removed_chunks) for r in found}
    assert [got[i] for i, _ in rows] == brute_lines(rows)
    assert len({r.text for r in found if r.doc_id == 20}) == 1


def test_shifted_passages_and_null_ids(spark):
    passage = "\n".join(f"line {i} of the passage" for i in range(40))
    docs = spark.createDataFrame([(1, "x\n" + passage), (2, "y\nz\nw\n" + passage + "\nv"), (None, None), (None, "q\n" + passage)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(docs.filter("doc_id is not null")).collect()}
    assert got[1].removed_lines == 0 and got[2].removed_lines >= 30 and got[2].text.startswith("y\nz\nw") and got[2].text.endswith("v")
    by_text = {r.text: r.removed_lines for r in line_dedup.dedup(docs).collect() if r.doc_id is None and r.text}
    assert list(by_text.values()) == [0]  # null ids rank first
    assert line_dedup.dedup(docs.limit(0)).collect() == []


def brute_runs(rows):
    """rows in order of their ids; a line goes with either neighbour if both stood side by side before."""
    seen, kept = set(), []
    for _, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
        gone = set()
        for a, b in zip(full, full[1:], strict=False):
            body = "\n".join(lines[a:b + 1])
            gone |= set(range(a, b + 1)) if body in seen else set()
            seen.add(body)
        kept.append("\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text)
    return kept


def test_repeated_runs_of_lines_go_whole(spark):
    rows = documents()
    docs = spark.createDataFrame([*rows, rows[20]], "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    found = line_dedup.dedup_runs(docs).collect()
    got = {r.doc_id: r.text for r in found}
    assert len(found) == len(rows) + 1 and [got[i] for i, _ in rows] == brute_runs(rows)

    for n in range(2, 10):
        passage = [f"line {i} of a passage of {n} lines" for i in range(n)]
        passage[1:1] = [""] * (n % 2)
        rows = [(1, "\n".join(["a", *passage, "b"])), (2, "\n".join(["", "c", *passage, "", "d"])), (3, "\n".join(passage)), (4, "e\n" + passage[0])]
        got = {r.doc_id: r for r in line_dedup.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [got[i].text for i in range(1, 5)] == [rows[0][1], "\nc\n\nd", "", rows[3][1]]
        assert [(got[i].removed_runs, got[i].removed_lines) for i in range(1, 5)] == [(0, 0), (1, len(passage)), (1, len(passage)), (0, 0)]
    assert line_dedup.dedup_runs(docs.limit(0)).collect() == []


def test_substring_dedup(spark):
    passage = "First sentence of a passage that many share here. It goes on and on with a second one, which is longer than that! And a third? Yes 3.5 of it."
    rows = [(1, f"Own start. {passage} Own end."), (2, f"Another start here.\n{passage}\nAnother end."), (3, f"mid {passage.upper()} tail."),
            (4, "Yes 3.5 of it. Alone."), (5, None), (6, ""), (7, "..."), (2, f"Another start here.\n{passage}\nAnother end.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash"))
    got = [(r.doc_id, r.text, [(s.start, s.end) for s in r.removed]) for r in substring_dedup.dedup(docs, min_words=20).collect()]
    by_id = {r[0]: r for r in got}
    assert len(got) == 8 and by_id[1][1] == rows[0][1] and by_id[1][2] == []
    assert by_id[2][1] == "Another start here.\nAnother end."
    start, end = by_id[2][2][0]
    assert rows[1][1][start:end].strip() == passage
    cut_start, cut_end = by_id[3][2][0]  # its first sentence differs, the others are repeats
    assert rows[2][1][cut_start:cut_end].strip() == passage.upper().split(". ", 1)[1]
    assert by_id[4][1] == rows[3][1] and by_id[5][1] is None and by_id[6][1] == "" and by_id[7][1] == "..."
    assert substring_dedup.dedup(docs.limit(0)).collect() == []


def brute_units(rows, min_words):
    """Unit by unit in order of (id, place); a run of repeats goes if it holds enough words."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        units = [u for u in re.findall(r"(?:[^\n.!?]|[.!?]+[^ \t\r\n.!?])*(?:[.!?]+[ \t]*)?\n?", text or "") if u]
        runs, run, at = [], None, 0
        for unit in units:
            words = re.findall(r"[^\W_]+", unit.lower())
            if words and tuple(words) in seen:
                run = (run[0] if run else at, at + len(unit), (run[2] if run else 0) + len(words))
            elif words:
                seen.add(tuple(words))
                runs, run = runs + [run] * (run is not None), None
            at += len(unit)
        gone = [r for r in runs + [run] * (run is not None) if r[2] >= min_words]
        kept, at = "", 0
        for start, end, _ in gone:
            kept, at = kept + text[at:start], end
        out[doc_id] = (kept + text[at:] if text is not None else None, [(start, end) for start, end, _ in gone])
    return out


def test_substring_dedup_equals_brute_force(spark):
    random.seed(4)
    sentence = lambda: " ".join(random.choice(["a", "Bb", "é", "4,5"]) for _ in range(random.randrange(1, 4))) + random.choice([". ", "!\n", "\n", "... ", ".", "?!\t"])
    rows = [(i, "".join(random.choice([sentence, sentence, lambda: "- "])() for _ in range(random.randrange(25)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "..."), (63, rows[7][1]), (64, "As. " * 3000), (65, "1.2.3." * 50000)]
    docs = spark.createDataFrame(rows + [rows[7], rows[7]], "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("a.b", F.lit(2))
    for min_words in (0, 4):
        wanted = brute_units(rows, min_words)
        found = substring_dedup.dedup(docs, min_words=min_words).collect()
        assert len(found) == len(rows) + 2 and found[0].asDict().keys() == {"doc_id", "text", "digest", "a.b", "removed"}
        for r in found:
            assert (r.text, [(x.start, x.end) for x in r.removed]) == wanted[r.doc_id], r.doc_id


def test_units_are_the_whole_text(spark):
    random.seed(1)
    texts = ["".join(random.choice("ab .!?\n\t3é") for _ in range(random.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in df.select("text", F.array_join(substring_dedup.units(F.col("text")), "").alias("joined")).collect():
        assert row.text == row.joined


def leaves(text):
    return [md5(m)[:8] for line in (text or "").split("\n") for m in re.findall(r"(?:[^ ]* ){1,4}|[^ ]+", line)]


def likeness(a, b):
    a, b = set(leaves(a)), set(leaves(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rows = [(i, t) for i, t in documents() if i < 30] + [(40, None), (41, ""), (42, "é😀x"), (-3, "first of all words here")]
    docs = spark.createDataFrame(rows + [rows[4]], "doc_id long, text string").withColumn("next_id", F.lit(0))
    found = merkle.report(docs).collect()
    assert len(found) == len(rows) + 1
    got = {r.doc_id: r for r in found}
    ordered = sorted(rows)
    for (doc_id, text), (next_id, next_text) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        own, after, row = text or "", next_text or "", got[doc_id]
        k = len(own) // 4
        edited = own[:len(own) - k] + after[:k]
        assert (row.n_chars, row.next_id, row.edited_sha256) == (len(own), next_id, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(row.near_edited - likeness(own, edited)) < 1e-12 and abs(row.near_next - likeness(own, after)) < 1e-12
        assert (row.fingerprint == row.edited_fingerprint) == (own == edited)


def test_fingerprint_ties_nulls_and_edits(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "x"), (1, "y"), (1, "x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.fingerprint, r.next_id) for r in merkle.report(docs).collect())
    assert len(got) == 4 and [g[0] for g in got] == ["1", "1", "1", "None"]
    assert len({g[1] for g in got[:3]}) == 2 and (got[0][1] == got[1][1] or got[1][1] == got[2][1])
    assert merkle.report(docs.limit(0)).collect() == []
    assert [r.near_next for r in merkle.report(docs.limit(1)).collect()] == [1.0]
    lines = [f"paragraph number {i} of the text" for i in range(30)]
    other = [*lines[:12], "another paragraph", *lines[12:20], *lines[21:]]
    two = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    prints = two.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    assert prints.select(merkle.changed(F.col("a"), F.col("b"))).first()[0] == [12]
    assert prints.select(merkle.changed(F.col("a"), F.col("a"))).first()[0] == []
