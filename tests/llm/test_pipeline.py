"""Every stage of the pipeline against brute force, on its own input; then the whole run."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_dedup_and_merkle import brute_lines
from tests.llm.test_jaccard_join import brute as brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    random.seed(21)
    draw = lambda n: " ".join(random.choice("bcdfgklmn") + random.choice("aeiou") + random.choice("rst") for _ in range(n))
    passage = "\n".join(draw(12) for _ in range(30))
    items = [(i, draw(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = draw(60)
        if i % 4 == 1:
            text += " you worthless zzqoidiot" + str(i % 3)
        if i % 8 == 2:
            text = draw(20) + "\n" + passage + "\n" + draw(20)
        if i % 8 == 4 and i > 20:
            text = rows[i - 8][1][:-4] + "end"
        if i % 16 == 6:
            text += " " + random.choice(items)[1]
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(i % 4 == 1)))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, rows[0][1], "en", "s", 1)]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, _, items = corpus()
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    assert ids(clean) == {r[0] for r in rows if "worthless" not in (r[1] or "")}

    lines = stage["line_dedup"](spark, docs, folder)
    wanted = {i: text for i, text, lost in brute_lines([(r[0], r[1]) for r in rows]) if not lost or text.strip()}
    assert {r.doc_id: r.text for r in lines.collect()} == wanted and lines.columns == docs.columns and lines.dtypes == docs.dtypes
    assert all(r.n_chars == len(r.text) for r in lines.filter("doc_id % 8 = 2").collect())

    single = stage["near_duplicates"](spark, docs, folder)
    wanted_ids = {i for i, _, component in brute_components([(r[0], r[1]) for r in rows]) if i == component}
    assert ids(single) == wanted_ids and len(wanted_ids) < len(rows) and single.columns == docs.columns

    fresh = stage["decontamination"](spark, docs, folder)
    judged = {r[0]: brute_hits(r[1], items) for r in rows}
    assert ids(fresh) == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)} != {r[0] for r in rows}

    coded = {r.doc_id: r for r in stage["tokens"](spark, docs, folder).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for row in rows:
        assert coded[row[0]].ids == library.encode(row[1] or "", add_special_tokens=False).ids
        assert coded[row[0]].decoded_sha256 == hashlib.sha256((row[1] or "").encode()).hexdigest()


def test_run_is_its_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda r: (r.doc_id, tuple(r.ids))
    assert sorted(corpus_pipeline.run(spark, folder).collect(), key=key) == sorted(docs.collect(), key=key)


def test_one_of_exact_copies_stays_whole(spark, tmp_path):
    rows, labels, items = corpus()
    random.seed(4)
    texts = ["\n".join(" ".join(f"w{random.randrange(10**6)}" for _ in range(12)) for _ in range(n)) for n in (2, 3, 5, 8, 13, 40)]
    copies = [(1000 + 10 * k + i, text, "en", "s", len(text)) for k, text in enumerate(texts) for i in range(3)]
    copies += [(2000 + r[0], *r[1:]) for r in rows if r[0] % 16 == 2]
    spark.createDataFrame(rows + copies, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).filter("doc_id >= 1000").collect()}
    assert found == {1000 + 10 * k: hashlib.sha256(text.encode()).hexdigest() for k, text in enumerate(texts)}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
