import pytest
from pyspark.sql import functions as F

from spendspark.operators import categorize, ml
from tests import seed

# title: keyword category, keyword hits / list length, stored category, stored confidence, service category, score
EXPECTED = {
    "Team Lunch Meeting": ("meals", 2 / 14, "meals", 0.27, "meals", 0.333333),
    "Uber to Client Office": ("office_supplies", 1 / 14, "office_supplies", 0.20, "office_supplies", 0.2),
    "Adobe Creative Suite": ("software", 2 / 14, "software", 0.20, "software", 0.25),
    "AWS Cloud Services": ("software", 2 / 14, "software", 0.17, "meals", 0.0),
    "Tech Conference Ticket": ("training", 1 / 12, "training", 0.20, "travel", 0.3),
    "Office Supplies": ("office_supplies", 4 / 14, "office_supplies", 0.20, "office_supplies", 0.6),
    "Client Dinner": ("accommodation", 1 / 11, "accommodation", 0.20, "meals", 0.166667),
    "Hotel Stay - Business Trip": ("travel", 2 / 10, "travel", 0.24, "accommodation", 0.25),
    "Flight to São Paulo": ("transportation", 2 / 15, "transportation", 0.25, "travel", 0.55),
}
DESCRIPTIONS = {
    "Team Lunch Meeting": "Lunch with client to discuss new campaign",
    "Uber to Client Office": "Transportation to client meeting",
    "Adobe Creative Suite": "Monthly subscription for design tools",
    "AWS Cloud Services": "Monthly cloud infrastructure costs",
    "Tech Conference Ticket": "Annual developer conference registration",
    "Office Supplies": "Notebooks and pens for team",
    "Client Dinner": "Dinner meeting with potential client",
    "Hotel Stay - Business Trip": "Two nights in São Paulo for sales meeting",
    "Flight to São Paulo": "Round trip flight for client meetings",
}


@pytest.fixture(scope="module")
def described(spark):
    texts = spark.createDataFrame(list(DESCRIPTIONS.items()), "t string, d string")
    return seed.expenses(spark).join(texts, F.col("title") == F.col("t")).withColumn("description", F.col("d")).drop("t", "d")


def test_keyword_hits(described):
    rows = {r["title"]: r for r in categorize.keyword_category(described).collect()}
    for title, (category, score, *_rest) in EXPECTED.items():
        assert rows[title]["category_by_keyword"] == category, title
        assert rows[title]["keyword_confidence"] == pytest.approx(score), title


def test_final_suggestion(described):
    rows = {r["title"]: r for r in categorize.suggest_category(described).collect()}
    for title, (_c, _s, category, confidence, *_rest) in EXPECTED.items():
        assert rows[title]["suggested_category"] == category, title
        assert round(rows[title]["suggested_confidence"], 2) == pytest.approx(confidence), title


def test_service_rules(described):
    rows = {r["title"]: r for r in categorize.service_rules(described).collect()}
    for title, (*_first, category, score) in EXPECTED.items():
        assert rows[title]["service_category"] == category, title
        assert rows[title]["service_confidence"] == pytest.approx(score, abs=1e-6), title


def test_model_scores_keep_their_order_and_hints_come_last(spark):
    claim = spark.createDataFrame([("x", 10.0)], "id string, amount double").withColumn(
        "base_scores", F.array(F.struct(F.lit("software").alias("category"), F.lit(0.9).alias("score")))).withColumns(
        {"base_category": F.lit("software"), "base_confidence": F.lit(0.9)})
    row = categorize.with_final_choice(claim).first()
    assert [(s["category"], s["score"]) for s in row["all_scores"]] == [("software", 0.9), ("meals", 0.15), ("office_supplies", 0.1)]
    assert (row["suggested_category"], row["suggested_confidence"]) == ("software", 0.9)


def test_failed_suggestions_are_logged_only(spark):
    expenses = seed.expenses(spark)
    suggestions = categorize.suggest_category(expenses).withColumnRenamed("id", "expense_id").withColumn(
        "error", F.when(F.col("expense_id") == "e1", "timeout"))
    updated, audit = categorize.apply_suggestions(expenses, suggestions, "2024-03-01 00:00:00")
    assert seed.as_dict(updated, "id", "ml_suggested_category")["e1"] is None
    notes = seed.as_dict(audit, "expense_id", "notes")
    assert notes["e1"] == "ML categorization failed: timeout" and notes["e6"].startswith("ML categorization suggested: ")
    assert audit.count() == 9


@pytest.fixture(scope="module")
def trained(spark):
    words = {"meals": "lunch dinner pizza", "travel": "visa luggage trip", "software": "license cloud app"}
    rows = [(f"{c}-{i}", f"{w} number{i % 7}", None, None, 10.0 + i, c) for c, w in words.items()
            for i in range(60 if c == "meals" else 30)]
    samples = spark.createDataFrame(rows, "id string, title string, description string, vendor string, amount double, category string")
    return samples, *ml.train_categorizer(samples, "2024-03-01", trees=10, depth=5)


def test_separable_text_is_learned(trained):
    samples, model, report = trained
    assert model.accuracy >= 0.95 and model.version == "1.120" and model.labels == ["meals", "software", "travel"]
    assert 15 <= model.test_samples <= 33
    rows = {r["class"]: r for r in report.collect()}
    assert rows["accuracy"]["f1"] == pytest.approx(model.accuracy) and set(rows) >= {"macro avg", "weighted avg", "meals"}
    scored = ml.score_categorizer(model, samples)
    assert scored.filter("base_category = category").count() >= 114
    sums = scored.select(F.aggregate("base_scores", F.lit(0.0), lambda a, s: a + s["score"]).alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").count() == 0


def test_saved_model_scores_the_same(spark, trained, folder):
    samples, model, _report = trained
    ml.save_model(model, folder, spark)
    loaded = ml.load_model(spark, folder)
    assert (loaded.version, loaded.accuracy, loaded.labels) == (model.version, model.accuracy, model.labels)
    first, second = (seed.as_dict(ml.score_categorizer(m, samples), "id", "base_confidence") for m in (model, loaded))
    assert first == second


def test_without_model_the_service_rules_apply(described):
    rows = ml.score_categorizer(None, described)
    assert seed.as_dict(rows, "title", "base_category")["AWS Cloud Services"] == "meals"


def test_too_few_samples(spark, trained):
    with pytest.raises(ml.InsufficientData):
        ml.train_categorizer(trained[0].limit(5), "2024-03-01")
    settings = spark.createDataFrame([], "key string, value string, description string, updated_by string, updated_at timestamp")
    assert ml.retrain(seed.expenses(spark), settings, "2024-03-01 00:00:00") is None


def test_split_is_stratified(spark):
    rows = spark.range(20000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 100 = 1 THEN 'c' ELSE 'b' END AS category")
    split = ml.stratified_split(rows, "id", "category").groupBy("category").agg(F.avg(F.col("in_train").cast("int")).alias("p"))
    assert all(abs(r["p"] - 0.8) < 0.02 for r in split.collect())


def test_features(spark):
    df = spark.createDataFrame([("0",), ("20",), ("20.01",), ("500",), ("501",), ("abc",), (None,)], "amount string").withColumns(
        {"title": F.lit("A"), "description": F.lit(None).cast("string"), "vendor": F.lit("b")})
    rows = ml.expense_features(df).collect()
    assert [r["amount_bucket"] for r in rows] == [None, "low", "medium", "high", "very_high", None, None]
    assert rows[0]["combined_text"] == "A  b"


def test_split_takes_exactly_its_share_of_every_class(spark, monkeypatch):
    from spendspark.operators import ml

    rows = [(i, "abc"[i % 3] if i % 10 else "rare") for i in range(3000)] + [(5000, "single"), (5001, None)]
    samples = spark.createDataFrame(rows, "id long, category string")
    for share in (0.8, 0.5, 0.0, 1.0):
        for bits in (15, 5, 3):  # more rounds with fewer bits give the same split
            monkeypatch.setattr(ml, "ROUND_BITS", bits)
            found = ml.stratified_split(samples, "id", "category", share).collect()
            assert len(found) == 3001
            for name in ("a", "b", "c", "rare", "single"):
                own = [r["in_train"] for r in found if r["category"] == name]
                assert sum(own) == max(1, int(share * len(own) + 1e-9)), (name, share, bits)
    assert ml.stratified_split(samples.limit(0), "id", "category").count() == 0
    twice = ml.stratified_split(samples.union(samples), "id", "category").groupBy("id").agg(F.countDistinct("in_train").alias("n"))
    assert twice.filter("n > 1").count() == 0


def test_pages_from_ranges(spark, claims):
    from spendspark.operators import views

    rows = claims.expenses.select("id", "status", "created_at").withColumn("status", F.when(F.col("id") % 9 > 0, F.col("status")))
    for by, order in (("status", "asc"), ("created_at", "desc")):
        keys = views.sort_keys(by, order)
        pages = views.RangedPages(rows, keys, 32)
        n = rows.count()
        last = -(-n // 20)
        for number in (1, 2, last // 2, last, last + 1):
            found, _ = pages.ranges_of(number, 20)
            assert len(found) <= 2
            assert [tuple(r) for r in pages.page(number, 20).collect()] == [tuple(r) for r in views.page(rows, keys, number, 20).collect()]
        assert [r["id"] for r in pages.page(1, n).collect()] == [r["id"] for r in rows.orderBy(*keys).collect()]
        assert pages.page(1, 20).columns == rows.columns
    assert views.RangedPages(rows.limit(0), views.sort_keys(), 4).page(3).count() == 0


def test_training_keeps_what_is_read_again(spark, monkeypatch):
    """Terms of training rows and claims of test rows are written, no other form of the texts; the
    vocabulary's limit is a number of rows, for which MLlib needs no copy of the terms."""
    written, fitted = [], []
    cut, counts = ml.cut, ml.term_counts
    monkeypatch.setattr(ml, "cut", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(ml, "term_counts", lambda rows, size: fitted.append(counts(rows, size)) or fitted[-1])
    samples = spark.createDataFrame([(i, f"lunch number {i % 7}" if i % 2 else f"taxi ride {i % 5}", None, None, 10, "meals" if i % 2 else "travel")
                                     for i in range(60)], "id long, title string, description string, vendor string, amount int, category string")
    model, _report = ml.train_categorizer(samples, "2024-01-01", trees=2, depth=2)
    kept = next(df for df in written if "terms" in df.columns)
    assert not {"tokens", "words", "pairs"} & set(kept.columns)
    assert kept.filter("in_train and (terms is null or title is not null)").count() == 0
    assert kept.filter("not in_train and (terms is not null or title is null)").count() == 0
    assert fitted[0][0].getMaxDF() == 0.8 * kept.filter("in_train").count()
    assert model.test_samples == kept.filter("not in_train").count() > 0


def test_the_query_trains_whole_trees(spark, monkeypatch):
    """Forty words of two classes: a tree parts one word a level, so twelve levels leave most rows mixed."""
    from checks import registry, suggestions

    rows = [(i, f"word{i % 40}", None, None, 0, str(i % 40 % 2)) for i in range(400)]
    samples = spark.createDataFrame(rows, "doc_id long, title string, description string, vendor string, amount int, category string")
    trained, train = [], ml.train_categorizer
    monkeypatch.setattr(suggestions, "labelled", lambda c: samples)
    monkeypatch.setattr(ml, "train_categorizer", lambda *a, **b: trained.append(train(*a, **b)) or trained[-1])
    report = {r["class"]: r["f1"] for r in registry.QUERIES["train_categorizer"](spark, "/root/testdata/sf0.001").collect()}
    trees = trained[0][0].model.stages[-1].trees
    assert len(trees) == 100 and all(t.depth > 12 for t in trees) and max(t.depth for t in trees) <= 30
    assert report["accuracy"] == 1.0
    assert ml.score_categorizer(trained[0][0], samples).filter("base_category = category").count() == 400


def test_all_terms_are_counted(spark, monkeypatch):
    """Without a size no term is dropped and no vocabulary brought to the driver; values are those of MLlib's models."""
    texts = [["a", "a", "b"], ["b", "c", "a"], ["d", "a"], ["d", "e", "a"], [], *[[f"t{i}", f"t{i + 1}", "c"] for i in range(20)]]
    rows = spark.createDataFrame([(t,) for t in texts], "terms array<string>")
    counted, idf, _ = ml.term_counts(rows, 1000)
    expected = {r["term"]: (r["document_frequency"], pytest.approx(r["idf"])) for r in ml.idf_table(counted, idf, spark).collect()}
    monkeypatch.setattr(ml, "CountVectorizer", None)
    counted, idf, counts = ml.term_counts(rows, None)
    found = ml.idf_table(counted, idf, spark)
    assert {r["term"]: (r["document_frequency"], r["idf"]) for r in found.collect()} == expected and len(expected) == 22
    assert found.columns == ["term", "document_frequency", "idf"]
    assert sorted(r["tf"] for r in counts.filter("term = 'a'").collect()) == [1, 1, 1, 2]
    often = spark.createDataFrame([(["x", "y"] if i < 4 else ["x"],) for i in range(5)], "terms array<string>")
    assert [r["term"] for r in ml.term_counts(often, None)[0].collect()] == ["y"]
    assert ml.idf_table(*ml.term_counts(rows.limit(0), None)[:2], spark).count() == 0


def test_the_idf_query_keeps_more_terms_than_a_vocabulary_of_two_to_the_twenty(spark, monkeypatch):
    """Four of ten texts have 600,000 words and the pairs between them; of the eight in training, two at least."""
    from checks import registry, suggestions

    words = "concat_ws(' ', transform(sequence(1, 600000), i -> concat('w', i)))"
    samples = spark.range(10).selectExpr("id AS doc_id", f"CASE WHEN id < 4 THEN {words} ELSE 'short' END AS title", "string(null) AS description",
                                         "string(null) AS vendor", "0 AS amount", "'1' AS category")
    monkeypatch.setattr(suggestions, "labelled", lambda c: samples)
    table = registry.QUERIES["train_idf"](spark, "/root/testdata/sf0.001")
    assert table.filter("term LIKE 'w%'").count() == 2 * 600000 - 1
