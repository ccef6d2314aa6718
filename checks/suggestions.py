"""Category suggestion: keyword rules, hints, service rules, write-back, feedback."""

from pyspark.sql import functions as F

from checks.registry import query
from spendspark import fixed
from spendspark.functions import sql
from spendspark.operators import categorize, ml, reports, views
from spendspark.plans.fixtures import AS_OF
from spendspark.session import cut

TEXT = "lower(concat(coalesce(title, ''), ' ', coalesce(description, ''), ' ', coalesce(vendor, '')))"


def share(keywords):
    hits = " + ".join(f"CAST(contains(txt, '{w}') AS INT)" for w in keywords)
    return f"(({hits}) / CAST({len(keywords)} AS DOUBLE))"


HINTS = "CASE WHEN amt < 20 THEN {0} WHEN amt < 100 THEN {1} WHEN amt < 500 THEN {2} ELSE {3} END"


def hint(category):
    values = [dict(h).get(category) for _, h in fixed.AMOUNT_HINTS]
    return HINTS.format(*["NULL" if v is None else f"CAST({v} AS DOUBLE)" for v in values])


CATS = list(fixed.KEYWORDS)
BASE = "scored AS (SELECT id, " + ", ".join(f"{share(k)} AS s_{c}" for c, k in fixed.KEYWORDS.items()) + \
    f", amt FROM (SELECT id, {TEXT} AS txt, CAST(amount AS DOUBLE) AS amt FROM expenses) t)"
LONG = "long_scores AS (" + " UNION ALL ".join(
    f"SELECT id, '{c}' AS category, {i} AS ord, s_{c} AS score, {hint(c)} AS hint FROM scored" for i, c in enumerate(CATS)) + ")"
BEST_BASE = """base AS (SELECT id, category AS best, score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord DESC) AS rn FROM long_scores) r WHERE rn = 1)"""
MIXED = """mixed AS (SELECT id, category, ord, CASE WHEN hint IS NULL THEN score WHEN score <> 0 THEN (score + hint) / 2
    ELSE hint * CAST(0.5 AS DOUBLE) END AS score FROM long_scores)"""
BEST = """top AS (SELECT id, category AS best, score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord DESC) AS rn FROM mixed) r WHERE rn = 1)"""
CHOICE = """choice AS (SELECT b.id, CASE WHEN b.score > 0 THEN b.best ELSE 'other' END AS base_category,
    b.score AS base_confidence, CASE WHEN t.score <> 0 THEN t.score ELSE b.score END AS confidence, t.best
    FROM base b JOIN top t ON t.id = b.id),
final AS (SELECT id, base_category, base_confidence, confidence,
    CASE WHEN confidence > CAST(0.3 AS DOUBLE) THEN best ELSE base_category END AS category FROM choice)"""
ALL = f"WITH {BASE}, {LONG}, {BEST_BASE}, {MIXED}, {BEST}, {CHOICE}"


@query("keyword_scores", f"WITH {BASE}, {LONG} SELECT id, category, round(score, 9) AS score FROM long_scores")
def _(c):
    return categorize.keyword_scores(c.expenses).withColumn("score", F.round("score", 9))


@query("keyword_category", f"""{ALL}
SELECT id, base_category AS category_by_keyword, round(base_confidence, 9) AS keyword_confidence FROM final""")
def _(c):
    return categorize.keyword_category(c.expenses).select(
        "id", "category_by_keyword", F.round("keyword_confidence", 9).alias("keyword_confidence"))


@query("sql_keyword_category", f"""{ALL}
SELECT id, base_category AS category, round(base_confidence, 9) AS confidence FROM final""")
def _(c):
    """The rules as a function of Spark's SQL."""
    sql.register(c.spark)
    chosen = c.spark.sql("SELECT id, keyword_category(title, description, vendor) AS k FROM {claims}", claims=c.expenses)
    return chosen.select("id", "k.category", F.round("k.confidence", 9).alias("confidence"))


@query("amount_hints", f"""
WITH scored AS (SELECT id, CAST(amount AS DOUBLE) AS amt FROM expenses),
hints AS ({" UNION ALL ".join(f"SELECT id, '{c}' AS category, {hint(c)} AS hint FROM scored" for c in CATS)})
SELECT * FROM hints WHERE hint IS NOT NULL""")
def _(c):
    long = c.expenses.select("id", F.explode(categorize.amount_hints(F.col("amount"))).alias("h"))
    return long.select("id", "h.category", F.col("h.score").alias("hint"))


@query("combined_scores", f"{ALL} SELECT id, category, round(score, 9) AS score FROM mixed")
def _(c):
    long = categorize.suggest_category(c.expenses).select("id", F.explode("all_scores").alias("s"))
    return long.select("id", "s.category", F.round("s.score", 9).alias("score"))


@query("suggest_category", f"{ALL} SELECT id, category, round(confidence, 9) AS confidence FROM final")
def _(c):
    return categorize.suggest_category(c.expenses).select(
        "id", F.col("suggested_category").alias("category"), F.round("suggested_confidence", 9).alias("confidence"))


def service_score(category):
    score = share(fixed.SERVICE_KEYWORDS[category])
    if category in fixed.SERVICE_LOW_BONUS:
        score = f"CASE WHEN amt < 20 THEN {score} + CAST({fixed.SERVICE_LOW_BONUS[category]} AS DOUBLE) ELSE {score} END"
    if category in fixed.SERVICE_HIGH_BONUS:
        score = f"CASE WHEN amt > 500 THEN {score} + CAST({fixed.SERVICE_HIGH_BONUS[category]} AS DOUBLE) ELSE {score} END"
    return score


SERVICE = f"""WITH texts AS (SELECT id, {TEXT} AS txt, CAST(amount AS DOUBLE) AS amt FROM expenses),
long_scores AS ({" UNION ALL ".join(f"SELECT id, '{c}' AS category, {i} AS ord, {service_score(c)} AS score FROM texts"
                                     for i, c in enumerate(fixed.SERVICE_KEYWORDS))})
SELECT id, category AS service_category, round(score, 9) AS service_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rn FROM long_scores) r WHERE rn = 1"""


@query("service_rules", SERVICE)
def _(c):
    return categorize.service_rules(c.expenses).select(
        "id", "service_category", F.round("service_confidence", 9).alias("service_confidence"))


@query("expense_features", """
SELECT id, concat(coalesce(title, ''), ' ', coalesce(description, ''), ' ', coalesce(vendor, '')) AS combined_text,
       round(ln(1 + CAST(amount AS DOUBLE)), 6) AS amount_log,
       CASE WHEN amount <= 0 THEN NULL WHEN amount <= 20 THEN 'low' WHEN amount <= 100 THEN 'medium'
            WHEN amount <= 500 THEN 'high' ELSE 'very_high' END AS amount_bucket FROM expenses""")
def _(c):
    return ml.expense_features(c.expenses).select("id", "combined_text", F.round("amount_log", 6).alias("amount_log"),
                                                  "amount_bucket")


@query("apply_suggestions", f"""{ALL}
SELECT e.id, f.category AS ml_suggested_category, round(f.confidence, 2) AS ml_confidence,
       concat('ML categorization suggested: ', f.category, ' (', printf('%.1f', f.confidence * 100), '% confidence)') AS notes,
       'ml_categorized' AS action, e.user_id, f.category AS logged_category
FROM expenses e JOIN final f ON f.id = e.id""")
def _(c):
    suggestions = categorize.suggest_category(c.expenses).withColumnRenamed("id", "expense_id")
    updated, audit = categorize.apply_suggestions(c.expenses, suggestions, AS_OF)
    logged = F.get_json_object("metadata", "$.suggested_category").alias("logged_category")
    rows = audit.select(F.col("expense_id"), "user_id", "action", "notes", logged)
    return updated.select("id", "ml_suggested_category", "ml_confidence").join(
        rows, F.col("id") == F.col("expense_id")).drop("expense_id")


@query("feedback_rows", """
SELECT ml_suggested_category AS predicted_category, category AS actual_category, title, CAST(amount AS DOUBLE) AS amount,
       CAST(ml_confidence AS DOUBLE) AS confidence FROM expenses
WHERE status = 'approved' AND ml_suggested_category <> category""")
def _(c):
    feedback, _audit = categorize.feedback_rows(c.expenses, AS_OF)
    return feedback.select("predicted_category", "actual_category", "expense_data.title", "expense_data.amount", "confidence")


@query("feedback_audit", """
SELECT id AS expense_id, user_id,
       'User corrected ML suggestion from ' || ml_suggested_category || ' to ' || category AS notes,
       CAST(ml_confidence AS DOUBLE) AS logged FROM expenses
WHERE status = 'approved' AND ml_suggested_category <> category""")
def _(c):
    _feedback, audit = categorize.feedback_rows(c.expenses, AS_OF)
    logged = F.get_json_object("metadata", "$.ml_confidence").cast("double").alias("logged")
    return audit.select("expense_id", "user_id", "notes", logged)


@query("feedback_stats", """
SELECT ml_suggested_category AS predicted_category, category AS actual_category, count(*) AS count,
       round(avg(CAST(ml_confidence AS DOUBLE)), 9) AS mean_confidence FROM expenses
WHERE status = 'approved' AND ml_suggested_category <> category GROUP BY ALL""")
def _(c):
    """Feedback appended as JSON lines in the shared folder and read back."""
    import uuid

    from spendspark.session import checkpoint_dir
    from spendspark.sources.feedback import append_feedback, read_feedback

    path = f"{checkpoint_dir(c.spark)}/feedback-{uuid.uuid4().hex}"
    append_feedback(categorize.feedback_rows(c.expenses, AS_OF)[0], path)
    stats = reports.feedback_stats(read_feedback(c.spark, path))
    return stats.withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("model_stats", """
SELECT count(*) AS feedback_count, '1.0' AS model_version, false AS has_trained_model FROM expenses
WHERE status = 'approved' AND ml_suggested_category <> category""")
def _(c):
    feedback, _audit = categorize.feedback_rows(c.expenses, AS_OF)
    return ml.model_stats(feedback).select("feedback_count", "model_version", "has_trained_model")


# The English stop words of Spark ML, which the classifier's texts lose.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()


@query("normalize_text", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'),
             lambda w: length(w) > 1 AND w NOT IN ({", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)})) AS words FROM documents)
SELECT doc_id, CAST(len(words) AS INT) AS words, CAST(len(list_distinct(words)) AS INT) AS distinct_words FROM t""", "")
def _(c):
    """Words per document, whole texts."""
    docs = c.base("documents").select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("description"),
                                      F.lit(None).cast("string").alias("vendor"), F.lit(0).alias("amount"))
    return ml.normalize_text(docs).select("doc_id", F.size("words").alias("words"),
                                          F.size(F.array_distinct("words")).alias("distinct_words"))


def labelled(c):
    docs = c.base("documents").join(c.base("labels"), "doc_id")
    return docs.select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("description"),
                       F.col("source").alias("vendor"), F.lit(0).alias("amount"),
                       F.col("quality").cast("string").alias("category"))


# the lowest four fifths of the draws of every class, one row at least
SPLIT = """
WITH l AS (SELECT d.doc_id, coalesce(d.text, '') AS text, d.source, CAST(l.quality AS VARCHAR) AS category,
                  CAST('0x' || md5(d.doc_id || ':42')[1:15] AS BIGINT) AS draw FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY draw) <= greatest(1, (4 * count(*) OVER (PARTITION BY category)) // 5) AS in_train FROM l)"""

TERMS = f"""{SPLIT},
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text || ' ' || coalesce(source, '')), '[\\p{{L}}\\p{{N}}_]+'),
        lambda w: length(w) > 1 AND w NOT IN ({", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)})) AS ws FROM s WHERE in_train),
t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
f AS (SELECT term, count(DISTINCT doc_id) AS document_frequency FROM t GROUP BY term),
n AS (SELECT count(*) AS n FROM w)"""


@query("train_split", f"{SPLIT} SELECT doc_id, category, in_train FROM s", "")
def _(c):
    return ml.stratified_split(labelled(c), "doc_id", "category").select("doc_id", "category", "in_train")


@query("train_class_weights", f"""{SPLIT}
SELECT category, count(*) AS n, round((SELECT count(*) FROM s WHERE in_train) / (SELECT count(DISTINCT category) FROM s WHERE in_train)
       / count(*), 9) AS weight FROM s WHERE in_train GROUP BY category""", "")
def _(c):
    train = ml.stratified_split(labelled(c), "doc_id", "category").filter("in_train")
    return ml.class_weights(train, "category").select(F.col("w_label").alias("category"), "n", F.round("weight", 9).alias("weight"))


@query("train_idf", f"""{TERMS}
SELECT term, document_frequency, round(ln((n.n + 1.0::DOUBLE) / (document_frequency + 1.0::DOUBLE)) + 1, 9) AS idf FROM f, n
WHERE document_frequency >= 2 AND document_frequency <= 0.8 * n.n""", "")
def _(c):
    """Document frequency and idf of all terms of the training texts that pass the limits."""
    usable = ml.expense_features(labelled(c))
    _, terms = ml.with_terms(ml.stratified_split(usable, "doc_id", "category").filter("in_train"))
    counted, idf, _ = ml.term_counts(cut(terms.select("terms")), None)
    return ml.idf_table(counted, idf, c.spark).withColumn("idf", F.round("idf", 9))


@query("train_categorizer")
def _(c):
    """Report on the held-out fifth of the labelled documents."""
    _model, report = ml.train_categorizer(labelled(c), AS_OF, key="doc_id", labels=["0", "1"])
    return report


@query("model_stats_trained", f"""{SPLIT},
f AS (SELECT count(*) AS n FROM expenses WHERE status = 'approved' AND ml_suggested_category <> category)
SELECT f.n AS feedback_count, '1.' || count(*) AS model_version, '{AS_OF}' AS last_trained, true AS has_trained_model, count(*) AS training_samples,
       count(*) FILTER (NOT in_train) AS test_samples, true AS accuracy_is_share FROM s, f GROUP BY f.n""", "expenses")
def _(c):
    """Statistics with a model: what of it does not depend on the trees."""
    model, _report = ml.train_categorizer(labelled(c), AS_OF, key="doc_id", labels=["0", "1"], trees=2, depth=2)
    feedback, _audit = categorize.feedback_rows(c.expenses, AS_OF)
    return ml.model_stats(feedback, model).select(
        "feedback_count", "model_version", "last_trained", "has_trained_model", F.lit(model.training_samples).cast("long").alias("training_samples"),
        F.lit(model.test_samples).cast("long").alias("test_samples"), F.col("accuracy").between(0, 1).alias("accuracy_is_share"))


@query("score_categorizer")
def _(c):
    """Model trained on the labelled documents, saved, loaded, applied to all documents."""
    import uuid

    from spendspark.session import checkpoint_dir

    model, _report = ml.train_categorizer(labelled(c), AS_OF, key="doc_id", labels=["0", "1"], trees=20, depth=8)
    path = f"{checkpoint_dir(c.spark)}/model-{uuid.uuid4().hex}"
    ml.save_model(model, path, c.spark)
    docs = c.base("documents").select("doc_id", F.col("text").alias("title"), F.lit(None).cast("string").alias("description"),
                                      F.col("source").alias("vendor"), F.lit(0).alias("amount"))
    return ml.score_categorizer(ml.load_model(c.spark, path), docs).select("doc_id", "base_category", "base_confidence")
