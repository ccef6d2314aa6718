"""Rule-based category suggestion.

The keyword lists travel as a literal array column, so scoring a row needs no join
and no shuffle. A score set is ARRAY<STRUCT<category, score>> in rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.functions.scalars import let, percent_text


def claim_text(lower: bool = True) -> Column:
    """title + description + vendor with blanks between, missing parts empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "vendor")]
    text = F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2])
    return F.lower(text) if lower else text


def _score(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords contained in the text (substrings, not words)."""
    words = F.array(*[F.lit(w) for w in keywords])
    return F.size(F.filter(words, lambda w: text.contains(w))) / F.lit(float(len(keywords)))


def score_array(text: Column, rules: dict[str, list[str]]) -> Column:
    return let(text, lambda t: F.array(*[
        F.struct(F.lit(category).alias("category"), _score(t, keywords).alias("score"))
        for category, keywords in rules.items()]))


def best_of(scores: Column, last_wins: bool) -> Column:
    """Entry with the highest score; ties go to the last or to the first entry."""
    sign = 1 if last_wins else -1
    ranked = F.transform(scores, lambda s, i: F.struct(
        s["score"].alias("score"), (i * sign).alias("ord"), s["category"].alias("category")))
    return F.array_max(ranked)


def _based(claims: DataFrame, scores: Column, last_wins: bool, fallback: str | None) -> DataFrame:
    """Adds base_scores, base_category, base_confidence; the fallback category is for
    rows that score nothing."""
    def chosen(all_scores: Column) -> Column:
        def pick(best: Column) -> Column:
            category = best["category"] if fallback is None else \
                F.when(best["score"] > 0, best["category"]).otherwise(fallback)
            return F.struct(all_scores.alias("scores"), category.alias("category"), best["score"].alias("confidence"))

        return let(best_of(all_scores, last_wins), pick)

    return claims.withColumn("base", let(scores, chosen)).withColumns({
        f"base_{f}": F.col(f"base.{f}") for f in ("scores", "category", "confidence")}).drop("base")


def with_keyword_scores(claims: DataFrame) -> DataFrame:
    """Adds base_scores, base_category, base_confidence of the keyword pass."""
    return _based(claims, score_array(claim_text(), fixed.KEYWORDS), last_wins=True, fallback="other")


def keyword_scores(claims: DataFrame, key: str = "id") -> DataFrame:
    """Long form: one row per claim and category."""
    scored = claims.select(key, F.explode(score_array(claim_text(), fixed.KEYWORDS)).alias("s"))
    return scored.select(key, "s.category", "s.score")


def keyword_category(claims: DataFrame) -> DataFrame:
    return with_keyword_scores(claims).drop("base_scores").withColumnsRenamed(
        {"base_category": "category_by_keyword", "base_confidence": "keyword_confidence"})


def amount_hints(amount: Column) -> Column:
    """Hint set by size of the amount; a missing amount counts as 0."""
    value = F.coalesce(amount.cast("double"), F.lit(0.0))
    chain = None
    for bound, hints in fixed.AMOUNT_HINTS:
        literal = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(h).alias("score")) for c, h in hints])
        if bound is None:
            return chain.otherwise(literal)
        chain = F.when(value < bound, literal) if chain is None else chain.when(value < bound, literal)
    raise ValueError("the last amount hint must have no bound")


def combine_scores(base: Column, hints: Column) -> Column:
    """A hinted category takes the mean of score and hint, or half the hint where
    its score is 0; hinted categories missing in the base come last."""

    def entry(category: Column, score: Column) -> Column:
        return F.struct(category.alias("category"), score.alias("score"))

    def combined(scores: Column, hinted: Column) -> Column:
        def blend(e: Column) -> Column:
            hint = F.get(F.filter(hinted, lambda h: h["category"] == e["category"]), F.lit(0))["score"]
            return let(hint, lambda h: entry(
                e["category"], F.when(h.isNull(), e["score"]).when(e["score"] != 0, (e["score"] + h) / 2)
                .otherwise(h * F.lit(0.5))))

        absent = F.filter(hinted, lambda h: ~F.exists(scores, lambda b: b["category"] == h["category"]))
        return F.concat(F.transform(scores, blend),
                        F.transform(absent, lambda h: entry(h["category"], h["score"] * F.lit(0.5))))

    return let(F.struct(base.alias("scores"), hints.alias("hints")), lambda p: combined(p["scores"], p["hints"]))


def with_final_choice(scored: DataFrame) -> DataFrame:
    """From base_scores, base_category, base_confidence and amount to
    suggested_category, suggested_confidence, all_scores."""
    def choose(scores: Column) -> Column:
        def settle(best: Column) -> Column:
            confidence = F.when(best["score"] != 0, best["score"]).otherwise(F.col("base_confidence"))
            return let(confidence, lambda value: F.struct(
                scores.alias("all_scores"), value.alias("suggested_confidence"),
                F.when(value > fixed.ACCEPT_CONFIDENCE, best["category"]).otherwise(F.col("base_category"))
                .alias("suggested_category")))

        return let(best_of(scores, last_wins=True), settle)

    combined = combine_scores(F.col("base_scores"), amount_hints(F.col("amount")))
    return scored.withColumn("choice", let(combined, choose)).withColumns({
        c: F.col(f"choice.{c}") for c in ("all_scores", "suggested_confidence", "suggested_category")}).drop("choice")


def suggest_category(claims: DataFrame) -> DataFrame:
    """Claims plus the suggestion made from keywords and amount hints."""
    return with_final_choice(with_keyword_scores(claims)).withColumn("method", F.lit("rule-based"))


def with_service_scores(claims: DataFrame) -> DataFrame:
    """Fallback of the scoring service: fewer keywords, bonus by amount, first wins."""
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))

    def entries(text: Column) -> Column:
        result = []
        for category, keywords in fixed.SERVICE_KEYWORDS.items():
            low, high = fixed.SERVICE_LOW_BONUS.get(category), fixed.SERVICE_HIGH_BONUS.get(category)
            bonus = F.lit(0.0)
            if low is not None:
                bonus = F.when(amount < 20, F.lit(low)).otherwise(bonus)
            if high is not None:
                bonus = F.when(amount > 500, F.lit(high)).otherwise(bonus)
            result.append(F.struct(F.lit(category).alias("category"),
                                   (_score(text, keywords) + bonus).alias("score")))
        return F.array(*result)

    return _based(claims, let(claim_text(), entries), last_wins=False, fallback=None)


def service_rules(claims: DataFrame) -> DataFrame:
    return with_service_scores(claims).drop("base_scores").withColumnsRenamed(
        {"base_category": "service_category", "base_confidence": "service_confidence"})


# --- writing suggestions and feedback back -----------------------------------------------


def apply_suggestions(expenses: DataFrame, suggestions: DataFrame, as_of, latest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(expenses with the suggestion columns, audit rows).

    suggestions: expense_id, suggested_category, suggested_confidence, method,
    all_scores, and optionally error (text): such a row leaves the expense alone and
    is logged as failed. Of several suggestions of one expense (retries, repeated
    deliveries) the latest by the column `latest` counts, where it is given; ties and the
    rest go to one without error, then to the higher confidence, then category.
    """
    from spendspark.functions.scalars import moment, one_per

    now = moment(as_of)
    error = F.col("error") if "error" in suggestions.columns else F.lit(None).cast("string")
    order = [F.col(latest)] if latest else []
    suggestions = one_per(suggestions, "expense_id", [
        *order, error.isNull(), F.col("suggested_confidence"), F.col("suggested_category"), error])
    given = suggestions.select(
        F.col("expense_id").alias("s_id"), F.col("suggested_category").alias("s_category"),
        F.col("suggested_confidence").cast("double").alias("s_confidence"), F.col("method").alias("s_method"),
        F.col("all_scores").alias("s_scores"), error.alias("s_error"))
    good = given.filter(F.col("s_error").isNull())
    joined = expenses.join(good, F.col("id") == F.col("s_id"), "left")
    changed = F.col("s_id").isNotNull()
    updates = {
        "ml_suggested_category": F.when(changed, F.col("s_category")).otherwise(F.col("ml_suggested_category")),
        "ml_confidence": F.when(changed, F.col("s_confidence").cast("decimal(3,2)")).otherwise(F.col("ml_confidence")),
    }
    if "updated_at" in expenses.columns:
        updates["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    updated = joined.withColumns(updates).select(*expenses.columns)

    failed = F.col("s_error").isNotNull()
    scores = F.map_from_entries("s_scores")
    audit = given.join(
        expenses.select("id", "user_id"), F.col("s_id") == F.col("id")
    ).select(
        F.col("id").alias("expense_id"), "user_id",
        F.when(failed, "ml_categorization_failed").otherwise("ml_categorized").alias("action"),
        F.when(failed, F.concat(F.lit("ML categorization failed: "), F.col("s_error")))
        .otherwise(F.concat(F.lit("ML categorization suggested: "), F.col("s_category"), F.lit(" ("),
                            percent_text(F.col("s_confidence")), F.lit(" confidence)"))).alias("notes"),
        F.when(failed, F.to_json(F.struct(F.col("s_error").alias("error"))))
        .otherwise(F.to_json(F.struct(
            F.col("s_category").alias("suggested_category"), F.col("s_confidence").alias("confidence"),
            F.col("s_method").alias("method"), scores.alias("all_scores")))).alias("metadata"),
        now.alias("created_at"))
    return updated, audit


def feedback_rows(expenses: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(feedback rows, audit rows) for decided expenses whose category differs from
    the suggestion."""
    from spendspark.functions.scalars import moment

    now = moment(as_of)
    corrected = expenses.filter(
        F.col("status").isin("approved") & F.col("ml_suggested_category").isNotNull()
        & (F.col("ml_suggested_category") != F.col("category")))
    feedback = corrected.select(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.struct("title", "description", "vendor", F.col("amount").cast("double").alias("amount")).alias("expense_data"),
        F.col("ml_suggested_category").alias("predicted_category"),
        F.col("category").alias("actual_category"),
        F.col("ml_confidence").cast("double").alias("confidence"))
    audit = corrected.select(
        F.col("id").alias("expense_id"), "user_id", F.lit("ml_feedback").alias("action"),
        F.concat(F.lit("User corrected ML suggestion from "), F.col("ml_suggested_category"),
                 F.lit(" to "), F.col("category")).alias("notes"),
        F.to_json(F.struct(F.col("ml_suggested_category").alias("ml_suggested"),
                           F.col("category").alias("user_corrected"),
                           F.col("ml_confidence").cast("double").alias("ml_confidence"))).alias("metadata"),
        now.alias("created_at"))
    return feedback, audit
