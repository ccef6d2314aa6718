"""Field extraction from receipt text and OCR blocks, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark import fixed
from spendspark.functions.scalars import leading_number, let, moment, one_per, percent_text, trim_all

# what \s covers in JavaScript beyond the ASCII blanks of Java
_WIDE = r"\s\u00a0\ufeff\u2028\u2029"


def _java(pattern: str) -> str:
    """A fixed pattern with its white space widened to the JavaScript meaning."""
    inside = pattern.replace(r"[:\s]", f"[:{_WIDE}]")
    return inside if inside != pattern else pattern.replace(r"\s", f"[{_WIDE}]")


# --- OCR blocks ---------------------------------------------------------------------------


def blocks_to_text(blocks: DataFrame, long: bool = False) -> DataFrame:
    """LINE blocks in order, joined by newlines: one row per receipt, of any length. What
    one group collects is the text of one file, which the upload limit that scan_receipts
    enforces (10 MB) bounds.

    long: for receipts beyond that limit. The lines of all receipts are dealt out in ranges of their
    order, sorted and joined there, so that a group collects one text per range instead of its lines."""
    lines = blocks.filter(F.col("BlockType") == "LINE").select("receipt_key", "pos", F.coalesce("Text", F.lit("")).alias("Text"))
    keys = ["receipt_key"]
    if long:
        dealt = lines.repartitionByRange("receipt_key", "pos").sortWithinPartitions("receipt_key", "pos", "Text")
        # numbers in the order of the lines: sorting by them costs one comparison a line, as the lines already are in order
        lines = dealt.withColumns({"pos": F.monotonically_increasing_id(), "range": F.spark_partition_id()})
        keys.append("range")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "Text")))
    text = lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda b: b["Text"]), "\n").alias("text"))
    if long:
        ranges = F.sort_array(F.collect_list(F.struct("range", "text")))
        text = text.groupBy("receipt_key").agg(F.array_join(F.transform(ranges, lambda r: r["text"]), "\n").alias("text"))
    return text


def _relation(block: Column, kind: str) -> Column:
    """Ids of the first relationship of that type, in order; null without one."""
    return F.get(F.filter(block["Relationships"], lambda r: r["Type"] == kind), F.lit(0))["Ids"]


# entries of a receipt per shelf, and the most shelves that a receipt has
_SHELF, _SHELVES = 64, 512


def _shelves(entries: Column) -> Column:
    """Entries of one receipt dealt out by the hash of their Id. A lookup reads one shelf, so a
    receipt of n blocks costs n * (n / shelves + shelves) steps and a common one, with one shelf, n * n."""
    n = F.least(F.lit(_SHELVES), F.floor(F.sqrt(F.size(entries) / _SHELF)) + 1)
    return let(n, lambda k: F.when(k == 1, F.array(entries)).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.filter(entries, lambda e: F.pmod(F.xxhash64(e["Id"]), k) == i))))


def _with_id(shelves: Column, wanted: Column) -> Column:
    """The entries that have this Id, none for a null one."""
    shelf = F.get(shelves, F.pmod(F.xxhash64(wanted), F.size(shelves).cast("long")).cast("int"))
    return F.filter(shelf, lambda e: e["Id"] == wanted)


def _receipt_fields_of(blocks: DataFrame) -> DataFrame:
    """One row per receipt: its key-value blocks with their own text, else their CHILD words joined
    by blanks. All blocks of a receipt come from one file, which the upload limit bounds: they
    meet in one row, dealt out once, and ids are looked up there."""
    spelled = F.coalesce(F.col("Text"), F.lit("")) != ""
    # an unnamed receipt has no words
    word = F.when(spelled & F.col("receipt_key").isNotNull(), F.struct("Id", "Text"))
    field = F.when(F.col("BlockType") == "KEY_VALUE_SET", F.struct("Id", "pos", "EntityTypes", "Relationships", "Text"))
    whole = blocks.filter(spelled | (F.col("BlockType") == "KEY_VALUE_SET")).groupBy("receipt_key").agg(
        F.collect_list(word).alias("words"), F.collect_list(field).alias("fields"))

    def child_text(block: Column, shelves: Column) -> Column:
        found = F.flatten(F.transform(_relation(block, "CHILD"), lambda i: F.array_sort(F.transform(_with_id(shelves, i), lambda w: w["Text"]))))
        return F.coalesce(F.array_join(found, " "), F.lit(""))

    def read(shelves: Column) -> Column:
        return F.transform("fields", lambda b: F.struct(
            b["Id"].alias("Id"), b["pos"].alias("pos"), b["EntityTypes"].alias("EntityTypes"), b["Relationships"].alias("Relationships"),
            F.when(F.coalesce(b["Text"], F.lit("")) != "", b["Text"]).otherwise(child_text(b, shelves)).alias("block_text")))

    return whole.filter(F.size("fields") > 0).select("receipt_key", let(_shelves(F.col("words")), read).alias("fields"))


def block_texts(blocks: DataFrame) -> DataFrame:
    """Own text of each key-value block, else its CHILD words joined by blanks."""
    # outer only for the optimizer, which would else look the words up once more to find empty lists
    return _receipt_fields_of(blocks).select("receipt_key", F.inline_outer("fields"))


def _receipt_pairs(blocks: DataFrame) -> DataFrame:
    """One row per receipt with its pairs ARRAY<STRUCT<key, pos, value>> in the order of the
    keys: lower-case keys; the last of equal keys wins and keeps the place of the first."""
    texts = _receipt_fields_of(blocks.filter(F.col("receipt_key").isNotNull()))

    def pairs(shelves: Column) -> Column:
        def value(block: Column) -> Column:
            known = F.filter(F.transform(_relation(block, "VALUE"), lambda i: F.get(_with_id(shelves, i), F.lit(0))["block_text"]),
                             lambda t: t.isNotNull())
            return F.struct(F.lower(block["block_text"]).alias("key"), block["pos"].alias("pos"), F.array_join(known, " ").alias("value"))

        keys = F.filter("fields", lambda b: F.array_contains(b["EntityTypes"], "KEY") & (b["block_text"] != ""))
        return F.sort_array(F.filter(F.transform(keys, value), lambda p: p["value"] != ""))

    def once(found: Column) -> Column:
        other = lambda p, i: ~F.get(found, i)["key"].eqNullSafe(p["key"])
        first = F.filter(found, lambda p, i: other(p, i - 1))
        last = F.filter(found, lambda p, i: other(p, i + 1))
        return F.zip_with(first, last, lambda a, z: F.struct(a["key"].alias("key"), a["pos"].alias("pos"), z["value"].alias("value")))

    found = F.filter(F.array(let(let(_shelves(F.col("fields")), pairs), once)), lambda p: F.size(p) > 0)
    # a filter on a generated column isn't moved down, where all lookups would be done twice
    return texts.select("receipt_key", F.explode_outer(found).alias("pairs")).filter(F.col("pairs").isNotNull())


def blocks_to_pairs(blocks: DataFrame) -> DataFrame:
    """Long form (receipt_key, pos, key, value): lower-case keys; the last of equal
    keys wins and keeps the place of the first."""
    return _receipt_pairs(blocks).select("receipt_key", F.inline("pairs")).select("receipt_key", "key", "pos", "value")


def blocks_to_kv(blocks: DataFrame) -> DataFrame:
    """One map per receipt with the keys in reading order, bounded like the text. For results
    without a map see pair_overrides."""
    ordered = F.sort_array(F.transform("pairs", lambda p: F.struct(p["pos"].alias("pos"), p["key"].alias("key"), p["value"].alias("value"))))
    return _receipt_pairs(blocks).select("receipt_key", F.map_from_entries(
        F.transform(ordered, lambda p: F.struct(p["key"], p["value"]))).alias("kv"))


# --- fields from text, historic reading ------------------------------------------------------


def vendor_of(text: Column) -> Column:
    """First line that is not blank, trimmed."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), trim_all), lambda line: line != ""), F.lit(0))


def _found(match: Column, read: Callable[[Column], Column] = lambda m: m) -> Column:
    """read(match) with the match computed once; null, without reading, for an empty one."""
    return let(match, lambda m: F.when(m != "", read(m)))


def amount_of(text: Column) -> Column:
    """First pattern that matches anywhere; comma read as decimal point."""
    found = F.coalesce(*[_found(F.regexp_extract(text, _java(p), 1)) for p in fixed.AMOUNT_PATTERNS])
    return F.translate(found, ",", ".").try_cast("double")


def _composed(year: Column, month: Column, day: Column) -> Column:
    """Date from numbers: months 1-12 and days 1-31 only, a day past the end of its
    month rolls over, years 0-49 are 20xx and 50-99 are 19xx."""
    full = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    valid = month.between(1, 12) & day.between(1, 31)
    start = F.make_date(F.when(valid, full), F.when(valid, month), F.when(valid, F.lit(1)))
    return F.date_add(start, day - 1)


# shapes of a readable date and what separates their parts
_NUMERIC = (r"^\s*\d{1,9}[/\-]\d{1,9}[/\-]\d{1,9}", r"[/\-]")
_WORDED = (rf"^[{_WIDE}]*\d{{1,9}}[{_WIDE}]+\w+[{_WIDE}]+\d{{1,9}}", rf"[{_WIDE}]+")
_MONTH_FIRST = (rf"^[{_WIDE}]*[A-Za-z]+\.?[{_WIDE}]+\d{{1,2}},?[{_WIDE}]+\d{{2,4}}", rf"[.,{_WIDE}]+")


# what may follow a date up to the end of the text: a time, and its zone
_TIME = (rf"(?:(?:T|,?[{_WIDE}]+)(\d{{1,2}}):(\d{{2}})(?::\d{{2}}(?:\.\d+)?)?[{_WIDE}]*([AaPp][Mm])?[{_WIDE}]*"
         rf"(?:Z|UTC|GMT)?([+-]\d{{2}}:?\d{{2}})?)?[{_WIDE}]*$")


def _in_utc(day: Column, text: Column, pattern: str) -> Column:
    """The day on which that time of that zone falls in UTC; without a zone the day itself."""
    def minutes(hour: Column, minute: Column, half: Column, zone: Column) -> Column:
        on_clock = F.when(half == "", hour.cast("int")).otherwise(
            hour.cast("int") % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0)) * 60 + minute.cast("int")
        ahead = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, -2, 2).cast("int")
        return on_clock - F.when(zone.startswith("-"), -ahead).otherwise(ahead)

    part = [F.regexp_extract(text, pattern, g) for g in (1, 2, 3, 4)]
    return F.when(part[3] == "", day).otherwise(F.date_add(day, F.floor(minutes(*part) / 1440).cast("int")))


def _pieces(text: Column, shape: tuple[str, str], read: Callable[[Column, Column, Column], Column]) -> Column:
    """read(first, second, third part) of a text of that shape, which only a time may
    follow, null for other texts. A cast then only meets digits: casts that fail are dear,
    even tolerant ones."""
    date_part, separator = shape
    whole = date_part + _TIME
    parts = F.when(text.rlike(whole), F.split(trim_all(F.regexp_extract(text, date_part, 0)), separator))
    return _in_utc(let(parts, lambda p: read(*[F.get(p, F.lit(i)) for i in range(3)])), text, whole)


def _month_number(word: Column) -> Column:
    """1-12 by the first three letters of the word, null for other words."""
    position = F.array_position(F.array(*[F.lit(m) for m in fixed.MONTH_PREFIXES]), F.lower(F.substring(word, 1, 3)))
    return F.nullif(position, F.lit(0).cast("long")).cast("int")


def _in_order(first: Column, second: Column, third: Column) -> Column:
    """Three numbers: month, day, year when the first could be a month or day,
    otherwise year, month, day."""
    return F.when(first.between(1, 31), _composed(third, first, second)).otherwise(
        _composed(first, second, third))


def _numeric_date(text: Column) -> Column:
    return _pieces(text, _NUMERIC, lambda a, b, c: _in_order(a.cast("int"), b.cast("int"), c.cast("int")))


def _worded_date(text: Column) -> Column:
    """20 Jan 2025 and 10 05 2025."""
    def read(first: Column, middle: Column, last: Column) -> Column:
        a, c = first.cast("int"), last.cast("int")
        number = F.when(middle.rlike(r"^\d{1,9}$"), middle).cast("int")
        named = let(_month_number(middle), lambda month: F.when(
            a.between(1, 31), _composed(c, month, a)).otherwise(_composed(a, month, c)))
        return F.when(number.isNotNull(), _in_order(a, number, c)).otherwise(named)

    return _pieces(text, _WORDED, read)


def _month_first_date(text: Column) -> Column:
    """Jan 20, 2025."""
    return _pieces(text, _MONTH_FIRST, lambda word, day, year: let(
        _month_number(word), lambda month: _composed(year.cast("int"), month, day.cast("int"))))


def date_from(text: Column) -> Column:
    """Date of a text that is one, month first, or one with a time after it; null when not
    readable. A time with a zone counts in UTC, one without is taken as UTC."""
    return F.coalesce(_numeric_date(text), _worded_date(text), _month_first_date(text))


def date_of(text: Column) -> Column:
    """Each pattern's first match in turn; one that is no date gives way to the next."""
    readers = [_numeric_date, _numeric_date, _worded_date]
    # the readers use their text many times: the whole receipt is searched once per pattern
    return F.coalesce(*[_found(F.regexp_extract(text, _java(p), 1), read) for p, read in zip(fixed.DATE_PATTERNS, readers)])


def _last_reading(kv: Column, key_parts: list[str], read) -> Column:
    """Value of the last key that contains one of the words and can be read."""
    def matches(entry: Column) -> Column:
        hit = F.lit(False)
        for part in key_parts:
            hit = hit | entry["key"].contains(part)
        return hit

    entries = F.filter(F.map_entries(kv), matches)
    readings = F.filter(F.transform(entries, lambda e: read(e["value"])), lambda v: v.isNotNull())
    return F.try_element_at(readings, F.lit(-1))


def _total(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^\d.,]", "")
    # only the first comma becomes a point
    return let(F.regexp_replace(digits, r"^([^,]*),", "$1."), leading_number)


def total_from_kv(kv: Column) -> Column:
    return _last_reading(kv, fixed.TOTAL_KEY_PARTS, _total)


def date_from_kv(kv: Column) -> Column:
    return _last_reading(kv, fixed.DATE_KEY_PARTS, date_from)


# --- fields from text, Brazilian reading -------------------------------------------------------

_PRICE = r"(?:R?\$)?[ \t\u00a0]*(\d[\d.]*,\d{2}|\d[\d,]*\.\d{2}|\d+)"
_ITEM = r"(?m)^[ \t]*(\S.*?\S)[ \t]+(\d+)[ \t]+R\$[ \t\u00a0]*(\d[\d.,]*)[ \t\r]*$"


def price_of(text: Column) -> Column:
    """1.234,56 and 1,234.56: the last of the two marks is the decimal one."""
    def read(price: Column) -> Column:
        local = F.translate(F.translate(price, ".", ""), ",", ".")
        foreign = F.translate(price, ",", "")
        return F.when(price.rlike(r",\d{2}$"), local).otherwise(foreign).try_cast("double")

    return let(text, read)


def _local_amount(text: Column) -> Column:
    def on_line(word: str) -> Column:
        return F.regexp_extract(text, rf"(?im)^[ \t]*{word}[ \t]*:?[ \t\u00a0]*" + _PRICE + r"[ \t\r]*$", 1)

    any_price = F.regexp_extract(text, r"(?m)R?\$[ \t\u00a0]*(\d[\d.,]*\d)[ \t\r]*$", 1)
    # a pattern is only searched when those before it aren't found
    return price_of(F.coalesce(*[_found(m) for m in (*[on_line(w) for w in ("total", "amount", "valor", "subtotal")], any_price)]))


def _local_date(text: Column) -> Column:
    iso = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    day_first = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4}|\d{2})\b"
    def dated(pattern: str, read) -> Column:
        return _found(F.regexp_extract(text, pattern, 0), lambda m: let(
            F.split(m, r"[/\-.]"), lambda p: read(*[F.get(p, F.lit(i)).cast("int") for i in range(3)])))

    return F.coalesce(dated(iso, _composed), dated(day_first, lambda d, m, y: _composed(y, m, d)))


def _local_items(text: Column) -> Column:
    # the text is searched once; each match, which begins and ends with its line, is then taken apart
    def item(match: Column) -> Column:
        name, qty, price = [F.regexp_extract(match, _ITEM, g) for g in (1, 2, 3)]
        return F.struct(name.alias("name"), qty.try_cast("int").alias("qty"), price_of(price).alias("price"))

    return F.transform(F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0)), item)


_NO_ITEMS = "array<struct<name:string,qty:int,price:double>>"


def receipt_fields(text: Column, kv: Column | None = None, mode: str = "reference") -> Column:
    """STRUCT<vendor, amount, date, items, total> of one receipt.

    mode 'reference': fixed patterns, month-first dates, no items. mode 'locale':
    skips rule lines, accepts R$, prefers TOTAL over SUBTOTAL, day-first dates, items.
    """
    kv = F.lit(None).cast("map<string,string>") if kv is None else kv
    if mode == "reference":
        vendor, amount, day, items = vendor_of(text), amount_of(text), date_of(text), F.array().cast(_NO_ITEMS)
    elif mode == "locale":
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\p{L}"))
        vendor, amount = trim_all(F.get(lines, F.lit(0))), _local_amount(text)
        day, items = _local_date(text), _local_items(text)
    else:
        raise ValueError("mode must be 'reference' or 'locale'")
    return F.struct(
        vendor.alias("vendor"), amount.alias("amount"),
        F.coalesce(date_from_kv(kv), day).alias("date"),
        items.alias("items"), total_from_kv(kv).alias("total"))


def extract_receipt(receipts: DataFrame, mode: str = "reference", text: str = "text", kv: str = "kv") -> DataFrame:
    """Adds the column parsed. Row by row: no shuffle, whole text."""
    pairs = F.col(kv) if kv in receipts.columns else None
    return receipts.withColumn("parsed", receipt_fields(F.col(text), pairs, mode))


# --- writing results back ------------------------------------------------------------------------


def apply_ocr_results(expenses: DataFrame, queue: DataFrame, results: DataFrame, as_of, latest: str | None = None
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expenses, queue, audit rows) after a batch of OCR results.

    results: expense_id, full_text, kv, confidence, parsed, error. Without error: data
    and status are stored, an audit row is written. With error: status failed, message
    kept, attempts + 1, no audit row. Of several results of one expense (retries, repeated
    deliveries) the latest by the column `latest` counts, where it is given; ties and
    the rest go to a result without error, then to the higher confidence, then text.
    """
    now = moment(as_of)
    order = [F.col(latest)] if latest else []
    results = one_per(results, "expense_id", [*order, F.col("error").isNull(), F.col("confidence"), F.col("full_text"), F.col("error")])
    done = results.select(
        F.col("expense_id").alias("r_id"), F.col("error").alias("r_error"), F.col("confidence").alias("r_confidence"),
        "parsed",
        F.to_json(F.struct(F.col("full_text").alias("fullText"), F.col("kv").alias("keyValuePairs"),
                           "confidence", "parsed")).alias("r_data"))
    seen, failed = F.col("r_id").isNotNull(), F.col("r_error").isNotNull()
    outcome = F.when(failed, "failed").otherwise("completed")

    thin = done.drop("parsed")
    new_expenses = expenses.join(thin, F.col("id") == F.col("r_id"), "left").withColumns({
        "ocr_data": F.when(seen & ~failed, F.col("r_data")).otherwise(F.col("ocr_data")),
        "ocr_status": F.when(seen, outcome).otherwise(F.col("ocr_status")),
        "updated_at": F.when(seen, now).otherwise(F.col("updated_at")),
    }).select(*expenses.columns)

    state = done.select("r_id", "r_error")
    new_queue = queue.join(state, F.col("expense_id") == F.col("r_id"), "left").withColumns({
        "status": F.when(seen, outcome).otherwise(F.col("status")),
        "error_message": F.when(seen & failed, F.col("r_error")).otherwise(F.col("error_message")),
        "attempts": F.when(seen & failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "processed_at": F.when(seen, now).otherwise(F.col("processed_at")),
    }).select(*queue.columns)

    audit = done.filter(~failed).join(expenses.select("id", "user_id"), F.col("r_id") == F.col("id")).select(
        F.col("r_id").alias("expense_id"), "user_id", F.lit("ocr_processed").alias("action"),
        F.concat(F.lit("OCR processing completed with "), percent_text(F.col("r_confidence")),
                 F.lit(" confidence")).alias("notes"),
        F.to_json(F.struct(F.col("r_confidence").alias("confidence"),
                           F.col("parsed").alias("parsedData"))).alias("metadata"),
        now.alias("created_at"))
    return new_expenses, new_queue, audit


def retry_failed(expenses: DataFrame, queue: DataFrame, texts: DataFrame, as_of, n: int | None = None,
                 hours: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs the extraction again for the retry candidates. texts: expense_id, full_text,
    kv, confidence; a candidate without text fails again."""
    from spendspark.operators.views import retry_candidates

    jobs = retry_candidates(queue, as_of, n, hours).select("expense_id").distinct()
    known = jobs.join(expenses.select(F.col("id").alias("known_id")), F.col("expense_id") == F.col("known_id")).drop("known_id")
    redone = known.join(texts, "expense_id", "left")
    results = redone.withColumn("parsed", receipt_fields(F.col("full_text"), F.col("kv"))).withColumn(
        "error", F.when(F.col("full_text").isNull(), "Failed to extract text from receipt"))
    return apply_ocr_results(expenses, queue, results, as_of)


def autofill_expenses(forms: DataFrame) -> DataFrame:
    """Form rows with the OCR values put in: vendor, amount, date override the form
    where the receipt has them; an amount that is no number or 0 empties the field.
    Columns: vendor, amount, expense_date, category, ocr MAP<STRING,STRING>,
    suggested_category."""
    kv = F.col("ocr")
    vendor, amount, day = (F.nullif(kv[k], F.lit("")) for k in ("vendor", "amount", "date"))
    number = leading_number(amount)
    return forms.withColumns({
        "vendor": F.coalesce(vendor, F.col("vendor")),
        "amount": F.when(amount.isNotNull(), F.nullif(number, F.lit(0.0))).otherwise(F.col("amount").cast("double")),
        "expense_date": F.when(day.isNotNull(), date_from(day)).otherwise(F.col("expense_date")),
        "category": F.coalesce(F.nullif("suggested_category", F.lit("")), F.col("category")),
    })


def pair_overrides(pairs: DataFrame) -> DataFrame:
    """total and date per receipt from the long form of blocks_to_pairs: plain
    aggregates, so a receipt with very many pairs needs no map."""
    def named(words: list[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.col("key").contains(word)
        return hit

    read = pairs.select("receipt_key", "pos",
                        F.when(named(fixed.TOTAL_KEY_PARTS), _total(F.col("value"))).alias("t"),
                        F.when(named(fixed.DATE_KEY_PARTS), date_from(F.col("value"))).alias("d"))
    return read.groupBy("receipt_key").agg(
        F.max_by("t", F.when(F.col("t").isNotNull(), F.col("pos"))).alias("total"),
        F.max_by("d", F.when(F.col("d").isNotNull(), F.col("pos"))).alias("date"))
