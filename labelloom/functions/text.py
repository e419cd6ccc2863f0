"""Text normal forms, predicates and value parsers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions import vocabulary as V

SPACES = r"(?U)\s+"


def clean(text: Column) -> Column:
    """White space runs as one space, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def match_form(text: Column) -> Column:
    """The form that labels are looked for in."""
    low = F.lower(clean(text))
    low = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), V.MATCH_REPLACEMENTS, low)
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[;|]+", " "), SPACES, " "))


def alnum_form(text: Column) -> Column:
    return F.regexp_replace(match_form(text), "[^a-z0-9]", "")


def clean_token(text: Column) -> Column:
    """Without noise at the edges. A value in another script alone becomes empty."""
    x = F.regexp_replace(clean(text), "^[^A-Za-z0-9₹+]+", "")
    x = F.regexp_replace(x, "[^A-Za-z0-9₹@+.,:/()&' -]+$", "")
    return F.btrim(x, F.lit(" :-;,.|"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(match_form(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared different tokens over the larger count of them."""
    x, y = tokens(a), tokens(b)
    most = F.greatest(F.size(x), F.size(y))
    none = F.least(F.size(x), F.size(y)) == 0
    return F.when(none, 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def unicode_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(clean(text)), r"[^\p{L}\p{N}]", "")


def is_useful(text: Column) -> Column:
    """Has a letter or digit, and 180 characters at most."""
    x = clean(text)
    return x.rlike(r"[\p{L}\p{N}]") & (F.length(x) <= 180)


def unit_clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def to_double(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def adjusted_confidence(confidence: Column, text: Column, source: Column) -> Column:
    x = clean(text)
    short = (F.length(x) <= 2) & x.rlike(r"^\p{L}+$")
    score = unit_clip(confidence) * F.when(short, 0.85).otherwise(1.0)
    score = score * F.when(x.rlike(r"\p{Nd}"), 1.02).otherwise(1.0) * F.when(source == "original", 1.03).otherwise(1.0)
    return unit_clip(score)


def fusion_form(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    low = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), V.FUSION_REPLACEMENTS, low)
    return F.trim(F.regexp_replace(low, SPACES, " "))


def fusion_compact(value: Column) -> Column:
    return F.regexp_replace(fusion_form(value), r"[^\p{L}\p{N}]", "")


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value, F.lit("")) != ""


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def word_count(text: Column) -> Column:
    x = clean(text)
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def parsed_money(raw: Column) -> Column:
    """Comma as decimal point; above 0 and a million at most."""
    x = F.regexp_replace(F.replace(raw, F.lit(","), F.lit(".")), "[^0-9.]", "").try_cast("double")
    return F.when((x > 0) & (x <= 1_000_000), x)


def money_text(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("₹%.2f", value))


def normal_quantity(number: Column, unit: Column) -> Column:
    """Such as "500 g": whole numbers as integers, others to six digits."""
    x = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    low = F.lower(unit)
    names = F.create_map(*(F.lit(y) for pair in V.UNITS.items() for y in pair))
    short = F.coalesce(F.try_element_at(names, low), low)
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), 5 - F.floor(F.log10(x))))
    six = F.regexp_replace((F.round(x * scale) / scale).cast("string"), r"\.0$", "")
    return F.when(x > 0, F.concat(F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(six), F.lit(" "), short))


def batch_token(value: Column) -> Column:
    """The token of a text that looks most like a batch code, or null.

    Of tokens with a digit: those with a letter first, then 20 characters at
    most, then the longer, then the earlier. Without such, the first token.
    """
    x = F.regexp_replace(clean_token(value), r"(?i)^n[oe]?\s*[_:.-]*\s*", "")
    x = F.regexp_replace(x, r"(?i)^(?:number|no)\s*[_:.: -]*\s*", "")
    x = F.trim(F.regexp_replace(x, r"^[_:;,.\-\s]+", ""))
    found_ = F.regexp_extract_all(x, F.lit(r"([A-Za-z0-9][A-Za-z0-9._/-]{2,39})"), F.lit(1))
    numeric = F.filter(found_, lambda t: t.rlike(r"\d"))
    ranked = F.transform(
        numeric,
        lambda t, i: F.struct(t.rlike("[A-Za-z]").cast("int").alias("a"), (F.length(t) <= 20).cast("int").alias("b"), F.length(t).alias("c"), (-i).alias("d"), t.alias("t")),
    )
    return F.when(F.size(numeric) > 0, F.array_max(ranked)["t"]).otherwise(F.get(found_, 0))


def is_batch(value: Column) -> Column:
    x = clean_token(value)
    low = match_form(x)
    return F.coalesce(
        F.length(x).between(3, 40)
        & ~low.isin(V.NON_VALUE_WORDS)
        & ~x.rlike(r"^(19|20)\d{2}$")
        & ~x.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$")
        & ~x.rlike(r"^\d+(?:[.,]\d+)?$")
        & x.rlike(r"\d")
        & ~low.rlike(V.BATCH_ADDRESS)
        & x.rlike(r"^[A-Za-z0-9][A-Za-z0-9./_ -]{2,39}$"),
        F.lit(False),
    )


def _month(name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(y) for pair in V.MONTHS.items() for y in pair)), F.lower(name))


def _full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def parsed_date(text: Column) -> Column:
    """A full date, as "11 APR 2026" or "11/04/2026", or null. Only the first match of each form counts, and no calendar."""
    x = clean(text)
    named = r"(?i)\b(\d{1,2})\s*([A-Za-z]{3,9})\s*(\d{2,4})\b"
    day, month, year = found(x, named, 1).cast("int"), _month(found(x, named, 2)), found(x, named, 3).cast("int")
    by_name = F.when(month.isNotNull() & day.between(1, 31), F.format_string("%02d %s %04d", day, month, _full_year(year)))
    plain = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
    d, m, y = (found(x, plain, g).cast("int") for g in (1, 2, 3))
    by_number = F.when(d.between(1, 31) & m.between(1, 12), F.format_string("%02d/%02d/%04d", d, m, _full_year(y)))
    return F.coalesce(by_name, by_number)


def partial_date(text: Column) -> Column:
    """struct<day, month> of a date whose year stands elsewhere, or null; looked at where no full date is."""
    x = clean(text)
    pattern = r"(?i)\b(\d{1,2})\s*([A-Za-z]{3,9})\b"
    day, month = found(x, pattern, 1).cast("int"), _month(found(x, pattern, 2))
    return F.when(parsed_date(text).isNull() & month.isNotNull() & day.between(1, 31), F.struct(day.alias("day"), month.alias("month")))


def month_in(text: Column) -> Column:
    return _month(found(clean(text), rf"(?i)\b{V.MONTH_PATTERN}\b"))


def year_in(text: Column) -> Column:
    return found(clean(text), r"\b((?:19|20)\d{2})\b").cast("int")


def days_in(text: Column) -> Column:
    """Numbers from 1 to 31 that stand alone, save those after a price or weight mark."""
    x = clean(text)
    runs = F.regexp_extract_all(x, F.lit(r"(?i)((?:\bmrp\b|\brs\b|₹|\bkg\b)[^0-9]{0,8}(?=\d))?(?<!\d)([0-3]?\d)(?!\d)"), F.lit(0))
    free = F.filter(runs, lambda r: r.rlike(r"^\d+$"))
    return F.filter(F.transform(free, lambda r: r.cast("int")), lambda d: d.between(1, 31))


def normal_phone(phone: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(digits.rlike(r"^(?:91)?[6-9]\d{9}$"), F.concat(F.lit("+91-"), F.right(digits, F.lit(10))))


def phones_in(text: Column) -> Column:
    found_ = F.regexp_extract_all(clean(text), F.lit(f"({V.PHONE})"), F.lit(1))
    return F.filter(F.transform(found_, normal_phone), lambda p: p.isNotNull())


def emails_in(text: Column) -> Column:
    return F.regexp_extract_all(clean(text), F.lit(f"({V.EMAIL})"), F.lit(1))


def licence_number(text: Column) -> Column:
    """All digits of the text, if there are 14."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 14, digits)


def is_product(value: Column) -> Column:
    x = clean_token(value)
    low = match_form(x)
    return (
        (x != "")
        & ~low.rlike(V.PRODUCT_BAD)
        & ~x.contains("@")
        & ~x.rlike(r"\b\d{5,}\b")
        & x.rlike("[A-Za-z]{2,}")
        & (F.length(x) <= 70)
        & ~low.rlike(V.PRODUCT_ADDRESS)
    )


def is_company(value: Column) -> Column:
    low = match_form(value)
    return F.coalesce(F.length(value).between(3, 160) & ~value.contains("@") & ~low.rlike(V.COMPANY_BAD) & value.rlike("[A-Za-z]{2,}"), F.lit(False))


def is_address(text: Column) -> Column:
    x = clean(text)
    low = match_form(x)
    return (x != "") & (low.rlike(V.ADDRESS_HINT) | x.rlike(r"\b\d{6}\b") | low.rlike(V.ADDRESS_PREFIX))


def address_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(clean(text), r"^[|:;,.\s]+", ""), F.lit(" ,;|-_"))


def is_next_declaration(text: Column) -> Column:
    return match_form(text).rlike(V.NEXT_DECLARATION)


def exact_label(form: Column, labels: list[str]) -> Column:
    """The first label that a matching form contains, or null."""
    return F.coalesce(*(F.when(form.contains(label), F.lit(label)) for label in labels), F.lit(None).cast("string"))


def label_positions(form: Column, labels: list[str]) -> Column:
    """array of (at, length, label), in order: where each label that a matching form contains begins, from 0."""
    found = F.array(*(F.struct((F.locate(x, form) - 1).alias("at"), F.lit(len(x)).alias("length"), F.lit(x).alias("label")) for x in labels))
    return F.array_sort(F.filter(found, lambda x: x["at"] >= 0))


def without_exact_label(text: Column, labels: list[str]) -> Column:
    """Text without the first occurrence of the longest label in it; null if none is."""
    x = clean(text)
    options = []
    for label in sorted(labels, key=len, reverse=True):
        escaped = "".join(c if c.isalnum() or c == " " else "\\" + c for c in label)
        pattern = rf"(?is)^(.*?){escaped}\s*[:;\-.]*\s*(.*)$"
        options.append(F.when(x.rlike(pattern), clean(F.regexp_replace(x, pattern, "$1$2"))))
    return F.coalesce(*options)
