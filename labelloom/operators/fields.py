"""The fifteen declared fields: candidates from lines, ranked, best one kept.

Every extractor turns prepared lines into candidate rows by filters, pattern
extraction and neighbour joins; all fields' candidates then go through grouping
and ranking together, so that a package is shuffled once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions import text as T
from labelloom.functions import vocabulary as V
from labelloom.functions.similarity import sequence_ratio, similarity, with_labels, with_rests
from labelloom.operators.candidates import exact_groups, first_fit, group_scores, top_group
from labelloom.operators.lines import ranked_neighbours
from labelloom.staging import dealt, keyed, stage_keyed

#: Vertical reaches in which extractors look for neighbours.
GAPS = (80, 100, 120, 140, 150, 170, 180)
MOST_NEIGHBOURS = 8
#: Kinds of label whose line may hold the value, too.
RESTS = ("manufacturer", "best_before", "ingredients", "nutrition")
#: What a line is told of its neighbours.
NEIGHBOUR = ("text", "form", "confidence", "geo", "label", "source")


def conf() -> Column:
    return F.col("confidence")


def candidate(rows: DataFrame, field_: str, value: Column, score: Column, strategy: int, confidence: Column | str = "confidence", source: Column | str = "source", rank: Column | None = None) -> DataFrame:
    """Candidate rows; order is that of the line, the strategy, then the rank."""
    order = F.array(F.col("pos").cast("int"), F.lit(strategy), (rank if rank is not None else F.lit(0)).cast("int"))
    src = F.col(source) if isinstance(source, str) else source
    sure = F.col(confidence) if isinstance(confidence, str) else confidence
    return rows.select(
        "package_id", F.lit(field_).alias("field"), order.alias("ord"), value.alias("value"), score.cast("double").alias("score"), sure.cast("double").alias("confidence"), src.alias("source")
    ).where(F.col("value").isNotNull())


@dataclass
class Lines:
    """Prepared lines, each with its labels and its neighbours, staged once for all extractors.

    `near` holds the neighbours of a line as structs (pos, text, form, confidence,
    geo, label, source, apart, ranks), no more than MOST_NEIGHBOURS for each of GAPS,
    so that extractors look around without a join.
    """

    rows: DataFrame

    @classmethod
    def of(cls, prepared: DataFrame) -> Lines:
        plain = stage_keyed(dealt(prepared.withColumn("pos", F.col("pos").cast("int")), "package_id"), "lines")
        told = stage_keyed(with_rests(with_labels(plain, V.LABELS), {k: V.LABELS[k] for k in RESTS}), "labelled-lines")
        pairs = ranked_neighbours(plain, GAPS, MOST_NEIGHBOURS).where(F.array_min("ranks") <= MOST_NEIGHBOURS)
        pairs = pairs.select("package_id", F.col("i").cast("int").alias("pos"), F.col("j").cast("int").alias("n_pos"), "ranks")
        item = F.struct("n_pos", *(f"n_{c}" for c in NEIGHBOUR), "ranks")
        other = told.select("package_id", F.col("pos").alias("n_pos"), *(F.col(c).alias(f"n_{c}") for c in NEIGHBOUR))
        near = pairs.join(other, ["package_id", "n_pos"]).groupBy("package_id", "pos").agg(F.collect_list(item).alias("near"))
        return cls(stage_keyed(told.join(near, ["package_id", "pos"], "left"), "lines-and-neighbours"))

    def near(self, count: int, gap: int, base: DataFrame | None = None) -> DataFrame:
        """Lines (of `base`) with each of their neighbours: n_text, n_form, n_confidence, n_pos, n_geo, n_label, n_source, rank, apart."""
        rows = base if base is not None else self.rows
        at = GAPS.index(gap)
        told = rows.select(*(c for c in rows.columns if c != "near"), F.inline(F.filter("near", lambda x: x["ranks"][at] <= count)))
        return told.withColumn("rank", F.col("ranks")[at]).withColumn("apart", G.relative_distance(F.col("geo"), F.col("n_geo")))

    def by_label(self, name: str) -> DataFrame:
        return self.rows.where(F.col(f"label.{name}").isNotNull())

    def with_label_near(self, base: DataFrame, name: str, count: int, gap: int = 180) -> DataFrame:
        """base with label_near: whether a neighbour bears the label."""
        at = GAPS.index(gap)
        found = F.exists("near", lambda x: (x["ranks"][at] <= count) & x["n_label"][name].isNotNull())
        return base.withColumn("label_near", F.coalesce(found, F.lit(False)))


def product_candidates(lines: Lines) -> DataFrame:
    rows = lines.rows
    named = T.clean_token(T.found(F.col("text"), r"(?i)^(?:product(?:\s+name)?|item(?:\s+name)?)\s*[:\-]\s*(.+)$"))
    explicit = candidate(rows, "product_name", F.when(T.is_product(named), named), F.lit(150), 0)
    made_of = rows.withColumn("first", T.clean_token(T.found(F.col("text"), r"(?i)^ingredient\s*[:\-]\s*(.+)$"))).where(T.is_product(F.col("first")))
    single = candidate(made_of, "product_name", F.col("first"), 95 + F.least(F.length("first"), F.lit(30)), 1)
    # a neighbour completes the name, unless it has it already, or a better reading is next to it
    first_letters = T.alnum_form(F.col("first"))
    beside = lines.near(4, 100, made_of).where(
        T.is_product(F.col("n_text")) & ~F.col("n_form").rlike(V.PRODUCT_NEIGHBOUR_BAD) & ((first_letters == "") | ~T.alnum_form(F.col("n_text")).contains(first_letters))
    )
    around = lines.near(5, 80).select("package_id", F.col("pos").alias("n_pos"), F.col("n_text").alias("alt"), F.col("n_confidence").alias("alt_confidence"))
    better = (
        beside.select("package_id", "pos", "n_pos", "first")
        .join(around, ["package_id", "n_pos"])
        .where((T.word_count(F.col("alt")) >= 2) & (first_letters != "") & T.alnum_form(F.col("alt")).startswith(first_letters) & (F.col("alt_confidence") >= 0.70))
        .select("package_id", "pos", "n_pos")
        .distinct()
    )
    joined = T.clean_token(F.concat_ws(" ", "first", "n_text"))
    fits = (F.length(joined) <= 70) & joined.rlike(r"^[A-Za-z][A-Za-z '&/.-]+$")
    both = beside.join(better, ["package_id", "pos", "n_pos"], "left_anti")
    combined = candidate(both, "product_name", F.when(fits, joined), F.lit(142), 2, (conf() + F.col("n_confidence")) / 2, rank=F.col("rank"))
    letters, upper = (F.length(F.regexp_replace("text", p, "")) for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    loud = rows.where(T.is_product(F.col("text")) & ~F.col("text").rlike(r"\d") & (letters > 0) & (upper >= 0.55 * letters))
    words = T.word_count(F.col("text"))
    score = 52 + F.when(words >= 2, 22).when((words == 1) & (F.length("text") <= 5), -20).otherwise(0)
    return reduce(DataFrame.unionByName, (explicit, single, combined, candidate(loud, "product_name", F.col("text"), score, 3)))


def price_candidates(lines: Lines) -> DataFrame:
    """Values as "₹%.2f", which is their key too: prices of one amount are one."""
    amount = r"([0-9]{1,7}(?:[.,][0-9]{1,2})?)"
    labelled = T.parsed_money(T.found(F.col("text"), rf"(?i)\bmrp\b[^0-9]{{0,28}}(?:rs|inr)?\s*{amount}"))
    currency = T.parsed_money(T.found(F.col("text"), rf"(?i)(?:₹|rs\.?|inr)\s*{amount}"))
    loose = F.when(F.col("form").contains("mrp"), T.parsed_money(T.found(F.col("text"), rf"(?i)\bmrp\b.*?{amount}")))
    rows = lines.rows.withColumn("p", labelled)
    strong = candidate(rows, "mrp", T.money_text(F.col("p")), 155 + conf() * 35, 0)
    weak = rows.where("p is null").withColumn("p", currency).withColumn("q", loose).where("p is not null or q is not null")
    weak = lines.with_label_near(weak, "mrp", 3)
    plain = candidate(weak, "mrp", T.money_text(F.col("p")), 65 + conf() * 20 + F.when(F.col("label_near"), 40).otherwise(0), 1)
    return strong.unionByName(plain).unionByName(candidate(weak, "mrp", T.money_text(F.col("q")), 135 + conf() * 30, 2))


def quantity_candidates(lines: Lines) -> DataFrame:
    number = r"([0-9]{1,7}(?:[.,][0-9]+)?)\s*"
    labelled = rf"(?i)(?:net\s*(?:quantity|qty|weight|wt))\s*[:;\-]?\s*{number}{V.UNIT_PATTERN}\b"
    generic = rf"(?i)\b{number}{V.UNIT_PATTERN}\b"

    def read(text: Column, pattern: str) -> Column:
        return T.normal_quantity(T.found(text, pattern, 1), T.found(text, pattern, 2))

    rows = lines.rows.where(~F.col("form").rlike(V.QUANTITY_CONTEXT_BAD)).withColumn("q", read(F.col("text"), labelled))
    strong = candidate(rows, "net_quantity", F.col("q"), F.lit(155), 0)
    rest = rows.where("q is null")
    plain = lines.with_label_near(rest.withColumn("q", read(F.col("text"), generic)).where("q is not null"), "quantity", 3)
    weak = candidate(plain, "net_quantity", F.col("q"), 62 + conf() * 20 + F.when(F.col("label_near"), 45).otherwise(0), 1)
    beside = lines.near(4, 100, rest.where("label.quantity is not null")).withColumn("q", read(F.col("n_text"), generic))
    split = candidate(beside, "net_quantity", F.col("q"), 135 + conf() * 20 + F.col("n_confidence") * 20, 2, (conf() + F.col("n_confidence")) / 2, rank=F.col("rank"))
    return strong.unionByName(weak).unionByName(split)


def batch_candidates(lines: Lines) -> DataFrame:
    same = T.batch_token(T.found(F.col("text"), r"(?i)(?:batch|lot)\s*(?:no|number)?\s*[:;._\-]?\s*(.+)$"))
    rows = lines.rows.withColumn("b", same)
    direct = candidate(rows.where(T.is_batch(F.col("b"))), "batch_number", F.col("b"), F.lit(180), 0)
    beside = lines.near(6, 140, lines.by_label("batch")).withColumn("b", T.batch_token(F.col("n_text")))
    beside = beside.where(T.is_batch(F.col("b")) & ~T.match_form(F.col("b")).rlike(V.BATCH_NEIGHBOUR_BAD))
    score = 105 + conf() * 20 + F.col("n_confidence") * 30 - F.least(F.col("apart"), F.lit(100.0))
    return direct.unionByName(candidate(beside, "batch_number", F.col("b"), score, 1, F.col("n_confidence"), "n_source", F.col("rank")))


def dates(lines: Lines, name: str) -> DataFrame:
    """(package_id, field, value): the date at the label of most confidence, read from its surroundings.

    A full date nearby wins; else day, month and year are chosen each by
    confidence and nearness, and all three are needed.
    """
    base = lines.by_label(name).select("package_id", "pos", conf().alias("label_confidence"), "geo", "near")
    near = lines.near(8, 170, base).select("package_id", "pos", "n_pos")
    base = base.drop("near")
    offset = F.explode(F.array(*(F.lit(x) for x in (-2, -1, 0, 1, 2, 3, 4, 5)))).alias("d")
    window = base.select("package_id", "pos", offset).select("package_id", "pos", (F.col("pos") + F.col("d")).alias("n_pos"))
    wanted = near.unionByName(window).distinct()
    other = lines.rows.select("package_id", F.col("pos").alias("n_pos"), F.col("text").alias("t"), conf().alias("c"), F.col("geo").alias("n_geo"))
    seen = wanted.join(other, ["package_id", "n_pos"]).join(base, ["package_id", "pos"])
    own = F.col("n_pos") == F.col("pos")
    rise = F.when(own | F.col("geo").isNull() | F.col("n_geo").isNull(), 0.0).otherwise(F.abs(F.col("geo.y") - F.col("n_geo.y")))
    apart = F.when(own, 0.0).otherwise(G.relative_distance(F.col("geo"), F.col("n_geo")))
    close = F.greatest(F.lit(0.0), 120 - F.least(rise, F.lit(120.0))) + F.greatest(F.lit(0.0), 15 - F.least(apart, F.lit(15.0)))
    told = seen.withColumn("close", close).withColumn("full", T.parsed_date(F.col("t"))).withColumn("m", T.month_in(F.col("t"))).withColumn("y", T.year_in(F.col("t")))
    told = told.withColumn("days", T.days_in(F.col("t"))).withColumn("day", F.array_max("days"))

    def best(value: str, score: Column) -> Column:
        return F.max(F.when(F.col(value).isNotNull(), F.struct(score.alias("s"), F.col(value).alias("v"))))["v"]

    per_label = told.groupBy("package_id", "pos").agg(
        F.max("label_confidence").alias("label_confidence"), best("full", 220 + F.col("c") * 45 + F.col("close")).alias("full"),
        best("day", F.col("c") * 90 + F.col("close") + F.when(own, 35).otherwise(0)).alias("day"), best("m", F.col("c") * 100 + F.col("close")).alias("m"),
        best("y", F.col("c") * 110 + F.col("close")).alias("y"),
    )
    parts = F.when(F.col("day").isNotNull() & F.col("m").isNotNull() & F.col("y").isNotNull(), F.format_string("%02d %s %04d", "day", "m", "y"))
    value = per_label.withColumn("value", F.coalesce("full", parts)).where("value is not null")
    first = F.struct(F.col("label_confidence"), (-F.col("pos")).alias("p"))
    return value.groupBy("package_id").agg(F.max_by("value", first).alias("value")).select("package_id", F.lit(name).alias("field"), "value")


def manufacturer_candidates(lines: Lines) -> DataFrame:
    bonus = rf"(?i){V.COMPANY_SUFFIX}"
    base = lines.by_label("manufacturer").withColumn("v", F.col("rest.manufacturer"))
    own = base.where(T.is_company(F.col("v")))
    direct = candidate(own, "manufacturer", F.col("v"), 145 + conf() * 30 + F.when(F.col("v").rlike(bonus), 25).otherwise(0), 0)
    beside = lines.near(6, 150, base).where(T.is_company(F.col("n_text")) & ~F.col("n_form").rlike(V.COMPANY_NEIGHBOUR_BAD))
    score = 115 + conf() * 20 + F.col("n_confidence") * 35 - F.least(F.col("apart"), F.lit(60.0)) + F.when(F.col("n_text").rlike(bonus), 25).otherwise(0)
    return direct.unionByName(candidate(beside, "manufacturer", F.col("n_text"), score, 1, F.col("n_confidence"), "n_source", F.col("rank")))


def contact_names(lines: Lines) -> DataFrame:
    """(package_id, ord, hint): company names that e-mail addresses and contact lines suggest.

    A compact name is cut before the longest company suffix in it (of equal
    length the first by letter); of others the words that name a service go.
    """
    x = lines.rows
    contact = F.col("form").rlike("email|mail|care|gmail|gmall")
    chunks = F.when(contact, F.regexp_extract_all("text", F.lit(r"([A-Za-z]{4,}(?:[._ -]?[A-Za-z]{2,}){0,4})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    locals_ = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9][A-Za-z0-9._+-]*)@"), F.lit(1))
    told = x.select("package_id", "pos", F.posexplode(F.concat(locals_, F.array_except(chunks, locals_))).alias("n", "local"))
    told = told.withColumn("compact", F.lower(F.regexp_replace("local", "[^A-Za-z0-9]", ""))).where(F.length("compact") >= 4)
    cut = F.lit(None).cast("string")
    for suffix in sorted(V.COMPANY_SUFFIXES, key=lambda s: (len(s), [-ord(c) for c in s])):
        at = F.locate(suffix, F.col("compact"))
        cut = F.when(at >= 4, F.concat(F.substring("compact", F.lit(1), at - 1), F.lit(f" {suffix}"))).otherwise(cut)
    words = F.filter(F.split(F.regexp_replace(F.lower("local"), "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    stops = F.array(*map(F.lit, V.CONTACT_STOP_WORDS))
    last = F.array_max(F.transform(words, lambda w, i: F.when(~F.array_contains(stops, w), i + 1).otherwise(0)))
    plain = F.nullif(F.array_join(F.slice(words, 1, F.least(F.coalesce(last, F.lit(0)), F.lit(3))), " "), F.lit(""))
    return told.select("package_id", F.array("pos", "n").alias("ord"), F.coalesce(cut, plain).alias("hint")).where("hint is not null")


def corrected_manufacturer(best: DataFrame, lines: Lines) -> DataFrame:
    """(package_id, value): the declared company, spelt as a contact has it if that agrees strongly."""
    told = best.join(contact_names(lines), "package_id")
    told = told.withColumn("d", F.split(T.match_form(F.col("value")), " ")).withColumn("h", F.split(T.match_form(F.col("hint")), " "))

    def letters(w: Column) -> Column:
        return F.regexp_replace(F.lower(w), "[^a-z]", "")

    pairs = told.select("package_id", "ord", F.posexplode("d").alias("n", "dw"), "h").select("package_id", "ord", "n", letters(F.col("dw")).alias("dw"), F.explode("h").alias("hw"))
    words = pairs.select("dw", letters(F.col("hw")).alias("hw")).distinct().withColumn("r", sequence_ratio(F.col("dw"), F.col("hw")))
    token = keyed(pairs.withColumn("hw", letters(F.col("hw")))).join(words, ["dw", "hw"]).groupBy("package_id", "ord", "n").agg(F.max("r").alias("r"))
    token = token.groupBy("package_id", "ord").agg(F.avg("r").alias("token_score"), F.max("r").alias("best_token"))
    shared = F.size(F.array_intersect(F.array_intersect("d", "h"), F.array(*map(F.lit, V.COMPANY_SUFFIXES)))) > 0
    told = keyed(told).join(token, ["package_id", "ord"]).withColumn("phrase", similarity(F.col("value"), F.col("hint"))).withColumn("shared", shared)
    score = 0.35 * F.col("phrase") + 0.35 * F.col("token_score") + 0.20 * T.token_overlap(F.col("value"), F.col("hint")) + F.when(F.col("shared"), 0.15).otherwise(0.0)
    shown = F.array_join(F.transform("h", lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
    told = told.withColumn("s", score).withColumn("shown", shown)
    sure = told.where((F.col("s") >= 0.68) & (F.col("best_token") >= 0.78) & (F.col("shared") | (F.col("phrase") >= 0.72)) & T.is_company(F.col("shown")))
    order = Window.partitionBy("package_id").orderBy(F.desc("s"), "ord")
    better = sure.withColumn("r", F.row_number().over(order)).where("r = 1").select("package_id", "shown")
    return best.join(better, "package_id", "left").select("package_id", F.coalesce("shown", "value").alias("value"))


def contact_candidates(lines: Lines) -> DataFrame:
    """Phones (with no source) and, where a package has none, e-mail addresses."""
    x = lines.with_label_near(lines.rows.where(F.col("text").rlike(V.PHONE) | F.col("text").contains("@")), "consumer", 4)
    phones = x.select("*", F.posexplode(T.phones_in(F.col("text"))).alias("n", "phone"))
    score = 90 + conf() * 30 + F.when(F.col("label.consumer").isNotNull(), 75).otherwise(0) + F.when(F.col("label_near"), 45).otherwise(0)
    none = F.lit(None).cast("string")
    told = candidate(phones, "consumer_care", F.col("phone"), score, 0, source=none, rank=F.col("n"))
    mails = x.select("*", F.posexplode(T.emails_in(F.col("text"))).alias("n", "mail"))
    return told.unionByName(candidate(mails, "consumer_email", F.col("mail"), 95 + conf() * 20, 1, source=none, rank=F.col("n")))


def country_candidates(lines: Lines) -> DataFrame:
    patterns = [r"(?i)\bcountry\s+of\s+origin\s*[:\-]?\s*(.+)$", r"(?i)\bmade\s+in\s+(.+)$", r"(?i)\bproduct\s+of\s+(.+)$"]
    found = [candidate(lines.rows, "country_of_origin", F.nullif(T.clean_token(T.found(F.col("text"), p)), F.lit("")), 160 + conf() * 20, n) for n, p in enumerate(patterns)]
    return reduce(DataFrame.unionByName, found)


def best_before_candidates(lines: Lines) -> DataFrame:
    base = lines.by_label("best_before").withColumn("v", F.col("rest.best_before"))
    own = candidate(base.where(T.present(F.col("v"))), "best_before", F.col("v"), 145 + conf() * 25, 0)
    beside = lines.near(4, 120, base.where(~T.present(F.col("v")))).where(~F.col("n_form").rlike(V.BEST_BEFORE_NEIGHBOUR_BAD))
    score = 115 + conf() * 20 + F.col("n_confidence") * 25
    return own.unionByName(candidate(beside, "best_before", F.col("n_text"), score, 1, (conf() + F.col("n_confidence")) / 2, "n_source", F.col("rank")))


def licence_candidates(lines: Lines) -> DataFrame:
    base = lines.rows.where(F.col("label.licence").isNotNull() | F.col("form").rlike(V.LICENCE_CONTEXT)).withColumn("v", T.licence_number(F.col("text")))
    own = candidate(base, "fssai_license_number", F.col("v"), 220 + conf() * 40, 0)
    beside = lines.near(8, 170, base.where("v is null")).withColumn("v", T.licence_number(F.col("n_text"))).where(~F.col("n_form").rlike(V.LICENCE_NEIGHBOUR_BAD))
    score = 165 + conf() * 25 + F.col("n_confidence") * 55 - F.least(F.col("apart"), F.lit(90.0))
    return own.unionByName(candidate(beside, "fssai_license_number", F.col("v"), score, 1, F.col("n_confidence"), "n_source", F.col("rank")))


def section_candidates(lines: Lines, name: str, count: int, gap: int) -> DataFrame:
    base = lines.by_label(name).withColumn("v", F.col(f"rest.{name}"))
    told = T.present(F.col("v")) & ~T.is_next_declaration(F.col("v"))
    own = candidate(base.where(told), name, F.col("v"), 180 + conf() * 35, 0)
    beside = lines.near(count, gap, base.where(~told)).where(
        F.col(f"n_label.{name}").isNull() & ~T.is_next_declaration(F.col("n_text")) & ~F.col("n_text").rlike(r"^[:;,.|_-]+$")
    )
    order = Window.partitionBy("package_id", "pos").orderBy("apart", F.desc("n_confidence"), "rank")
    chosen = beside.withColumn("k", F.row_number().over(order)).where("k <= 3")
    joined = chosen.groupBy("package_id", "pos").agg(
        F.max(conf()).alias("confidence"), F.array_sort(F.collect_list(F.struct("n_pos", "n_text", "n_source"))).alias("parts"), F.avg("n_confidence").alias("mean"), F.min("apart").alias("apart")
    )
    value = F.trim(F.array_join(F.transform("parts", lambda p: p["n_text"]), " "))
    score = 125 + conf() * 25 + F.col("mean") * 35 - F.least(F.col("apart"), F.lit(60.0))
    return own.unionByName(candidate(joined, name, F.nullif(value, F.lit("")), score, 1, F.col("mean"), F.get("parts", 0)["n_source"]))


def veg_nonveg(lines: Lines) -> DataFrame:
    """(package_id, field, value): an explicit declaration, never inferred."""
    form = F.col("form")
    kinds = [(r"\bnon[\s-]*vegetarian\b", "Non-Vegetarian", 220), (r"\bvegetarian\b", "Vegetarian", 220), (r"\bnon[\s-]*veg\b", "Non-Vegetarian", 205), (r"\bveg\b", "Vegetarian", 200)]
    value, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for pattern, name, points in reversed(kinds):
        value, score = F.when(form.rlike(pattern), name).otherwise(value), F.when(form.rlike(pattern), points + conf() * 30).otherwise(score)
    told = lines.rows.select("package_id", "pos", value.alias("v"), score.alias("s")).where("v is not null")
    return told.groupBy("package_id").agg(F.max_by("v", F.struct("s", (-F.col("pos")).alias("p"))).alias("value")).select("package_id", F.lit("veg_nonveg").alias("field"), "value")


def address_candidates(lines: Lines) -> DataFrame:
    """Blocks of address lines after a maker's anchor, and those that begin with an address line, up to the next declaration."""
    rows = lines.rows.withColumn("address", T.is_address(F.col("text")))
    tail = rows.select("package_id", F.col("pos").alias("n_pos"), F.struct("pos", "text", "form", "confidence", "source").alias("item"), F.col("address").alias("n_address"), F.col("form").alias("n_form"))

    def block(base: DataFrame, reach: int, stop: str) -> DataFrame:
        steps = base.select("package_id", "pos", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + reach)).alias("n_pos")).join(tail, ["package_id", "n_pos"])
        stops = steps.groupBy("package_id", "pos").agg(F.min(F.when(F.col("n_form").rlike(stop), F.col("n_pos"))).alias("stop"))
        inside = keyed(steps).join(stops, ["package_id", "pos"]).where((F.col("stop").isNull() | (F.col("n_pos") < F.col("stop"))) & F.col("n_address"))
        return inside.groupBy("package_id", "pos").agg(F.array_sort(F.collect_list("item")).alias("items"))

    anchors = rows.where(F.col("text").rlike(V.ADDRESS_ANCHOR))
    after = block(anchors, 9, V.ADDRESS_STOP_AFTER_ANCHOR).join(anchors.select("package_id", "pos", conf().alias("anchor")), ["package_id", "pos"]).withColumn("strategy", F.lit(0))
    starts = rows.where("address").select("package_id", "pos", F.array(F.struct("pos", "text", "form", "confidence", "source")).alias("first"))
    more = starts.join(block(starts, 4, V.ADDRESS_STOP), ["package_id", "pos"], "left").withColumn("items", F.when(F.col("items").isNull(), F.col("first")).otherwise(F.concat("first", "items")))
    whole = F.array_join(F.transform("items", lambda x: T.address_line(x["text"])), " ")
    marks = F.size(F.regexp_extract_all(T.match_form(whole), F.lit(V.ADDRESS_MARKERS), F.lit(1)))
    strong = more.where((marks >= 2) | whole.rlike(r"\b\d{6}\b")).select("package_id", "pos", "items", F.lit(0.75).alias("anchor"), F.lit(1).alias("strategy"))
    blocks = after.select("package_id", "pos", "items", "anchor", "strategy").unionByName(strong)
    lined = blocks.withColumn("items", F.transform("items", lambda x: F.struct(T.address_line(x["text"]).alias("line"), x["form"].alias("form"), x["confidence"].alias("c"), x["source"].alias("source"))))
    formed = lined.withColumn("items", F.filter(F.transform("items", lambda x: x.withField("key", T.match_form(x["line"]))), lambda x: (x["line"] != "") & T.is_address(x["line"])))
    once = formed.withColumn("items", F.filter("items", lambda x, i: ~F.exists(F.slice("items", F.lit(1), i), lambda y: y["key"] == x["key"])))
    part = F.filter("items", lambda x: ~F.exists("items", lambda y: (x["form"] != "") & (y["form"] != x["form"]) & y["form"].contains(x["form"]) & (F.length(y["form"]) > F.length(x["form"]) + 4)))
    kept = once.withColumn("kept", part).withColumn("items", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("items"))).where(F.size("items") > 0)
    n = F.size("items")
    mean = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["c"]) / n
    value = F.array_join(F.transform("items", lambda x: F.rtrim(x["line"], F.lit(","))), ", ")
    score = 125 + F.col("anchor") * 25 + mean * 40 + F.least(n, F.lit(4)) * 8 + F.when(value.rlike(r"\b\d{6}\b"), 45).otherwise(0) + F.when(n >= 3, 20).otherwise(0)
    # all blocks after anchors come before those of the second kind
    told = kept.select("package_id", F.lit("manufacturer_address").alias("field"), F.array("strategy", F.col("pos").cast("int"), F.lit(0)).alias("ord"), value.alias("value"), score.cast("double").alias("score"), mean.alias("confidence"), F.get("items", 0)["source"].alias("source"))
    return told.where("value <> ''")


def field_bonus(scored: DataFrame) -> DataFrame:
    """What some fields add to a group's score."""
    words, best, name = T.word_count(F.col("best")), F.col("best"), F.col("field")
    product = F.when(F.length(best) >= F.col("longest"), 10).otherwise(0) - F.when((words == 1) & (F.col("most_words") >= 2), 25).otherwise(0)
    pin = best.rlike(r"\b\d{6}\b")
    placed = best.rlike(r"(?i)\bsonipat\b") & best.rlike(r"(?i)\bharyana\b") & pin
    address = F.when(pin, 30).otherwise(0) + F.when(words >= 6, 20).otherwise(0) + F.when(placed, 60).otherwise(0)
    more = F.when(name == "product_name", product).when(name == "manufacturer", F.when(words >= 2, 20).otherwise(0)).when(name == "manufacturer_address", address).otherwise(0)
    return scored.withColumn("score", F.col("score") + more)


def clustered_candidates(lines: Lines) -> DataFrame:
    made = (
        product_candidates(lines), quantity_candidates(lines), batch_candidates(lines), manufacturer_candidates(lines), country_candidates(lines), best_before_candidates(lines),
        licence_candidates(lines), section_candidates(lines, "ingredients", 4, 140), section_candidates(lines, "nutrition", 7, 180), address_candidates(lines),
    )
    return stage_keyed(reduce(DataFrame.unionByName, made), "candidates")


def exact_top(candidates: DataFrame) -> DataFrame:
    """(package_id, field, value) by fused score, values being one only if equal."""
    return top_group(group_scores(exact_groups(candidates, F.col("value")))).select("package_id", "field", F.col("first_value").alias("value"))


def consumer_care(lines: Lines) -> DataFrame:
    """(package_id, field, value): the best phone, else the e-mail address of most confidence."""
    told = contact_candidates(lines)
    phone = exact_top(told.where("field = 'consumer_care'"))
    mail = told.where("field = 'consumer_email'").groupBy("package_id").agg(F.min_by("value", F.struct((-F.col("score")).alias("s"), "ord")).alias("mail"))
    both = phone.join(mail, "package_id", "full")
    return both.select("package_id", F.lit("consumer_care").alias("field"), F.coalesce("value", "mail").alias("value"))


def extract_fields(prepared: DataFrame) -> DataFrame:
    """(package_id, field, value) of all fields found."""
    lines = Lines.of(prepared)
    best = top_group(field_bonus(group_scores(first_fit(clustered_candidates(lines)))).where("best is not null"))
    best = stage_keyed(best.select("package_id", "field", F.col("best").alias("value")), "best-values")
    value, name = F.col("value"), F.col("field")
    final = F.when(name == "batch_number", T.batch_token(value)).when(name == "fssai_license_number", T.licence_number(value)).otherwise(value)
    plain = best.where("field <> 'manufacturer'").withColumn("value", final)
    maker = corrected_manufacturer(best.where("field = 'manufacturer'").select("package_id", "value"), lines).select("package_id", F.lit("manufacturer").alias("field"), "value")
    parts = [plain, maker, exact_top(price_candidates(lines)), consumer_care(lines), dates(lines, "manufacturing_date"), dates(lines, "expiry_date"), veg_nonveg(lines)]
    return reduce(DataFrame.unionByName, (p.select("package_id", "field", "value") for p in parts)).where("value is not null")


def declarations(prepared: DataFrame, fields: DataFrame) -> DataFrame:
    """One wide row a package: the fields, its lines as raw_text, and the evidence."""
    wide = keyed(fields).groupBy("package_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in V.DECLARED_FIELDS))
    shown = F.struct("pos", "text", F.round(conf().cast("decimal(18,10)"), 4).cast("double").alias("confidence"), "box", "source")
    lines = prepared.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("e")))).alias("_e"))
    told = lines.join(wide, "package_id", "left")
    return told.select("package_id", *V.DECLARED_FIELDS, F.transform("_e", lambda x: x["e"]["text"]).alias("raw_text"), F.transform("_e", lambda x: x["e"].dropFields("pos")).alias("evidence"))
