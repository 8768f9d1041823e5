"""Prices, counts and ratings as Column expressions; nothing ambiguous is guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency markers in the order in which they are looked for, the first column a regular expression.
CURRENCIES = [
    ("₫|đ|Đ|VNĐ|VND|vnd", "VND"), (r"US\$|USD|\$", "USD"), ("EUR|€", "EUR"), ("JPY|¥", "JPY"), ("GBP|£", "GBP"),
    ("THB|฿", "THB"), (r"SGD|S\$", "SGD"), ("MYR|RM", "MYR"), ("CNY|RMB", "CNY"), ("KRW|₩", "KRW"),
]
# Amounts in shorthand are refused.
SHORTHAND = r"(?iu)[0-9][\s\u00a0]*(?:(?:k|nghìn|nghin|ngàn|ngan|tr|trieu|triệu|m|cu|ty|b)(?![0-9A-Za-z_])|(?:củ|tỷ)(?=[0-9A-Za-z_]))"
SPACES = r"[\u00a0\u2007\u202f\u2009]"
BLANKS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def let(x: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{BLANKS}", ""), f"{BLANKS}\\z", "")


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def group_reader(s: Column) -> Column:
    """struct(value, reason) of digits and separators: thousands in threes; of two kinds of separator the last is decimal."""
    kinds = sum((F.instr(s, sep) > 0).cast("int") for sep in ". ,")
    last = F.regexp_extract(s, r"([., ])[0-9]*\z", 1)
    whole, part = F.regexp_extract(s, r"^(.*)[., ]([0-9]*)\z", 1), F.regexp_extract(s, r"^(.*)[., ]([0-9]*)\z", 2)
    digits = lambda c: F.regexp_replace(c, "[., ]", "")
    number = lambda c: c.try_cast("double")
    same = lambda c: F.when(c.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+\z") | c.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+\z") | c.rlike(r"^[0-9]{1,3}(?: [0-9]{3})+\z"), F.lit("")).when(~c.rlike(r"^[0-9]{1,3}[., ]"), F.lit("first_group_not_1_to_3_digits")).otherwise(F.concat(F.lit("later_group_not_3_digits ("), c, F.lit(")")))
    mixed = F.when(~part.rlike(r"^[0-9]{1,2}\z"), F.lit("bad_fraction")).when(F.instr(whole, last) > 0, F.lit("first_group_not_1_to_3_digits")).otherwise(same(whole))
    reason = F.when(kinds == 0, F.lit("")).when(kinds > 2, F.lit("too_many_separators")).when(kinds == 1, same(s)).otherwise(mixed)
    value = F.when(kinds < 2, number(digits(s))).otherwise(number(F.concat(digits(whole), F.lit("."), part)))
    return F.struct(F.when(reason == "", value).alias("value"), reason.alias("reason"))


def human_price(text: Column) -> Column:
    """struct(price, currency, stripped, reason) of a price written for people."""
    return let(trimmed(F.regexp_replace(text.cast("string"), SPACES, " ")), lambda raw: _read_price(text, raw))


def _read_price(text: Column, raw: Column) -> Column:
    s, found, marks = raw, [], []
    for pattern, code in CURRENCIES:
        hit = s.rlike(pattern)
        found.append(F.when(hit, F.lit(code)))
        marks.append(F.when(hit, F.array_join(F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1)), "")))
        s = F.regexp_replace(s, pattern, " ")
    stripped = F.struct(s.alias("s"), trimmed(F.regexp_replace(s, BLANKS, " ")).alias("bare"), F.array_compact(F.array(*found)).alias("codes"), F.array_compact(F.array(*marks)).alias("strips"))
    return let(stripped, lambda x: let(group_reader(x["bare"]), lambda read: _judge_price(text, raw, x["s"], x["bare"], x["codes"], x["strips"], read)))


def _judge_price(text: Column, raw: Column, s: Column, bare: Column, codes: Column, strips: Column, read: Column) -> Column:
    early = (
        F.when(text.isNull() | (raw == ""), F.lit("blank"))
        .when(F.size(codes) > 1, F.lit("different_currencies"))
        .when(s.rlike(SHORTHAND), F.concat(F.lit("shorthand ("), trimmed(text.cast("string")), F.lit(")")))
        .when(s.rlike("[a-zA-ZÀ-ỹ]"), F.lit("letters_left"))
        .when(F.instr(s, "-") > 0, F.lit("minus_or_range"))
        .when(bare == "", F.lit("no_digits"))
        .when(~bare.rlike(r"^[0-9][0-9., ]*\z"), F.lit("odd_character"))
    )
    reason = F.coalesce(early, F.nullif(read["reason"], F.lit("")), F.when(F.size(codes) == 0, F.lit("no_currency_seen")), F.lit(""))
    currency = F.when(early.isNull() | ~early.isin("blank", "different_currencies"), F.get(codes, F.lit(0)))
    stripped = F.when(F.size(codes) > 1, F.get(strips, F.lit(1))).otherwise(F.coalesce(F.get(strips, F.lit(0)), F.lit("")))
    return F.struct(F.when(early.isNull(), read["value"]).alias("price"), currency.alias("currency"), F.when(raw == "", "").otherwise(stripped).alias("stripped"), reason.alias("reason"))


def machine_number(text: Column) -> Column:
    """A decimal as programs write it: digits, and a point with digits."""
    s = trimmed(text.cast("string"))
    return F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?\z"), s.try_cast("double"))


def whole_number(text: Column) -> Column:
    """A count; points, commas and spaces are taken for grouping."""
    s = F.regexp_replace(trimmed(text.cast("string")), r"[.,\u00a0 ]", "")
    return F.when(s.rlike(r"^[0-9]+\z"), s.try_cast("long"))


def star_rating(text: Column) -> Column:
    s = F.regexp_replace(trimmed(text.cast("string")), "^([^,]*),", "$1.")
    value = F.when(s.rlike(r"^[0-9]{1,2}(\.[0-9]{1,2})?\z"), s.try_cast("double"))
    return F.when(value.between(0, 5), value)


def implausible(price: Column, currency: Column) -> Column:
    """A warning on a VND price below 1000 or with a fraction; else null."""
    return F.when((currency == "VND") & ((price < 1000) | (price != F.floor(price))), F.concat(F.lit("implausible VND price ("), price.cast("string"), F.lit(")")))


def flexible_price(text: Column, hint: Column) -> Column:
    """Machine reading first, then the human one; struct(price, currency, reason, warning)."""
    return let(F.struct(machine_number(text).alias("machine"), human_price(text).alias("human")), lambda x: _flexible(x["machine"], x["human"], hint))


def _flexible(machine: Column, human: Column, hint: Column) -> Column:
    price = F.coalesce(machine, human["price"])
    currency = F.when(machine.isNotNull(), hint).otherwise(F.coalesce(human["currency"], F.when(human["price"].isNotNull(), hint)))
    return F.struct(price.alias("price"), currency.alias("currency"), F.when(machine.isNotNull(), F.lit("machine")).otherwise(human["reason"]).alias("reason"), implausible(price, currency).alias("warning"))


def is_number(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), F.lit(False))


def dotted(x: Column) -> Column:
    """Rounded, with dots between thousands."""
    return F.translate(F.format_number(F.floor(x + 0.5), 0), ",", ".")


def day(text: Column) -> Column:
    """A date or a moment from text; null if it is neither."""
    return F.try_to_timestamp(F.replace(trimmed(text), F.lit("T"), F.lit(" ")))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86400e6


def mentions(text: Column, symbols: str = r"₫|đ|VNĐ|VND|\$|€|£|¥", most: int | None = 400) -> Column:
    """The first ``most`` amounts (all: None) next to a currency mark, in order."""
    pattern = rf"((?:{symbols})\s*[0-9][0-9., ]{{2,}}|[0-9][0-9., ]{{2,}}\s*(?:{symbols}))"
    found = F.regexp_extract_all(F.regexp_replace(text, r"\u00a0", " "), F.lit(pattern), F.lit(1))
    return found if most is None else F.slice(found, 1, most)
