"""Normalisers of lexemes: numbers, money, dates, frequencies, ranks and day counts, as Column expressions.

A value is NULL where nothing was recognised. Normalisers with a third state give the string RAW_ONLY where a lexeme was
seen that has no canonical value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,10)"
RAW_ONLY = "RAW_ONLY"

# Names and codes of currencies.
CURRENCIES = {
    "euro": "EUR", "euros": "EUR", "eur": "EUR", "u.s dollars": "USD", "u.s. dollars": "USD", "us dollars": "USD", "dollars": "USD", "dólares": "USD", "dolares": "USD", "usd": "USD",
    "sterling": "GBP", "pounds sterling": "GBP", "gbp": "GBP", "swiss francs": "CHF", "chf": "CHF", "yen": "JPY", "jpy": "JPY", "renminbi": "CNH", "cnh": "CNH", "offshore cny": "CNH", "cny": "CNY",
}
# Month names.
MONTHS_EN = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS_ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
# Phrases of each payment frequency.
FREQUENCIES = {
    "ANNUAL": ("each year", "cada año", "cada ano", "anualmente", "annually", "por año", "once a year"),
    "SEMI_ANNUAL": ("each six months", "cada seis meses", "semestral", "semi-annual", "semiannually", "twice a year"),
    "QUARTERLY": ("each quarter", "quarterly", "trimestral", "cada trimestre", "each three months", "cada tres meses"),
    "MONTHLY": ("each month", "monthly", "mensual", "cada mes"),
    "WEEKLY": ("each week", "weekly", "semanal"),
}
# Months of each payment frequency.
SCHEDULE = {"each year": 12, "cada a": 12, "annually": 12, "each six months": 6, "semiannually": 6, "cada seis meses": 6, "each quarter": 3, "quarterly": 3, "trimestral": 3, "each month": 1, "monthly": 1, "mensual": 1}
# Phrases of open ranges.
OPEN_ENDED = r"(?iu)\b(?:to|hasta)\s+(?:and\s+)?including\b|\bfrom\b.*\bto\b|\bcommenc|or\s+the\b|\bpr[oó]rroga|\bextensi|variable|alternativ"
# Day-count conventions and their lexemes.
DAY_COUNTS = {
    "ACT_ACT_ICMA": ("ACT/ACT ICMA", "ACT/ACT (ICMA)", "ACTUAL/ACTUAL (ICMA)", "ACT/ACT-ICMA", "ICMA"),
    "ACT_ACT_ISDA": ("ACT/ACT ISDA", "ACT/ACT (ISDA)", "ACTUAL/ACTUAL (ISDA)", "ACT/ACT-ISDA", "ACT/ACT", "ACTUAL/ACTUAL"),
    "ACT_360": ("ACT/360", "ACTUAL/360", "ACT/360 (ACT/360)"),
    "ACT_365F": ("ACT/365F", "ACTUAL/365F", "ACTUAL/365 (FIXED)", "ACT/365 FIXED"),
    "ACT_365": ("ACT/365", "ACTUAL/365"),
    "A_30_360": ("30/360", "30/360 (30/360)", "BOND BASIS"),
    "A_30E_360": ("30E/360", "30E/360 (EUROBOND BASIS)", "EUROBOND BASIS"),
    "A_30E_360_ISDA": ("30E/360 ISDA", "30E/360 (ISDA)"),
    "ONE_ONE": ("1/1",),
}
# Words near a day count.
DAY_COUNT_ANCHOR = r"(?iu)day\s*count|base\s+de\s+c[aá]lculo|fraction|daycount|base\s+de\s+c[óo]mputo|m[ée]todo\s+de\s+c[aá]lculo\s+de\s+d[ií]as"
# Names of interest-rate indexes.
BENCHMARKS = r"EURIBOR|EURISOR|€STR|ESTR|EONIA|SONIA|SOFR|LIBOR|MIBOR|MID-?SWAP(?:\s+RATE)?|ICE\s+SWAP\s+RATE|CMS|CMT|IRPH|BTF|TIPO\s+DE\s+INTER[EÉ]S\s+DE\s+REFERENCIA"
# An index with its tenor and margin, ranks, tiers, and the form of a security code.
BENCHMARK = rf"(?iu)(?<![A-Za-z0-9])(?:{BENCHMARKS})(?:\s*[,\-]?\s*a?\s*\d+\s*(?:mes(?:es)?|months?|M|a[ñn]os?|years?))?(?:\s*(?:a\s+)?(?:6|12)\s*meses)?(?:\s*[+\-]\s*[0-9][0-9.,]*\s*%?)?"
RANK = r"(?iu)\b(senior\s+preferred|senior\s+non[- ]preferred|senior|subordinated|subordinad[ao]s?|ordinary|preferred)\b"
TIER = r"(?iu)\b(tier\s*[12]|t[12]\b|at1\b|additional\s+tier\s*1)\b"
ISIN = r"\b[A-Z]{2}[0-9A-Z]{9}[0-9]\b"
PERCENT_SIGN = r"(?:%|por ciento|per\s*cent)"


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, NULL if there is none (an empty match counts as none)."""
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: nested rules would repeat it in the generated code.

    As the end of an empty sum: an element of a transformed array would have its type worked out, through all of `body`, for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def norm_number(c: Column) -> Column:
    """The last of two kinds of separators is the decimal one; one comma with up to four digits after it is decimal, other commas and several points group."""
    return let(F.regexp_replace(c, r"[^0-9.,\-]", ""), _number)


def _number(s: Column) -> Column:
    no = lambda x, sep: F.replace(x, F.lit(sep), F.lit(""))
    last = F.regexp_extract(s, r"([.,])[^.,]*$", 1)
    comma, point = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    plain = (
        F.when(comma & point & (last == ","), F.replace(no(s, "."), F.lit(","), F.lit(".")))
        .when(comma & point, no(s, ","))
        .when(s.rlike(r"^[^,]*,[^,]{0,4}$"), F.replace(s, F.lit(","), F.lit(".")))
        .when(comma, no(s, ","))
        .when(s.rlike(r"\..*\."), no(s, "."))
        .otherwise(s)
    )
    return F.when(s.rlike("[0-9]"), plain.try_cast(NUMBER))


def norm_percent(c: Column) -> Column:
    return norm_number(found(c, rf"(?iu)(-?[0-9][0-9.,]*)\s*{PERCENT_SIGN}", 1))


def _groups(c: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern's first match as an array, NULL without one: found once, taken apart once."""
    split = lambda m: F.split(F.regexp_replace(m, pattern, "\x01".join(f"${i}" for i in range(1, n + 1))), "\x01")
    return let(F.regexp_extract(c, pattern, 0), lambda m: F.when(m != "", split(m)))


def norm_date(c: Column) -> Column:
    """ISO text. The day isn't checked, so an impossible one is passed on."""
    s, digits = F.trim(c), r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
    iso = lambda y, m, d: F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    words = r"(?iu)(\d{1,2})\s+(?:de[l]?\s+)?([A-Za-záéíóú]+)\s+(?:de[l]?\s+)?(\d{4})"
    names = F.create_map(*[F.lit(x) for table in (MONTHS_EN, MONTHS_ES) for i, n in enumerate(table) for x in (n, str(i + 1))])
    written = let(_groups(s, words, 3), lambda g: let(let(F.regexp_replace(F.lower(g[1]), "[^a-z]", ""), lambda name: F.try_element_at(names, name)), lambda month: F.when(month.isNotNull(), iso(g[2], month, g[0]))))
    return F.when(s.rlike(digits), let(_groups(s, digits, 3), lambda g: F.when(g[1].cast("int") <= 12, iso(g[2], g[1], g[0])))).otherwise(written)


def norm_currency(c: Column) -> Column:
    """The longest name that occurs anywhere, else the first word of three capitals."""
    names = sorted(CURRENCIES, key=len, reverse=True)
    named = lambda s: reduce(lambda w, n: w.when(F.contains(s, F.lit(n)), F.lit(CURRENCIES[n])), names[1:], F.when(F.contains(s, F.lit(names[0])), F.lit(CURRENCIES[names[0]])))
    return F.coalesce(let(F.trim(squeezed(F.lower(F.regexp_replace(c, "['’\"()]", "")))), named), found(c, r"\b([A-Z]{3})\b", 1))


def longest_number(c: Column) -> Column:
    """The longest numeric token, the first of equals."""
    return F.aggregate(F.regexp_extract_all(c, F.lit("[0-9][0-9.,]*"), F.lit(0)), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))


def norm_money(c: Column) -> Column:
    """struct(amount, currency, raw_number), NULL without a number."""
    money = let(longest_number(c), lambda raw: F.struct(norm_number(raw).alias("amount"), norm_currency(c).alias("currency"), raw.alias("raw_number")))
    return let(money, lambda m: F.when(m["amount"].isNotNull(), m))


def norm_benchmark(c: Column) -> Column:
    return F.trim(F.regexp_replace(squeezed(found(c, BENCHMARK)), r"^[ ,.\-]+|[ ,.\-]+$", ""))


def norm_frequency(c: Column) -> Column:
    """One class of phrases outside brackets: its name. Several, or one in brackets only, or an open range: RAW_ONLY."""
    return let(squeezed(F.lower(c)), lambda r: _frequency(r, c))


def _frequency(r: Column, c: Column) -> Column:
    free = F.regexp_replace(r, r"\[[^\]]*\]", " ")
    hits = lambda s: F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(s, F.lit(k)) for k in keys]), F.lit(name)) for name, keys in FREQUENCIES.items()]))
    return (
        F.when(F.size(hits(free)) == 1, F.try_element_at(hits(free), F.lit(1)))
        .when((F.size(hits(r)) > 0) | r.rlike(OPEN_ENDED), F.lit(RAW_ONLY))
        .when(r.rlike(r"\b\d{4}\b") & F.contains(c, F.lit(",")), F.lit(RAW_ONLY))
    )


def norm_spread(c: Column) -> Column:
    """Basis points over 100, else a percentage with a sign; the sign is dropped."""
    bps = norm_number(found(c, r"(?iu)(\d[\d.,]*)\s*(?:puntos?\s+b[aá]sicos|basis\s+points|\bbps?\b)", 1))
    return F.coalesce((bps / 100).cast(NUMBER), norm_number(found(c, rf"(?iu)[+\-−]\s*(\d[\d.,]*)\s*{PERCENT_SIGN}", 1)))


def or_raw(value: Column, c: Column) -> Column:
    """`value` as text, RAW_ONLY where it is NULL and the lexeme isn't blank."""
    return F.coalesce(value.cast("string"), F.when(F.trim(squeezed(c)) != "", F.lit(RAW_ONLY)))


def norm_applicability(c: Column) -> Column:
    t = squeezed(F.lower(F.trim(c)))
    yes, no = t.rlike(r"(?u)^(aplicable|applicable|a\s+plica|s[ií]\b|yes\b)"), t.rlike(r"^(not?\s+applicab|no\s+aplica|no\b|not\s+specified|n/?a\b)")
    return F.when(yes, "APPLICABLE").when(no, "NOT_APPLICABLE").when(t != "", RAW_ONLY)


def norm_ranking(c: Column) -> Column:
    return or_raw(F.regexp_replace(F.translate(F.upper(found(c, RANK)), "ÁÉ", "AE"), r"[\s\-]+", "_"), c)


def norm_subordination(c: Column) -> Column:
    t = F.regexp_replace(F.upper(found(c, TIER)), r"\s+", "")
    return F.when(t.isin("T1", "TIER1"), "TIER_1").when(t.isin("T2", "TIER2"), "TIER_2").when(t.isNotNull(), "AT1").when(c.rlike(RANK), RAW_ONLY)


def resolve_daycount(c: Column, context: Column) -> Column:
    """The convention of the longest lexeme that stands alone; `1/1` needs a day-count word near it, else nothing is resolved."""
    anchored = F.coalesce(context, F.lit("")).rlike(DAY_COUNT_ANCHOR) | c.rlike(DAY_COUNT_ANCHOR)
    pairs = sorted(((name, x) for name, xs in DAY_COUNTS.items() for x in xs), key=lambda p: -len(p[1]))
    out = None
    for name, x in pairs:
        quoted = x.replace("(", r"\(").replace(")", r"\)")
        test = c.rlike(rf"(?iu)(?<![\w/]){quoted}(?![\w/])")
        value = F.when(anchored, F.lit(name)) if name == "ONE_ONE" else F.lit(name)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def is_na(c: Column) -> Column:
    """Blank, or nothing but a phrase that says it doesn't apply."""
    return F.coalesce(c.rlike(r"(?iu)^\s*(?:n/?a\.?|not\s+applicable\.?|no\s+aplicable\.?|no\s+aplica\.?)?\s*$"), F.lit(True))


def numbers(c: Column) -> Column:
    """All numbers of a text: separators before groups of three digits group, others are decimal."""
    token = F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))

    def one(x: Column) -> Column:
        grouped = x.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+$") | x.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$")
        return F.when(grouped, F.regexp_replace(x, "[.,]", "")).otherwise(F.regexp_replace(x, r"[.,](?=.*[.,])", "")).cast("string")

    return F.transform(token, lambda x: F.replace(one(x), F.lit(","), F.lit(".")).try_cast("double"))


def scalar_key(c: Column) -> Column:
    """Numbers in one form (`2.50` is `2.5`), other texts trimmed and in lower case."""
    n = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast(NUMBER)
    return F.coalesce(F.regexp_replace(F.regexp_replace(n.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lower(F.trim(squeezed(c))))


def list_key(values: Column) -> Column:
    """The keys of a list's values in order, joined by blanks; nothing of NULL."""
    return F.coalesce(F.array_join(F.array_sort(F.transform(values, lambda x: F.coalesce(scalar_key(x), F.lit("")))), " "), F.lit(""))


def money_key(amount: Column) -> Column:
    """The digits of an amount."""
    return F.coalesce(F.regexp_replace(amount.cast("string"), "[^0-9]", ""), F.lit(""))


def reconcile_key(value: Column, money: Column | None = None) -> Column:
    """What two sources must share to agree: amount and currency of money, else the trimmed value; an empty text of NULL."""
    plain = F.coalesce(F.trim(value), F.lit(""))
    return plain if money is None else F.when(money.isNotNull(), F.concat_ws("|", money["amount"].cast("string"), money["currency"])).otherwise(plain)


def record_ids(c: Column) -> Column:
    """All record ids in a text or JSON, whatever it is nested in: words that open with one of four prefixes."""
    return F.regexp_extract_all(c, F.lit(r"(?:^|[\s()\"])((?:CCFF|FOL|ADM|PSE)_[^\s()\"]*)"), F.lit(1))


def verbatim_key(c: Column) -> Column:
    """White space squeezed, trimmed, lower case."""
    return F.lower(F.trim(squeezed(c)))


def base_register(c: Column) -> Column:
    """A register number without its version."""
    return found(c, r"^([^.\-]+)", 1)


def register_suffix(c: Column) -> Column:
    """`.k` of a supplement, `-k` of a correction."""
    return found(c, r"^[^.\-]+([.\-][0-9]+)$", 1)


def register_date(c: Column) -> Column:
    return F.try_to_date(c, "dd/MM/yyyy")


def valid_id(c: Column) -> Column:
    """Whether it is an id of a document or case as a whole: a letter or digit, then up to 199 of those, `_` and `-`."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,199}\z"), F.lit(False))


def schedule_months(c: Column) -> Column:
    """Months between payments, the longest phrase first."""
    r = F.lower(c)
    out = None
    for k in sorted(SCHEDULE, key=len, reverse=True):
        test = F.contains(r, F.lit(k))
        out = F.when(test, SCHEDULE[k]) if out is None else out.when(test, SCHEDULE[k])
    return out.when(r.rlike(r"(?u)each\s+year|cada\s+a[ñn]o|anual"), 12)
