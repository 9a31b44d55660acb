"""Queries over lexemes made by projection from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.plans.registry import Tables, query

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""
WITH t AS (SELECT {_LINE}, format('{{:,.2f}}', l_extendedprice) AS en FROM lineitem),
u AS (SELECT *, translate(en, ',.', '.,') AS es FROM t)
SELECT {_LINE}, en, es, CAST(replace(en, ',', '') AS DOUBLE) AS v_en,
  CAST(CASE WHEN en LIKE '%,%' THEN replace(replace(es, '.', ''), ',', '.') ELSE replace(es, ',', '.') END AS DOUBLE) AS v_es,
  CAST(CASE WHEN en LIKE '%,%,%' THEN replace(regexp_replace(en, '\\..*', ''), ',', '') ELSE replace(regexp_replace(en, '\\..*', ''), ',', '.') END AS DOUBLE) AS v_whole
FROM u""")
def norm_number_formats(t: Tables) -> DataFrame:
    """Numbers written the English and the Spanish way, and whole ones with one comma, which reads as decimal."""
    d = t.lineitem.select(*_LINE.split(", "), F.format_number("l_extendedprice", 2).alias("en")).withColumn("es", F.translate("en", ",.", ".,"))
    v = lambda c: L.norm_number(c).cast("double")
    return d.select("*", v(F.col("en")).alias("v_en"), v(F.col("es")).alias("v_es"), v(F.regexp_replace("en", r"\..*", "")).alias("v_whole"))


@query(f"""
WITH t AS (SELECT {_LINE}, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS x FROM lineitem)
SELECT {_LINE}, CAST(d AS DOUBLE) + 0.5 AS coupon, CAST(x AS DOUBLE) / 100 AS margin, CASE WHEN x % 2 = 0 THEN CAST(d AS DOUBLE) + 0.25 END AS signed_margin FROM t""")
def norm_percent_discount(t: Tables) -> DataFrame:
    """Percentages, basis points, and margins that count only with a sign."""
    d = t.lineitem.select(*_LINE.split(", "), F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("x"))
    coupon, bps = F.concat(F.lit("cupon "), F.col("d"), F.lit(",5 por ciento")), F.concat(F.col("x"), F.lit(" puntos básicos"))
    margin = F.concat(F.when(F.col("x") % 2 == 0, "EURIBOR + ").otherwise("EURIBOR "), F.col("d"), F.lit(".25%"))
    return d.select(*_LINE.split(", "), L.norm_percent(coupon).cast("double").alias("coupon"), L.norm_spread(bps).cast("double").alias("margin"), L.norm_spread(margin).cast("double").alias("signed_margin"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS slashes, strftime(o_orderdate, '%Y-%m-%d') AS english, strftime(o_orderdate, '%Y-%m-%d') AS spanish,
  CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') END AS swapped,
  CASE WHEN o_orderkey % 3 = 0 THEN 'RAW_ONLY' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS or_text FROM orders""")
def norm_date_lexemes(t: Tables) -> DataFrame:
    """Dates in four spellings, one of them with month and day swapped."""
    day, month, year = (F.date_format("o_orderdate", p) for p in ("d", "M", "yyyy"))
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), month.cast("int"))
    english, spanish = F.concat_ws(" ", F.lit("Maturity Date:"), day, name([m.title() for m in L.MONTHS_EN]), year), F.concat_ws(" de ", day, name(L.MONTHS_ES), year)
    either = F.when(F.col("o_orderkey") % 3 == 0, "on each payment date").otherwise(english)
    return t.orders.select("o_orderkey", L.norm_date(F.concat_ws("/", day, month, year)).alias("slashes"), L.norm_date(english).alias("english"), L.norm_date(spanish).alias("spanish"), L.norm_date(F.concat_ws(".", month, day, year)).alias("swapped"), L.or_raw(L.norm_date(either), either).alias("or_text"))


_COINS = ["Euros", "U.S. dollars (\"USD\")", "pounds sterling", "Swiss francs", "yen", "Renminbi- Offshore CNY ('CNH')", "XAU", "zloty"]
_CODES = ["EUR", "USD", "GBP", "CHF", "JPY", "CNH", "XAU", None]


@query(f"""
SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS amount, list_extract({_CODES!r}, CAST(o_custkey % 8 AS INT) + 1) AS currency, format('{{:,}}', CAST(round(o_totalprice) AS BIGINT)) AS raw_number FROM orders WHERE o_totalprice >= 1000000
UNION ALL SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT), list_extract({_CODES!r}, CAST(o_custkey % 8 AS INT) + 1), CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders WHERE o_totalprice < 1000000""".replace("None", "NULL"))
def norm_currency_money(t: Tables) -> DataFrame:
    """Money from texts such as `Nominal: 1,750,000 Euros, in 5 series`."""
    whole = F.round("o_totalprice").cast("long")
    number = F.when(F.col("o_totalprice") >= 1000000, F.format_number(whole, 0)).otherwise(whole.cast("string"))
    coin = F.element_at(F.array(*map(F.lit, _COINS)), (F.col("o_custkey") % 8).cast("int") + 1)
    money = L.norm_money(F.concat(F.lit("nominal: "), number, F.lit(" "), coin, F.lit(" in 5 series")))
    return t.orders.select("o_orderkey", money.alias("m")).select("o_orderkey", F.col("m.amount").cast("long").alias("amount"), "m.currency", "m.raw_number")


_PHRASES = ["5 August in each year", "cada seis meses", "each quarter", "mensual", "each week", "semi-annually in each year", "payable [in each year]", "from March to June", "3 May, 2030", "none"]
_FREQUENCY = ["ANNUAL", "SEMI_ANNUAL", "QUARTERLY", "MONTHLY", "WEEKLY", "RAW_ONLY", "RAW_ONLY", "RAW_ONLY", "RAW_ONLY", None]
_STEP = [12, 12, 3, 1, None, 12, 12, None, None, None]  # `cada a` is no part of `cada seis meses`, but its own phrase is
_STEP[1] = 6


@query(f"""
SELECT o_orderkey, list_extract({_FREQUENCY!r}, CAST(o_orderkey % 10 AS INT) + 1) AS frequency, list_extract({_STEP!r}, CAST(o_orderkey % 10 AS INT) + 1) AS months FROM orders""".replace("None", "NULL"))
def norm_frequency_tokens(t: Tables) -> DataFrame:
    """Payment frequencies by both tables of phrases, which differ."""
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("o_orderkey") % 10).cast("int") + 1)
    return t.orders.select("o_orderkey", L.norm_frequency(phrase).alias("frequency"), L.schedule_months(phrase).alias("months"))


_RANKS = ["Senior Preferred notes", "senior non-preferred", "Subordinada Tier 2", "T1 capital, subordinated", "AT1 notes", "Additional Tier 1", "pari passu", "   "]
_RANKED = ["SENIOR_PREFERRED", "SENIOR_NON_PREFERRED", "SUBORDINADA", "SUBORDINATED", "RAW_ONLY", "RAW_ONLY", "RAW_ONLY", None]
_TIERED = ["RAW_ONLY", "RAW_ONLY", "TIER_2", "TIER_1", "AT1", "AT1", None, None]
_APPLY = ["Applicable", "Sí", "Not Applicable", "no aplica", "N/A", "see condition 5", "yes", ""]
_APPLIED = ["APPLICABLE", "APPLICABLE", "NOT_APPLICABLE", "NOT_APPLICABLE", "NOT_APPLICABLE", "RAW_ONLY", "APPLICABLE", None]


@query(f"""
SELECT p_partkey, list_extract({_RANKED!r}, CAST(p_partkey % 8 AS INT) + 1) AS ranking, list_extract({_TIERED!r}, CAST(p_partkey % 8 AS INT) + 1) AS tier,
  list_extract({_APPLIED!r}, CAST(p_partkey % 8 AS INT) + 1) AS applies, p_partkey % 8 IN (2, 3, 4, 7) AS na FROM part""".replace("None", "NULL"))
def norm_rank_tier(t: Tables) -> DataFrame:
    """Ranking, tier and applicability of phrases."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 8).cast("int") + 1)
    return t.part.select("p_partkey", L.norm_ranking(pick(_RANKS)).alias("ranking"), L.norm_subordination(pick(_RANKS)).alias("tier"), L.norm_applicability(pick(_APPLY)).alias("applies"), L.is_na(pick(_APPLY)).alias("na"))


_COUNTS = [("ACT/ACT (ICMA)", "", "ACT_ACT_ICMA"), ("act/act", "", "ACT_ACT_ISDA"), ("Actual/360 basis", "", "ACT_360"), ("ACT/365 FIXED", "", "ACT_365F"), ("30/360", "", "A_30_360"), ("30E/360 ISDA", "", "A_30E_360_ISDA"), ("1/1", "", None), ("1/1", "Day Count Fraction: 1/1", "ONE_ONE"), ("bond basis", "", "A_30_360"), ("ratio 30/3600", "", None)]


@query(f"""
SELECT p_partkey, list_extract({[c for _, _, c in _COUNTS]!r}, CAST(p_partkey % 10 AS INT) + 1) AS convention FROM part""".replace("None", "NULL"))
def daycount_resolve(t: Tables) -> DataFrame:
    """Day-count conventions, with and without a word that anchors them."""
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in _COUNTS]), (F.col("p_partkey") % 10).cast("int") + 1)
    return t.part.select("p_partkey", L.resolve_daycount(pick(0), pick(1)).alias("convention"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'EURIBOR 3 months' WHEN 1 THEN 'SOFR + ' || (o_custkey % 9) || '.5%' WHEN 2 THEN NULL ELSE 'Mid-Swap Rate' END AS benchmark FROM orders""")
def benchmark_objects(t: Tables) -> DataFrame:
    """Index names with tenor or margin; a name inside a word is none."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "EURIBOR 3 months was 2.335%").when(k == 1, F.concat(F.lit("rate SOFR + "), F.col("o_custkey") % 9, F.lit(".5%"))).when(k == 2, "xSOFR was 2.335% on 3 July").otherwise("the Mid-Swap Rate, as quoted")
    return t.orders.select("o_orderkey", L.norm_benchmark(text).alias("benchmark"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN [] WHEN c_custkey % 3 = 1 THEN ['ES' || lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 'XS0000000019'] ELSE ['ES' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')] END AS isins FROM customer""")
def isin_scan(t: Tables) -> DataFrame:
    """All identifiers of a text, in order."""
    own = F.concat(F.lit("ES"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    text = F.concat(F.col("c_name"), F.lit(" ("), F.when(F.col("c_custkey") % 3 == 2, F.lower(own)).when(F.col("c_custkey") % 3 == 1, F.concat(own, F.lit(", XS0000000019"))).otherwise(own), F.lit(")"))
    return t.customer.select("c_custkey", F.regexp_extract_all(text, F.lit(L.ISIN), F.lit(0)).alias("isins"))


@query("""
SELECT p_partkey, [CAST(p_size AS DOUBLE) * 1000, CAST(p_size AS DOUBLE) + 0.5, 1234.5] AS numbers, CAST(p_size AS VARCHAR) || '.5' AS number_key, lower(p_brand) AS text_key FROM part""")
def number_lists(t: Tables) -> DataFrame:
    """All numbers of a text by the second grammar, where groups of three digits group; and comparison keys of scalars."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("a "), size, F.lit(",000 b "), size, F.lit(",5 c 1,234.5"))
    return t.part.select("p_partkey", L.numbers(text).alias("numbers"), L.scalar_key(F.concat(size, F.lit(",50"))).alias("number_key"), L.scalar_key(F.concat(F.lit(" "), F.col("p_brand"), F.lit("  "))).alias("text_key"))
