"""Extraction of labelled fields from laid-out text and tables: candidates, guards, normal forms, one observation a field.

Blocks are (doc_id, ix, page, text), `ix` gapless within a document, and may have boxes (l, t, r, b); table rows are
(doc_id, table, row, cells), with the table's page if cells shall make regions. All candidates of all fields come out of one pass over the
blocks and one over the rows, each with the span of blocks that it depends on; a region's view holds those whose span lies in it.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import lexemes as L
from factloom.operators import layout
from factloom.sources.shared import table, tasks


class Rule(NamedTuple):
    """How a field is read: its normal form, whether several values are a list, the section it stands in, its labels."""

    kind: str
    multi: bool
    section: str | None
    labels: tuple[str, ...]


# Labels that open each field, in English and Spanish.
RULES = {
    "isin": Rule("isin", False, "general", (r"\bISIN\b", r"C[oó]digo\s+ISIN")),
    "currency": Rule("currency", False, "general", (r"Specified\s+Currenc(?:y|ies)(?:\s+or\s+Currencies)?", r"Divisa\s+de\s+la\s+emisi[oó]n", r"Divisa\b", r"Divisa\s+de\s+denominaci[oó]n", r"Moneda\b")),
    "issue_date": Rule("date", False, "general", (r"\bIssue\s+Date\b", r"Fecha\s+de\s+emisi", r"Fecha\s+de\s+[Dd]esembolso")),
    "maturity": Rule("date", False, "general", (r"\bMaturity\s+Date\b", r"Fecha\s+de\s+vencimiento", r"Fecha\s+de\s+amortizaci[oó]n\s+final", r"Fecha\s+de\s+[Aa]mortizaci[oó]n\b(?!\s*[:-]?\s*anticipada)", r"Vencimiento\b")),
    "denomination": Rule("money", False, "general", (r"Specified\s+Denomination", r"Denominaci[oó]n\s+unitaria", r"Valor\s+nominal\s+unitario", r"Importe\s+unitario\s+de\s+los\s+[Vv]alores", r"Importe\s+nominal\s+unitario\s+de\s+los\s+[Vv]alores", r"Nominal\s+unitario")),
    "issued_amount": Rule("money", False, "general", (r"Aggregate\s+(?:Principal|Nominal)\s+Amount(?:\s+of\s+(?:the\s+)?Notes)?", r"Aggregate\s+Amount", r"Importe\s+(?:nominal\s+)?total\s+de\s+la\s+emisi[oó]n", r"Importe\s+total\s+(?:nominal|efectivo)\s+de\s+la\s+emisi[oó]n", r"Importe\s+nominal\s+y\s+efectivo\s+de\s+la\s+emisi[oó]n", r"Importe\s+nominal\s+y\s+efectivo\s+de\s+los\s+[Vv]alores", r"Importe\s+de\s+la\s+[Ee]misi[oó]n", r"por\s+un\s+importe\s+(?:nominal\s+)?(?:total\s+)?de")),
    "coupon_type": Rule("text", True, "interest", (r"Interest\s+Basis", r"Tipo\s+de\s+inter[eé]s\b")),
    "coupon_rate": Rule("percent", True, "interest", (r"Rate\s+of\s+Interest\b", r"Interest\s+Basis", r"Tipo\s+de\s+inter[eé]s\s+nominal", r"Tipo\s+de\s+inter[eé]s\s+inicial", r"Fixed\s+Coupon\s+Rate", r"Tipo\s+de\s+inter[eé]s\b(?!\s*(?:fijo|variable|inicial|m[ií]nimo|m[aá]ximo|indexado|de\s+demora))")),
    "benchmark": Rule("benchmark", True, "interest", (r"Floating\s+Rate\s+Option", r"Nombre\s+y\s+descripci[oó]n\s+del\s+Tipo\s+de\s+Referencia", r"Tipo\s+de\s+referencia", r"[ÍI]ndice\s+de\s+referencia", r"Reset\s+Reference\s+Rate", r"Reference\s+Rate\b", r"Tipo\s+de\s+inter[eé]s\s*:", r"Tipo\s+de\s+[Ss]ubyacente", r"Nombre\s+y\s+descripci[oó]n\s+del\s+[Ss]ubyacente", r"\bEURIBOR\b", r"€STR\b")),
    "spread": Rule("spread", True, "interest", (r"First\s+Margin", r"Subsequent\s+Margin", r"\bMargin[s]?\s*:", r"\bSpread\b", r"Margen\s*(?:sobre\s+el\s+tipo\s+de\s+referencia)?\s*:", r"Tipo\s+de\s+inter[eé]s\s*:", r"Tipo\s+de\s+[Rr]eferencia", r"Nombre\s+y\s+descripci[oó]n\s+del\s+Tipo\s+de\s+Referencia")),
    "payment_frequency": Rule("frequency", True, "interest", (r"Interest\s+Payment\s+Date\(s\)?", r"Fechas?\s+de\s+pago\s+de\s+(?:los\s+)?(?:intereses|cupones)", r"Fecha\s+de\s+[Pp]ago\b", r"Periodo\s+de\s+devengo\s+de\s+los\s+intereses")),
    "day_count": Rule("text", False, "interest", (r"Day\s+Count\s+Fraction", r"Base\s+de\s+c[aá]lculo", r"Day\s+Count\s+Basis")),
    "call_dates": Rule("dates_or_text", True, "exercise", (r"Optional\s+Redemption\s+Dates?", r"Early\s+Redemption\s+Date\(s\)", r"Call\s+Option\s+Date", r"Call\s+Option\s*:", r"Issuer\s+Call\s+Option", r"Issuer\s+Call\b", r"Issuer\s+Clean-?Up\s+Call", r"Clean-?Up\s+Call", r"Put/Call\s+Options?", r"Residual\s+Maturity\s+Call\s+Option", r"Opci[oó]n(?:es)?\s+de\s+amortizaci[oó]n(?:\s+anticipada)?(?:\s+o\s+cancelaci[oó]n(?:\s+anticipada)?)?(?:\s+para\s+el\s+Emisor)?", r"Opci[oó]n\s+(?:del?\s+)?Emisor", r"Amortizaci[oó]n\s+anticipada\s+(?:por|para)\s+el\s+[Ee]misor")),
    "business_day_convention": Rule("text", True, "interest", (r"Business\s+Day\s+Convention", r"Convenci[oó]n\s+(?:del?\s+)?d[ií]a[s]?\s+h[aá]bil(?:es)?")),
    "put_dates": Rule("dates_or_text", True, "exercise", (r"Securityholder\s+Put\s+Option", r"Noteholder\s+Put\b", r"Change\s+of\s+Control\s+Put\s+Option", r"Put\s+Option\s*:", r"Opci[oó]n\s+(?:del?\s+)?Inversor", r"Amortizaci[oó]n\s+anticipada\s+por\s+el\s+inversor", r"Opci[oó]n\s+de\s+(?:reembolso|venta)\s+anticipada")),
    "reset_dates": Rule("dates_or_text", True, "interest", (r"First\s+Reset\s+Date", r"Second\s+Reset\s+Date", r"Subsequent\s+Reset\s+Date", r"Reset\s+Note\s+Provisions", r"Fecha[s]?\s+de\s+revisi[oó]n", r"Fecha\s+de\s+[Rr]eset", r"Fecha\s+de\s+modificaci[oó]n\s+del\s+tipo", r"\bReset\s+Date\b")),
    "fixing_rules": Rule("text", True, "interest", (r"Fechas?\s+de\s+determinaci[oó]n\s+del\s+tipo\s+de\s+inter[eé]s(?:\s+aplicable)?", r"Fechas?\s+de\s+[Dd]eterminaci[oó]n\s+de\s+Intereses", r"Fecha\s+de\s+Determinaci[oó]n\s+del\s+Tipo\s+de\s+Inter[eé]s", r"Momento\s+de\s+Determinaci[oó]n", r"Pantalla\s+Relevante", r"Procedimiento\s+de\s+publicaci[oó]n\s+de\s+(?:la\s+)?fijaci[oó]n(?:\s+de\s+los\s+nuevos\s+tipos\s+de\s+inter[eé]s)?", r"Reset\s+Determination\s+(?:Time|Date)", r"Relevant\s+Screen\s+Page", r"Screen\s+Rate\s+Determination", r"Determinaci[oó]n\s+ISDA", r"Determinaci[oó]n\s+por\s+referencia\s+al\s+Tipo\s+de\s+Pantalla", r"Determination\s+Date\(s\)")),
    "ranking": Rule("ranking", False, "general", (r"Status\s+of\s+the\s+(?:Notes|Instruments|Valores)", r"Estatus\s+de\s+los\s+[Vv]alores", r"Rango\s+de\s+los\s+[Vv]alores", r"Jerarqu[ií]a")),
    "subordination": Rule("subordination", False, "general", (r"Status\s+of\s+the\s+(?:Notes|Instruments|Valores)", r"Estatus\s+de\s+los\s+[Vv]alores", r"Categor[ií]a\s+de\s+los\s+[Vv]alores", r"Subordinaci[oó]n")),
    "redemption_formula": Rule("text", True, None, (r"Redemption\s*/?\s*Payment\s+Basis", r"Redemption\s+Basis", r"Final\s+Redemption\s+Amount", r"Maturity\s+Redemption\s+Amount", r"Sistema\s+de\s+amortizaci[oó]n", r"Precio\s+de\s+[aA]mortizaci[oó]n\s+[fF]inal", r"Fecha\s+de\s+amortizaci[oó]n\s+final(?:\s+y\s+sistema\s+de\s+amortizaci[oó]n)?", r"Fecha\s+de\s+amortizaci[oó]n\s+a\s+vencimiento")),
    "underlying": Rule("text", True, None, (r"Reference\s+Item\(s\)", r"Nombre\s+y\s+descripci[oó]n\s+del\s+Subyacente", r"Descripci[oó]n\s+del\s+[Ss]ubyacente", r"Tipo\s+de\s+[Ss]ubyacente", r"\bIndex\s*:", r"\bUnderlying\b")),
    "barrier": Rule("text_or_percent", True, None, (r"Barrera\s+de\s+Cup[oó]n", r"Coupon\s+Barrier", r"Knock-in\s+Barrier", r"Knock-out\s+Barrier", r"Automatic\s+Early\s+Redemption\s+Trigger", r"\bBarrier\b")),
    "autocall": Rule("applicability", True, None, (r"Automatic\s+Early\s+Redemption\s*:", r"Estructura\s+de\s+Cancelaci[oó]n\s+Anticipada", r"\bAutocall\b")),
    "observation_dates": Rule("dates_or_text", True, None, (r"Fecha[s]?\s+de\s+Observaci[oó]n\s+(?:Inicial|Final)?", r"Observation\s+Date\(s\)", r"Coupon\s+Valuation\s+Date", r"Redemption\s+Valuation\s+Date", r"Knock-in\s+Determination\s+Day", r"Strike\s+Date", r"Valuation\s+Date\(s\)")),
    "settlement_type": Rule("text", True, None, (r"Liquidaci[oó]n\s+de\s+los\s+valores(?:\s+y\s+llevanza\s+del\s+registro\s+de\s+anotaciones\s+en\s+cuenta)?", r"Sistema\s+de\s+Compensaci[oó]n\s+y\s+Liquidaci[oó]n", r"Forma\s+de\s+liquidaci[oó]n", r"\bDelivery\b", r"Variation\s+of\s+Settlement", r"Settlement\s+(?:Exchange\s+Rate\s+)?Provisions")),
    "participation": Rule("text_or_percent", False, None, (r"Participation\s+Rate", r"\bParticipation\b", r"Participaci[oó]n")),
    "cap": Rule("text_or_percent", False, None, (r"Maximum\s+Interest\s+Rate", r"Maximum\s+Rate", r"Tipo\s+de\s+inter[eé]s\s+m[aá]ximo", r"Cap\s+Rate", r"\bCap\s*[:=]")),
    "strike": Rule("text_or_percent", False, None, (r"Strike\s+(?:Price|Level)", r"Initial\s+Strike", r"Precio\s+de\s+ejercicio")),
}
# Words that mark each section.
SECTIONS = {
    "interest": r"(?iu)tipo\s+de\s+inter[eé]s|rate\s+of\s+interest|interest\s+basis|cup[oó]n|eur[ií]bor|day\s+count|base\s+de\s+c[aá]lculo",
    "redemption": r"(?iu)reembolso|amortizaci[oó]n|redemption|vencimiento|maturity",
    "exercise": r"(?iu)opci[oó]n(?:es)?\s+de\s+amortizaci[oó]n|amortizaci[oó]n\s+anticipada|call\s+option|put\s+option|issuer\s+call|put/call|early\s+redemption|reembolso\s+anticipado|autocall",
    "general": r"(?iu)\bisin\b|divisa|currency|denominaci[oó]n|importe\s+nominal|importe\s+total|importe\s+nominal\s+y\s+efectivo|aggregate\s+(?:nominal|principal|amount)",
    "structured": r"(?iu)subyacente|underlying|barrera|barrier|strike|participaci[oó]n|observation|observaci[oó]n",
}
# Roles of documents whose fields are read, and those that have sections of their own, with the words that differ.
ROLES = ("final_terms", "base_prospectus", "supplement", "admission_doc", "registration_doc", "issue_document")
ROLE_SECTIONS = {
    "FINAL_TERMS": {},
    "SECURITIES_NOTE": {"general": r"(?iu)\bisin\b|divisa|currency|denominaci[oó]n|importe\s+nominal|admisi[oó]n|admission|descripci[oó]n\s+de\s+los\s+valores"},
    "ISSUE_DOC": {"general": r"(?iu)\bisin\b|divisa|currency|denominaci[oó]n|importe\s+nominal|emisi[oó]n|issue"},
    "BASE_PROSPECTUS": {"interest": r"(?iu)tipo\s+de\s+inter[eé]s|interest|cup[oó]n|day\s+count|base\s+de\s+c[aá]lculo|fixed\s+rate|floating\s+rate", "general": r"(?iu)programa|programme|emisores|issuers|divisa|currency|denominaci[oó]n|form\s+of\s+final\s+terms"},
}
# What a value is not (phrases, templates, parts of labels, other labels), references, rows below a label, conventions.
PHRASE = r"""(?iu)^\s*["'‘“`]?\s*(?:is|are|was|were|shall|means|ser|es|son|in\s+relation\s+to|as\s+provided|specified\s+in|de\s+conformidad|seg[uú]n)\b"""
TEMPLATE = r"\[[\[\]\s●…\.]*\]|\[●\]"
LABEL_PART = r"(?iu)^\s*(?:the\s+)?(?:notes?|instruments?|valores?|obligaciones|calculation\s+amount|notes?\s+payable)\s*\.?\s*$"
OTHER_LABEL = r"^[A-Za-zÁÉÍÓÚÜÑ(][^:]{0,60}\s*:"
REFERENCE = r"(?iu)^\s*(?:see|as\s+per|as\s+set\s+out|v[eé]ase|seg[uú]n|conforme\s+a)\b"
ROW_BELOW = r"(?iu)^\s*(?:\([a-z0-9]+\)|series|tranche|total|importe|nominal)\b"
BULLETS = r"^[•●·▪◦‣\-\*o\s]+"
CONVENTION = r"(?iu)(?:Modified\s+)?Following\s+Business\s+Day\s+Convention|Preceding\s+Business\s+Day\s+Convention|FRN\s+Convention|Convenci[oó]n\s+del?\s+Siguiente\s+D[ií]a\s+H[aá]bil|Convenci[oó]n\s+del?\s+D[ií]a\s+H[aá]bil\s+(?:Anterior|Precedente|Siguiente\s+Modificada?)|Siguiente\s+D[ií]a\s+H[aá]bil\s*\(?\s*Following\s+Business\s+Day\s+Convention\s*\)?"
CONVENTION_WORDS = ("conven", "siguiente")  # each convention has one of them
# Numbers before a label.
NUMBERING = r"(?:\(\s*[a-zivx0-9]+\s*\)|\d+\.?|[a-z]\))?\s*"

CANDIDATE = ("doc_id", "field", "source", "ix", "first", "last", "k", "raw", "item")
ENTRY = ("source", "k", "ix", "raw", "value", "class", "excerpt")
SETTLED = ("status", "class", "values", "lexeme", "blocks", "own")
EXCERPT = 300  # characters of a block that stand for it as evidence


def pattern(rule: Rule) -> str:
    """Groups: separator, value."""
    return rf"{opening(rule)}\s*([:\-]?)\s*(.{{0,200}})"


def opening(rule: Rule) -> str:
    """A label and the number before it. What `pattern` has after it fits anything, so it matches the same texts as far."""
    return rf"(?iu)^{NUMBERING}(?:{'|'.join(rule.labels)})"


def _of_field(values: dict[str, str | None], field: str = "field") -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("string"))]), F.col(field))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), BULLETS, "")


def _heads(label: str, letters: int = 2) -> set[str] | None:
    """The first characters that a text of a label can have, those that are ASCII in lower case; None if its pattern doesn't tell."""
    one = r"(\[[^\]\\^-]+\]|[^\W\d_])"
    m, rest = re.match(rf"(?:\\b)?{one * letters}(?![?*+{{])", label), label
    while (less := re.sub(r"\((?:[^()\\]|\\.)*\)", "", rest)) != rest:
        rest = less
    if "|" not in rest and re.match(r"[^\x00-\x7F\w]+\w", label):
        return set()  # opens with a sign that is no form of an ASCII one
    return {h.lower() for h in map("".join, itertools.product(*(x.strip("[]") for x in m.groups()))) if h.isascii()} if m and "|" not in rest else None


def _head(text: Column) -> Column:
    """The first three characters after numbers, in lower case."""
    return F.lower(F.regexp_extract(text, rf"(?ius)^{NUMBERING}(.{{0,3}})", 1))


def _head_bits(h: Column, rules: dict[str, Rule]) -> Column:
    """A bit for each rule of which a label may open a text with this head (two characters of it, where a label tells no more)."""
    own = [(1 << i, _heads(x), _heads(x, 3)) for i, r in enumerate(rules.values()) for x in r.labels]
    any_, short, at = 0, {}, {}
    for b, two, three in own:
        any_ |= b if two is None else 0
        for h2 in two or () if three is None else ():
            short[h2] = short.get(h2, 0) | b
    for b, two, three in own:
        for h3 in three or ():
            at[h3] = at.get(h3, any_ | short.get(h3[:2], 0)) | b
    every = F.lit(-1).cast("long")
    if len(rules) > 62 or not at:
        return every
    # by place, as a lookup in a map is rewritten to comparisons, one after the other
    known = lambda bits, k: F.get(F.array(*(F.lit(b).cast("long") for b in bits.values())), (F.array_position(F.array(*map(F.lit, bits)), k) - 1).cast("int"))
    two = [known({k: b | any_ for k, b in short.items()}, F.substring(h, 1, 2))] if short else []
    return F.when(F.octet_length(h) != F.length(h), every).otherwise(F.coalesce(known(at, h), *two, F.lit(any_).cast("long")))  # other letters may be forms of ASCII ones


def _may_open(text: Column, rules: dict[str, Rule]) -> Column:
    """A bit for each rule of which a label may open the text, by its first three characters after numbers: a pattern is tried only where they fit."""
    return L.let(_head(text), lambda h: _head_bits(h, rules))


AFTER = r"^\s*([:\-]?)\s*(.{0,200})"  # separator and value after a label
SOME = 4  # rules that are passed over at once


def _labels(texts: list[Column], rules: dict[str, Rule]) -> Column:
    """Array of field, which (the first of the texts that one of its labels opens), sep and value; each further text begins with the first. Patterns are literals, so each is compiled once.

    Labels are found as numbers of their rule and text with the label's length, in one text (an array of structs would have its type worked out
    for each row), and what follows is taken apart by one plain pattern, which fits whatever follows.
    """
    n, few = len(texts), len(rules) <= 62
    opens = list(enumerate(map(opening, rules.values())))

    def known(x: Column) -> Column:
        """With the rules that may open each text: those of the first text's head, where it is whole and no number goes on after it."""
        whole = (F.length(x["h"]) == 3) & (F.octet_length(x["h"]) == 3) & ~x["t0"].startswith("(")
        further = lambda k: F.when(x[f"t{k}"].isNull(), F.lit(0).cast("long")).when(whole, x["m"]).otherwise(_may_open(x[f"t{k}"], rules))
        return F.struct(*(x[f"t{k}"].alias(f"t{k}") for k in range(n)), x["m"].alias("m0"), *(further(k).alias(f"m{k}") for k in range(1, n)))

    def of(x: Column, i: int, rx: str) -> Column:
        def at(k: int) -> Column:
            mark = lambda size: F.when(size > 0, F.concat(F.lit(f"{i:04d}{k:02d}"), size.cast("string"), F.lit(",")))  # noqa: E731 - no label is empty
            return F.when(x[f"m{k}"].bitwiseAND(F.lit(1 << i if few else -1).cast("long")) != 0, L.let(F.length(F.regexp_extract(x[f"t{k}"], rx, 0)), mark))

        return F.coalesce(*map(at, range(n)))

    def found(x: Column) -> Column:
        may = x["m0"]
        for k in range(1, n):
            may = may.bitwiseOR(x[f"m{k}"])
        parts = []
        for at in range(0, len(opens), SOME):
            some = opens[at : at + SOME]
            parts.append(F.when(may.bitwiseAND(F.lit(sum(1 << i for i, _ in some) if few else -1).cast("long")) != 0, F.concat_ws("", *(of(x, i, rx) for i, rx in some))))
        return F.when(may != 0, F.rtrim(F.concat_ws("", *parts), F.lit(",")))

    def label(r: Column, x: Column) -> Column:
        number = lambda at, size: F.substring(r, at, size).cast("int")
        t = x["t0"]
        for k in range(1, n):
            t = F.when(number(5, 2) == k, x[f"t{k}"]).otherwise(t)
        rest = F.substr(t, number(7, 10) + 1)
        of_rest = lambda rest: F.struct(F.element_at(F.array(*map(F.lit, rules)), number(1, 4) + 1).alias("field"), number(5, 2).alias("which"), F.regexp_extract(rest, AFTER, 1).alias("sep"), F.trim(F.regexp_extract(rest, AFTER, 2)).alias("value"))
        return L.let(rest, of_rest)

    def labelled(x: Column) -> Column:
        return L.let(found(x), lambda s: F.transform(F.when(s != "", F.split(s, ",")).otherwise(F.array().cast("array<string>")), lambda r: label(r, x)))

    facts = F.struct(*(t.alias(f"t{k}") for k, t in enumerate(texts)), _head(texts[0]).alias("h"))
    facts = L.let(facts, lambda x: F.struct(*(x[f"t{k}"].alias(f"t{k}") for k in range(n)), x["h"].alias("h"), _head_bits(x["h"], rules).alias("m")))
    return L.let(L.let(facts, known), labelled)


def _is_label(text: Column, rules: dict[str, Rule]) -> Column:
    """Whether a label of the row's field opens a text."""
    c = F
    for name, rule in rules.items():
        c = c.when(F.col("field") == name, text.rlike(opening(rule)))
    return c


def _parts(d: DataFrame) -> DataFrame:
    """Values (sep, value) of labelled texts, without those that go on as prose."""
    longer = (F.col("sep") == "") & F.contains("value", F.lit(":"))
    prose = (F.col("sep") == "") & ~longer & F.col("value").rlike(r"""^['"‘“`]*\s*\p{Ll}""")
    return d.where(~prose).withColumns({"longer": longer, "value": F.when(longer, F.trim(F.regexp_replace("value", "^[^:]*:", ""))).otherwise(F.col("value"))})


def _beside(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ix, near_ix, near: what stands right of a label (doc_id, ix), else what a row below it says. Only labels are looked from."""
    boxes = blocks.where("l is not null").select(F.struct("doc_id", "page").alias("page"), "ix", "l", "t", "r", "b", "text")
    text = boxes.select("page", F.col("ix").alias("near_ix"), F.trim("text").alias("near"))
    asked = table(boxes.withColumn("doc_id", F.col("page.doc_id")).join(labels.distinct(), ["doc_id", "ix"]).drop("doc_id"), "asked")
    right = table(layout.right_of(boxes, probes=asked).withColumnRenamed("right_ix", "near_ix").join(text, ["page", "near_ix"]), "right")
    rest = asked.join(right.select("page", "ix"), ["page", "ix"], "left_anti")
    under = layout.below(boxes, probes=rest).withColumnRenamed("below_ix", "near_ix").join(text, ["page", "near_ix"]).where(F.col("near").rlike(ROW_BELOW))
    under = table(under.select("page", F.col("ix").alias("label_ix"), "near_ix", "near"), "below")
    far = layout.right_of(boxes, probes=boxes.join(under.select("page", F.col("near_ix").alias("ix")).distinct(), ["page", "ix"])).select("page", F.col("ix").alias("near_ix"), F.col("right_ix").alias("far_ix"))
    far = far.join(text.select("page", F.col("near_ix").alias("far_ix"), F.col("near").alias("far")), ["page", "far_ix"])
    inline = F.nullif(F.trim(F.regexp_extract("near", r"^[^:]+:\s*(.+)$", 1)), F.lit(""))
    under = under.join(far, ["page", "near_ix"], "left").select("page", F.col("label_ix").alias("ix"), F.coalesce("far_ix", F.when(inline.isNotNull(), F.col("near_ix"))).alias("near_ix"), F.coalesce("far", inline).alias("near")).where("near is not null")
    return right.select("page", "ix", "near_ix", "near").unionByName(under).select("page.doc_id", "ix", "near_ix", "near")


def text_candidates(blocks: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Values of labels that open a block or a part of it, or that go on in the next block.

    A label without a value takes what stands beside it, if there are boxes; else each of the next three blocks up to
    the first that is a label.
    """
    w = Window.partitionBy("doc_id").orderBy("ix")
    b = blocks.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    d = b.select("doc_id", "ix", "text", F.array(*[F.lead(F.struct("ix", "text"), k).over(w) for k in (1, 2, 3, 4)]).alias("nexts"))
    d = d.select("*", F.posexplode(F.split("text", "[·•▪◦‣]")).alias("k", "part")).withColumn("part", _bare(F.col("part"))).where("part <> ''")
    d = d.withColumn("joined", F.when(F.get("nexts", 0).isNotNull(), F.concat("part", F.lit(" "), _bare(F.get("nexts", 0)["text"]))))
    d = d.select("*", F.inline_outer(_labels([F.col("part"), F.col("joined")], rules))).where("field is not null")  # outer: no filter is inferred that would match all labels twice
    d = _parts(d.withColumn("merged", F.col("which") == 1)).withColumn("value", F.when(F.col("merged") & F.col("value").endswith(":"), "").otherwise(F.col("value")))
    d = d.withColumn("label", F.when(F.col("merged"), F.get("nexts", 0)).otherwise(F.struct("ix", "text")))
    following = F.filter(F.when(F.col("merged"), F.slice("nexts", 2, 3)).otherwise(F.slice("nexts", 1, 3)), lambda x: x.isNotNull() & (_bare(x["text"]) != ""))
    stops = F.transform(following, lambda x: _bare(x["text"]).endswith(":") | _bare(x["text"]).rlike(OTHER_LABEL) | _is_label(_bare(x["text"]), rules))
    first = F.array_position(stops, True)
    free = F.when(first == 0, following).otherwise(F.slice(following, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int")))
    one = lambda ix, raw, item, last: F.struct(ix.alias("ix"), raw.alias("raw"), item.alias("item"), last.alias("last"))
    own = F.col("label.ix")  # the last block of the label itself
    values = F.transform(free, lambda x: one(x["ix"], _bare(x["text"]), x["text"], x["ix"]))
    if "l" in blocks.columns:
        d = table(d.withColumn("free", F.when(F.col("value") == "", values)).select("doc_id", "ix", "k", "field", "merged", "value", "label", "free"), "labels")
        bare = d.where("value = ''")
        near = table(_beside(blocks, bare.select("doc_id", own.alias("ix")).unionByName(bare.where("merged").select("doc_id", "ix"))), "beside")
        for name, at in (("n0", F.when(F.col("merged"), F.col("d.ix"))), ("n1", F.col("label.ix"))):
            n = near.select(F.col("doc_id").alias("_doc"), F.col("ix").alias("_ix"), F.struct("near_ix", "near").alias(name))
            d = d.alias("d").join(n, (F.col("d.doc_id") == F.col("_doc")) & (at == F.col("_ix")) & (F.col("value") == ""), "left").drop("_doc", "_ix")
        beside = F.coalesce("n0", "n1")  # boxes are those of the page, whatever the view
        values = F.when(beside.isNotNull(), F.array(one(beside["near_ix"], beside["near"], beside["near"], own))).otherwise(F.col("free"))
    values = F.when(F.col("value") != "", F.array(one(own, F.col("value"), F.col("label.text"), own))).otherwise(values)
    d = d.select("doc_id", "field", F.lit(0).alias("source"), F.col("k").alias("part_k"), F.col("ix").alias("label_ix"), F.posexplode(values).alias("j", "v"))
    return d.select("doc_id", "field", "source", "v.ix", F.col("label_ix").alias("first"), "v.last", F.array("label_ix", F.col("part_k").cast("long"), F.col("j").cast("long")).alias("k"), "v.raw", "v.item")


def table_candidates(rows: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Values in a label's cell, in the first later cell of its row, or at the end of one of the next two rows of parts.

    A label text in three cells of a table or more heads a column of data and has no value.
    """
    w = Window.partitionBy("doc_id", "table").orderBy("row")
    d = rows.select("*", F.array(F.lead("cells", 1).over(w), F.lead("cells", 2).over(w)).alias("nexts"))
    d = d.select("*", F.posexplode("cells").alias("col", "cell")).withColumn("cell", _bare(F.col("cell"))).where("cell <> ''")
    d = d.select("*", F.inline_outer(_labels([F.col("cell")], rules))).where("field is not null").withColumn("times", F.count("*").over(Window.partitionBy("doc_id", "table", "field", F.lower(F.trim("cell"))))).where("times < 3")
    d = _parts(d)
    later = F.filter(F.slice("cells", F.col("col") + 2, F.size("cells")), lambda x: (F.coalesce(x, F.lit("")) != "") & ~_is_label(x, rules))
    filled = F.transform(F.filter("nexts", lambda r: r.isNotNull()), lambda r: F.filter(r, lambda x: F.coalesce(x, F.lit("")) != ""))
    parts = F.filter(filled, lambda r: F.coalesce(F.get(r, 0).rlike(ROW_BELOW), F.lit(False)))
    inline = F.when((F.col("value") != "") & (F.col("longer") | (F.col("sep") != "")), F.col("value"))
    raw = F.coalesce(inline, F.get(later, 0), F.try_element_at(F.get(parts, 0), F.lit(-1)), F.lit(""))
    return d.select("doc_id", "field", F.lit(1).alias("source"), *(F.lit(None).cast("long").alias(c) for c in ("ix", "first", "last")), F.array(F.col("table").cast("long"), F.col("row").cast("long"), F.col("col").cast("long")).alias("k"), raw.alias("raw"), F.lit("").alias("item"))


def own_candidates(blocks: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """What stands for itself: conventions of business days in any block or cell (source 3), and security codes in blocks (source 2), which count where no label has one."""
    t = F.trim(F.coalesce("text", F.lit("")))
    code = F.when(t.rlike(f"^{L.ISIN}$"), t).when(layout.may_hold(t, "(?i)ISIN") & t.rlike("(?i)ISIN"), L.found(t, L.ISIN))
    entry = lambda name, source, raw: F.struct(F.lit(name).alias("field"), F.lit(source).alias("source"), raw.alias("raw"))
    conventions = lambda c: F.transform(F.when(layout.may_hold(c, "|".join(CONVENTION_WORDS)), F.regexp_extract_all(c, F.lit(CONVENTION), F.lit(0))).otherwise(F.array().cast("array<string>")), lambda x: entry("business_day_convention", 3, x))
    found = F.concat(F.array_compact(F.array(F.when(code.isNotNull(), entry("isin", 2, code)))), conventions(t))
    d = blocks.select("doc_id", "ix", t.alias("item"), F.posexplode(found).alias("j", "f"))
    out = d.select("doc_id", "f.field", "f.source", "ix", F.col("ix").alias("first"), F.col("ix").alias("last"), F.array("ix", F.col("j").cast("long")).alias("k"), "f.raw", "item")
    if rows is None:
        return out
    cells = rows.select("doc_id", "table", "row", F.posexplode("cells").alias("col", "cell")).select("doc_id", "table", "row", "col", F.posexplode(conventions(_bare(F.col("cell")))).alias("j", "f"))
    place = F.array(*(F.col(c).cast("long") for c in ("table", "row", "col", "j")))
    return out.unionByName(cells.select("doc_id", "f.field", "f.source", *(F.lit(None).cast("long").alias(c) for c in ("ix", "first", "last")), place.alias("k"), "f.raw", F.lit("").alias("item")))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def observed(candidates: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Candidates that pass the guards, with value and class: anchored, raw_only, explicit_na or cross_reference.

    A lexeme that its field's normaliser doesn't know is no observation.
    """
    raw, item, kind = F.trim("raw"), F.col("item"), F.col("kind")
    guard = (F.col("raw") != "") & ~F.col("raw").rlike(PHRASE) & ~(F.contains("raw", F.lit("[")) & F.col("raw").rlike(TEMPLATE) & ~F.col("raw").rlike(r"\d")) & ~F.col("raw").rlike(LABEL_PART)
    d = candidates.where(guard).withColumn("kind", _of_field({n: r.kind for n, r in rules.items()}))
    def normal_of(raw: Column, item: Column, kind: Column) -> Column:
        percent = _plain(L.norm_percent(raw))
        money = L.let(L.norm_money(raw), lambda m: F.when(m.isNotNull(), F.concat_ws("|", _plain(m["amount"]), m["currency"])))
        return (
            F.when(kind == "isin", F.coalesce(L.found(raw, L.ISIN), L.found(item, L.ISIN))).when(kind == "currency", L.norm_currency(raw)).when(kind == "date", L.norm_date(raw)).when(kind == "money", money).when(kind == "percent", percent)
            .when(kind == "benchmark", F.coalesce(L.norm_benchmark(raw), L.norm_benchmark(item))).when(kind == "spread", _plain(L.norm_spread(raw))).when(kind == "frequency", L.norm_frequency(raw)).when(kind == "dates_or_text", L.or_raw(L.norm_date(raw), raw))
            .when(kind == "text_or_percent", L.or_raw(percent, raw)).when(kind == "ranking", L.norm_ranking(raw)).when(kind == "subordination", L.norm_subordination(raw)).when(kind == "applicability", L.norm_applicability(raw)).otherwise(raw)
        )

    normal = L.let(F.struct(raw.alias("raw"), "item", "kind"), lambda x: normal_of(x["raw"], x["item"], x["kind"]))  # beside the generated code, which would be too long to be compiled
    named = F.when(L.is_na(raw), "explicit_na").when(raw.rlike(REFERENCE), "cross_reference")
    d = d.select("*", F.explode(F.array(named)).alias("class"))
    d = d.select("*", F.explode_outer(F.array(F.when(F.col("class").isNull(), normal))).alias("normal"))  # a generator, so the filter isn't pushed below it and normal forms are worked out once
    d = d.where("class is not null or normal is not null")
    value = F.when(F.col("class") == "explicit_na", "NOT_APPLICABLE").when(F.col("normal") != L.RAW_ONLY, F.col("normal"))
    excerpt = F.substring(F.coalesce(item, F.lit("")), 1, EXCERPT)
    return d.select("doc_id", "field", "source", "ix", "first", "last", "k", raw.alias("raw"), value.alias("value"), F.coalesce("class", F.when(F.col("normal") == L.RAW_ONLY, "raw_only").otherwise("anchored")).alias("class"), excerpt.alias("excerpt"))


def settle(observations: DataFrame, rules: dict[str, Rule] = RULES, by: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """One observation of each document and field: status, class, values, lexeme, the blocks it rests on, and whether an excerpt of them has the lexeme (`own`; for a list, whether there is any excerpt).

    What doesn't apply goes beside others; one value stands; values inside others go; several are a list where the
    field may have several, else a conflict. A group is what one document says of one field.
    """
    return _settled(observations.groupBy(*by).agg(F.collect_list(F.struct(*ENTRY)).alias("all")), rules, by)


def settle_best(scoped: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """As settle by document and field, from the observations of one region alone: of those that have any, the one with the highest score, then the first page.

    What others say isn't settled. A group is what one document says of one field in all regions.
    """
    rank = F.struct("score", (-F.col("page")).alias("page"))
    g = scoped.groupBy("doc_id", "field").agg(F.max(rank).alias("best"), F.collect_list(F.struct(rank.alias("rank"), F.struct(*ENTRY).alias("entry"))).alias("all"))
    return _settled(g.select("doc_id", "field", F.transform(F.filter("all", lambda x: x["rank"] == F.col("best")), lambda x: x["entry"]).alias("all")), rules, ("doc_id", "field"))


def _settled(gathered: DataFrame, rules: dict[str, Rule], by: tuple[str, ...]) -> DataFrame:
    """One observation of each list `all` (nothing of NULL). Steps are values of one expression: as columns, each would copy all lists of its row."""
    key, let = L.verbatim_key, L.let
    na = lambda x: x["value"].eqNullSafe(F.lit("NOT_APPLICABLE"))

    def of_several(all_: Column) -> Column:
        labelled = let(F.filter(all_, lambda x: x["source"] != 2), lambda some: F.when((F.size(some) > 0) & (F.size(some) < F.size(all_)), some).otherwise(all_))
        return let(labelled, lambda each: let(F.filter(each, lambda x: ~na(x)), lambda some: F.when(F.size(some) > 0, some).otherwise(each)))

    def named(obs: Column) -> Column:
        valued = F.filter(obs, lambda x: x["value"].isNotNull())
        return let(F.struct(obs.alias("obs"), valued.alias("valued")), lambda s: F.struct(s["obs"].alias("obs"), s["valued"].alias("valued"), F.array_distinct(F.transform(s["valued"], lambda x: x["value"])).alias("names")))

    def kept(s: Column) -> Column:
        whole = F.filter(s["obs"], lambda x: x["value"].isNull() | ~F.exists(s["names"], lambda y: (y != x["value"]) & F.contains(y, x["value"])))
        return let(F.when(F.size(s["names"]) > 1, whole).otherwise(s["obs"]), lambda k: F.struct(s["obs"].alias("obs"), s["valued"].alias("valued"), F.size(s["names"]).alias("n"), k.alias("kept")))

    def chosen(s: Column) -> Column:
        kinds = F.size(F.array_distinct(F.transform(s["kept"], lambda x: F.coalesce(x["value"], F.lit("\0")))))
        one = F.when(s["n"] == 1, F.get(s["valued"], 0)).when(s["n"] == 0, F.get(s["obs"], 0)).when(kinds == 1, F.get(s["kept"], 0))
        return let(one, lambda one: F.struct(one.alias("one"), s["kept"].alias("kept"), F.when(s["n"] == 1, s["obs"]).when(one.isNotNull(), F.array(one)).otherwise(s["kept"]).alias("evidence")))

    multi = F.col("multi")

    def told(s: Column) -> Column:
        one = s["one"]
        status = F.when(one["class"] == "anchored", "DERIVED").when(one.isNotNull() | multi, "OBSERVED").otherwise("CONFLICT")
        values = F.when(one.isNotNull(), F.array_compact(F.array(one["value"]))).otherwise(F.transform(s["kept"], lambda x: F.when(multi, F.coalesce(x["value"], x["raw"])).otherwise(x["value"])))
        plain = F.octet_length(one["raw"]) == F.length(one["raw"])  # ASCII, so lower case doesn't hang on what stands about it: what is there as it is, is there by its key
        own = F.exists(s["evidence"], lambda x: (x["excerpt"] != "") & (one.isNull() | (plain & F.contains(x["excerpt"], one["raw"])) | F.contains(key(x["excerpt"]), key(one["raw"]))))
        kind = F.when(one.isNotNull(), one["class"]).when(multi, "multi_aspect")
        return F.struct(status.alias("status"), kind.alias("class"), values.alias("values"), one["raw"].alias("lexeme"), F.transform(s["evidence"], lambda x: x["ix"]).alias("blocks"), own.alias("own"))

    several = let(F.array_sort("all"), of_several)
    obs = F.when(F.size("all") > 1, several).otherwise(F.col("all"))  # of one entry nothing is to be left out
    r = F.when(F.col("all").isNotNull(), let(let(let(let(obs, named), kept), chosen), told))
    g = gathered.withColumn("multi", _of_field({n: str(x.multi) for n, x in rules.items()}) == "True")
    return g.select(*by, F.explode(F.array(r)).alias("r")).select(*by, *(F.col("r")[c].alias(c) for c in SETTLED))  # a generator, so it isn't worked out for each column


def day_counts(settled: DataFrame) -> DataFrame:
    """Day counts by their convention; a lexeme of none stays observed without a value."""
    own = (F.col("field") == "day_count") & F.col("lexeme").isNotNull()
    name = F.when(own, L.resolve_daycount(F.col("lexeme"), F.col("lexeme")))  # not of all fields, as what several columns share would be
    lost = own & name.isNull() & (F.col("status") == "DERIVED")
    return settled.withColumns({
        "values": F.when(own & name.isNotNull(), F.array(name)).when(lost, F.array().cast("array<string>")).otherwise(F.col("values")),
        "class": F.when(own & name.isNotNull(), F.concat_ws("+", "class", F.lit("canonical"))).when(lost, "unmapped_lexeme").otherwise(F.col("class")),
        "status": F.when(lost, "OBSERVED").otherwise(F.col("status")),
    })


def candidates(blocks: DataFrame, rows: DataFrame | None = None, rules: dict[str, Rule] = RULES) -> DataFrame:
    out = text_candidates(blocks, rules).unionByName(own_candidates(blocks, rows).where(F.col("field").isin(*rules)))
    return out.unionByName(table_candidates(rows, rules)) if rows is not None else out


def _each_field(docs: DataFrame, observations: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """A settled row for each document and field, MISSING where nothing was observed. A group is what one document says, so nothing but it is gathered and its fields aren't joined anew."""
    said = observations.groupBy("doc_id").agg(F.collect_list(F.struct("field", F.struct(*ENTRY).alias("entry"))).alias("said"))
    of = lambda f: F.transform(F.filter("said", lambda x: x["field"] == f), lambda x: x["entry"])
    d = docs.join(said.hint("shuffle_hash"), "doc_id", "left").select("doc_id", F.inline(F.transform(F.array(*map(F.lit, rules)), lambda f: F.struct(f.alias("field"), of(f).alias("all")))))
    d = day_counts(_settled(d.withColumn("all", F.when(F.size("all") > 0, F.col("all"))), rules, ("doc_id", "field")))
    return d.withColumn("status", F.coalesce("status", F.lit("MISSING")))


def extract_all(docs: DataFrame, blocks: DataFrame, rows: DataFrame | None = None, rules: dict[str, Rule] = RULES, role: str = "final_terms") -> DataFrame:
    """A row for each document and field, read from the whole document; MISSING where nothing was found, no rows for a role that isn't read.

    Documents, blocks and rows that are dealt out by document (`shared.dealt`) are read where they lie, without a shuffle.
    """
    docs = docs.where(F.lit(role in ROLES)).select("doc_id").distinct()
    return _each_field(docs, observed(candidates(blocks, rows, rules), rules), rules)


def verify(fields: DataFrame, blocks: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Observed and derived fields by what the document says word for word; others as they are.

    A lexeme stands in the excerpt of its own block (`verified_verbatim`) or anywhere in the document's blocks and cells
    (`verified_verbatim_doclevel`), or there is none (`no_lexeme`); a list needs the excerpt of a block. What can't be
    found is observed without a value (VALUE_UNVERIFIED).
    """
    key, many = L.verbatim_key, F.coalesce(F.col("class") == "multi_aspect", F.lit(False))
    said, own = key(F.coalesce("lexeme", F.lit(""))), F.coalesce("own", F.lit(False))
    asked = F.col("status").isin("OBSERVED", "DERIVED")
    d = table(fields.withColumns({"_said": said, "_lost": F.coalesce(asked & ~many & (said != "") & ~own, F.lit(False))}), "fields")
    # only what its own excerpts don't have is looked for, in the documents that it is from
    lost = d.where("_lost").select("doc_id", "field", "_said")
    texts = blocks.select("doc_id", F.col("text").alias("c"))
    if rows is not None:
        texts = texts.unionByName(rows.select("doc_id", F.explode("cells").alias("c")))
    n = tasks(d)
    asked_of = lost.repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("field", "_said")).alias("_all"))
    there = texts.repartition(n, "doc_id").join(asked_of, "doc_id")  # a document has a row for each field at most
    there = there.withColumn("_text", key(F.coalesce("c", F.lit("")))).select("doc_id", F.explode(F.filter("_all", lambda x: F.contains(F.col("_text"), x["_said"]))["field"]).alias("field"))
    looked = d.where("_lost").join(there.distinct().withColumn("_there", F.lit(True)), ["doc_id", "field"], "left")
    d = d.where("not _lost").unionByName(looked, allowMissingColumns=True)  # the others aren't shuffled
    kind = (
        F.when(many, F.when(own, "verified_verbatim").otherwise("VALUE_UNVERIFIED"))
        .when(F.col("_said") == "", "no_lexeme").when(own, "verified_verbatim").when(F.coalesce("_there", F.lit(False)), "verified_verbatim_doclevel").otherwise("VALUE_UNVERIFIED")
    )
    d = d.withColumn("_kind", F.when(asked, kind))
    bad = F.coalesce(F.col("_kind") == "VALUE_UNVERIFIED", F.lit(False))
    new = {"status": F.when(bad, "OBSERVED").otherwise(F.col("status")), "class": F.coalesce("_kind", "class"), "values": F.when(~bad, F.col("values"))}
    return d.select(*(new[c].alias(c) if c in new else F.col(c) for c in fields.columns))


def extract_documents(docs: DataFrame, blocks: DataFrame, rows: DataFrame | None = None, rules: dict[str, Rule] = RULES, each: int = 10) -> DataFrame:
    """Fields of classified documents (doc_id, role), verified, by the sections of their role; a role that isn't read gives one row with a note.

    Blocks and rows are dealt out by document to tasks that grow with the documents, which have about `each` blocks.
    """
    docs = table(docs, "documents")
    read = docs.where(F.col("role").isin(*ROLE_SECTIONS))

    def of_role(c: Column) -> Column:
        def tests(x: Column) -> Column:
            holds = lambda p: layout.may_hold(x["text"], p, x["low"]) & x["text"].rlike(p)
            by_role = {s: F.coalesce(*(F.when(x["role"] == r, holds(own[s])) for r, own in ROLE_SECTIONS.items() if s in own), holds(p)) for s, p in SECTIONS.items()}
            return F.array_compact(F.array(*(F.when(test, F.lit(s)) for s, test in by_role.items())))

        return L.let(F.struct(c.alias("text"), F.lower(c).alias("low"), "role"), tests)

    roles = read.select("doc_id", "role")
    n = tasks(docs, each)
    dealt = lambda d: d.repartition(n, "doc_id").join(roles.repartition(n, "doc_id"), "doc_id")
    own = table(dealt(blocks), "read")
    hits = own.select("doc_id", "ix", "page", F.explode(of_role(F.coalesce("text", F.lit("")))).alias("section"))
    cells = table(dealt(rows), "rows") if rows is not None else None
    if rows is not None and "page" in rows.columns:
        hits = hits.unionByName(cells.select("doc_id", "page", F.explode("cells").alias("c"), "role").select("doc_id", "page", F.explode(of_role(F.coalesce("c", F.lit("")))).alias("section")), allowMissingColumns=True)
    found = extract_by_section(read, own.drop("role"), cells.drop("role") if rows is not None else None, rules, hits=hits)
    found = verify(found, own, cells).withColumn("note", F.lit(None).cast("string"))
    other = docs.where(~F.coalesce(F.col("role").isin(*ROLE_SECTIONS), F.lit(False))).select("doc_id", F.concat(F.lit("no extractor for role "), F.coalesce("role", F.lit("UNKNOWN"))).alias("note"))
    return found.unionByName(other, allowMissingColumns=True)


def extract_by_section(docs: DataFrame, blocks: DataFrame, rows: DataFrame | None = None, rules: dict[str, Rule] = RULES, sections: dict[str, str] = SECTIONS, hits: DataFrame | None = None) -> DataFrame:
    """As extract_all, but fields of a section are read in views of its regions, the one with most hits first; adds failure.

    A view sees a region's blocks alone: labels that go on beyond it, and values in blocks beyond it, are not there. Tables belong to
    every region, and boxes beside a label are those of its page. LOCATION_MISS: the document has no region of the section;
    PARSING_MISS: regions, but no observation. `hits` (doc_id, ix, page, section) replace the patterns of sections; cells make hits
    if rows have a page.
    """
    cells = rows if rows is not None and "page" in rows.columns else None
    hits = hits if hits is not None else layout.section_hits(blocks.withColumn("block", F.coalesce("text", F.lit(""))), sections, cells)
    areas = table(layout.regions(hits).select("doc_id", "section", F.coalesce("page", F.lit(-1)).cast("long").alias("page"), "lo", "hi", "score"), "regions")
    everywhere = docs.select("doc_id").distinct().select("doc_id", F.lit("").alias("section"), F.lit(-1).cast("long").alias("page"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("score"))
    section = F.coalesce(_of_field({n: r.section for n, r in rules.items()}), F.lit(""))
    obs = observed(candidates(blocks, rows, rules), rules).withColumn("section", section)
    free = F.col("section") == ""  # fields of no section are read from the whole document
    obs = obs.withColumns({c: F.when(~free, F.col(c)) for c in ("first", "last")})
    # by shuffle: sizes of files tell nothing of lines and observations that come out of one row, which the driver would hold for a broadcast
    scoped = layout.inside(obs.hint("merge"), areas.unionByName(everywhere), ["doc_id", "section"], "first", "last")
    found = day_counts(settle_best(scoped, rules))
    seen = areas.groupBy("doc_id").agg(F.collect_set("section").alias("seen"))  # a row for each document, so its fields aren't shuffled to find their sections
    d = docs.select("doc_id").distinct().join(seen, "doc_id", "left").select("doc_id", "seen", F.explode(F.array(*map(F.lit, rules))).alias("field"))
    d = d.withColumn("section", _of_field({n: r.section for n, r in rules.items()})).withColumn("located", F.array_contains("seen", F.col("section"))).join(found.hint("merge"), ["doc_id", "field"], "left")
    failure = F.when(F.col("status").isNull(), F.when(F.col("section").isNotNull() & ~F.coalesce("located", F.lit(False)), "LOCATION_MISS").otherwise("PARSING_MISS"))
    return d.select("doc_id", "field", F.coalesce("status", F.lit("MISSING")).alias("status"), *SETTLED[1:], failure.alias("failure"))
