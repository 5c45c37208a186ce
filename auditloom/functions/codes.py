"""Interpretation of the type codes and reference codes that audit files carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.values import stripped

# FIXED VALUES: journal type codes, and the words that free-text types start with
JOURNAL_CODES = {"B": "bank", "C": "cash", "G": "goods", "M": "memo", "O": "opening", "P": "purchases", "S": "sales", "T": "production", "Y": "payroll", "Z": "other"}
JOURNAL_WORDS = [("bank", "bank"), ("kas", "cash"), ("cash", "cash"), ("memo", "memo"), ("dagboek", "memo"), ("begin", "opening"), ("opening", "opening"), ("inkoop", "purchases"), ("purchase", "purchases"), ("verkoop", "sales"), ("sale", "sales"), ("loon", "payroll"), ("salaris", "payroll"), ("payroll", "payroll"), ("productie", "production"), ("production", "production"), ("goederen", "goods"), ("goods", "goods"), ("voorraad", "goods")]
# FIXED VALUES: account types, and the words that free-text types start with
ACCOUNT_CODES = {"balance": ["b", "balans", "balance", "bal", "balans-rekening"], "profit_loss": ["p", "w", "v", "wv", "w&v", "pl", "p&l", "resultaat", "winst- en verlies"], "mixed": ["m", "mixed", "gemengd"]}
ACCOUNT_WORDS = {"balance": ["balans", "balance", "activa", "passiva", "asset", "liabilit"], "profit_loss": ["winst", "verlies", "resultaat", "kosten", "opbrengst", "profit"]}
# FIXED VALUES: relation types, and the words that free-text types contain
RELATION_CODES = {"B": "both", "C": "customer", "S": "supplier", "O": "other", "D": "customer", "F": "supplier"}
CUSTOMER_WORDS, SUPPLIER_WORDS = ["debiteur", "klant", "customer", "afnemer"], ["crediteur", "leverancier", "supplier", "vendor"]
# FIXED VALUES: what exporters write where they have no reference code
PLACEHOLDERS = ["", "0", "00", "000", "0000", "0001", "-", "rgs-1", "nvt", "n.v.t."]
RGS = r"^([BW](?:[A-Z][A-Za-z0-9]{2})*)([\s\S]*)$"


def _chain(tests: list[tuple[Column, str]], other: str = "unknown") -> Column:
    out = F.when(tests[0][0], tests[0][1])
    for test, value in tests[1:]:
        out = out.when(test, value)
    return out.otherwise(other)


def journal_kind(code: Column) -> Column:
    c = stripped(code)
    low = F.lower(c)
    return _chain([(F.upper(c) == k, v) for k, v in JOURNAL_CODES.items()] + [(low.startswith(w), v) for w, v in JOURNAL_WORDS])


def account_kind(code: Column) -> Column:
    c = F.lower(stripped(code))
    words = [(c.startswith(w), kind) for kind, starts in ACCOUNT_WORDS.items() for w in starts]
    return _chain([(c.isin(codes), kind) for kind, codes in ACCOUNT_CODES.items()] + words)


def relation_kind(code: Column) -> Column:
    c = F.upper(stripped(code))
    low = F.lower(c)
    customer, supplier = (F.coalesce(low.rlike("|".join(w)), F.lit(False)) for w in (CUSTOMER_WORDS, SUPPLIER_WORDS))
    both = (customer & supplier) | low.contains("both") | low.contains("beide")
    return _chain([(c == k, v) for k, v in RELATION_CODES.items()] + [(both, "both"), (customer, "customer"), (supplier, "supplier")])


def rgs_placeholder(raw: Column) -> Column:
    return F.lower(stripped(raw)).isin(PLACEHOLDERS)


def rgs_code(raw: Column) -> Column:
    s = stripped(raw)
    return F.when(~rgs_placeholder(raw), F.nullif(F.regexp_extract(s, RGS, 1), F.lit("")))


def rgs_extension(raw: Column) -> Column:
    rest = F.regexp_extract(stripped(raw), RGS, 2)
    return F.when(rgs_code(raw).isNotNull(), F.nullif(F.regexp_replace(rest, r"^[ .\-_]+|[ .\-_]+$", ""), F.lit("")))


def concept_code(ref: Column) -> Column:
    """The local part of a taxonomy reference: after the last #, then after the last colon."""
    return F.substring_index(F.substring_index(ref, "#", -1), ":", -1)


def release(text: Column) -> Column:
    """A release number in free text: commas as points, no zero padding, no trailing .0."""
    found = F.regexp_extract(text, r"(?<![0-9.])([0-9]+(?:[.,][0-9]+)*)", 1)
    parts = F.transform(F.split(F.translate(found, ",", "."), r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.nullif(F.regexp_replace(F.array_join(parts, "."), r"(\.0)+$", ""), F.lit(""))
