"""Personal data: patterns propose, checksums confirm, context adjusts the score.

Everything is a JVM expression. Positions come from splitting: a pattern's
matches and the stretches between them alternate, so a running sum of their
lengths gives each match's place in code points. Patterns are written with
possessive quantifiers and start either where the last match ended or outside a
run of the same signs; that keeps leftmost, non-overlapping matching unchanged
but linear in the text, however long a run is.

One row for each match and one for each document go through one exchange by row
number; no text is shuffled, but for the matches and 48 characters before each.

Kinds: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to
15 digits); the method adds iban (mod-97). Score: 0.5 for a pattern, 0.3 more
for a checksum or range that holds, 0.2 more for a context word before it.

Defined cases: null counts as empty; documents without matches have zero counts
and the digest of the empty string; repeated rows are scanned one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, read

KINDS = ("email", "ip", "card", "phone", "iban")

#: Java patterns; each is equal to its plain form under leftmost non-overlapping matching.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[a-z]?+",
}

# Length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: What a text must hold before its pattern is tried; cheap to test.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}

#: Words before a match that speak for its kind.
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|kontakt|correo",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobile",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
CONTEXT_CHARS = 48


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """The digits' Luhn sum ends in 0."""
    digits = F.split(F.reverse(_digits(text)), "")
    digit = F.transform(F.filter(digits, lambda x: x != ""), lambda x, i: x.cast("int") * (1 + F.pmod(i, F.lit(2))))
    return F.pmod(F.aggregate(digit, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)), F.lit(10)) == 0


def mod97(text: Column) -> Column:
    """The account number, its first four signs moved last and letters as numbers from 10, is 1 mod 97."""
    flat = F.replace(text, F.lit(" "), F.lit(""))
    signs = F.filter(F.split(F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4))), ""), lambda x: x != "")
    value = F.transform(signs, lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55))
    return F.aggregate(value, F.lit(0), lambda a, x: F.pmod(F.when(x > 9, a * 100 + x).otherwise(a * 10 + x), F.lit(97))) == 1


def _account(found: Column) -> Column:
    """An account number cut to its country's length, as words in capitals may follow it; empty if it doesn't end there or the country has none."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    out = F.lit("")
    for n, countries in by_length.items():
        own = F.regexp_extract(found, rf"^((?:\x20?[A-Z0-9]){{{n}}})(?![A-Za-z0-9])", 1)
        out = F.when(F.substr(found, F.lit(1), F.lit(2)).isin(*countries), own).otherwise(out)
    return out


def _valid(kind: Column, found: Column) -> Column:
    n = F.length(_digits(found))
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", found.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", n.between(13, 19) & luhn(found))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "iban", (found != "") & mod97(found))
        .otherwise(False)
    )


def _matches(kind: str) -> Column:
    """array of (kind, number, length before, match, context) of one kind."""
    empty = F.array().cast("array<struct<k:int,i:int,gap:int,found:string,near:string>>")
    found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split("text", PATTERNS[kind], -1)
    rows = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), lambda m, g: F.struct(F.lit(KINDS.index(kind)).alias("k"), F.char_length(g).alias("gap"), m.alias("found"), F.right(g, F.lit(CONTEXT_CHARS)).alias("near")))
    numbered = F.transform(F.filter(rows, lambda r: r["found"].isNotNull()), lambda r, i: F.struct(r["k"].alias("k"), i.cast("int").alias("i"), r["gap"].alias("gap"), r["found"].alias("found"), r["near"].alias("near")))
    return F.when(F.col("text").rlike(HINTS[kind]), numbered).otherwise(empty)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id and one row for each confirmed span (kind, start, end, found, score); one row with null kind for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("found"), F.lit("").alias("near")))
    each = rows.select("doc_id", "uid", F.explode(F.concat(none, *(_matches(k) for k in KINDS))).alias("m")).select("uid", "doc_id", "m.*")
    each = each.repartition("uid")
    order = Window.partitionBy("uid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("found")
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    kind = F.when(F.col("k") >= 0, F.get(F.array(*(F.lit(k) for k in KINDS)), F.col("k")))
    near = F.lit(False)
    for i, k in enumerate(KINDS):
        near = F.when(F.col("k") == i, F.col("near").rlike(CONTEXT[k])).otherwise(near)
    # Places are counted with whole matches; only then is an account number cut.
    named = placed.withColumn("kind", kind).withColumn("found", F.when(F.col("kind") == "iban", _account(F.col("found"))).otherwise(F.col("found")))
    named = named.withColumn("end", F.when(F.col("kind") == "iban", F.col("start") + size).otherwise(F.col("end")))
    kept = named.filter((F.col("k") < 0) | _valid(F.col("kind"), F.col("found")))
    checked = F.col("kind").isin("ip", "card", "iban").cast("int") * 0.3
    return kept.select("uid", "doc_id", "k", "kind", "start", "end", "found", F.when(F.col("k") >= 0, F.lit(0.5) + checked + near.cast("int") * 0.2).alias("score"))


def summary(found: DataFrame) -> DataFrame:
    """One row for each document."""
    span = F.struct("k", "start", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("shown"))
    lists = found.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), *(F.count_if(F.col("k") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.array_sort(F.collect_list(F.when(F.col("k") >= 0, span))).alias("all"), F.max("score").alias("top_score"),
    )
    shown = lambda a: F.array_join(F.transform(a, lambda s: s["shown"]), ",")
    base = F.filter("all", lambda s: s["k"] < 4)
    return lists.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"), "n_iban", "top_score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(summary(spans(read(spark, sf_dir, "documents"))))
