"""Text functions of the engine as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes and the micro sign that matching folds, one code point to one.
DASHES = "‐‑‒–—−"
CELL_LINE = r"(?:SW\d+|HT-?\d+|Hs\d+|MCF-?\d+|HCT\d+|MDA-MB-?\d+)"
# Licenses by the texts that name them, in order of precedence.
LICENSE_RULES = (
    (("cc0", "public domain"), "public-domain"),
    (("creative commons attribution-noncommercial-sharealike", "cc by-nc-sa"), "CC-BY-NC-SA"),
    (("creative commons attribution-noncommercial", "cc by-nc"), "CC-BY-NC"),
    (("creative commons attribution-sharealike", "cc by-sa"), "CC-BY-SA-4.0"),
    (("creative commons attribution", "cc by"), "CC-BY-4.0"),
)
KNOWN_LICENSES = ("CC-BY", "CC-BY-4.0", "CC-BY-SA", "CC-BY-SA-4.0", "MIT", "public-domain")
# What a paragraph relation looks like.
RELATION = (
    r"(?i)([^.;:()]+?)\s+(?:was|were|is|are|showed|shows|had|has|yielded|demonstrated|indicates?)?\s*(?:significantly\s+)?"
    r"(increased|decreased|higher|lower|improved|reduced|positively correlated|negatively correlated)\s+([^.;:()]+)"
)
#: Words of which a text with a relation holds one, in lower case.
RELATION_HINTS = ("increased", "decreased", "higher", "lower", "improved", "reduced", "correlated")


def _ascii(text: Column) -> Column:
    """Whether a text has one byte for each character, so that folding signs beyond ASCII leaves it as it is. It costs a
    hundredth of ``translate``, which looks up each character."""
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    return F.when(_ascii(text), text).otherwise(F.translate(text, DASHES + "µ", "-" * len(DASHES) + "μ"))


def fold_micro(text: Column) -> Column:
    return F.when(_ascii(text), text).otherwise(F.translate(text, "µ", "μ"))


def casefold(text: Column) -> Column:
    """Case folding for the letters that the domain uses: lower case, micro sign to mu, sharp s to ss."""
    return F.when(_ascii(text), F.lower(text)).otherwise(F.replace(F.translate(F.lower(text), "µ", "μ"), F.lit("ß"), F.lit("ss")))


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def license_label(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("unknown")
    for texts, label in reversed(LICENSE_RULES):
        hit = F.lit(False)
        for t in texts:
            hit = hit | low.contains(t)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def known_license(label: Column) -> Column:
    return F.trim(F.coalesce(label, F.lit(""))).isin(*KNOWN_LICENSES)


def tokens(text: Column) -> Column:
    """Distinct search tokens of two characters or more."""
    found = F.regexp_extract_all(casefold(text), F.lit("[a-z0-9μµ%]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def relation(text: Column) -> Column:
    """struct<value, subject, object> of the first relation of a text, null where there is none or it says nothing.

    The pattern, whose cost grows with the square of a sentence, is tried only where a text holds one of its words."""
    low = F.lower(text)
    hinted = low.contains(RELATION_HINTS[0])
    for word in RELATION_HINTS[1:]:
        hinted = hinted | low.contains(word)
    subject, verb, rest = (F.regexp_extract(text, RELATION, k) for k in (1, 2, 3))
    subject = squeeze(subject)
    rest = F.regexp_replace(squeeze(rest), r"(?i)^than\s+", "")
    rest = F.regexp_replace(rest, r"(?i)^[A-Za-z -]+\s+values\s+than\s+", "")
    ok = (verb != "") & (subject != "") & (rest != "") & ~F.lower(subject).isin("a", "an", "the")
    return F.when(hinted & ok, F.struct(F.lower(verb).alias("value"), subject.alias("subject"), rest.alias("object")))


def local_clause(text: Column, limit: int = 520) -> Column:
    """The last sentence, at most its last ``limit`` characters; decimal points do not end sentences."""
    return F.right(F.element_at(F.split(text, r"(?U)(?<=[.!?])\s+"), -1), F.lit(limit))


def text_or_none(value: Column) -> Column:
    """Text form in keys, where a missing part reads ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def candidate_id(doc_id: Column, container: Column, row: Column, slot: Column, prefix: str = "candidate-") -> Column:
    key = F.concat_ws("|", *(text_or_none(c) for c in (doc_id, container, row, slot)))
    return F.concat(F.lit(prefix), F.substring(F.sha1(key), 1, 10))


def group_key(*parts: Column) -> Column:
    """The whole SHA-1 of a group's parts. The ids that are published have 12 digits of it, which two of some ten million groups
    can share."""
    return F.sha1(F.concat_ws("|", *(text_or_none(p) for p in parts)))


def group_hash(*parts: Column) -> Column:
    return F.substring(group_key(*parts), 1, 12)


def split_name(doc_id: Column) -> Column:
    """train, dev or test by a hash of the document: 80, 10 and 10 of a hundred."""
    n = F.conv(F.substring(F.sha2(doc_id.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(n < 80, "train").when(n < 90, "dev").otherwise("test")


def float_text(x: Column) -> Column:
    """A double in the shortest form that reads back equal, as keys spell it: 12345678.0, 0.0005, 1.25e-05.

    Digits are those of the JVM, which before JDK 19 prints a few values (such as the least denormal, 4.9e-324) one digit longer."""
    java = x.cast("string")
    sign = F.when(java.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(java, "^-", "")
    whole, frac, power = (F.regexp_extract(body, r"^(\d)\.(\d+)E(-?\d+)$", k) for k in (1, 2, 3))
    digits = F.concat(whole, F.when(frac == "0", "").otherwise(frac))
    e = power.try_cast("int")
    wide = F.when(F.length(digits) <= e + 1, F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
    short = F.concat(whole, F.when(frac == "0", "").otherwise(F.concat(F.lit("."), frac)), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.lit(3)), digits)
    shaped = F.when((e >= 7) & (e < 16), wide).when(e == -4, small).otherwise(short)
    return F.when(power == "", java).otherwise(F.concat(sign, shaped))
