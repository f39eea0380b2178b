"""Column functions on text: folding, tokens, chunk spans, redaction, identifiers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token classes (ASCII words with inner marks, runs of Japanese letters).
JAPANESE = "一-龯々ぁ-んァ-ヶー"
TOKEN = rf"[a-z0-9][a-z0-9_.+#/:-]*|[{JAPANESE}]+"

# Redaction rules in the order in which they apply.
REDACTIONS = [
    ("email", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[メールアドレス]"),
    ("phone", r"(?<!\d)(?:\+?\d{1,3}[-\s]?)?(?:0\d{1,4}[-\s]?\d{1,4}[-\s]?\d{3,4})(?!\d)", "[電話番号]"),
    ("path", r"[A-Za-z]:\\[^\r\n\t :;\"'<>|]+(?:\\[^\r\n\t :;\"'<>|]+)*", "[Windowsパス]"),
    ("key", r"(?i)(?:sk-[A-Za-z0-9_-]{12,}|Bearer\s+[A-Za-z0-9._-]{12,}|(?:api[_-]?key|apikey)\s*[:=]\s*[A-Za-z0-9._-]{8,})", "[APIキー]"),
]


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition and full case folding: the exact form for any script."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def tokenise(text: str | None) -> list[str]:
    """``tokens`` of the exactly folded text, for use inside tasks."""
    out = []
    for token in re.findall(TOKEN, unicodedata.normalize("NFKC", text or "").casefold()):
        out.append(token)
        if re.match(f"[{JAPANESE}]", token):
            out += [token[i : i + n] for n in (2, 3) for i in range(len(token) - n + 1)]
    return out


# Fixed value: texts of these characters and ASCII alone are in NFKC form, and ß is the only one that folds to more than lower case.
PLAIN = "^[\\u00c0-\\u00ff\\u0152\\u0153¡§«»¿°©€•–—‘’“”、。「」・一-龯々ぁ-んァ-ヶー]*$"


def plain(text: Column) -> Column:
    """Whether a text is of the characters of ``PLAIN`` and ASCII alone. ASCII is told by the bytes or taken out first: a class of many
    ranges is slow to try on each character."""
    return (F.octet_length(text) == F.char_length(text)) | F.regexp_replace(text, "[\\x00-\\x7f]+", "").rlike(PLAIN)


def fold(text: Column) -> Column:
    """NFKC and case folding. Texts that need no more than lower case and ß, which their characters tell, stay in the
    JVM; only others go to Python."""
    easy = plain(text)
    return F.when(text.isNull(), text).when(easy, F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).otherwise(nfkc_casefold(F.when(~easy, text)))


def fold_all(texts: Column) -> Column:
    """``fold`` of each member of an array, a null one empty; as one text, as no Python function may be called for a member."""
    given = F.transform(texts, lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit("\x1e"), F.lit(" ")))
    return F.when(F.size(given) > 0, F.split(fold(F.array_join(given, "\x1e")), "\x1e")).otherwise(F.array().cast("array<string>"))


def composed(text: Column) -> Column:
    """NFKC form. Texts that are in it, which their characters tell, stay in the JVM."""
    easy = plain(text)
    return F.when(text.isNull() | easy, text).otherwise(nfkc(F.when(~easy, text)))


def tokens(folded: Column) -> Column:
    """Tokens of a folded text, repeats kept; a Japanese token is followed by its 2-grams and 3-grams."""
    found = F.regexp_extract_all(folded, F.lit(f"({TOKEN})"), 1)

    def grams(token: Column) -> Column:
        size = F.char_length(token)
        runs = [
            F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
            for n in (2, 3)
        ]
        return F.when(token.rlike(f"[{JAPANESE}]"), F.concat(F.array(token), *runs)).otherwise(F.array(token))

    return F.when(folded.rlike(f"[{JAPANESE}]"), F.flatten(F.transform(found, grams))).otherwise(found)


def chunk_texts(text: Column, maximum: int, overlap: int) -> Column:
    """The fixed chunks of a text, at steps of ``maximum`` - ``overlap`` until a chunk reaches the end: pieces of one step, each with
    the beginning of the next, which stands beside it and is not looked up by its place, as that would cut the text once for each."""
    if not 0 <= overlap < maximum:
        raise ValueError("the overlap must be smaller than the chunk, and not negative")
    size, step = F.char_length(text), maximum - overlap
    count = F.when(size == 0, 0).when(size <= maximum, 1).otherwise(F.ceil((size - overlap) / step)).cast("int")
    if overlap > step:
        starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(maximum)))
    steps = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), 1)
    if not overlap:
        return steps

    def lapped(own: Column) -> Column:
        behind = F.slice(own, 2, F.greatest(F.size(own), F.lit(1)))
        return F.zip_with(own, behind, lambda x, more: F.concat(x, F.coalesce(F.substring(more, 1, overlap), F.lit(""))))

    # a function of the one member of an array: what it names more than once is computed once
    return F.slice(F.get(F.transform(F.array(steps), lapped), F.lit(0)), 1, F.coalesce(count, F.lit(0)))


def chunk_id(document: Column, strategy: str, index: Column, section: Column, text: Column) -> Column:
    """document:strategy: and the first 20 hex digits of the SHA-256 of the five parts."""
    material = F.concat_ws("\x1f", document.cast("string"), F.lit(strategy), index.cast("string"), F.coalesce(section, F.lit("")), text)
    return F.concat(document.cast("string"), F.lit(f":{strategy}:"), F.substring(F.sha2(material, 256), 1, 20))


def redact(text: Column) -> Column:
    """``text`` with e-mail addresses, phone numbers, paths and keys replaced, in that order."""
    for _, pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def support_number(value: Column) -> Column:
    """Letters and digits of a support number; all digits: padded with zeros to eight; else upper case."""
    kept = F.regexp_replace(value, r"[^\p{L}\p{Nd}]", "")
    digits = kept.rlike(r"^[0-9]+$")
    return F.when(digits & (F.char_length(kept) < 8), F.lpad(kept, 8, "0")).when(digits, kept).otherwise(F.upper(kept))


def date_text(value: Column) -> Column:
    """A date from ``yyyyMMdd``, ``yyyyMM`` or ``yyyy`` digits, or from any text that casts to a date."""
    size = F.when(value.rlike("^[0-9]+$"), F.char_length(value))
    full = F.when(size == 8, value).when(size == 6, F.concat(value, F.lit("01"))).when(size == 4, F.concat(value, F.lit("0101")))
    return F.coalesce(F.to_date(F.try_to_timestamp(full, F.lit("yyyyMMdd"))), F.when(size.isNull(), F.try_to_timestamp(value).cast("date")))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlap; none if either is empty."""
    cut = F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))
    return F.when(F.char_length(part) > 0, (cut / F.char_length(part)).cast("int")).otherwise(0)


def excerpt(text: Column, focus: Column, size: int = 1200, lead: int = 220) -> Column:
    """A window of ``size`` characters of the white-space-joined text that begins ``lead`` before the focus term, with
    an ellipsis where text is left out; the whole text if it is shorter."""
    joined = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = F.instr(F.lower(joined), F.lower(focus))
    start = F.greatest(F.lit(1), F.when(found > 0, found - lead).otherwise(1))
    body = F.substr(joined, start, F.lit(size))
    before = F.when(start > 1, "...").otherwise("")
    after = F.when(start + size - 1 < F.char_length(joined), "...").otherwise("")
    return F.when(F.char_length(joined) <= size, joined).otherwise(F.concat(before, body, after))


def product(a: Column, b: Column) -> Column:
    """Dot product of two number arrays of one length; null entries count as 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 if the lengths differ or one is all zero."""
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), product(a, b) / norm))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def ochiai(a: Column, b: Column) -> Column:
    """Shared over the root of the product of the sizes of two sets; 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(a) * F.size(b)
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / F.sqrt(both)).otherwise(0.0)


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice similarity of the distinct 2-grams of two texts without white space; equal texts give 1."""

    def grams(text: Column) -> Column:
        compact = F.regexp_replace(text, r"\s+", "")
        size = F.char_length(compact)
        pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr(compact, i, F.lit(2)))
        return F.array_distinct(F.when(size >= 2, pairs).otherwise(F.array().cast("array<string>")))

    x, y = grams(a), grams(b)
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(total > 0, 2 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)
