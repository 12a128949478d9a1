"""Text measures as column expressions; NFC is an Arrow UDF, skipped for ASCII."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glyphmark.functions.edits import text_edits, word_edits

#: The characters that count as white space for stripping.
BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _composed(texts: pa.Array) -> pa.Array:
    """Each different text once; Arrow's own kernel leaves letters and their marks apart, so it can't be used."""
    coded = texts.dictionary_encode()
    words = [w if unicodedata.is_normalized("NFC", w) else unicodedata.normalize("NFC", w) for w in coded.dictionary.to_pylist()]
    return pa.array(words, pa.string()).take(coded.indices)


def _composed_lists(lists: pa.Array) -> pa.Array:
    return pa.array([None if texts is None else _composed(pa.array(texts, pa.string())).to_pylist() for texts in lists.to_pylist()], pa.list_(pa.string()))


_nfc = F.arrow_udf(_composed, StringType())
_nfc_lists = F.arrow_udf(_composed_lists, ArrayType(StringType()))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def nfc(text: Column) -> Column:
    """Only texts that aren't ASCII leave the JVM."""
    return F.when(is_ascii(text), text).otherwise(_nfc(F.when(~is_ascii(text), text)))


def normalize(text: Column) -> Column:
    """NFC, then stripped of white space; case stays."""
    return strip(nfc(text))


def normalize_all(texts: Column) -> Column:
    """The same of each text of an array, by one call a list."""
    plain = is_ascii(F.array_join(texts, ""))
    return F.transform(F.when(plain, texts).otherwise(_nfc_lists(F.when(~plain, texts))), strip)


def cer(reference: Column, read: Column) -> Column:
    return F.try_divide(text_edits(reference, read).cast("double"), F.length(reference).cast("double"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def wer(reference: Column, read: Column) -> Column:
    """Word edits by the words of the reference."""
    r, h = words(reference), words(read)
    return F.try_divide(word_edits(r, h).cast("double"), F.size(r).cast("double"))


def abstains(text: Column, marker: str = "<<NOTEXT>>") -> Column:
    """Whether a reply is the abstain marker but for quotes, closing punctuation, inner spaces and case."""
    bare = F.regexp_replace(F.btrim(strip(text), F.lit("\"'`“”‘’ \t")), "[.!;:]+$", "")
    return F.lower(F.regexp_replace(bare, r"\s+", "")) == marker.lower()


def rounded(x: Column, places: int) -> Column:
    """The binary value to so many decimals, half to even only where it is exactly between."""
    scale = float(10**places)
    big = x * 134217729.0
    high = big - (big - x)
    product = x * scale
    # What the product lost in rounding, exactly.
    lost = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    over = product - below
    up = (over > 0.5) | (over == 0.5) & ((lost > 0) | (lost == 0) & (below % 2 != 0))
    # From 2^52 units on there is nothing between them.
    return F.when(F.abs(x) < 2.0**52 / scale, (below + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)


def percent(x: Column, missing: str = "—") -> Column:
    """Two decimals, half to even; the formatter by itself rounds half up."""
    return F.when(x.isNull(), missing).otherwise(F.format_string("%.2f%%", F.rint(x * 100 * 100) / 100))


def int_text(x: Column, missing: str = "—") -> Column:
    return F.coalesce(x.cast("long").cast("string"), F.lit(missing))


def float_text(x: Column, places: int = 4, missing: str = "—") -> Column:
    """So many decimals of the binary value, half to even where it is exactly between."""
    return F.when(x.isNull(), missing).otherwise(F.format_string(f"%.{places}f", F.bround(x.cast("decimal(38,18)"), places).cast("double")))


def cost_text(x: Column, missing: str = "—") -> Column:
    return F.when(x.isNull(), missing).otherwise(F.concat(F.lit("$"), float_text(x, 6)))
