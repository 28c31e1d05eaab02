"""Version order as a sortable string, in built-in functions.

Numbers compare as numbers; alpha < beta < milestone < rc = cr < snapshot < the release itself < sp < other
words < numbers behind a dash < numbers behind a dot. Zeros and words for a release are dropped where they end a
version or stand before a dash or a word. Every key ends with a mark that sorts like the release.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known qualifiers in their order (fixed values).
QUALIFIERS = ["alpha", "beta", "milestone", "rc", "snapshot"]
_END = "5"


def version_key(version: Column) -> Column:
    """A string that sorts as the version does; null stays null."""
    v = F.lower(F.trim(version))
    for short, word in (("a", "alpha"), ("b", "beta"), ("m", "milestone")):
        v = F.regexp_replace(v, f"(?<![a-z]){short}(?=[0-9])", word)
    v = F.regexp_replace(v, "(?<![a-z])cr(?![a-z])", "rc")
    v = F.regexp_replace(v, "(?<=[0-9])(?=[a-z])|(?<=[a-z])(?=[0-9])", "-")
    v = F.regexp_replace(v, "[.]([a-z])", "-$1")
    v = F.regexp_replace(v, "(?:(?<=^|[.-])(?:0+|ga|final|release)(?:[.-]|$))+(?=[a-z]|$)|(?:[.-](?:0+|ga|final|release))+(?=-|$)", "")
    v = F.regexp_replace(v, "^[.-]+|[.-]+$", "")
    v = F.when(v == "", v).otherwise(F.concat(F.when(v.rlike("^[0-9]"), F.lit(".")).otherwise(F.lit("-")), v))
    tokens = F.regexp_extract_all(v, F.lit("([.-][0-9]+|[.-][^.-]+)"), F.lit(1))

    def encode(token: Column) -> Column:
        word = F.substring(token, 2, 1 << 30)
        digits = F.regexp_replace(word, "^0+(?=.)", "")
        number = F.concat(F.lpad(F.char_length(digits).cast("string"), 4, "0"), digits)
        known = F.array_position(F.array(*[F.lit(q) for q in QUALIFIERS]), word)
        text = F.when(known > 0, (known - 1).cast("string")).when(word == "sp", F.lit("6")).otherwise(F.concat(F.lit("7"), word, F.lit("\u0001")))
        return F.when(word.rlike("^[0-9]+$"), F.concat(F.when(token.startswith("."), F.lit("9")).otherwise(F.lit("8")), number)).otherwise(text)

    return F.concat(F.array_join(F.transform(tokens, encode), ""), F.lit(_END))


def within(version: Column, lower: str | None, upper: str | None) -> Column:
    """Whether a version is in inclusive bounds; unknown versions (null or empty) always are."""
    if lower is None and upper is None:
        return F.lit(True)
    key = version_key(version)
    ok = F.lit(True)
    if lower is not None:
        ok &= key >= version_key(F.lit(lower))
    if upper is not None:
        ok &= key <= version_key(F.lit(upper))
    return F.coalesce(version == "", F.lit(True)) | ok
