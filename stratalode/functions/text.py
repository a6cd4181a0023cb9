"""Scalar functions on strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NESTED_ARCHIVE = r"^/(BOOT-INF/lib|WEB-INF/lib)/.*\.jar$|^/[^/]+\.jar$"
PROJECT_NAME = r"^[\p{L}\p{Nd}._-]*$"
UNIT_NAME = r"^/?[\p{L}_$][\p{L}\p{Nd}_$-]*([./][\p{L}_$][\p{L}\p{Nd}_$-]*)*$"
#: Characters that a search query must escape.
ESCAPED = r'([\\+\-&|!(){}\[\]^"~*?:/])'


def is_nested_archive(path: Column) -> Column:
    return path.rlike(NESTED_ARCHIVE)


def source_kind(path: Column) -> Column:
    """Kind of source by file name, the first rule that fits; null if there is no extractor."""
    name = F.lower(path)
    return (
        F.when(name.endswith(".class"), "CLASS_FILE")
        .when(name.endswith(".yml") | name.endswith(".yaml"), "YAML")
        .when(name.endswith(".properties"), "PROPERTIES")
    )


def valid_project(name: Column) -> Column:
    return F.coalesce(name.rlike(PROJECT_NAME), F.lit(True))


def valid_unit(name: Column) -> Column:
    return name.rlike(UNIT_NAME)


def not_blank(col: Column) -> Column:
    return col.isNotNull() & (F.trim(col) != "")


def java_class_name(internal: Column) -> Column:
    """Dots for slashes and for the dollar of nested classes."""
    return F.regexp_replace(internal, "[/$]", ".")


def concat_pieces(recipe: Column) -> Column:
    """Literals of a string-concatenation recipe, as a set; empty pieces count."""
    return F.array_distinct(F.split(recipe, "\u0001", -1))


#: Characters that have a letter of their own in a Java literal. Fixed values.
NAMED = (("\b", "b"), ("\t", "t"), ("\n", "n"), ("\f", "f"), ("\r", "r"), ('"', '"'), ("'", "'"), ("\\", "\\"))


def log_escaped(text: Column) -> Column:
    """The text as the inside of a Java literal, for logs: no control character is left to forge a line with.

    Other control characters are octal, in three digits where a digit follows;
    what isn't ASCII is four hex digits for each of its UTF-16 units.
    """
    units = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(chars: Column, c: Column, i: Column) -> Column:
        code, following = F.ascii(c), F.try_element_at(chars, i + 2)
        octal = F.conv(code, 10, 8)
        octal = F.when(F.coalesce(following.rlike("^[0-7]"), F.lit(False)), F.lpad(octal, 3, "0")).otherwise(octal)
        pair = F.concat(units(F.lit(0xD800) + F.floor((code - 0x10000) / 1024)), units(F.lit(0xDC00) + (code - 0x10000) % 1024))
        told = F.when(code > 0xFFFF, pair).when(code > 126, F.when(code == 127, F.lit("\\177")).otherwise(units(code))).when(code < 32, F.concat(F.lit("\\"), octal)).otherwise(c)
        for char, letter in NAMED:
            told = F.when(c == char, F.lit("\\" + letter)).otherwise(told)
        return told

    chars = F.split(text, "")
    escaped = F.array_join(F.transform(chars, lambda c, i: one(chars, c, i)), "")
    return F.when(text.rlike(r"""[^ !#-&(-\[\]-~]"""), escaped).otherwise(text)


def escape_query(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def build_query(term: Column, distance: int) -> Column:
    """Search query: tokens escaped, each with its edit distance if that is above 0."""
    if distance not in (0, 1, 2):
        raise ValueError("edit distance must be 0, 1 or 2")
    suffix = f"~{distance}" if distance else ""

    def token(t):
        return F.when((t != "") & F.lit(bool(suffix)), F.concat(escape_query(t), F.lit(suffix))).otherwise(escape_query(t))

    return F.array_join(F.transform(F.split(F.trim(term), r"\s+"), token), " ")


def sanitise_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit("\\0"))


def humanise(name: Column) -> Column:
    return F.initcap(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))


def category(name: Column) -> Column:
    """A semantic category in its normal form; blank ones are an error to the caller (null here)."""
    plain = F.lower(F.trim(name))
    return F.when(plain != "", plain)


def usage_pair(value: Column, structural: Column) -> Column:
    return F.concat_ws("|", value, structural)


def semantic_pair(value: Column, display: Column, confidence: Column) -> Column:
    return F.concat_ws("|", value, display, F.format_string("%.2f", confidence))


def pair_value(pair: Column) -> Column:
    """What stands before the last bar; null if the pair has none or begins with it."""
    last = F.substring_index(pair, "|", -1)
    head = F.length(pair) - F.length(last) - 1
    return F.when(head > 0, F.substring(pair, F.lit(1), head))


def pair_usage(pair: Column) -> Column:
    return F.when(pair_value(pair).isNotNull(), F.substring_index(pair, "|", -1))


def key_parts(key: Column) -> Column:
    """project:path:version in three; the path may not hold a colon."""
    return F.split(key, ":", 3)


def short_name(unit: Column) -> Column:
    return F.substring_index(unit, "/", -1)


def package_of(unit: Column) -> Column:
    return F.when(unit.contains("/"), F.substring(unit, F.lit(1), F.length(unit) - F.length(short_name(unit)) - 1)).otherwise("")


def highlight(text: Column, term: str, before: str = "[", after: str = "]") -> Column:
    """All places of a term, whatever its case, between marks."""
    quoted = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in term)
    return F.regexp_replace(text, f"(?i)({quoted})", f"{before}$1{after}")


def backoff_seconds(attempts: Column) -> Column:
    """Wait before the next attempt: 2 ** (attempts + 1) seconds, an hour at most."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts, F.lit(20)) + 1), F.lit(3600.0)).cast("long")


def value_type(kind: Column) -> Column:
    """Type tag of a value's class name: the part after the last dot, ``Null`` for no value."""
    return F.coalesce(F.substring_index(kind, ".", -1), F.lit("Null"))
