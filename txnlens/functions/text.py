"""Text expressions: trimming, null tokens, number parsing, message formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnlens.schema import NULL_TOKENS

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_null_token(text: Column) -> Column:
    return text.isNull() | F.lower(strip(text)).isin(NULL_TOKENS)


def has_space(text: Column) -> Column:
    return text.rlike(r"(?U)\s")


def to_number(text: Column) -> Column:
    """A stripped number, or null; suffixes such as 1d are not numbers here."""
    return parse_number(strip(text))


def parse_number(bare: Column) -> Column:
    """`to_number` of text without surrounding whitespace."""
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def _iso_spelling(text: Column) -> Column:
    """Ordinary date spellings rewritten year first; other texts as they are.

    Numbers before the year are month and day, or day and month where the first is no month.
    """
    rest = r"(?:,?[ T]+(.*))?$"
    numeric = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})" + rest
    year_first = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + rest
    packed = r"^(\d{4})(\d{2})(\d{2})" + rest
    names = "|".join(MONTHS)
    month_first = rf"(?i)^({names})[a-z]*[.]? +(\d{{1,2}}),? +(\d{{4}})" + rest
    day_first = rf"(?i)^(\d{{1,2}})[ -]+({names})[a-z]*[.]?,?[ -]+(\d{{4}})" + rest

    def spelled(pattern, year, month, day):
        def part(k):
            return F.regexp_extract(text, pattern, k)

        def number(k):
            if pattern not in (month_first, day_first) or k != month:
                return part(k)
            found = F.lower(F.substring(part(k), 1, 3))
            return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), found).cast("string")

        return F.concat_ws("-", part(year), number(month), part(day)), part(4)

    def joined(spelling):
        date, time = spelling
        return F.when(time == "", date).otherwise(F.concat_ws(" ", date, time))

    swapped = F.regexp_extract(text, numeric, 1).try_cast("int") > 12
    return (
        F.when(text.rlike(numeric) & swapped, joined(spelled(numeric, 3, 2, 1)))
        .when(text.rlike(numeric), joined(spelled(numeric, 3, 1, 2)))
        .when(text.rlike(year_first), joined(spelled(year_first, 1, 2, 3)))
        .when(text.rlike(packed), joined(spelled(packed, 1, 2, 3)))
        .when(text.rlike(month_first), joined(spelled(month_first, 3, 1, 2)))
        .when(text.rlike(day_first), joined(spelled(day_first, 3, 2, 1)))
        .otherwise(text)
    )


def to_naive_timestamp(text: Column) -> Column:
    """The wall time of a timestamp text; an offset is dropped, not applied."""
    bare = strip(text)
    return F.coalesce(
        F.when(bare.rlike(r"^\d{4}-"), bare.try_cast("timestamp_ntz")), _iso_spelling(bare).try_cast("timestamp_ntz"))


def match_key(header: Column) -> Column:
    """A header folded for comparison: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]", "")


def short_number(value: Column) -> Column:
    """Six significant digits without trailing zeros, exponent form outside 1e-4..1e6."""
    science = F.format_string("%.5e", value)
    exponent = F.substring_index(science, "e", -1).try_cast("int")
    zeros = r"\.?0+$"
    plain = F.regexp_replace(science.try_cast("decimal(38,12)").cast("string"), zeros, "")
    mantissa = F.regexp_replace(F.substring_index(science, "e", 1), zeros, "")
    return (
        F.when(value.isNull(), F.lit(None))
        .when(F.isnan(value), "nan")
        .when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(value == 0, "0")
        .when((exponent >= -4) & (exponent < 6), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), F.substring_index(science, "e", -1)))
    )


def quoted(text: Column) -> Column:
    """Single-quoted text; double quotes when it holds only single ones."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    plain = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    swapped = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(text.contains("'") & ~text.contains('"'), swapped).otherwise(plain)


def ordinal(number: Column) -> Column:
    """1st, 2nd, 3rd, 4th ... with 10th to 20th always in th."""
    tail = (
        F.when((number % 100).between(10, 20), "th")
        .when(number % 10 == 1, "st")
        .when(number % 10 == 2, "nd")
        .when(number % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(number.cast("string"), tail)
