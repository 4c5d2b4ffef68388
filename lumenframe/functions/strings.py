"""String functions over Columns. Positions count from 0; a missing text gives a missing result."""

from __future__ import annotations

import textwrap
import unicodedata
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_META = set(r"\.[]{}()<>*+-=!?^$|")


def quoted(text: str) -> str:
    """The text as a pattern that matches itself."""
    return "".join("\\" + c if c in _META else c for c in text)


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def title(c: Column) -> Column:
    """First letter of each run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def swapcase(c: Column) -> Column:
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_join(F.transform(letters, lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


def length(c: Column) -> Column:
    return F.char_length(c)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def contains(c: Column, pattern: str, regex: bool = True, case: bool = True, na: bool | None = None) -> Column:
    found = c.rlike(("" if case else "(?i)") + (pattern if regex else quoted(pattern))) if regex or not case else c.contains(pattern)
    return found if na is None else F.coalesce(found, F.lit(na))


def startswith(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


def endswith(c: Column, suffix: str) -> Column:
    return c.endswith(suffix)


def match(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})")


def fullmatch(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def find(c: Column, sub: str) -> Column:
    return F.instr(c, sub) - 1


def rfind(c: Column, sub: str) -> Column:
    at = F.instr(F.reverse(c), sub[::-1])
    return F.when(at > 0, F.char_length(c) - at - len(sub) + 1).otherwise(F.when(c.isNotNull(), F.lit(-1)))


def index(c: Column, sub: str) -> Column:
    """As find, but a text without it is an error."""
    return F.when(c.isNull() | c.contains(sub), find(c, sub)).otherwise(F.raise_error(F.lit("substring not found")).cast("int"))


def rindex(c: Column, sub: str) -> Column:
    return F.when(c.isNull() | c.contains(sub), rfind(c, sub)).otherwise(F.raise_error(F.lit("substring not found")).cast("int"))


def findall(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)


def get(c: Column, i: int) -> Column:
    """The character at a place; missing beyond the ends. For lists see nested.get."""
    n = F.char_length(c)
    if i >= 0:
        return F.when(n > i, F.substring(c, i + 1, 1))
    return F.when(n >= -i, F.substr(c, n + 1 + i, F.lit(1)))


def slice_(c: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    n = F.char_length(c)

    def place(i: int) -> Column:
        return F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))

    if step in (None, 1):
        low, high = place(start or 0), n if stop is None else place(stop)
        return F.when(high > low, F.substr(c, low + 1, high - low)).otherwise(F.when(c.isNotNull(), F.lit("")))
    if step == -1 and start is None and stop is None:
        return F.reverse(c)
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    if step > 0:
        low, high = place(start or 0), n if stop is None else place(stop)
        part = F.slice(chars, low + 1, F.greatest(high - low, F.lit(0)))
    else:
        high, low = (n - 1) if start is None else F.least(place(start), n - 1), F.lit(-1) if stop is None else place(stop)
        part = F.reverse(F.slice(chars, low + 2, F.greatest(high - low, F.lit(0))))
    return F.array_join(F.filter(part, lambda _, i: i % abs(step) == 0), "")


def slice_replace(c: Column, start: int = 0, stop: int | None = None, by: str = "") -> Column:
    head = slice_(c, 0, start)
    return F.concat(head, F.lit(by), F.lit("") if stop is None else slice_(c, stop))


def strip(c: Column, chars: str | None = None) -> Column:
    return F.btrim(c, F.lit(chars if chars is not None else " \t\n\r\x0b\x0c"))


def lstrip(c: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(c, f"^[{quoted(chars)}]+" if chars else r"^[\s\x0b]+", "")


def rstrip(c: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(c, f"[{quoted(chars)}]+$" if chars else r"[\s\x0b]+$", "")


def removeprefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def removesuffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.substring(c, 1, 1 << 30) if not suffix else F.substr(c, F.lit(1), F.char_length(c) - len(suffix))).otherwise(c)


def ljust(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.char_length(c) >= width, c).otherwise(F.rpad(c, width, fill))


def rjust(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.char_length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def center(c: Column, width: int, fill: str = " ") -> Column:
    """An odd space goes to the left where the width is odd, as texts are centred in Python."""
    n = F.char_length(c)
    gap = F.lit(width) - n
    left = F.floor(gap / 2) + F.when((gap % 2 == 1) & (F.lit(width) % 2 == 1), 1).otherwise(0)
    return F.when(gap <= 0, c).otherwise(F.concat(F.repeat(F.lit(fill), left.cast("int")), c, F.repeat(F.lit(fill), (gap - left).cast("int"))))


def pad(c: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    return {"left": rjust, "right": ljust, "both": center}[side](c, width, fill)


def zfill(c: Column, width: int) -> Column:
    signed = c.rlike(r"^[+-]")
    body = F.when(signed, F.substr(c, F.lit(2))).otherwise(c)
    padded = F.concat(F.when(signed, F.substring(c, 1, 1)).otherwise(F.lit("")), F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.char_length(c))), body)
    return F.when(F.char_length(c) >= width, c).otherwise(padded)


def repeat(c: Column, n: int) -> Column:
    return F.repeat(c, n)


def replace(c: Column, pattern: str, by: str, regex: bool = False, n: int = -1, case: bool = True) -> Column:
    if regex or not case:
        pattern = ("" if case else "(?i)") + (pattern if regex else quoted(pattern))
        return F.regexp_replace(c, pattern, by) if n < 0 else _first(c, pattern, by, n)
    return F.replace(c, F.lit(pattern), F.lit(by)) if n < 0 else _first(c, quoted(pattern), by, n)


def _first(c: Column, pattern: str, by: str, n: int) -> Column:
    parts = F.split(c, pattern, n + 1)
    return F.array_join(parts, by)


def translate(c: Column, table: Mapping[str, str | None]) -> Column:
    kept = {k: v for k, v in table.items() if v}
    gone = [k for k, v in table.items() if not v]
    return F.translate(c, "".join([*kept, *gone]), "".join(kept.values()))


def split(c: Column, pat: str | None = None, n: int = -1, regex: bool = False) -> Column:
    """A list of the parts; without a separator runs of white space part and the ends are stripped."""
    if pat is None:
        plain = strip(c)
        return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"\s+", n + 1 if n > 0 else -1))
    return F.split(c, pat if regex else quoted(pat), n + 1 if n > 0 else -1)


def rsplit(c: Column, pat: str | None = None, n: int = -1) -> Column:
    parts = split(c, pat)
    if n <= 0:
        return parts
    glue = " " if pat is None else pat
    k = F.greatest(F.size(parts) - n, F.lit(1))
    return F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), k), glue)), F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0))))


def partition(c: Column, sep: str = " ") -> Column:
    """A list of three: before, separator, after the first separator."""
    at = F.instr(c, sep)
    found = F.array(F.substr(c, F.lit(1), at - 1), F.lit(sep), F.substr(c, at + len(sep)))
    return F.when(at > 0, found).otherwise(F.when(c.isNotNull(), F.array(c, F.lit(""), F.lit(""))))


def rpartition(c: Column, sep: str = " ") -> Column:
    at = rfind(c, sep)
    found = F.array(F.substr(c, F.lit(1), at), F.lit(sep), F.substr(c, at + len(sep) + 1))
    return F.when(at >= 0, found).otherwise(F.when(c.isNotNull(), F.array(F.lit(""), F.lit(""), c)))


def join(c: Column, sep: str) -> Column:
    """The texts of a list with `sep` between; of a text, its characters."""
    return F.array_join(c, sep)


def cat(cols: list[Column], sep: str = "", na_rep: str | None = None) -> Column:
    cols = cols if na_rep is None else [F.coalesce(c, F.lit(na_rep)) for c in cols]
    out = cols[0]
    for c in cols[1:]:
        out = F.concat(out, F.lit(sep), c)
    return out


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, missing where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def extractall(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def get_dummies(c: Column, sep: str, values: list[str]) -> list[Column]:
    parts = split(c, sep)
    return [F.array_contains(parts, v).cast("bigint").alias(v) for v in values]


def isalnum(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}]+$")


def isalpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def isdecimal(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def isdigit(c: Column) -> Column:
    return c.rlike("^[\\p{Nd}²³¹⁰⁴-⁹₀-₉]+$")


def isnumeric(c: Column) -> Column:
    return c.rlike(r"^\p{N}+$")


def isspace(c: Column) -> Column:
    return c.rlike(r"^[\s\x0b\x1c-\x1f\u0085\p{Z}]+$")


def islower(c: Column) -> Column:
    return (c == F.lower(c)) & c.rlike(r"\p{L}")


def isupper(c: Column) -> Column:
    return (c == F.upper(c)) & c.rlike(r"\p{L}")


def istitle(c: Column) -> Column:
    return (c == title(c)) & c.rlike(r"\p{L}")


def encode(c: Column, encoding: str = "utf-8") -> Column:
    return F.encode(c, encoding)


def decode(c: Column, encoding: str = "utf-8") -> Column:
    return F.decode(c, encoding)


#: Bytes of whole texts in an Arrow batch, at most; one text that is longer is a batch of its own.
BATCH_BYTES = 16 << 20


def _texts(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Python function of whole texts. Batches are bounded by bytes, for this session from now on, as plans are lazy, and a
    text at a time is a Python object."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.arrow_udf("string")  # type: ignore[call-overload]
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((f(x.as_py()) if x.is_valid else None for x in texts), pa.string())

    return run


def normalize(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form. No built-in has it, so texts go through Arrow, but for those whose code points show that they have
    it: all below U+0300 for NFC, ASCII for the others."""
    other = c.rlike("[^\\x00-\\u02ff]" if form == "NFC" else "[^\\x00-\\x7f]")
    return F.when(other, _texts(lambda s: unicodedata.normalize(form, s))(F.when(other, c))).otherwise(c)


def wrap(c: Column, width: int) -> Column:
    """Lines of at most `width` characters; texts go through Arrow."""
    return _texts(lambda s: "\n".join(textwrap.wrap(s, width)))(c)
