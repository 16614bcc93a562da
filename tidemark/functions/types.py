"""Column values of change records: text to typed columns, by type code.

Records carry values as text, decoded by the log reader; binary layouts are outside this library.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The type codes that are supported, and the Spark type of each.
TYPE_CODES = {
    1: "string",  # character
    2: "number",  # exact number: decimal if it fits 38 digits, else its text
    12: "timestamp_ntz",  # date with time
    23: "binary",  # raw, in hex
    58: "string",  # XML as text
    96: "string",  # fixed-length character
    100: "float",
    101: "double",
    112: "string",  # character large object
    113: "binary",  # binary large object, in hex
    180: "timestamp_ntz",
    181: "zoned",  # timestamp with time zone: the instant and the zone as written
    182: "year_month",
    183: "day_second",
    208: "string",  # row address
    231: "timestamp",  # in local time zone
    252: "boolean",
}
UNSUPPORTED = "?"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def supported(code: Column) -> Column:
    return code.isin(*TYPE_CODES)


def shown(code: Column, text: Column) -> Column:
    """The text of a supported column, ``?`` for any other, so that no column vanishes."""
    return F.when(supported(code), text).otherwise(F.lit(UNSUPPORTED))


def number_text(text: Column) -> Column:
    """A number as plain decimal text without an exponent, however many digits it has; null if it is none."""
    mantissa = F.regexp_extract(text, r"^[+-]?([\d.]+)", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_extract(mantissa, r"\.(\d*)", 1)
    digits, point = F.concat(whole, part), F.length(whole) + power
    padded = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), 1 - point), digits)).otherwise(F.rpad(digits, F.greatest(F.length(digits), point), "0"))
    at = F.greatest(point, F.lit(1))
    head, tail = F.substr(padded, F.lit(1), at), F.regexp_replace(F.substr(padded, at + 1), "0+$", "")
    head = F.regexp_replace(head, r"^0+(?=\d)", "")
    plain = F.when(tail == "", head).otherwise(F.concat(head, F.lit("."), tail))
    negative = text.startswith("-") & (plain != "0")
    return F.when(text.rlike(_NUMBER), F.when(negative, F.concat(F.lit("-"), plain)).otherwise(plain))


def _unless(bad: Column, text: Column, why: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(text, F.lit(f" has {why}")))).otherwise(value)


def typed(code: int, text: Column, precision: int | None = None, scale: int | None = None) -> Column:
    """The value of a column of type ``code`` from its text.

    Text that does not fit fails the job: also a number with more decimal places than ``scale``, and a
    time with more than the six that Spark's types keep, as nothing may be lost unsaid.
    """
    kind = TYPE_CODES.get(code)
    if kind is None:
        return F.lit(UNSUPPORTED)
    if kind == "number":
        if not precision or precision > 38:
            return number_text(text)
        places = F.length(F.regexp_extract(number_text(text), r"\.(\d+)$", 1))
        return _unless(places > (scale or 0), text, f"more than {scale or 0} decimal places", text.cast(f"decimal({precision},{scale or 0})"))
    if kind == "binary":
        return F.unhex(text)
    if kind in ("zoned", "timestamp", "timestamp_ntz"):
        text = _unless(text.rlike(r"\.\d{6}\d*[1-9]"), text, "more than six decimal places of a second", text)
    if kind == "zoned":
        zone = F.regexp_extract(text, r"([+-]\d\d:?\d\d|[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*|Z)$", 1)
        return F.struct(F.to_timestamp(text).alias("utc"), zone.alias("zone"))
    if kind == "year_month":
        return text.cast("interval year to month")
    if kind == "day_second":
        return text.cast("interval day to second")
    return text.cast(kind)


def xid_text(undo: Column, slot: Column, sequence: Column) -> Column:
    """A transaction id as three dot-separated hex parts: 4, 3 and 8 digits."""
    return F.concat_ws(".", *[F.lower(F.lpad(F.hex(p.cast("long")), n, "0")) for p, n in ((undo, 4), (slot, 3), (sequence, 8))])


def decoded(data: Column, charset: str) -> Column:
    """Text from bytes. UTF-8 is decoded by Spark; other character sets need
    ``spark.sql.legacy.javaCharsets`` or go through ``decoded_by_python``."""
    return F.decode(data, {"AL32UTF8": "UTF-8", "UTF8": "UTF-8"}.get(charset, charset))


#: Names of database character sets and the codecs for them.
CODECS = {"AL32UTF8": "utf-8", "UTF8": "utf-8", "US7ASCII": "ascii", "ZHS16GBK": "gbk", "ZHS32GB18030": "gb18030", "WE8MSWIN1252": "cp1252", "WE8ISO8859P1": "latin-1", "WE8ISO8859P15": "iso8859-15", "AL16UTF16": "utf-16-be", "JA16SJIS": "cp932", "JA16EUC": "euc_jp", "KO16MSWIN949": "cp949", "KO16KSC5601": "euc_kr", "ZHT16BIG5": "big5", "CL8MSWIN1251": "cp1251", "EE8MSWIN1250": "cp1250", "CL8KOI8R": "koi8_r"}


def decoded_by_python(data: Column, charset: str) -> Column:
    """Text from bytes of a character set that Spark does not decode, in Arrow batches. Bad bytes fail the job."""
    codec = CODECS.get(charset)
    if codec is None:
        raise ValueError(f"unknown character set: {charset}")

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode(codec))

    return decode(data)


def to_json(fields: Column) -> Column:
    """JSON with null fields kept."""
    return F.to_json(fields, {"ignoreNullFields": "false"})


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces, for comparing structures."""
    return F.to_json(F.parse_json(text))


def fingerprint(text: Column) -> Column:
    """The SHA-256 of a JSON text's canonical form."""
    return F.sha2(canonical_json(text), 256)
