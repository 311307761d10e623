"""Built-in scalar functions as column expressions.

Where Spark and DuckDB disagree, DuckDB's answer is built: division by zero, half-even and half-away rounding in casts,
text of large and small doubles, indices from 0, literal separators, membership over nulls.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from . import host, places

#: Tells the type of a column.
TypeOf = Callable[[Column], T.DataType]


def divide(a: Column, b: Column) -> Column:
    top, low = a.cast("double"), b.cast("double")
    infinite = F.when(top == 0, F.lit(float("nan"))).when(top > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(top.isNull() | low.isNull(), F.lit(None).cast("double")).when(low == 0, infinite).otherwise(top / low)


def to_int(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.rint(x).cast("long")
    if isinstance(kind, T.DecimalType):
        return F.round(x).cast("long")
    if isinstance(kind, T.StringType):
        return F.coalesce(x.try_cast("long"), F.round(x.cast("decimal(38,10)")).cast("long"))
    return x.cast("long")


def shortest(x: Column) -> Column:
    """A double as Java's text in the fewest digits that give it back; Java before 19 may write more (17 for 1.1807E21)."""
    plain, out = x.cast("string"), F.lit(None).cast("string")
    for digits in (17, 16, 15, 1):
        rounded = F.format_string(f"%.{digits - 1}e", x)
        out = F.when(rounded.try_cast("double") == x, rounded).otherwise(out)
    power = F.regexp_replace(F.regexp_replace(out, r"(\.\d+?)0+e", "$1e"), r"e\+?(-?)0?", "E$1")
    bare = F.regexp_replace(F.regexp_replace(out.try_cast("decimal(38,24)").cast("string"), "0+$", ""), r"\.$", ".0")
    size = F.length(F.regexp_extract(plain, r"^-?([\d.]+)", 1))
    may = (size > 16) | (F.abs(x) < 1e-300)  # up to 15 digits are the fewest already, but for the least of all doubles
    return F.when(may & out.isNotNull() & ~F.isnan(x) & (x != 0), F.when(plain.contains("E"), power).otherwise(bare)).otherwise(plain)


def to_text(x: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return x.cast("string")
    size, plain = F.abs(x), shortest(x) if isinstance(kind, T.DoubleType) else x.cast("string")
    wide = F.regexp_replace(F.regexp_replace(plain.cast("decimal(30,10)").cast("string"), "0+$", ""), r"\.$", ".0")
    small = F.regexp_replace(plain.cast("decimal(38,30)").cast("string"), "0+$", "")
    power = F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E(-?)", "e$1")
    power = F.regexp_replace(F.regexp_replace(power, r"e-(\d)$", "e-0$1"), r"e(\d+)$", "e+$1")
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(size.isNull() | (size == 0), plain).when((size >= 1e7) & (size < 1e16), wide).when((size < 1e-3) & (size >= 1e-4), small).when((size >= 1e16) | (size < 1e-4), power).otherwise(plain)


def element(a: Column, i: Column) -> Column:
    return F.when(i == -1, F.lit(None)).otherwise(F.try_element_at(a, (i + 1).cast("int")))


def sequence(n: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).when(n.isNotNull(), none)


def within(x: Column, items: Column) -> Column:
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.array_contains(items, x), F.lit(False)))


def split(text: Column, separator: Column) -> Column:
    return F.split(text, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1)


def substring(text: Column, start: Column, size: Column | None = None) -> Column:
    """1-based; a start of zero is the place before the first character."""
    if size is None:
        return F.substr(text, F.when(start == 0, 1).otherwise(start).cast("int"))
    low = F.when(start == 0, F.greatest(size - 1, F.lit(0))).otherwise(size)
    return F.substr(text, F.when(start == 0, 1).otherwise(start).cast("int"), low.cast("int"))


_KINDS = {
    "int64": "long", "bigint": "long", "int": "int", "integer": "int", "int32": "int", "float64": "double", "double": "double", "float": "float",
    "string": "string", "varchar": "string", "text": "string", "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "bytes": "binary",
}


def kind_named(name: str) -> str:
    """A Spark type for a type's name; only known names and decimals pass."""
    low = name.strip().lower()
    if low in _KINDS:
        return _KINDS[low]
    if re.fullmatch(r"(decimal|numeric)\(\d+\s*,\s*\d+\)", low):
        return low.replace("numeric", "decimal")
    raise PlanError(f"no type is called {name!r}")


#: The parts of a time that times are moved and compared by.
UNITS = ("MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def unit_named(part: object) -> str:
    if str(part).upper() not in UNITS:
        raise PlanError(f"{part!r} is no part of a time; there are {', '.join(UNITS)}")
    return str(part).upper()


def moved(t: Column, n: Column, part: object, kind: str) -> Column:
    """``n`` whole units later."""
    return F.timestamp_add(unit_named(part), n.cast("int"), t.cast(kind))


def crossed(a: Column, b: Column, part: object) -> Column:
    """How many starts of a unit lie between two times, negative where ``a`` is the earlier."""
    a, b = (F.date_trunc(unit_named(part), x.cast("timestamp_ntz")) for x in (a, b))
    return F.timestamp_diff(unit_named(part), b, a)


def seconds(s: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))


def time_text(t: Column) -> Column:
    """A moment's time of day, which is a text here: Spark's type for it is switched off by default."""
    return F.regexp_replace(F.date_format(t, "HH:mm:ss.SSSSSS"), r"\.0+$|(?<=\.\d{1,5})0+$", "")


def on_a_day(t: Column) -> Column:
    """A time of day as a moment that ``date_format`` takes."""
    return F.concat(F.lit("1970-01-01 "), t.cast("string")).cast("timestamp_ntz")


#: Second-level labels under which country registries hand out names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")


def host_of(url: Column) -> Column:
    return F.parse_url(url, F.lit("HOST"))


def suffix_of(url: Column, more: int) -> Column:
    """The last label of a host, or the last two where the last has two letters and the one before is a usual second level;
    ``more`` labels before it.  Null where the host has fewer labels."""
    parts = F.split(F.lower(host_of(url)), r"\.")
    two = (F.length(F.element_at(parts, -1)) == 2) & F.coalesce(F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL), F.lit(False))
    n = F.when(two, 2).otherwise(1) + more
    return F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "."))


def dotted(n: Column) -> Column:
    """An address of four bytes from its number."""
    return F.when(n.isNotNull(), F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


def undotted(s: Column) -> Column:
    return F.aggregate(F.split(s, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))


def dissembled(record: Column) -> Column:
    """A record's fields as pairs ``{arg, value}`` of texts."""
    return F.transform(F.map_entries(F.from_json(F.to_json(record), "map<string,string>")), lambda e: F.struct(e["key"].alias("arg"), e["value"].alias("value")))


def assembled(pairs: Column) -> Column:
    """The JSON text of a record from pairs ``{arg, value}``."""
    return F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["arg"], p["value"]))))


OPERATORS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": lambda a, b: a % b,
    "^": lambda a, b: F.pow(a.cast("double"), b.cast("double")), "++": F.concat, "++?": F.concat,
    "==": lambda a, b: a == b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "&&": lambda a, b: a & b, "||": lambda a, b: a | b, "!": lambda a: ~a, "neg": lambda a: -a,
    "is": lambda a, b: a.eqNullSafe(b), "is not": lambda a, b: ~a.eqNullSafe(b),
    "->": lambda a, b: F.struct(a.alias("arg"), b.alias("value")),
}


def _interval(days: Column) -> Column:
    return F.make_dt_interval(days.cast("int"))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    # text
    "Substr": substring, "Length": F.length, "CharLength": F.length, "Upper": F.upper, "Lower": F.lower, "Trim": F.trim, "Ltrim": F.ltrim, "Rtrim": F.rtrim,
    "Split": split, "Join": lambda a, s: F.call_function("array_join", a, s), "ArrayToString": lambda a, s: F.call_function("array_join", a, s),
    "Replace": lambda s, a, b: F.replace(s, a, b), "Chr": lambda n: F.call_function("chr", n), "Char": lambda n: F.call_function("chr", n), "Ord": F.ascii,
    "Like": lambda s, p: F.call_function("like", s, p), "ILike": lambda s, p: F.call_function("ilike", s, p),
    "RMatch": F.regexp_like, "RExtract": lambda s, p: F.regexp_substr(s, p), "RegexpContains": F.regexp_like, "RegexpExtract": lambda s, p: F.regexp_substr(s, p),
    "RegexpExtractAll": lambda s, p: F.call_function("regexp_extract_all", s, p, F.lit(0)), "RegexpMatch": lambda s, p: F.regexp_like(s, F.concat(F.lit("^(?:"), p, F.lit(")$"))), "RegexpReplace": lambda s, p, r: F.regexp_replace(s, p, r),
    "StartsWith": F.startswith, "EndsWith": F.endswith, "Strpos": lambda s, x: F.call_function("instr", s, x),
    "Lpad": lambda s, n, p=None: F.call_function("lpad", s, n.cast("int"), *([p] if p is not None else [])), "Rpad": lambda s, n, p=None: F.call_function("rpad", s, n.cast("int"), *([p] if p is not None else [])),
    "Repeat": lambda s, n: F.call_function("repeat", s, n.cast("int")), "Reverse": F.reverse, "ByteLength": F.octet_length, "JoinOrEmpty": lambda a, s: F.coalesce(F.call_function("array_join", a, s), F.lit("")),
    "ToCodePoints": lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii), "CodePointsToString": lambda a: F.array_join(F.transform(a, lambda c: F.call_function("chr", c)), ""),
    "QuoteIt": lambda s: F.concat(F.lit('"'), s, F.lit('"')),
    # arrays
    "Size": lambda a: F.size(a).cast("long"), "ArrayLength": lambda a: F.size(a).cast("long"), "Element": element, "ArrayConcat": F.concat, "Concat": F.concat, "Range": sequence, "RangeOf": lambda a: sequence(F.size(a)),
    "Sort": F.array_sort, "Unique": lambda a: F.array_sort(F.array_distinct(a)), "ArrayReverse": F.reverse,
    "GenerateArray": lambda a, b, s=None: F.when((b >= a) if s is None else ((b - a) * F.signum(s) >= 0), F.sequence(a.cast("long"), b.cast("long"), (F.lit(1) if s is None else s).cast("long"))).otherwise(F.array().cast("array<bigint>")),
    "GenerateDateArray": lambda a, b: F.sequence(a.cast("date"), b.cast("date")), "GenerateTimestampArray": lambda a, b, i: F.sequence(a, b, i), "RangeBucket": lambda x, a: F.size(F.filter(a, lambda e: e <= x)).cast("long"),
    "ValueOfUnnested": lambda x: x, "MagicalEntangle": lambda a, b: a, "Container": lambda x: x,
    # numbers
    "Abs": F.abs, "Exp": F.exp, "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Sqrt": F.sqrt, "Ln": F.ln, "Log": F.ln, "Log10": F.log10, "Pow": lambda a, b: F.pow(a.cast("double"), b.cast("double")),
    "Floor": lambda x: F.floor(x).cast("double"), "Ceil": lambda x: F.ceil(x).cast("double"), "Ceiling": lambda x: F.ceil(x).cast("double"), "Round": lambda x, n=None: F.round(x) if n is None else F.call_function("round", x, n),
    "Trunc": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double"), "Least": F.least, "Greatest": F.greatest, "Rand": F.rand, "Mod": lambda a, b: a % b, "Sign": F.signum,
    "Div": lambda a, b: F.call_function("div", a, b), "IeeeDivide": divide, "SafeDivide": F.try_divide, "SafeAdd": F.try_add, "SafeSubtract": F.try_subtract, "SafeMultiply": F.try_multiply, "SafeNegate": lambda x: F.try_subtract(F.lit(0), x),
    "IsInf": lambda x: x.isin(float("inf"), float("-inf")), "IsNan": F.isnan, "BitCount": F.bit_count, "BitCastToInt64": lambda x: x.cast("long"),
    "BitCastToUint32": lambda x: x.bitwiseAND(F.lit(4294967295)), "BitCastToInt32": lambda x: (((x.cast("long") + 2147483648).bitwiseAND(F.lit(4294967295))) - 2147483648).cast("int"),
    "BitCastToUint64": lambda x: F.when(x < 0, x.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)")),
    # types and nulls
    "ToFloat64": lambda x: x.cast("double"), "ToUInt64": lambda x: x.cast("long"), "Num": lambda x: x, "Str": lambda x: x, "String": lambda x: x.cast("string"),
    "Coalesce": F.coalesce, "IsNull": F.isnull, "IfNull": F.ifnull, "Ifnull": F.ifnull, "NullIf": F.nullif, "Nullif": F.nullif, "ProtoDefaultIfNull": F.coalesce,
    "If": lambda c, a, b: F.when(c, a).otherwise(b),
    # dates and times
    "DateAddDay": lambda d, n: F.date_add(d.cast("date"), n.cast("int")), "DateSub": lambda d, n: F.date_sub(d.cast("date"), n.cast("int")), "DateAdd": lambda d, n: F.date_add(d.cast("date"), n.cast("int")),
    "DateDiffDay": lambda a, b: F.datediff(a.cast("date"), b.cast("date")).cast("long"), "DateDiff": lambda a, b: F.datediff(a.cast("date"), b.cast("date")).cast("long"),
    "TimestampAddDays": lambda t, n: t.cast("timestamp_ntz") + _interval(n), "CurrentTimestamp": F.current_timestamp, "CurrentDate": F.current_date, "CurrentDatetime": F.localtimestamp,
    "TimeAdd": lambda t, s: t + seconds(s), "TimeSub": lambda t, s: t - seconds(s), "ParseTime": lambda f, s: time_text(F.call_function("to_timestamp_ntz", s, f)), "FormatTime": lambda f, t: F.call_function("date_format", on_a_day(t), f), "CurrentTime": lambda: time_text(F.localtimestamp()), "Epoch": lambda t: F.unix_micros(t.cast("timestamp")) / 1000000.0,
    "TimeDiffSeconds": lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1000000.0, "ToTime": lambda x: x.cast("timestamp"),
    "Date": lambda x: x.cast("date"), "Datetime": lambda x: x.cast("timestamp_ntz"), "Timestamp": lambda x: x.cast("timestamp"), "DateTrunc": lambda d, p: F.call_function("trunc", d, p),
    "TimestampTrunc": lambda t, p: F.call_function("date_trunc", p, t), "DatetimeTrunc": lambda t, p: F.call_function("date_trunc", p, t), "ParseDate": lambda f, s: F.call_function("to_date", s, f), "ParseTimestamp": lambda f, s: F.call_function("to_timestamp", s, f),
    "ParseDatetime": lambda f, s: F.call_function("to_timestamp_ntz", s, f), "FormatDate": lambda f, d: F.call_function("date_format", d, f), "FormatDatetime": lambda f, d: F.call_function("date_format", d, f), "FormatTimestamp": lambda f, d: F.call_function("date_format", d, f),
    "TimestampFromUnixMicros": F.timestamp_micros, "TimestampFromUnixMillis": F.timestamp_millis, "TimestampFromUnixSeconds": F.timestamp_seconds,
    # records and JSON
    "JsonExtract": lambda j, p: F.call_function("get_json_object", j, p), "JsonExtractScalar": lambda j, p: F.call_function("get_json_object", j, p), "JsonQuery": lambda j, p: F.call_function("get_json_object", j, p),
    "JsonValue": lambda j, p: F.call_function("get_json_object", j, p), "RecordAsJson": F.to_json, "ToJsonString": lambda x: F.to_json(x), "AssembleRecord": assembled, "DisassembleRecord": dissembled,
    # bytes and hashes
    "Fingerprint": F.xxhash64, "FarmFingerprint": F.xxhash64, "NaturalHash": F.xxhash64, "Md5": lambda x: F.unhex(F.md5(x.cast("binary"))), "Sha1": lambda x: F.unhex(F.sha1(x.cast("binary"))),
    "Sha256": lambda x: F.unhex(F.sha2(x.cast("binary"), 256)), "Sha512": lambda x: F.unhex(F.sha2(x.cast("binary"), 512)), "ToHex": lambda x: F.lower(F.hex(x)), "FromHex": F.unhex, "ToBase64": F.base64, "FromBase64": F.unbase64,
    # authenticated encryption with a key of 16, 24 or 32 bytes: GCM, the nonce in front
    "AeadEncrypt": lambda key, text, more: F.call_function("aes_encrypt", text.cast("binary"), key.cast("binary"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), more.cast("binary")),
    "AeadDecryptBytes": lambda key, text, more: F.call_function("aes_decrypt", text, key.cast("binary"), F.lit("GCM"), F.lit("DEFAULT"), more.cast("binary")),
    "AeadDecryptString": lambda key, text, more: F.call_function("aes_decrypt", text, key.cast("binary"), F.lit("GCM"), F.lit("DEFAULT"), more.cast("binary")).cast("string"),
    "SafeConvertBytesToString": lambda x: F.try_validate_utf8(x.cast("string")), "HllCountExtract": F.hll_sketch_estimate, "NetHost": lambda u: host_of(u), "NetPublicSuffix": lambda u: suffix_of(u, 0), "NetRegDomain": lambda u: suffix_of(u, 1),
    "NetIpv4FromInt64": dotted, "NetFormatIp": dotted, "NetIpv4ToInt64": undotted, "NetParseIp": undotted,
    # others
    "UniqueNumber": F.monotonically_increasing_id, "UnsafeToUseUniqueNumber": F.monotonically_increasing_id, "ProverChoice": F.monotonically_increasing_id, "GenerateUuid": F.uuid, "SessionUser": F.session_user, "Error": F.raise_error,
}

#: Functions that want to know an argument's type, or its literal value.
TYPED: dict[str, Callable[[TypeOf, list[Column]], Column]] = {
    "ToInt64": lambda kind, v: to_int(v[0], kind(v[0])),
    "ToString": lambda kind, v: to_text(v[0], kind(v[0])),
    "in": lambda kind, v: F.lit(None).cast("boolean") if isinstance(kind(v[0]), T.NullType) else within(*v),
}
#: Functions with an argument that must be a literal: its place, and a function of its value and the other arguments.
LITERAL: dict[str, tuple[int, Callable[..., Column]]] = {
    "Cast": (1, lambda name, x: x.cast(kind_named(name))),
    "TryCast": (1, lambda name, x: x.try_cast(kind_named(name))),
    "Format": (0, lambda fmt, *v: F.format_string(fmt, *v)),
    "DatetimeAdd": (2, lambda part, t, n: moved(t, n, part, "timestamp_ntz")),
    "DatetimeSub": (2, lambda part, t, n: moved(t, -n, part, "timestamp_ntz")),
    "DatetimeDiff": (2, lambda part, a, b: crossed(a, b, part)),
    "TimestampAdd": (2, lambda part, t, n: moved(t, n, part, "timestamp")),
    "TimestampSub": (2, lambda part, t, n: moved(t, -n, part, "timestamp")),
    "TimestampDiff": (2, lambda part, a, b: F.timestamp_diff(unit_named(part), b.cast("timestamp"), a.cast("timestamp"))),
}


def spark_name(name: str) -> str:
    """``FirstValue`` to ``first_value``."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def known_name(name: str, spark_functions: set[str]) -> bool:
    return name in OPERATORS or name in FUNCTIONS or name in TYPED or name in LITERAL or name in host.NAMES or name in places.FUNCTIONS or name[:1].isupper() and bool({spark_name(name), name.lower()} & spark_functions)


def call(name: str, values: list[Column], kind: TypeOf, spark_functions: set[str]) -> Column:
    """The column of a built-in by its language name; beyond the tables above, Spark's own function of that name."""
    if name in TYPED:
        return TYPED[name](kind, values)
    if name in host.NAMES:
        return host.call(name, values)
    function = OPERATORS.get(name) or FUNCTIONS.get(name) or places.FUNCTIONS.get(name)
    if function:
        try:
            return function(*values)
        except TypeError as e:
            raise PlanError(f"{name} can't take {len(values)} arguments") from e
    for own in (spark_name(name), name.lower()):
        if name[:1].isupper() and own in spark_functions:
            return F.call_function(own, *values)
    raise PlanError(f"there is no function {name}")
