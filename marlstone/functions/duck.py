"""DuckDB's scalar functions as Spark SQL functions. Catalyst puts their bodies in place of the calls, so they run in generated code."""

from __future__ import annotations

import re
import weakref

from pyspark.sql import SparkSession

#: name: (parameters, result type, body). Names that Spark has with other semantics begin with duck_.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # Strings
    "duck_split_part": ("s STRING, d STRING, n INT", "STRING", "CASE WHEN n = 0 THEN CASE WHEN s IS NOT NULL AND d IS NOT NULL THEN '' END ELSE split_part(s, d, CASE WHEN n = 0 THEN 1 ELSE n END) END"),
    "string_split": ("s STRING, d STRING", "ARRAY<STRING>", "CASE WHEN s IS NULL THEN NULL WHEN d IS NULL THEN array(s) WHEN d = '' THEN split(s, '') ELSE split(s, concat('\\\\Q', d, '\\\\E'), -1) END"),
    "regexp_replace_first": ("s STRING, p STRING, r STRING", "STRING", "CASE WHEN regexp_instr(s, p) = 0 THEN s ELSE concat(left(s, regexp_instr(s, p) - 1), regexp_replace(substring(s, regexp_instr(s, p)), concat('\\\\A(?:', p, ')'), r)) END"),
    "regexp_full_match": ("s STRING, p STRING", "BOOLEAN", "s RLIKE concat('^(?:', p, ')$')"),
    "strpos": ("s STRING, t STRING", "BIGINT", "CAST(instr(s, t) AS BIGINT)"),
    "duck_split_regex": ("s STRING, p STRING", "ARRAY<STRING>", "split(s, p, -1)"),
    "hex_of_int": ("i BIGINT", "STRING", "hex(i)"),
    "hex_of_natural": ("x DECIMAL(38,0)", "STRING", """CASE WHEN x < 18446744073709551616 THEN conv(CAST(x AS STRING), 10, 16)
        ELSE concat(conv(CAST(CAST((x - x % 18446744073709551616) / 18446744073709551616 AS DECIMAL(20,0)) AS STRING), 10, 16), lpad(conv(CAST(x % 18446744073709551616 AS STRING), 10, 16), 16, '0')) END"""),
    "hex_of_wide": ("x DECIMAL(38,0)", "STRING", "CASE WHEN x >= 0 THEN hex_of_natural(x) ELSE translate(lpad(hex_of_natural(-x - 1), 32, '0'), '0123456789ABCDEF', 'FEDCBA9876543210') END"),
    "duck_unhex": ("s STRING", "BINARY", "CASE WHEN s IS NOT NULL AND unhex(s) IS NULL THEN CAST(raise_error('not hex digits') AS BINARY) ELSE unhex(s) END"),
    # Numbers
    "duck_div": ("a BIGINT, b BIGINT", "BIGINT", "a DIV nullif(b, 0)"),
    "duck_mod": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a = -9223372036854775808L AND b = -1 THEN CAST(raise_error('overflow in %') AS BIGINT) ELSE a % nullif(b, 0) END"),
    "duck_divide": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b <> 0 THEN a / b WHEN b IS NULL OR a IS NULL THEN NULL WHEN a = 0 OR isnan(a) THEN double('NaN') WHEN a > 0 THEN double('Infinity') ELSE double('-Infinity') END"),
    "duck_double_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "a / nullif(b, 0)"),
    "duck_double_mod": ("a DOUBLE, b DOUBLE", "DOUBLE", "a % nullif(b, 0)"),
    "duck_wide_mod": ("a DECIMAL(38,0), b DECIMAL(38,0)", "DECIMAL(38,0)", "CAST(a % nullif(b, 0) AS DECIMAL(38,0))"),
    "duck_wide_div": ("a DECIMAL(38,0), b DECIMAL(38,0)", "DECIMAL(38,0)", "CAST((a - a % nullif(b, 0)) / nullif(b, 0) AS DECIMAL(38,0))"),
    "duck_sign": ("x DOUBLE", "INT", "CAST(signum(x) AS INT)"),
    "shift_left": ("a BIGINT, n BIGINT", "BIGINT", """CASE WHEN a < 0 OR n < 0 OR n > 62 AND a <> 0 OR a > shiftright(9223372036854775807L, CAST(least(n, 63) AS INT)) AND a <> 0
        THEN CAST(raise_error('overflow in shift') AS BIGINT) ELSE shiftleft(a, CAST(n AS INT)) END"""),
    "shift_right": ("a BIGINT, n BIGINT", "BIGINT", "CASE WHEN n < 0 OR n > 63 THEN 0 ELSE shiftright(a, CAST(n AS INT)) END"),
    "half_even_int": ("x DOUBLE", "BIGINT", "CAST(rint(x) AS BIGINT)"),
    "text_to_int": ("s STRING", "DECIMAL(38,0)", r"""CASE
        WHEN trim(s) RLIKE '^[+-]?0[xX][0-9a-fA-F]+$' THEN CASE WHEN trim(s) LIKE '-%' THEN -1 ELSE 1 END * try_cast(conv(regexp_extract(trim(s), '0[xX]([0-9a-fA-F]+)$', 1), 16, 10) AS DECIMAL(38,0))
        WHEN trim(s) RLIKE '^[+-]?[0-9]+(_[0-9]+)*$' THEN try_cast(replace(trim(s), '_', '') AS DECIMAL(38,0))
        ELSE round(try_cast(trim(s) AS DECIMAL(38,6)), 0) END"""),
    "text_to_int_strictly": ("s STRING", "DECIMAL(38,0)", "CASE WHEN s IS NOT NULL AND text_to_int(s) IS NULL THEN CAST(raise_error(concat('could not convert text to a whole number: ', s)) AS DECIMAL(38,0)) ELSE text_to_int(s) END"),
    "text_to_wide": ("s STRING", "DECIMAL(38,0)", r"CASE WHEN text_to_int(s) IS NULL AND trim(s) RLIKE '^[+-]?[0-9]+(_[0-9]+)*$' THEN CAST(raise_error('overflow: a number in text has more than 38 digits') AS DECIMAL(38,0)) ELSE text_to_int(s) END"),
    "text_is_hugeint": ("s STRING", "BOOLEAN", r"text_to_int(s) IS NOT NULL OR trim(s) RLIKE '^[+-]?[0-9]+(_[0-9]+)*$' AND abs(try_cast(replace(trim(s), '_', '') AS DOUBLE)) < 1.7014118346046923e38D"),
    "timestamp_text": ("t TIMESTAMP_NTZ", "STRING", "CAST(t AS STRING)"),
    # Dates and times, in UTC
    "date_diff_months": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS BIGINT)"),
    "date_diff_quarters": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "CAST((year(b) - year(a)) * 4 + quarter(b) - quarter(a) AS BIGINT)"),
    "date_diff_years": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "CAST(year(b) - year(a) AS BIGINT)"),
    "date_diff_decades": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "year(b) DIV 10 - year(a) DIV 10"),
    "date_diff_centurys": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "(year(b) + 99) DIV 100 - (year(a) + 99) DIV 100"),
    "date_diff_days": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "CAST(datediff(b, a) AS BIGINT)"),
    "date_diff_weeks": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "CAST(datediff(b, a) DIV 7 AS BIGINT)"),
    "date_diff_hours": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "CAST((unix_seconds(date_trunc('HOUR', b)) - unix_seconds(date_trunc('HOUR', a))) DIV 3600 AS BIGINT)"),
    "date_diff_minutes": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "(unix_seconds(date_trunc('MINUTE', b)) - unix_seconds(date_trunc('MINUTE', a))) DIV 60"),
    "date_diff_seconds": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "unix_seconds(b) - unix_seconds(a)"),
    "date_diff_milliseconds": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "unix_millis(b) - unix_millis(a)"),
    "date_diff_microseconds": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "unix_micros(b) - unix_micros(a)"),
    "epoch_of": ("t TIMESTAMP", "DOUBLE", "unix_micros(t) / 1e6D"),
    "sunday_zero": ("t TIMESTAMP", "BIGINT", "CAST(dayofweek(t) - 1 AS BIGINT)"),
    # Lists
    "list_at": ("l ARRAY<STRING>, i INT", "STRING", "CASE WHEN i = 0 THEN NULL ELSE try_element_at(l, CASE WHEN i = 0 THEN 1 ELSE i END) END"),
    "long_list_at": ("l ARRAY<BIGINT>, i INT", "BIGINT", "CASE WHEN i = 0 THEN NULL ELSE try_element_at(l, CASE WHEN i = 0 THEN 1 ELSE i END) END"),
}
# The start counts from the end if negative, 0 is the place before the first, and a negative length runs backwards.
_START = "CASE WHEN start < 0 THEN char_length(s) + start + 1 ELSE start END"
FUNCTIONS["duck_substring"] = (
    "s STRING, start BIGINT, n BIGINT",
    "STRING",
    f"""CASE WHEN s IS NULL OR start IS NULL OR n IS NULL THEN NULL ELSE substring(s,
        CAST(greatest(1, {_START} + CASE WHEN n < 0 THEN n ELSE 0 END) AS INT),
        CAST(greatest(0, {_START} + CASE WHEN n < 0 THEN 0 ELSE n END - greatest(1, {_START} + CASE WHEN n < 0 THEN n ELSE 0 END)) AS INT)) END""",
)

FUNCTIONS["duck_substring_from"] = ("s STRING, start BIGINT", "STRING", f"CASE WHEN s IS NULL OR start IS NULL THEN NULL ELSE substring(s, CAST(greatest(1, {_START}) AS INT)) END")

# JSON: what isn't JSON is refused; an _or_null form gives null for it.
for _end, _parse in (("", "parse_json"), ("_or_null", "try_parse_json")):
    _at = f"variant_get({_parse}(j), p, 'variant')"
    _kind = f"schema_of_variant({_at})"
    FUNCTIONS[f"json_value{_end}"] = ("j STRING, p STRING", "STRING", f"CASE WHEN {_kind} = 'STRING' THEN to_json({_at}) WHEN {_kind} = 'VOID' THEN 'null' WHEN {_at} IS NOT NULL THEN get_json_object(j, p) END")
    FUNCTIONS[f"json_string{_end}"] = ("j STRING, p STRING", "STRING", f"CASE WHEN {_at} IS NOT NULL AND {_kind} <> 'VOID' THEN get_json_object(j, p) END")
    FUNCTIONS[f"json_type_at{_end}"] = (
        "j STRING, p STRING",
        "STRING",
        f"""CASE WHEN {_kind} LIKE 'OBJECT%' THEN 'OBJECT' WHEN {_kind} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {_kind} = 'STRING' THEN 'VARCHAR' WHEN {_kind} = 'VOID' THEN 'NULL' WHEN {_kind} = 'BOOLEAN' THEN 'BOOLEAN'
        WHEN {_kind} IS NULL THEN NULL WHEN to_json({_at}) RLIKE '^-[0-9]+$' THEN 'BIGINT' WHEN get_json_object(j, p) RLIKE '^[0-9]{{1,20}}$' THEN 'UBIGINT' ELSE 'DOUBLE' END""",
    )

#: strftime codes as date_format patterns; %j %u %w and codes with a dash are made of other functions.
CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "f": "SSSSSS", "j": "DDD", "g": "SSS"}
PLAIN = {"-d": "d", "-m": "M", "-H": "H", "-I": "h", "-M": "m", "-S": "s", "-y": "yy", "-j": "D"}


def strftime(column: str, fmt: str) -> str:
    """The Spark SQL expression for strftime(column, fmt), fmt being a constant."""
    parts, at, plain = [], 0, ""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    while at < len(fmt):
        if fmt[at] != "%":
            plain += fmt[at]
            at += 1
            continue
        code = fmt[at + 1 : at + 3] if fmt[at + 1 : at + 2] == "-" else fmt[at + 1 : at + 2]
        at += 1 + len(code)
        if code == "%":
            plain += "%"
            continue
        if plain:
            parts.append(quote(plain))
            plain = ""
        if code == "w":
            parts.append(f"CAST(dayofweek({column}) - 1 AS STRING)")
        elif code == "u":
            parts.append(f"CAST(weekday({column}) + 1 AS STRING)")
        elif code in CODES or code in PLAIN:
            parts.append(f"date_format({column}, '{CODES.get(code) or PLAIN[code]}')")
        else:
            raise ValueError(f"strftime code %{code} isn't supported")
    if plain:
        parts.append(quote(plain))
    return f"concat({', '.join(parts)})" if parts else "''"


_CALL = re.compile(r"'(?:[^'\\\\]|\\\\.)*'|\b([a-z_0-9]+)\(")


def inlined(text: str) -> str:
    """The expression with these functions' bodies in place of their calls, for places where Spark can't call them: within functions
    given as arguments."""
    at = 0
    while m := _CALL.search(text, at):
        at = m.end()
        if m[1] not in FUNCTIONS:
            continue
        args, depth, quote, held, i = [], 0, False, at, at
        while True:
            c = text[i]
            if quote:
                i += c == "\\"
                quote = c != "'"
            elif c == "'":
                quote = True
            elif c in "([":
                depth += 1
            elif c in ")]" and depth:
                depth -= 1
            elif c == ")" or c == "," and not depth:
                args.append(text[held:i].strip())
                held = i + 1
                if c == ")":
                    break
            i += 1
        parameters, result, body = FUNCTIONS[m[1]]
        given = {p.split(" ", 1)[0]: f"CAST({a} AS {p.split(' ', 1)[1]})" for p, a in zip(re.split(r", (?=\w+ [A-Z])", parameters), args, strict=True)}
        made = re.sub(r"'(?:[^'\\\\]|\\\\.)*'|\b\w+\b(?!\()", lambda w: given.get(w[0], w[0]), body)
        text = f"{text[: m.start()]}CAST({made} AS {result}){text[i + 1 :]}"
        at = m.start()
    return text


_installed: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def install(spark: SparkSession) -> None:
    """Registers the functions in the session, once."""
    if _installed.get(spark):
        return
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    _installed[spark] = True
