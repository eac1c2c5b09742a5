"""Writes a DuckDB statement's tree as Spark SQL.

Where the two differ by type (a cast of a fraction, the sum of integers, `len` of a list), the writer asks Spark's analyzer for the type
of the operand in its scope; nothing is run for that.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Decimal

from pyspark.logger import PySparkLogger
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import NotAllowed, PlanError
from ..functions.duck import inlined, strftime
from . import names
from .parser import (Between, Binary, Call, Case, Cast, Col, Comprehension, Derived, Differs, Exists, Field, In, Index, Is, Item, Join, Key, Lambda, Like, ListOf, Lit, MapOf, Query, Row, Select, Series, SetOp, Slice, Star, StructOf, Sub, Table, Unary, Values, Window, walk)

#: DuckDB's type names in Spark.
TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "STRING": "STRING", "CHAR": "STRING", "BPCHAR": "STRING", "UUID": "STRING", "JSON": "STRING", "HUGEINT": "DECIMAL(38,0)", "UHUGEINT": "DECIMAL(38,0)", "BIGNUM": "DECIMAL(38,0)", "VARINT": "DECIMAL(38,0)", "UBIGINT": "DECIMAL(20,0)", "BIGINT": "BIGINT", "INT8": "BIGINT", "LONG": "BIGINT", "INTEGER": "INT", "INT": "INT", "INT4": "INT", "SIGNED": "INT", "UINTEGER": "BIGINT", "SMALLINT": "SMALLINT", "INT2": "SMALLINT", "USMALLINT": "INT", "TINYINT": "TINYINT", "UTINYINT": "SMALLINT", "DOUBLE": "DOUBLE", "FLOAT8": "DOUBLE", "FLOAT": "FLOAT", "REAL": "FLOAT", "FLOAT4": "FLOAT", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "LOGICAL": "BOOLEAN", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "BLOB": "BINARY", "BYTEA": "BINARY", "DECIMAL": "DECIMAL(18,3)", "NUMERIC": "DECIMAL(18,3)"}
WHOLE = {"TINYINT", "SMALLINT", "INT", "BIGINT"}
_log = PySparkLogger.getLogger("SQLQueryContextLogger")
_TRIED = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}
_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "<>": "<>"}
#: Functions that only have another name in Spark, or the same.
SAME = set("""abs acos asin atan atan2 cos sin tan cot degrees radians cbrt ceil ceiling exp ln log10 log2 pi sqrt lower upper reverse replace repeat lpad rpad chr md5 coalesce greatest least
    concat_ws initcap translate levenshtein random uuid nullif ifnull nvl if isnan flatten map_keys map_values map_entries element_at array_distinct array_contains array_position array_remove
    array_union array_intersect array_except array_max array_min bool_and bool_or bit_and bit_or bit_xor any_value count_if corr covar_pop covar_samp regr_slope regr_intercept regr_r2 regr_count
    regr_avgx regr_avgy regr_sxx regr_syy regr_sxy stddev stddev_pop stddev_samp var_pop var_samp variance skewness kurtosis median mode grouping grouping_id percent_rank cume_dist lag lead
    first_value last_value nth_value min max count current_date last_day""".split())
RENAMED = {"lcase": "lower", "ucase": "upper", "list_distinct": "array_distinct", "list_unique": "array_distinct", "list_contains": "array_contains", "list_has": "array_contains", "array_has": "array_contains", "list_concat": "concat", "array_concat": "concat", "list_cat": "concat", "array_cat": "concat", "list_max": "array_max", "list_min": "array_min", "list_intersect": "array_intersect", "list_has_any": "arrays_overlap", "ends_with": "endswith", "suffix": "endswith", "starts_with": "startswith", "prefix": "startswith", "error": "raise_error", "jaccard": "levenshtein", "pow": "power", "string_split_regex": "duck_split_regex", "regexp_split_to_array": "duck_split_regex", "every": "bool_and", "logical_or": "bool_or", "today": "current_date", "make_date": "make_date", "map_from_entries": "map_from_entries", "array_reverse": "reverse", "list_reverse": "reverse", "xor": "xor", "editdist3": "levenshtein", "covariance": "covar_samp", "var": "var_samp", "from_hex": "duck_unhex", "unhex": "duck_unhex", "regexp_full_match": "regexp_full_match", "zip": "arrays_zip"}
del RENAMED["jaccard"], RENAMED["editdist3"], RENAMED["zip"], RENAMED["xor"]
#: Functions refused by name, as the engine's surface says.
REFUSED = set("strptime list_aggregate array_aggregate list_aggr approx_count_distinct approx_quantile reservoir_quantile read_parquet read_csv read_csv_auto read_json read_json_auto read_text read_blob glob parquet_scan parquet_metadata getenv sniff_csv duckdb_tables duckdb_settings pragma_table_info query query_table".split())
_LAMBDAS = {"list_transform": "transform", "array_transform": "transform", "list_apply": "transform", "apply": "transform", "array_apply": "transform", "list_filter": "filter", "array_filter": "filter"}
_BIGS = {"length", "char_length", "character_length", "octet_length", "bit_length", "ascii", "levenshtein", "strpos", "instr", "array_length", "cardinality", "len", "unicode", "ord"}
_RANKS = {"row_number", "rank", "dense_rank", "ntile"}
AGGREGATES = set("sum avg mean count min max first last any_value arbitrary first_value last_value nth_value arg_max arg_min max_by min_by argmax argmin list array_agg string_agg group_concat listagg bool_and bool_or bit_and bit_or bit_xor median mode quantile quantile_cont quantile_disc percentile_cont percentile_disc stddev stddev_pop stddev_samp var_pop var_samp variance corr covar_pop covar_samp regr_slope regr_intercept regr_r2 regr_count regr_avgx regr_avgy regr_sxx regr_syy regr_sxy skewness kurtosis count_if countif fsum sum_no_overflow product count_star".split())
#: Parts of dates: how DuckDB spells them, and how much one is in date_trunc's words.
PARTS = {"years": "year", "yr": "year", "y": "year", "months": "month", "mon": "month", "days": "day", "d": "day", "dayofmonth": "day", "hours": "hour", "h": "hour", "hr": "hour", "minutes": "minute", "min": "minute", "seconds": "second", "s": "second", "sec": "second", "weeks": "week", "w": "week", "weekofyear": "week", "quarters": "quarter", "milliseconds": "millisecond", "ms": "millisecond", "microseconds": "microsecond", "us": "microsecond", "dayofweek": "dow", "weekday": "dow", "dayofyear": "doy", "decades": "decade", "centuries": "century", "millenniums": "millennium", "millennia": "millennium"}
_PART_SQL = {"year": "year({t})", "month": "month({t})", "day": "day({t})", "hour": "hour({t})", "minute": "minute({t})", "second": "second({t})", "quarter": "quarter({t})", "week": "weekofyear({t})", "doy": "dayofyear({t})", "dow": "dayofweek({t}) - 1", "isodow": "weekday({t}) + 1", "isoyear": "extract(YEAROFWEEK FROM {t})", "decade": "year({t}) DIV 10", "century": "(year({t}) + 99) DIV 100", "millennium": "(year({t}) + 999) DIV 1000", "millisecond": "(unix_micros(CAST({t} AS TIMESTAMP)) - unix_micros(date_trunc('MINUTE', CAST({t} AS TIMESTAMP)))) DIV 1000", "microsecond": "unix_micros(CAST({t} AS TIMESTAMP)) - unix_micros(date_trunc('MINUTE', CAST({t} AS TIMESTAMP)))"}


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Words that need quotes as names: Spark reads them otherwise.
_WORDS = set("""all and anti any array as asc at between both by case cast check collate column create cross cube current current_date current_time current_timestamp current_user date day desc describe distinct
    div drop else end escape except exists extract false filter for from full function group grouping having hour if in inner insert intersect interval into is join lateral leading left like limit map
    minus minute month natural not null of on or order outer over overlay partition position range right rollup row rows second select semi session_user set some struct substring table then time timestamp
    to trailing trim true union unique unknown unpivot update user using values when where window with within year quarter week sort distribute cluster pivot qualify offset lambda""".split())


def ident(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) and name.lower() not in _WORDS else "`" + name.replace("`", "``") + "`"


def spark_type(text: str) -> str:
    if text.endswith("[]"):
        return f"ARRAY<{spark_type(text[:-2])}>"
    if text.startswith("STRUCT("):
        parts, depth, held = [], 0, ""
        for c in text[7:-1] + ",":
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(held.strip().split(" ", 1))
                held = ""
            else:
                held += c
        return "STRUCT<" + ", ".join(f"{ident(n)}: {spark_type(t)}" for n, t in parts) + ">"
    base, _, rest = text.partition("(")
    if base in ("DECIMAL", "NUMERIC") and rest:
        args = [a.strip() for a in rest[:-1].split(",")]
        return f"DECIMAL({args[0]},{args[1] if len(args) > 1 else 0})"
    if base not in TYPES:
        raise PlanError(f"type {text} isn't supported")
    return TYPES[base]


def kind_of_type(t: T.DataType) -> str | None:
    if isinstance(t, T.DecimalType):
        return "wide" if t.scale == 0 else "decimal"
    for k, name in ((T.BooleanType, "bool"), (T.IntegralType, "int"), (T.FractionalType, "double"), (T.StringType, "text"), (T.DateType, "date"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp"), (T.ArrayType, "list"), (T.MapType, "map"), (T.StructType, "struct"), (T.BinaryType, "blob"), (T.NullType, "null"), (T.DayTimeIntervalType, "interval"), (T.YearMonthIntervalType, "interval")):
        if isinstance(t, k):
            return name
    return None


@dataclass
class Scope:
    """What names mean: the FROM clause in Spark's words, the scope around it, and the select list's aliases."""

    source: str | None = None
    outer: Scope | None = None
    aliases: dict[str, object] = field(default_factory=dict)
    variables: frozenset = frozenset()  # of functions given as arguments
    windows: dict = field(default_factory=dict)


class Writer:
    def __init__(self, spark: SparkSession | None = None, solve=None, functions: set[str] | frozenset = frozenset()):
        """solve: makes the table of a recursive query that keeps distinct rows, from its name, columns, start and step; functions:
        the host's own."""
        self.spark, self.solve, self.functions, self.with_, self.trying, self._types = spark, solve, functions, [], False, {}

    # Queries
    def query(self, q: Query, outer: Scope | None = None) -> str:
        held, texts = list(self.with_), []
        for name, columns, inner in q.ctes:
            texts.append(self.cte(name, columns, inner, q.recursive))
            self.with_.append(texts[-1])
        head = f"WITH {'RECURSIVE ' if q.recursive and any(t.startswith('RECURSIVE ') for t in texts) else ''}{', '.join(t.removeprefix('RECURSIVE ') for t in texts)} " if texts else ""
        out = head + self.ordered(q, outer)
        self.with_ = held
        return out

    def cte(self, name: str, columns: list[str], q: Query, recursive: bool) -> str:
        own = recursive and isinstance(q.body, SetOp) and q.body.op == "UNION" and any(isinstance(n, Table) and [p.lower() for p in n.parts] == [name.lower()] for n in walk(q.body.b))
        names = f"({', '.join(map(ident, columns))})" if columns else ""
        if not own:
            text = self.query(q)
            return f"{ident(name)}{names or self.renamed_twins(q, text)} AS ({text})"
        start = self.query(Query([], False, q.body.a, [], None, None) if not isinstance(q.body.a, Query) else q.body.a)
        held = list(self.with_)
        self.with_.append(f"{ident(name)}{names} AS ({start})")  # for the types within the step
        step = self.query(Query([], False, q.body.b, [], None, None) if not isinstance(q.body.b, Query) else q.body.b)
        self.with_ = held
        if q.body.all:
            return f"RECURSIVE {ident(name)}{names} AS ({start} UNION ALL {step})"
        if self.solve is None:
            raise PlanError("WITH RECURSIVE ... UNION needs an engine")
        head = f"WITH {', '.join(t.removeprefix('RECURSIVE ') for t in held)} " if held else ""
        made = self.solve(name, columns, head + start, head, step)
        return f"{ident(name)}{names} AS (SELECT * FROM {ident(made)})"

    def renamed_twins(self, q: Query, text: str) -> str:
        """A column list that numbers repeated names, as DuckDB does in tables of a statement; empty if none repeats."""
        body = q.body
        if self.spark is None or not isinstance(body, Select) or not any(isinstance(i.x, Star) for i in body.items) and len({self.item_name(i).lower() for i in body.items}) == len(body.items):
            return ""
        found = self.columns(text)
        if found is None or len({c.lower() for c in found}) == len(found):
            return ""
        seen, made = {}, []
        for c in found:
            n = seen.get(c.lower(), 0)
            seen[c.lower()] = n + 1
            made.append(f"{c}_{n}" if n else c)
        return f"({', '.join(map(ident, made))})"

    def ordered(self, q: Query, outer: Scope | None) -> str:
        body = q.body
        if isinstance(body, Select) and (body.qualify is not None or isinstance(body.distinct, list)):
            out = self.filtered(body, q.order, outer)
        else:
            scope = Scope(outer=outer)
            if isinstance(body, Select):
                out, scope = self.select(body, outer)
                chosen = {self.item_name(i).lower() for i in body.items}
                stars = any(isinstance(i.x, Star) for i in body.items)
                if body.distinct is True and not stars and isinstance(q.order, list):
                    texts = {self.text(i.x, scope) for i in body.items}
                    for k in q.order:
                        if not (isinstance(k.x, Lit) or isinstance(k.x, Col) and k.x.parts[-1].lower() in chosen) and any(isinstance(n, Col) and n.parts[-1].lower() not in chosen for n in walk(k.x)) and self.text(k.x, scope) not in texts:
                            raise PlanError("DISTINCT can't be ordered by what isn't selected")
            else:
                out = self.body(body, outer)
            out += self.order_by(q.order, scope)
        if q.limit is not None:
            out += f" LIMIT {self.count(q.limit, outer)}"
        if q.offset is not None:
            out += f" OFFSET {self.count(q.offset, outer)}"
        return out

    def count(self, x, scope) -> str:
        if isinstance(x, Lit) and x.kind in ("decimal", "double"):
            return str(int(Decimal(x.text).quantize(Decimal(1), ROUND_HALF_UP)))
        return self.text(x, scope)

    def order_by(self, order, scope: Scope, word: str = "ORDER BY") -> str:
        if not order:
            return ""
        if isinstance(order, tuple):
            return f" {word} ALL {'DESC' if order[1] else 'ASC'} NULLS {order[2] or 'LAST'}"
        return f" {word} " + ", ".join(self.key(k, scope) for k in order)

    def key(self, k: Key, scope: Scope) -> str:
        return f"{self.text(k.x, scope)} {'DESC' if k.down else 'ASC'} NULLS {k.nulls or 'LAST'}"

    def body(self, body, outer: Scope | None) -> str:
        if isinstance(body, Query):
            return f"({self.query(body, outer)})"
        if isinstance(body, Select):
            return self.ordered(Query([], False, body, [], None, None), outer)
        if isinstance(body, Values):
            return "VALUES " + ", ".join(f"({', '.join(self.text(x, Scope(outer=outer)) for x in r)})" for r in body.rows)
        a, b = self.body(body.a, outer), self.body(body.b, outer)
        if body.by_name:
            a, b = self.by_name(a, b)
        wrap = lambda text, side: f"({text})" if isinstance(side, SetOp) and not text.startswith("(") else text
        return f"{wrap(a, body.a)} {body.op}{' ALL' if body.all else ''} {wrap(b, body.b)}"

    def by_name(self, a: str, b: str) -> tuple[str, str]:
        left, right = self.columns(a), self.columns(b)
        if left is None or right is None:
            raise PlanError("UNION BY NAME needs an engine")
        low = {c.lower() for c in left}
        every = left + [c for c in right if c.lower() not in low]

        def side(text: str, own: list[str]) -> str:
            have = {c.lower() for c in own}
            return f"SELECT {', '.join(ident(c) if c.lower() in have else f'NULL AS {ident(c)}' for c in every)} FROM ({text})"

        return side(a, left), side(b, right)

    def filtered(self, s: Select, order, outer: Scope | None) -> str:
        """QUALIFY and DISTINCT ON: the select with a test, or with a rank, and the rows that pass."""
        plain, hidden, extra = replace(s, qualify=None, distinct=None), [], []
        test, keys, again = s.qualify, [], []
        if isinstance(s.distinct, list):
            ranks = order if isinstance(order, list) and order else [Key(x, False, None) for x in s.distinct]
            own = Window(None, [self.aliased(x, s) for x in s.distinct], [replace(k, x=self.aliased(k.x, s)) for k in ranks], None, [])
            extra.append(Item(Call("row_number", [], over=own), "_first"))
            keys.append("`_first` = 1")
        if test is not None:
            test = self.aliased(test, s)
            test = self.extreme(test) or test
            extra.append(Item(test, "_kept"))
            keys.append("`_kept`")
        chosen = {self.item_name(i).lower() for i in s.items}
        if isinstance(order, tuple):
            again = order
        for n, k in enumerate(order if isinstance(order, list) else []):
            if isinstance(k.x, Lit) or isinstance(k.x, Col) and len(k.x.parts) == 1 and k.x.parts[0].lower() in chosen:
                again.append(k)
            else:
                hidden.append(f"_s{n}")
                extra.append(Item(self.aliased(k.x, s), f"_s{n}"))
                again.append(replace(k, x=Col([f"_s{n}"])))
        plain.items = [*s.items, *extra]
        text, _ = self.select(plain, outer)
        gone = ", ".join(ident(i.alias) for i in extra)
        return f"SELECT {'DISTINCT ' if s.distinct is True else ''}* EXCEPT ({gone}) FROM ({text}) WHERE {' AND '.join(keys)}" + self.order_by(again, Scope())

    def aliased(self, x, s: Select):
        """x with aliases of the select list in the place of names that the tables lack."""
        known = {i.alias.lower(): i.x for i in s.items if i.alias}
        if not known:
            return x
        source = self.source(s.source, Scope()) if s.source is not None else None
        return self.substituted(x, known, Scope(source))

    def substituted(self, x, known: dict, scope: Scope):
        if isinstance(x, Col) and len(x.parts) == 1 and x.parts[0].lower() in known:
            return known[x.parts[0].lower()] if self.type_of(x, scope) is None else x
        if isinstance(x, list):
            return [self.substituted(i, known, scope) for i in x]
        if isinstance(x, tuple):
            return tuple(self.substituted(i, known, scope) for i in x)
        if hasattr(x, "__dataclass_fields__") and not isinstance(x, (Query, Star)):
            return replace(x, **{f: self.substituted(getattr(x, f), known, scope) for f in x.__dataclass_fields__})
        return x

    @staticmethod
    def extreme(test):
        """x = min(x) OVER (PARTITION BY ...) keeps rows of rank one, which Spark cuts before it shuffles."""
        if not (isinstance(test, Binary) and test.op == "="):
            return None
        for x, w in ((test.a, test.b), (test.b, test.a)):
            if isinstance(w, Call) and w.name in ("min", "max") and isinstance(w.over, Window) and w.args == [x] and w.where is None and not w.over.order and not w.over.frame and not w.over.base:
                ranked = Call("rank", [], over=replace(w.over, order=[Key(x, w.name == "max", "LAST")]))
                return Binary("AND", Binary("=", ranked, Lit("int", "1")), Is(x, "null", True))
        return None

    def item_name(self, i: Item) -> str:
        return i.alias or (i.x.parts[-1] if isinstance(i.x, Col) else names.default(i.x))

    def select(self, s: Select, outer: Scope | None) -> tuple[str, Scope]:
        scope = Scope(outer=outer, windows=s.windows)
        latest = self.latest(s, outer)
        if latest is not None:
            s, scope.source = latest
        where = s.where
        if s.source is not None and scope.source is None:
            scope.source = self.source(s.source, Scope(outer=outer), any(isinstance(i.x, Star) for i in s.items))
        out = "SELECT " + ("DISTINCT " if s.distinct is True else "")
        out += ", ".join(self.item(i, scope) for i in s.items)
        if scope.source is not None:
            out += f" FROM {scope.source}"
        if where is not None:
            known = {i.alias.lower(): i.x for i in s.items if i.alias and not any(isinstance(n, Call) and (n.over is not None or n.name in AGGREGATES) for n in walk(i.x))}
            out += f" WHERE {self.condition(self.substituted(where, known, scope) if known else where, scope)}"
        if s.group is not None:
            out += " GROUP BY " + ("ALL" if s.group == "ALL" else self.groups(s.group, scope))
        if s.having is not None:
            out += f" HAVING {self.text(s.having, scope)}"
        if s.windows:
            out += " WINDOW " + ", ".join(f"{ident(n)} AS {self.window(w, scope)}" for n, w in s.windows.items())
        return out, scope

    def latest(self, s: Select, outer: Scope | None) -> tuple[Select, str] | None:
        """(SELECT v FROM p WHERE p.k = e.k AND p.b <= e.t ORDER BY p.b DESC LIMIT 1) as an item of a select over one table e: rows of
        both are laid end to end and sorted once by key and time, and the last of p is carried on, instead of joining a key's rows each
        with each. The select without these items, and its table with their values; None if there are none."""
        if self.spark is None or not isinstance(s.source, (Table, Derived)) or isinstance(s.source, Derived) and s.source.lateral or any(isinstance(i.x, Star) for i in s.items):
            return None
        text, items = self.source(s.source, Scope(outer=outer)), []
        name = s.source.alias or (s.source.parts[-1] if isinstance(s.source, Table) else None)
        if name is None:
            return None
        found = 0
        for i in s.items:
            made = self.carried(i.x.query, text, name, found) if isinstance(i.x, Sub) else None
            if made is None:
                items.append(i)
                continue
            text = made
            items.append(Item(Col([name, f"_latest{found}"]), self.item_name(i)))
            found += 1
        return (replace(s, items=items), text) if found else None

    def carried(self, q: Query, text: str, name: str, n: int) -> str | None:
        body = q.body
        if q.ctes or not isinstance(body, Select) or len(body.items) != 1 or not isinstance(body.source, (Table, Derived)) or body.group or body.having or body.distinct or body.qualify or body.where is None or q.offset is not None:
            return None
        if not (isinstance(q.limit, Lit) and q.limit.text == "1" and isinstance(q.order, list) and len(q.order) == 1 and isinstance(q.order[0].x, Col)) or isinstance(body.items[0].x, Star) or any(isinstance(x, Call) and (x.name in AGGREGATES or x.over) for x in walk(body.items[0].x)):
            return None
        inner = Scope(self.source(body.source, Scope()))
        ours, around = Scope(text), lambda x: isinstance(x, Col) and self.type_of(x, inner) is None
        by, down, keys, bound, rest, todo = q.order[0].x, q.order[0].down, [], None, [], [body.where]
        while todo:
            x = todo.pop()
            if isinstance(x, Binary) and x.op == "AND":
                todo += [x.a, x.b]
                continue
            if not any(around(c) for c in walk(x)):
                rest.append(x)
                continue
            if not (isinstance(x, Binary) and x.op in _FLIPPED and isinstance(x.a, Col) and isinstance(x.b, Col)) or around(x.a) == around(x.b):
                return None
            a, b, op = (x.a, x.b, x.op) if around(x.b) else (x.b, x.a, _FLIPPED[x.op])
            if self.type_of(b, ours) is None:
                return None
            if op == "=":
                keys.append((a, b))
            elif a == by and bound is None and op in (("<=", "<") if down else (">=", ">")):
                bound = (b, op)
            else:
                return None
        if not keys or bound is None or any(around(c) for c in walk(body.items[0].x)):
            return None
        e, value = ident(name), self.text(body.items[0].x, inner)
        ours_ = ", ".join(f"{self.text(b, ours)} AS _k{k}" for k, (_, b) in enumerate(keys))
        theirs = ", ".join(f"{self.text(a, inner)} AS _k{k}" for k, (a, _) in enumerate(keys))
        known = " AND ".join([*(f"_k{k} IS NOT NULL" for k in range(len(keys))), "_t IS NOT NULL"])
        tests = " AND ".join([f"{self.text(by, inner)} IS NOT NULL", *(self.condition(x, inner) for x in rest)])
        both = f"SELECT struct({e}.*) AS _e, {ours_}, {self.text(bound[0], ours)} AS _t, 1 AS _side, NULL AS _h FROM {text} UNION ALL SELECT NULL, {theirs}, {self.text(by, inner)}, 0, struct({value} AS v) FROM {inner.source} WHERE {tests}"
        order = f"_t {'ASC' if down else 'DESC'}, _side {'ASC' if '=' in bound[1] else 'DESC'}"
        carried = f"SELECT _e, _side, CASE WHEN {known} THEN last(_h, true) OVER (PARTITION BY {', '.join(f'_k{k}' for k in range(len(keys)))} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS _l FROM ({both})"
        return f"(SELECT _e.*, _l.v AS _latest{n} FROM ({carried}) WHERE _side = 1) AS {e}"

    def groups(self, groups: list[tuple], scope: Scope) -> str:
        found = []
        for kind, x in groups:
            if kind == "SETS":
                found.append("GROUPING SETS (" + ", ".join(f"({', '.join(self.text(e, scope) for e in one)})" for one in x) + ")")
            elif kind:
                found.append(f"{kind} (" + ", ".join(self.text(e, scope) for e in x) + ")")
            else:
                found.append(self.text(x, scope))
        return ", ".join(found)

    def item(self, i: Item, scope: Scope) -> str:
        if isinstance(i.x, Star):
            return self.star(i.x, scope)
        text = self.text(i.x, scope)
        if i.alias is None and isinstance(i.x, Col):
            return text
        return f"{text} AS {ident(self.item_name(i))}"

    def star(self, s: Star, scope: Scope) -> str:
        head = f"{ident(s.table)}." if s.table else ""
        if not s.replace:
            return f"{head}*" + (f" EXCEPT ({', '.join(map(ident, s.exclude))})" if s.exclude else "")
        found = self.columns(f"SELECT {head}* FROM {scope.source}")
        if found is None:
            raise PlanError("REPLACE needs an engine")
        gone, put = {c.lower() for c in s.exclude}, {n.lower(): x for x, n in s.replace}
        return ", ".join(f"{self.text(put[c.lower()], scope)} AS {ident(c)}" if c.lower() in put else f"{head}{ident(c)}" for c in found if c.lower() not in gone)

    # Tables
    def source(self, x, scope: Scope, stars: bool = True) -> str:
        if isinstance(x, Table):
            name = "_".join(x.parts) if x.parts[0].lower() == "information_schema" else x.parts[-1]
            return ident(name) + self.called(x.alias or (x.parts[-1] if len(x.parts) > 1 else None), x.columns)
        if isinstance(x, Derived):
            text = self.query(x.query, scope)
            columns = x.columns
            if not columns and (twins := self.renamed_twins(x.query, text)):
                return f"({text}) AS {ident(x.alias or '_t')}{twins}" if not x.lateral else f"LATERAL ({text}) AS {ident(x.alias or '_t')}{twins}"
            if isinstance(x.query.body, Values) and not columns and x.alias and not x.query.order and x.query.limit is None:
                columns = [f"col{k}" for k in range(len(x.query.body.rows[0]))]
            return f"{'LATERAL ' if x.lateral else ''}({text}){self.called(x.alias, columns)}"
        if isinstance(x, Series):
            return self.series(x)
        made = self.ranged(x, scope) if not stars and x.kind in ("INNER", "LEFT", "RIGHT") and x.on is not None else None
        if made:
            return made
        a = self.source(x.a, scope, stars)
        inner = Scope(a, scope.outer) if isinstance(x.b, Derived) else scope
        b = self.source(x.b, inner, stars)
        if isinstance(x.b, Join):
            b = f"({b})"
        kind = x.kind
        if x.natural:
            return f"{a} NATURAL {kind} JOIN {b}"
        out = f"{a} {kind} JOIN {b}"
        if x.using:
            return f"{out} USING ({', '.join(map(ident, x.using))})"
        if x.on is not None and not (isinstance(x.on, Lit) and x.on.text == "true"):
            out += f" ON {self.text(x.on, Scope(f'{a} CROSS JOIN {b}', scope.outer))}"
        return out

    def called(self, alias: str | None, columns: list[str]) -> str:
        if not alias and not columns:
            return ""
        return f" AS {ident(alias or '_t')}" + (f"({', '.join(map(ident, columns))})" if columns else "")

    def series(self, x: Series) -> str:
        if x.name in REFUSED:
            raise NotAllowed(f"function {x.name} isn't allowed")
        if x.name not in ("range", "generate_series"):
            raise PlanError(f"table function {x.name} isn't supported")
        numbers = []
        for a in x.args:
            sign, lit = (-1, a.x) if isinstance(a, Unary) and a.op == "-" else (1, a)
            if not (isinstance(lit, Lit) and lit.kind == "int"):
                raise PlanError(f"{x.name} takes whole numbers as they stand")
            numbers.append(sign * int(lit.text))
        if not 1 <= len(numbers) <= 3:
            raise PlanError(f"{x.name} takes one to three numbers")
        start, stop, step = (0, numbers[0], 1) if len(numbers) == 1 else (*numbers, 1)[:3]
        if step == 0:
            raise PlanError(f"the step of {x.name} is 0")
        if x.name == "generate_series":
            stop += 1 if step > 0 else -1
        column = x.columns[0] if x.columns else x.alias or x.name
        return f"(SELECT `id` AS {ident(column)} FROM range({start}, {stop}, {step})) AS {ident(x.alias or x.name)}"

    def ranged(self, j: Join, scope: Scope) -> str | None:
        """Two bounds on one column and no equal keys: ranges fall in blocks as wide as the next power of two beyond their length, each
        in one block; a point looks in its own block and the one before, for each width there is (65 at most). Ranges are never
        repeated, and the join is by equal block. Where points without a range must stay, each point looks only in the blocks where its
        value has one, which distinct values are told first, and once in none if there is no such block. None if the join has another form."""
        bounds, todo = [], [j.on]
        while todo:
            x = todo.pop()
            if isinstance(x, Binary) and x.op == "AND":
                todo += [x.a, x.b]
            elif isinstance(x, Between) and not x.negate:
                todo += [Binary(">=", x.x, x.low), Binary("<=", x.x, x.high)]
            elif isinstance(x, Binary) and x.op in ("<", "<=", ">", ">=") and isinstance(x.a, Col) and isinstance(x.b, Col) and len(x.a.parts) == len(x.b.parts) == 2:
                bounds.append(x)
            else:
                return None
        sides = {}
        for side in (j.a, j.b):
            if not isinstance(side, (Table, Derived)) or isinstance(side, Derived) and side.lateral:
                return None
            sides[(side.alias or (side.parts[-1] if isinstance(side, Table) else "")).lower()] = side
        if len(bounds) != 2 or len(sides) != 2 or self.spark is None:
            return None
        for point, of in ((p, r) for p in sides for r in sides if p != r):
            low = high = at = None
            for x in bounds:
                a, b, op = (x.a, x.b, x.op) if x.a.parts[0].lower() == point else (x.b, x.a, _FLIPPED[x.op])
                if a.parts[0].lower() != point or b.parts[0].lower() != of or at is not None and at != a.parts[1].lower():
                    break
                at = a.parts[1].lower()
                low, high = (b.parts[1], high) if op in (">", ">=") else (low, b.parts[1])
            else:
                if low and high:
                    break
        else:
            return None
        lonely = j.kind == "LEFT" and sides[of] is j.b or j.kind == "RIGHT" and sides[of] is j.a
        texts = {n: self.source(s, scope) for n, s in sides.items()}
        if lonely and not all(map(self.steady, texts.values())):
            return None
        place = {k: self.number(Col([n, c]), Scope(texts[n], scope.outer)) for k, n, c in (("at", point, at), ("low", of, low), ("high", of, high))}
        if None in place.values():
            return None
        level = f"CASE WHEN {place['low']} <= {place['high']} THEN CAST(ceil(log2({place['high']} - {place['low']} + 1)) AS INT) + 1 END"
        p, r = ident(point), ident(of)
        levels = f"(SELECT collect_set({level}) FROM {texts[of]})"
        block = f"floor({place['at'].replace(p + '.', '')} / power(2, `_w`))"
        spread = lambda text: f"(SELECT *, explode(array({block}, {block} - 1)) AS `_n` FROM (SELECT {p}.*, explode({levels}) AS `_w` FROM {text})) AS {p}"
        ranges = f"(SELECT *, floor({place['low'].replace(r + '.', '')} / power(2, `_w`)) AS `_n` FROM (SELECT {r}.*, {level} AS `_w` FROM {texts[of]})) AS {r}"
        tests = " AND ".join(f"{ident(x.a.parts[0])}.{ident(x.a.parts[1])} {x.op} {ident(x.b.parts[0])}.{ident(x.b.parts[1])}" for x in bounds)
        on = f"{p}.`_w` = {r}.`_w` AND {p}.`_n` = {r}.`_n` AND {tests}"
        points = spread(texts[point])
        if lonely:
            value = f"{p}.{ident(at)}"
            values = spread(f"(SELECT DISTINCT {value} FROM {texts[point]} WHERE {value} IS NOT NULL) AS {p}")
            hits = f"(SELECT {value} AS `_at`, collect_list(struct({p}.`_w`, {p}.`_n`)) AS `_hits` FROM {values} LEFT SEMI JOIN {ranges} ON {on} GROUP BY {value}) AS `_h`"
            points = f"(SELECT {p}.*, inline_outer(`_h`.`_hits`) FROM {texts[point]} LEFT JOIN {hits} ON {value} = `_h`.`_at`) AS {p}"
        made = {point: points, of: ranges}
        first, second = (n for n in sides)
        return f"{made[first]} {j.kind} JOIN {made[second]} ON {on}"

    def steady(self, text: str) -> bool:
        """Whether a relation has the same rows each time it is read: nothing random, and no limit or window, which ties leave open."""
        plan = self.spark.sql(f"{self._head()}SELECT * FROM {text}")._jdf.queryExecution().analyzed()
        return plan.deterministic() and not re.search(r"\b(GlobalLimit|LocalLimit|Offset|Window|Sample)\b", plan.toString())

    def number(self, x: Col, scope: Scope) -> str | None:
        kind, text = self.kind(x, scope), f"{ident(x.parts[0])}.{ident(x.parts[1])}"
        if kind in ("int", "wide", "decimal"):
            return f"CAST({text} AS DOUBLE)"
        if kind == "date":
            return f"CAST(unix_date({text}) AS DOUBLE)"
        return f"CAST(unix_micros(CAST({text} AS TIMESTAMP)) AS DOUBLE)" if kind == "timestamp" else None

    # Types
    def columns(self, text: str) -> list[str] | None:
        if self.spark is None:
            return None
        return self.spark.sql(self._head() + text).columns

    def _head(self) -> str:
        if not self.with_:
            return ""
        loops = any(t.startswith("RECURSIVE ") for t in self.with_)
        return f"WITH {'RECURSIVE ' if loops else ''}{', '.join(t.removeprefix('RECURSIVE ') for t in self.with_)} "

    def type_of(self, x, scope: Scope | None) -> T.DataType | None:
        """Spark's type of the expression, null if it can't be told (aggregates beside keys, names of functions given as arguments)."""
        if self.spark is None or scope is None:
            return None
        if scope.variables and any(isinstance(n, Col) and n.parts[0].lower() in scope.variables for n in walk(x)):
            return None
        key = (len(self.with_), scope.source, scope.outer.source if scope.outer else None, self.trying, repr(x))
        if key not in self._types:
            self._types[key] = None
            level, _log.level = _log.level, logging.CRITICAL  # a question that has no answer is no error
            try:
                inner = f"SELECT {self.text(x, scope)} AS `_x`" + (f" FROM {scope.source}" if scope.source else "")
                text = inner
                try:
                    self._types[key] = self.spark.sql(self._head() + text).schema["_x"].dataType
                except Exception:
                    if scope.outer is None or not scope.outer.source:
                        raise
                    self._types[key] = self.spark.sql(f"{self._head()}SELECT `_y`.`_x` AS `_x` FROM {scope.outer.source}, LATERAL ({inner}) AS `_y`").schema["_x"].dataType
            except Exception:  # can't be told here; the whole statement is analyzed afterwards and says what is wrong
                pass
            finally:
                _log.level = level
        return self._types[key]

    def kind(self, x, scope: Scope | None) -> str | None:
        if isinstance(x, Lit):
            return {"int": "int", "decimal": "decimal", "interval": "interval"}.get(x.kind, x.kind)
        if isinstance(x, Cast):
            t = spark_type(x.type)
            return "wide" if t.startswith("DECIMAL") and t.endswith(",0)") else "decimal" if t.startswith("DECIMAL") else "list" if t.startswith("ARRAY") else "struct" if t.startswith("STRUCT") else {"STRING": "text", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "bool", "DATE": "date", "BINARY": "blob"}.get(t, "timestamp" if t.startswith("TIMESTAMP") else "int")
        if isinstance(x, Unary) and x.op == "-":
            return self.kind(x.x, scope)
        if isinstance(x, Binary):
            if x.op in ("AND", "OR", *_FLIPPED):
                return "bool"
            if x.op == "/":
                return "double"
            if x.op in ("->", "->>"):
                return "text"
            if x.op in ("+", "-", "*", "%", "//"):
                kinds = {self.kind(x.a, scope), self.kind(x.b, scope)}
                for k in ("date", "timestamp", "interval", "double", "decimal", "wide", "int"):
                    if k in kinds:
                        return ("int" if kinds == {"date"} else k) if None not in kinds or k in ("date", "timestamp") else None
        if isinstance(x, (In, Between, Like, Is, Differs, Exists)) or isinstance(x, Unary) and x.op == "NOT":
            return "bool"
        if isinstance(x, ListOf | Comprehension):
            return "list"
        if isinstance(x, StructOf | Row):
            return "struct"
        if isinstance(x, MapOf):
            return "map"
        if isinstance(x, Call):
            if x.name in _BIGS or x.name in _RANKS or x.name in ("count", "count_star", "date_diff", "datediff"):
                return "int"
            if x.name in ("lower", "upper", "substring", "substr", "concat", "replace", "trim", "string_agg", "strftime", "split_part", "regexp_replace", "regexp_extract", "printf", "format", "json_extract", "json_extract_string", "to_json", "typeof", "json_type"):
                return "text" if x.name != "concat" else self._asked(x, scope)
            if x.name == "sum" and x.args and (k := self.kind(x.args[0], scope)):
                return {"int": "wide", "bool": "wide"}.get(k, k)
            if x.name in ("avg", "mean", "sqrt", "ln", "exp"):
                return "double"
            if x.name in ("list", "array_agg", "string_split", "list_transform", "list_filter", "list_sort"):
                return "list"
            if x.name in ("date_part", "year", "month", "day", "hour", "minute", "week", "quarter"):
                return "int"
        return self._asked(x, scope)

    def _asked(self, x, scope: Scope | None) -> str | None:
        found = self.type_of(x, scope)
        return None if found is None else kind_of_type(found)

    # Expressions
    def text(self, x, scope: Scope | None) -> str:
        return getattr(self, "_" + type(x).__name__.lower())(x, scope)

    def _lit(self, x: Lit, scope) -> str:
        if x.kind == "text":
            return quoted(x.text)
        if x.kind == "int":
            n = int(x.text)
            return f"{n}" if n < 1 << 31 else f"{n}L" if n < 1 << 63 else f"CAST('{n}' AS DECIMAL(38,0))"
        if x.kind == "double":
            return f"{x.text}D"
        if x.kind == "decimal":
            return x.text.rstrip(".") if x.text.endswith(".") else "0" + x.text if x.text.startswith(".") else x.text
        if x.kind == "date":
            return f"DATE {quoted(x.text)}"
        if x.kind == "timestamp":
            return f"TIMESTAMP_NTZ {quoted(x.text)}"
        if x.kind == "interval":
            return f"INTERVAL {quoted(x.text)}"
        return x.text.upper()

    def _col(self, x: Col, scope) -> str:
        if len(x.parts) == 1 and x.parts[0].lower() in ("current_date", "current_timestamp"):
            return f"{x.parts[0].lower()}()"
        return ".".join(map(ident, x.parts))

    def _star(self, x: Star, scope) -> str:
        return "*" if not x.table else f"{ident(x.table)}.*"

    def _unary(self, x: Unary, scope) -> str:
        if x.op == "-" and isinstance(x.x, Lit) and x.x.kind in ("int", "decimal", "double"):
            if x.x.kind == "int" and int(x.x.text) == 1 << 63:
                return "-9223372036854775808L"
            return f"-{self.text(x.x, scope)}"
        return f"({'NOT ' if x.op == 'NOT' else x.op}{self.text(x.x, scope)})"

    def _binary(self, x: Binary, scope) -> str:
        op = x.op
        if op in _FLIPPED:
            return self.compared(x, scope)
        if op in ("->", "->>"):
            return self.json_at(x.a, x.b, op == "->>", scope)
        if op == "^@":
            return f"startswith({self.text(x.a, scope)}, {self.text(x.b, scope)})"
        if op in ("~", "!~"):
            return f"{'NOT ' if op == '!~' else ''}regexp_full_match({self.text(x.a, scope)}, {self.text(x.b, scope)})"
        if op in ("<<", ">>"):
            return f"{'shift_left' if op == '<<' else 'shift_right'}({self.text(x.a, scope)}, {self.text(x.b, scope)})"
        a, b = self.text(x.a, scope), self.text(x.b, scope)
        if op == "||":
            return f"concat({a}, {b})" if "list" in (self.kind(x.a, scope), self.kind(x.b, scope)) else f"({a} || {b})"
        if op == "/":
            if isinstance(x.b, Lit) and x.b.kind in ("int", "decimal", "double") and Decimal(x.b.text):
                return f"(CAST({a} AS DOUBLE) / {Decimal(x.b.text)}D)" if x.b.kind != "double" else f"(CAST({a} AS DOUBLE) / {b})"
            return f"duck_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
        if op in ("//", "%"):
            kinds = {self.kind(x.a, scope), self.kind(x.b, scope)}
            if "double" in kinds or "decimal" in kinds and op == "//":
                return f"duck_double_{'div' if op == '//' else 'mod'}(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            if "decimal" in kinds:
                return f"({a} % nullif({b}, 0))"
            if "wide" in kinds:
                return f"duck_wide_{'div' if op == '//' else 'mod'}({a}, {b})"
            return f"{'duck_div' if op == '//' else 'duck_mod'}({a}, {b})"
        if op in ("+", "-"):
            ka, kb = self.kind(x.a, scope), self.kind(x.b, scope)
            if ka == "date" and kb in ("int", "wide"):
                return f"date_{'add' if op == '+' else 'sub'}({a}, CAST({b} AS INT))"
            if kb == "date" and ka in ("int", "wide") and op == "+":
                return f"date_add({b}, CAST({a} AS INT))"
            if ka == kb == "date":
                return f"CAST(datediff({a}, {b}) AS BIGINT)"
            if ka == "date" and kb == "interval":
                return f"(CAST({a} AS TIMESTAMP_NTZ) {op} {b})"
        if self.trying and op in _TRIED:
            return f"{_TRIED[op]}({a}, {b})"
        return f"({a} {op} {b})"

    def compared(self, x: Binary, scope) -> str:
        a, b, op = x.a, x.b, x.op
        for l, r, o in ((a, b, op), (b, a, _FLIPPED[op])):
            moved = self.moved(l, r, o, scope)
            if moved:
                return moved
        ka, kb = (self.kind(s, scope) for s in (a, b)) if any(isinstance(s, Lit) and s.kind == "bool" for s in (a, b)) or any(self._bool_like(s) for s in (a, b)) else (None, None)
        ta, tb = self.text(a, scope), self.text(b, scope)
        if {ka, kb} & {"bool"} and {ka, kb} & {"int", "wide", "decimal", "double"}:
            ta, tb = (f"CAST({t} AS INT)" if k == "bool" else t for t, k in ((ta, ka), (tb, kb)))
        return f"({ta} {op} {tb})"

    @staticmethod
    def _bool_like(x) -> bool:
        return isinstance(x, (In, Between, Like, Is, Differs, Exists)) or isinstance(x, Binary) and x.op in ("AND", "OR", *_FLIPPED) or isinstance(x, Unary) and x.op == "NOT" or isinstance(x, Lit) and x.kind in ("int", "bool")

    def moved(self, x, other, op: str, scope) -> str | None:
        """x + 5 > 3 as x > -2: constants move across, so the addition can't overflow and the scan can be pruned."""
        whole = lambda e: int(e.text) if isinstance(e, Lit) and e.kind == "int" else -int(e.x.text) if isinstance(e, Unary) and e.op == "-" and isinstance(e.x, Lit) and e.x.kind == "int" else None
        d = whole(other)
        if d is None or not (isinstance(x, Binary) and x.op in ("+", "-")):
            return None
        a, b = whole(x.a), whole(x.b)
        if isinstance(x.a, Col) and b is not None:
            column, value = x.a, d - b if x.op == "+" else d + b
        elif isinstance(x.b, Col) and a is not None:
            column, value, op = x.b, d - a if x.op == "+" else a - d, op if x.op == "+" else _FLIPPED[op]
        else:
            return None
        if self.kind(column, scope) != "int" or not -(1 << 63) < value < 1 << 63:
            return None
        return f"({self.text(column, scope)} {op} {f'-{self._lit(Lit("int", str(-value)), scope)}' if value < 0 else self._lit(Lit('int', str(value)), scope)})"

    def _cast(self, x: Cast, scope) -> str:
        text, to, kind = self.text(x.x, scope), spark_type(x.type), self.kind(x.x, scope)
        cast = "try_cast" if x.may_fail or self.trying else "CAST"
        exact = to in WHOLE or to.startswith("DECIMAL") and to.endswith(",0)")
        if exact and kind == "double":
            return f"{cast}(rint({text}) AS {to})" if to in WHOLE else f"{cast}(bround(CAST({text} AS DECIMAL(38,10)), 0) AS {to})" if not x.may_fail else f"try_cast(rint({text}) AS {to})"
        if exact and kind == "decimal":
            return f"{cast}(round({text}, 0) AS {to})"
        if exact and kind == "text":
            return f"{cast}({'text_to_int' if cast == 'try_cast' else 'text_to_int_strictly'}({text}) AS {to})"
        if to == "STRING":
            if kind == "struct":
                raise PlanError("a struct can't be cast to text")
            if kind == "timestamp":
                return f"concat(CAST({text} AS STRING), '+00')" if isinstance(self.type_of(x.x, scope), T.TimestampType) else f"timestamp_text({text})"
            if kind == "blob":
                return f"decode({text}, 'UTF-8')"
        return f"{cast}({text} AS {to})"

    def _case(self, x: Case, scope) -> str:
        out = "CASE" + (f" {self.text(x.of, scope)}" if x.of is not None else "")
        for test, then in x.whens:
            out += f" WHEN {self.text(test, scope)} THEN {self.text(then, scope)}"
        return out + (f" ELSE {self.text(x.other, scope)}" if x.other is not None else "") + " END"

    def condition(self, x, scope) -> str:
        """What rows must meet: tests by IN (SELECT ...) that stand alone become joins, for which null is false."""
        if isinstance(x, Binary) and x.op == "AND":
            return f"({self.condition(x.a, scope)} AND {self.condition(x.b, scope)})"
        if isinstance(x, Unary) and x.op == "NOT" and isinstance(x.x, In):
            return self.condition(replace(x.x, negate=not x.x.negate), scope)
        if isinstance(x, In) and isinstance(x.items, Query):
            return f"({self.text(x.x, scope)} {'NOT ' if x.negate else ''}IN ({self.query(x.items, scope)}))"
        return self.text(x, scope)

    def _in(self, x: In, scope) -> str:
        value = self.text(x.x, scope)
        if isinstance(x.items, Query):
            # As a value, Spark answers false where SQL says null.
            inner = self.query(x.items, scope)
            if isinstance(x.x, Row) or self.spark is None or not self.stands_alone(inner):
                return f"({value} {'NOT ' if x.negate else ''}IN ({inner}))"
            nulls = f"EXISTS (SELECT 1 FROM ({inner}) AS _v(_c) WHERE _c IS NULL) OR {value} IS NULL AND EXISTS (SELECT 1 FROM ({inner}))"
            return f"(CASE WHEN {value} IN ({inner}) THEN {'FALSE' if x.negate else 'TRUE'} WHEN {nulls} THEN NULL ELSE {'TRUE' if x.negate else 'FALSE'} END)"
        return f"({value} {'NOT ' if x.negate else ''}IN ({', '.join(self.text(i, scope) for i in x.items)}))"

    def stands_alone(self, text: str) -> bool:
        level, _log.level = _log.level, logging.CRITICAL
        try:
            return self.columns(text) is not None
        except Exception:  # it names columns of the query around it
            return False
        finally:
            _log.level = level

    def _between(self, x: Between, scope) -> str:
        return f"({self.text(x.x, scope)} {'NOT ' if x.negate else ''}BETWEEN {self.text(x.low, scope)} AND {self.text(x.high, scope)})"

    def _like(self, x: Like, scope) -> str:
        no = "NOT " if x.negate else ""
        if x.op == "SIMILAR":
            return f"({no}regexp_full_match({self.text(x.x, scope)}, {self.text(x.pattern, scope)}))"
        # DuckDB has no escape character unless one is named; Spark's is the backslash.
        escape = self.text(x.escape, scope) if x.escape is not None else None
        pattern = self.text(x.pattern, scope)
        if escape is None and not (isinstance(x.pattern, Lit) and "\\" not in x.pattern.text):
            pattern = f"replace({pattern}, '\\\\', '\\\\\\\\')"
        return f"({self.text(x.x, scope)} {no}{x.op} {pattern}{f' ESCAPE {escape}' if escape else ''})"

    def _is(self, x: Is, scope) -> str:
        if x.what == "null" and isinstance(x.x, Cast) and spark_type(x.x.type) == "DECIMAL(38,0)" and x.x.may_fail and self.kind(x.x.x, scope) == "text":
            # Numbers of 39 digits have no room here, but they are no null either.
            return f"({'' if x.negate else 'NOT '}coalesce(text_is_hugeint({self.text(x.x.x, scope)}), false))"
        return f"({self.text(x.x, scope)} IS {'NOT ' if x.negate else ''}{x.what.upper()})"

    def _differs(self, x: Differs, scope) -> str:
        return f"({self.text(x.a, scope)} IS {'NOT ' if x.negate else ''}DISTINCT FROM {self.text(x.b, scope)})"

    def _exists(self, x: Exists, scope) -> str:
        return f"EXISTS ({self.query(x.query, scope)})"

    def _sub(self, x: Sub, scope) -> str:
        return f"({self.query(x.query, scope)})"

    def _row(self, x: Row, scope) -> str:
        return f"({', '.join(self.text(i, scope) for i in x.items)})"

    def _listof(self, x: ListOf, scope) -> str:
        return f"array({', '.join(self.text(i, scope) for i in x.items)})"

    def _comprehension(self, x: Comprehension, scope) -> str:
        inner = self.inside(scope, [x.name])
        source = self.text(x.source, scope)
        if x.test is not None:
            source = f"filter({source}, {ident(x.name)} -> {inlined(self.text(x.test, inner))})"
        return f"transform({source}, {ident(x.name)} -> {inlined(self.text(x.of, inner))})"

    def inside(self, scope: Scope | None, names_: list[str]) -> Scope:
        scope = scope or Scope()
        return replace(scope, variables=scope.variables | {n.lower() for n in names_})

    def _structof(self, x: StructOf, scope) -> str:
        return "named_struct(" + ", ".join(f"{quoted(k)}, {self.text(v, scope)}" for k, v in x.items) + ")"

    def _mapof(self, x: MapOf, scope) -> str:
        return "map(" + ", ".join(f"{self.text(k, scope)}, {self.text(v, scope)}" for k, v in x.items) + ")"

    def _field(self, x: Field, scope) -> str:
        return f"{self.text(x.x, scope)}.{ident(x.name)}"

    def _lambda(self, x: Lambda, scope) -> str:
        names_ = ident(x.names[0]) if len(x.names) == 1 else f"({', '.join(map(ident, x.names))})"
        return f"{names_} -> {inlined(self.text(x.body, self.inside(scope, x.names)))}"

    def _index(self, x: Index, scope) -> str:
        kind, of, at = self.kind(x.x, scope), self.text(x.x, scope), self.text(x.at, scope)
        if kind == "map":
            return f"try_element_at({of}, {at})"
        if kind == "text":
            return f"duck_substring({of}, {at}, 1)"
        if kind == "struct":
            return f"{of}.{ident(x.at.text)}" if isinstance(x.at, Lit) and x.at.kind == "text" else f"{of}.{ident('col' + x.at.text)}"
        if isinstance(x.at, Lit) and x.at.kind == "text":
            return f"try_element_at({of}, {at})"
        whole = at if isinstance(x.at, (Lit, Unary)) else f"CAST({at} AS INT)"
        if isinstance(x.at, Lit) and int(x.at.text) == 0:
            return f"get({of}, -1)"
        if isinstance(x.at, (Lit, Unary)):
            return f"try_element_at({of}, {whole})"
        return f"CASE WHEN {whole} <> 0 THEN try_element_at({of}, CASE WHEN {whole} = 0 THEN 1 ELSE {whole} END) END"

    def _slice(self, x: Slice, scope) -> str:
        of = self.text(x.x, scope)
        low = self.text(x.low, scope) if x.low is not None else "1"
        high = self.text(x.high, scope) if x.high is not None else "-1"
        size = f"length({of})" if self.kind(x.x, scope) == "text" else f"size({of})"
        first = f"CAST(greatest(CASE WHEN {low} < 0 THEN {size} + {low} + 1 ELSE {low} END, 1) AS INT)"
        last = f"CAST(CASE WHEN {high} < 0 THEN {size} + {high} + 1 ELSE least({high}, {size}) END AS INT)"
        take = "substring" if size.startswith("length") else "slice"
        return f"{take}({of}, {first}, greatest({last} - {first} + 1, 0))"

    def window(self, w: Window | str, scope: Scope) -> str:
        if isinstance(w, str):
            return ident(w)
        parts = [ident(w.base)] if w.base else []
        if w.keys:
            parts.append("PARTITION BY " + ", ".join(self.text(k, scope) for k in w.keys))
        if w.order:
            parts.append(self.order_by(w.order, scope).strip())
        if w.frame:
            ends = [b if isinstance(b, str) else f"{self.text(b[0], scope)} {b[1]}" for b in w.bounds]
            parts.append(f"{w.frame} BETWEEN {ends[0]} AND {ends[1]}")
        return f"({' '.join(parts)})"

    # Functions
    def _call(self, x: Call, scope) -> str:
        if x.name in REFUSED:
            raise NotAllowed(f"function {x.name} isn't allowed")
        if x.name in AGGREGATES or x.over is not None:
            return self.aggregate(x, scope)
        made = getattr(self, f"f_{x.name}", None)
        if made is not None:
            return made(x, scope)
        args = [self.text(a, scope) for a in x.args]
        if x.name in _LAMBDAS:
            return f"{_LAMBDAS[x.name]}({', '.join(args)})"
        if x.name in _BIGS:
            return self.sized(x, args, scope)
        part = PARTS.get(x.name, x.name)
        if (x.name in PARTS or x.name in _PART_SQL or x.name in ("epoch", "epoch_ms", "epoch_us")) and len(args) == 1:
            return self.part(part, args[0])
        name = RENAMED.get(x.name, x.name)
        if x.name not in SAME and x.name not in RENAMED and x.name not in self.functions and self.known is not None and name not in self.known:
            raise NotAllowed(f"function {x.name} isn't allowed")
        return f"{name}({', '.join(args)})"

    #: Names that pass as they are, besides those above: DuckDB's functions as SQL functions.
    known: frozenset | None = frozenset({"duck_split_regex", "duck_unhex", "raise_error", "make_date", "map_from_entries", "power", "ltrim", "rtrim", "position", "space", "arrays_overlap", "now"})

    def sized(self, x: Call, args: list[str], scope) -> str:
        kind = self.kind(x.args[0], scope) if x.args else None
        if x.name in ("len", "length", "array_length", "cardinality"):
            if kind in ("list", "map") or x.name in ("array_length", "cardinality"):
                return f"CAST(CASE WHEN {args[0]} IS NOT NULL THEN size({args[0]}) END AS BIGINT)"
            return f"CAST(length({args[0]}) AS BIGINT)"
        name = {"char_length": "length", "character_length": "length", "unicode": "ascii", "ord": "ascii"}.get(x.name, x.name)
        return f"CAST({name}({', '.join(args)}) AS BIGINT)"

    def part(self, part: str, t: str) -> str:
        if part == "epoch":
            return f"epoch_of(CAST({t} AS TIMESTAMP))"
        if part == "epoch_ms":
            return f"(unix_micros(CAST({t} AS TIMESTAMP)) DIV 1000)"
        if part == "epoch_us":
            return f"unix_micros(CAST({t} AS TIMESTAMP))"
        if part not in _PART_SQL:
            raise PlanError(f"the part {part} of a date isn't supported")
        return f"CAST({_PART_SQL[part].format(t=t)} AS BIGINT)"

    @staticmethod
    def constant(x, what: str) -> str:
        if not isinstance(x, Lit):
            raise PlanError(f"{what} must be a constant")
        return x.text

    def f_date_part(self, x, scope):
        part = self.constant(x.args[0], "the part").lower()
        return self.part(PARTS.get(part, part), self.text(x.args[1], scope))

    f_datepart = f_date_part

    def f_date_trunc(self, x, scope):
        part = self.constant(x.args[0], "the part").lower()
        text = f"date_trunc({quoted(PARTS.get(part, part).upper())}, {self.text(x.args[1], scope)})"
        return text if isinstance(self.type_of(x.args[1], scope), T.TimestampType) else f"CAST({text} AS TIMESTAMP_NTZ)"

    f_datetrunc = f_date_trunc

    def f_date_diff(self, x, scope):
        part = self.constant(x.args[0], "the part").lower()
        part = PARTS.get(part, part)
        if part not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond", "decade", "century"):
            raise PlanError(f"the part {part} of a date isn't supported")
        a, b = (f"CAST({self.text(e, scope)} AS TIMESTAMP)" for e in x.args[1:])
        return f"date_diff_{part}s({a}, {b})"

    f_datediff = f_date_diff

    def f_strftime(self, x, scope):
        t, fmt = x.args if not (isinstance(x.args[0], Lit) and x.args[0].kind == "text") else x.args[::-1]
        try:
            return strftime(self.text(t, scope), self.constant(fmt, "the format"))
        except ValueError as e:
            raise PlanError(str(e)) from e

    def f_to_timestamp(self, x, scope):
        return f"timestamp_micros(CAST(CAST({self.text(x.args[0], scope)} AS DECIMAL(30,6)) * 1000000 AS BIGINT))"

    def f_make_timestamp(self, x, scope):
        if len(x.args) == 1:
            return f"CAST(timestamp_micros({self.text(x.args[0], scope)}) AS TIMESTAMP_NTZ)"
        return f"make_timestamp_ntz({', '.join(self.text(a, scope) for a in x.args)})"

    def f_now(self, x, scope):
        return "current_timestamp()"

    f_current_timestamp = f_get_current_timestamp = f_transaction_timestamp = f_now

    def f_typeof(self, x, scope):
        from ..sources.tables import duck_name

        found = self.type_of(x.args[0], scope)
        if found is None:
            raise PlanError("the type can't be told here")
        return quoted('"NULL"' if isinstance(found, T.NullType) else duck_name(found))

    def f_try(self, x, scope):
        held, self.trying = self.trying, True
        try:
            return self.text(x.args[0], scope)
        finally:
            self.trying = held

    def f_error(self, x, scope):
        return "NULL" if self.trying else f"raise_error({self.text(x.args[0], scope)})"

    def f_from_hex(self, x, scope):
        return f"{'unhex' if self.trying else 'duck_unhex'}({self.text(x.args[0], scope)})"

    f_unhex = f_from_hex

    def f_concat(self, x, scope):
        args = [self.text(a, scope) for a in x.args]
        if any(self.kind(a, scope) == "list" for a in x.args):
            return f"concat({', '.join(args)})"
        return f"concat_ws('', {', '.join(args)})"  # nulls are passed over

    def f_hex(self, x, scope):
        kind, text = self.kind(x.args[0], scope), self.text(x.args[0], scope)
        return f"hex_of_wide({text})" if kind == "wide" else f"hex({text})"

    f_to_hex = f_hex

    def f_encode(self, x, scope):
        return f"encode({self.text(x.args[0], scope)}, 'UTF-8')"

    def f_decode(self, x, scope):
        return f"decode({self.text(x.args[0], scope)}, 'UTF-8')"

    def f_octet_length(self, x, scope):
        return f"CAST(octet_length({self.text(x.args[0], scope)}) AS BIGINT)"

    f_strlen = f_octet_length

    def f_sha256(self, x, scope):
        return f"sha2({self.text(x.args[0], scope)}, 256)"

    def f_sha1(self, x, scope):
        return f"sha1({self.text(x.args[0], scope)})"

    def f_substring(self, x, scope):
        s, at, *n = (self.text(a, scope) for a in x.args)
        return f"duck_substring({s}, {at}, {n[0]})" if n else f"duck_substring_from({s}, {at})"

    f_substr = f_substring

    def f_left(self, x, scope):
        s, n = (self.text(a, scope) for a in x.args)
        return f"substring({s}, 1, CAST(CASE WHEN {n} < 0 THEN greatest(length({s}) + {n}, 0) ELSE {n} END AS INT))"

    def f_right(self, x, scope):
        s, n = (self.text(a, scope) for a in x.args)
        return f"right({s}, CAST(CASE WHEN {n} < 0 THEN greatest(length({s}) + {n}, 0) ELSE {n} END AS INT))"

    def f_trim(self, x, scope):
        s, *c = (self.text(a, scope) for a in x.args)
        return f"trim(BOTH {c[0]} FROM {s})" if c else f"trim({s})"

    def f_ltrim(self, x, scope):
        s, *c = (self.text(a, scope) for a in x.args)
        return f"trim(LEADING {c[0]} FROM {s})" if c else f"ltrim({s})"

    def f_rtrim(self, x, scope):
        s, *c = (self.text(a, scope) for a in x.args)
        return f"trim(TRAILING {c[0]} FROM {s})" if c else f"rtrim({s})"

    def f_lpad(self, x, scope):
        s, n, p = (self.text(a, scope) for a in x.args)
        return f"{x.name}({s}, CAST({n} AS INT), {p})"

    f_rpad = f_lpad

    def f_repeat(self, x, scope):
        s, n = (self.text(a, scope) for a in x.args)
        return f"repeat({s}, CAST({n} AS INT))" if self.kind(x.args[0], scope) != "list" else f"flatten(array_repeat({s}, CAST({n} AS INT)))"

    def f_chr(self, x, scope):
        return f"chr(CAST({self.text(x.args[0], scope)} AS INT))"

    def f_split_part(self, x, scope):
        s, d, n = (self.text(a, scope) for a in x.args)
        return f"duck_split_part({s}, {d}, CAST({n} AS INT))"

    def f_string_split(self, x, scope):
        return f"string_split({', '.join(self.text(a, scope) for a in x.args)})"

    f_str_split = f_string_to_array = f_split = f_string_split

    def f_contains(self, x, scope):
        a, b = (self.text(e, scope) for e in x.args)
        return f"{'array_contains' if self.kind(x.args[0], scope) == 'list' else 'map_contains_key' if self.kind(x.args[0], scope) == 'map' else 'contains'}({a}, {b})"

    @staticmethod
    def flagged(pattern: str, flags: str) -> str:
        """The pattern with DuckDB's options as Java spells them; a dot passes line ends unless n is among them."""
        on = "".join(f for f in "is" if f in flags) + ("m" if "m" in flags or "n" in flags or "p" in flags else "")
        return f"concat('(?{on})', {pattern})" if on else pattern

    def pattern(self, x, scope, at: int) -> tuple[str, str]:
        flags = self.constant(x.args[at], "the options") if len(x.args) > at else ""
        return self.flagged(self.text(x.args[1], scope), flags), flags

    def f_regexp_replace(self, x, scope):
        pattern, flags = self.pattern(x, scope, 3)
        to = x.args[2]
        if isinstance(to, Lit):
            said = quoted(re.sub(r"\\(\d)", r"$\1", re.sub(r"\$", r"\\$", to.text)))
        else:
            said = f"regexp_replace(replace({self.text(to, scope)}, '$', '\\\\$'), '\\\\\\\\([0-9])', '\\$$1')"
        return f"{'regexp_replace' if 'g' in flags else 'regexp_replace_first'}({self.text(x.args[0], scope)}, {pattern}, {said})"

    def f_regexp_matches(self, x, scope):
        return f"({self.text(x.args[0], scope)} RLIKE {self.pattern(x, scope, 2)[0]})"

    f_regexp_like = f_regexp_matches

    def f_regexp_full_match(self, x, scope):
        return f"regexp_full_match({self.text(x.args[0], scope)}, {self.pattern(x, scope, 2)[0]})"

    def f_regexp_extract(self, x, scope):
        group = self.text(x.args[2], scope) if len(x.args) > 2 else "0"
        return f"regexp_extract({self.text(x.args[0], scope)}, {self.pattern(x, scope, 3)[0]}, {group})"

    def f_regexp_extract_all(self, x, scope):
        group = self.text(x.args[2], scope) if len(x.args) > 2 else "0"
        return f"regexp_extract_all({self.text(x.args[0], scope)}, {self.pattern(x, scope, 3)[0]}, {group})"

    def f_printf(self, x, scope):
        fmt = self.constant(x.args[0], "the format").replace("%i", "%d")
        codes = [m[0] for m in re.finditer(r"%%|%[-+ 0#,]*\d*(?:\.\d+)?[a-zA-Z]", fmt) if m[0] != "%%"]
        if len(codes) != len(x.args) - 1:
            raise PlanError("printf has other numbers of codes and values")
        parts = [self.rounded(a, c, scope) for a, c in zip(x.args[1:], codes, strict=True)]
        return f"printf({', '.join([quoted(fmt), *parts])})"

    def rounded(self, x, code: str, scope) -> str:
        """A value for a code such as %.2f: ties go to the even digit, as C has it."""
        digits = re.search(r"(?:\.(\d+))?[fF]$", code)
        if not digits or self.kind(x, scope) not in ("double", "decimal", None):
            return self.text(x, scope)
        n, text = int(digits[1] or 6), self.text(x, scope)
        return f"coalesce(CAST(bround(try_cast({text} AS DECIMAL(38,15)), {n}) AS DOUBLE), CAST({text} AS DOUBLE))" if n < 15 else text

    def f_format(self, x, scope):
        """format('{} {:05d} {1}', ...): places by order or number, with the part of the specification that printf has."""
        fmt, parts, at, out = self.constant(x.args[0], "the format"), [], 0, ""
        for m in re.finditer(r"\{\{|\}\}|\{(\d*)(?::([^{}]*))?\}|%", fmt):
            out += fmt[at : m.start()]
            at = m.end()
            if m[0] in ("{{", "}}", "%"):
                out += {"{{": "{", "}}": "}", "%": "%%"}[m[0]]
                continue
            k = int(m[1]) if m[1] else len(parts)
            if k + 1 >= len(x.args):
                raise PlanError("format has too few values")
            arg, spec = x.args[k + 1], m[2] or ""
            if not spec:
                out += "%s"
                parts.append(self.shown(arg, scope))
                continue
            found = re.fullmatch(r"([<>]?)([+0]?)(\d*)(,?)(\.\d+)?([dxXfesg]?)", spec)
            if not found:
                raise PlanError(f"the format {spec!r} isn't supported")
            side, sign, width, comma, digits, code = found.groups()
            code = code or ("s" if self.kind(arg, scope) == "text" else "d" if self.kind(arg, scope) == "int" else "f" if digits else "s")
            left = "-" if width and (side == "<" or not side and code == "s") else ""
            out += f"%{left}{sign}{comma}{width}{digits or ''}{code}"
            parts.append(self.rounded(arg, f"{digits or ''}{code}", scope) if code != "s" else self.shown(arg, scope))
        out += fmt[at:]
        return f"printf({', '.join([quoted(out), *parts])})"

    def shown(self, x, scope) -> str:
        return self.text(Cast(x, "VARCHAR"), scope) if self.kind(x, scope) != "text" else self.text(x, scope)

    # Numbers
    def f_round(self, x, scope):
        args = [self.text(a, scope) for a in x.args]
        return f"round({', '.join(args)})"

    def f_floor(self, x, scope):
        text = f"{'ceil' if x.name.startswith('ceil') else 'floor'}({self.text(x.args[0], scope)})"
        return f"CAST({text} AS DOUBLE)" if self.kind(x.args[0], scope) == "double" else text

    f_ceil = f_ceiling = f_floor

    def f_trunc(self, x, scope):
        text, kind = self.text(x.args[0], scope), self.kind(x.args[0], scope)
        return f"(CASE WHEN {text} < 0 THEN ceil({text}) ELSE floor({text}) END)" if kind != "double" else f"CAST(CASE WHEN {text} < 0 THEN ceil({text}) ELSE floor({text}) END AS DOUBLE)"

    def f_sign(self, x, scope):
        return f"CAST(signum({self.text(x.args[0], scope)}) AS TINYINT)"

    def f_log(self, x, scope):
        args = [self.text(a, scope) for a in x.args]
        return f"log10({args[0]})" if len(args) == 1 else f"log({args[0]}, {args[1]})"

    def f_power(self, x, scope):
        return f"power({', '.join(f'CAST({self.text(a, scope)} AS DOUBLE)' for a in x.args)})"

    f_pow = f_power

    def f_xor(self, x, scope):
        a, b = (self.text(e, scope) for e in x.args)
        return f"({a} ^ {b})"

    def f_divide(self, x, scope):
        return self.text(Binary("//", *x.args), scope)

    def f_mod(self, x, scope):
        return self.text(Binary("%", *x.args), scope)

    f_fmod = f_mod

    # Lists, structs, maps
    def f_list_value(self, x, scope):
        return self.text(ListOf(x.args), scope)

    f_list_pack = f_list_value

    def f_struct_pack(self, x, scope):
        return self.text(StructOf(x.named), scope)

    def f_row(self, x, scope):
        return f"struct({', '.join(self.text(a, scope) for a in x.args)})"

    def f_struct_extract(self, x, scope):
        return self.text(Field(x.args[0], self.constant(x.args[1], "the field")), scope)

    def f_list_extract(self, x, scope):
        return self.text(Index(*x.args), scope)

    f_array_extract = f_list_element = f_list_extract

    def f_list_slice(self, x, scope):
        return self.text(Slice(*x.args[:3]), scope)

    f_array_slice = f_list_slice

    def f_list_append(self, x, scope):
        a, b = (self.text(e, scope) for e in x.args)
        return f"concat(coalesce({a}, array()), array({b}))"

    f_array_append = f_array_push_back = f_list_append

    def f_list_prepend(self, x, scope):
        a, b = (self.text(e, scope) for e in x.args)
        return f"concat(array({a}), coalesce({b}, array()))"

    def f_array_prepend(self, x, scope):
        return self.f_list_prepend(x, scope)

    f_array_push_front = f_array_prepend

    def f_list_position(self, x, scope):
        a, b = (self.text(e, scope) for e in x.args)
        return f"CAST(nullif(array_position({a}, {b}), 0) AS INT)"

    f_list_indexof = f_array_position = f_array_indexof = f_list_position

    def f_list_sort(self, x, scope):
        down = len(x.args) > 1 and self.constant(x.args[1], "the direction").lower() == "desc"
        first = len(x.args) > 2 and "first" in self.constant(x.args[2], "the place of nulls").lower()
        return self.sorted_list(self.text(x.args[0], scope), down, first)

    f_array_sort = f_list_sort

    def f_list_reverse_sort(self, x, scope):
        first = len(x.args) > 1 and "first" in self.constant(x.args[1], "the place of nulls").lower()
        return self.sorted_list(self.text(x.args[0], scope), True, first)

    f_array_reverse_sort = f_list_reverse_sort

    @staticmethod
    def sorted_list(text: str, down: bool, first: bool) -> str:
        if first:
            return f"sort_array({text})" if not down else f"reverse(array_sort({text}))"
        return f"sort_array({text}, false)" if down else f"array_sort({text})"

    def f_list_reduce(self, x, scope):
        """From the first element, or from a start; a list without elements is refused."""
        of, fold = self.text(x.args[0], scope), x.args[1]
        step = self.text(fold, scope)
        if len(x.args) > 2:
            start, found = self.text(x.args[2], scope), self.type_of(x.args[0], scope)
            if isinstance(found, T.ArrayType) and self.kind(x.args[2], scope) == "int" and isinstance(found.elementType, T.NumericType):
                start = f"CAST({start} AS {found.elementType.simpleString()})"
            return f"aggregate({of}, {start}, {step})"
        first = f"CASE WHEN size({of}) = 0 THEN raise_error('list_reduce over an empty list') ELSE try_element_at({of}, 1) END"
        return f"aggregate(slice({of}, 2, greatest(size({of}) - 1, 0)), {first}, {step})"

    f_array_reduce = f_reduce = f_list_reduce

    def f_range(self, x, scope):
        args = [self.text(a, scope) for a in x.args]
        start, stop, step = ("0", args[0], "1") if len(args) == 1 else (*args, "1")[:3]
        if x.name == "generate_series":
            return f"CASE WHEN ({stop} - {start}) * {step} >= 0 THEN sequence({start}, {stop}, {step}) ELSE array() END"
        return f"CASE WHEN ({stop} - {start}) * {step} > 0 THEN filter(sequence({start}, {stop}, {step}), v -> v <> {stop}) ELSE array() END"

    f_generate_series = f_range

    def f_unnest(self, x, scope):
        return f"explode({self.text(x.args[0], scope)})"

    def f_map(self, x, scope):
        return f"map_from_arrays({', '.join(self.text(a, scope) for a in x.args)})" if x.args else "map()"

    def f_map_extract(self, x, scope):
        m, k = (self.text(a, scope) for a in x.args)
        return f"CASE WHEN map_contains_key({m}, {k}) THEN array({m}[{k}]) ELSE array() END"

    # JSON
    def path(self, x, scope) -> str:
        """A path for Spark's functions; keys and places stand for themselves."""
        if isinstance(x, Unary) and isinstance(x.x, Lit):
            x = Lit("int", f"-{x.x.text}")
        if not isinstance(x, Lit):
            raise PlanError("a path must be a constant")
        if x.kind == "int":
            return f"$[{x.text}]"
        text = x.text
        if text.startswith("/"):
            return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in text[1:].split("/"))
        if not text.startswith("$"):
            return f"$['{text}']"
        return re.sub(r'\."([^"]*)"', r"['\1']", text)

    def json_at(self, j, path, as_text: bool, scope) -> str:
        text, at = self.text(j, scope), self.path(path, scope)
        back = re.fullmatch(r"(.*)\[(?:#-|-)(\d+)\]", at)
        if back:  # places from the end: the list is read as such
            whole = f"from_json({self.json_text(text, back[1], False)}, 'ARRAY<VARIANT>')"
            item = f"try_element_at({whole}, -{back[2]})"
            return f"CAST({item} AS STRING)" if as_text else f"to_json({item})"
        return self.json_text(text, at, as_text)

    def json_text(self, text: str, at: str, as_text: bool) -> str:
        return f"{'json_string' if as_text else 'json_value'}{'_or_null' if self.trying else ''}({text}, {quoted(at)})"

    def f_json_extract(self, x, scope):
        return self.json_at(x.args[0], x.args[1], False, scope)

    def f_json_extract_string(self, x, scope):
        return self.json_at(x.args[0], x.args[1], True, scope)

    f_json_extract_path, f_json_extract_path_text = f_json_extract, f_json_extract_string

    def f_json_type(self, x, scope):
        at = self.path(x.args[1], scope) if len(x.args) > 1 else "$"
        return f"json_type_at{'_or_null' if self.trying else ''}({self.text(x.args[0], scope)}, {quoted(at)})"

    def f_json_valid(self, x, scope):
        text = self.text(x.args[0], scope)
        return f"CASE WHEN {text} IS NOT NULL THEN try_parse_json({text}) IS NOT NULL END"

    def f_json_array_length(self, x, scope):
        at = self.path(x.args[1], scope) if len(x.args) > 1 else "$"
        return f"CAST(coalesce(json_array_length(get_json_object({self.text(x.args[0], scope)}, {quoted(at)})), 0) AS BIGINT)"

    def f_json_keys(self, x, scope):
        return f"json_object_keys({self.text(x.args[0], scope)})"

    def f_from_json(self, x, scope):
        def shape(v) -> str:
            if isinstance(v, dict):
                return "STRUCT<" + ", ".join(f"{ident(k)}: {shape(s)}" for k, s in v.items()) + ">"
            if isinstance(v, list):
                return f"ARRAY<{shape(v[0])}>"
            return spark_type(v.upper())

        try:
            want = json.loads(self.constant(x.args[1], "the structure"))
        except ValueError as e:
            raise PlanError("the structure isn't JSON") from e
        return f"from_json({self.text(x.args[0], scope)}, {quoted(shape(want))})"

    f_json_transform = f_from_json

    def f_to_json(self, x, scope):
        text, kind = self.text(x.args[0], scope), self.kind(x.args[0], scope)
        if kind in ("struct", "list", "map", None):
            return f"to_json({text}, map('ignoreNullFields', 'false'))"
        return f"regexp_extract(to_json(named_struct('v', {text}), map('ignoreNullFields', 'false')), '(?s)^.\"v\":(.*).$', 1)"

    # Aggregates and windows
    def aggregate(self, x: Call, scope) -> str:
        name = {"mean": "avg", "arbitrary": "any_value", "max_by": "arg_max", "min_by": "arg_min", "argmax": "arg_max", "argmin": "arg_min", "array_agg": "list", "group_concat": "string_agg", "listagg": "string_agg", "countif": "count_if", "sum_no_overflow": "sum", "quantile": "quantile_disc"}.get(x.name, x.name)
        args, where = list(x.args), x.where
        if name == "count_star":
            name, args = "count", [Star()]
        if x.name in AGGREGATES and name not in ("sum",) or name == "sum" and args and not self.text_summed(args[0], scope):
            args = [self.guarded(a, name, scope) for a in args]
        if where is not None and x.over is not None:
            # Spark has no FILTER on windows.
            args = [Case(None, [(where, Lit("int", "1") if isinstance(a, Star) else a)], None) for a in (args or [Star()])][:1] + args[1:]
            where = None
        tail = (f" FILTER (WHERE {self.text(where, scope)})" if where is not None else "")
        over = f" OVER {self.window(x.over, scope)}" if x.over is not None else ""
        nulls = f" {x.nulls} NULLS" if x.nulls else ""
        distinct = "DISTINCT " if x.distinct else ""
        if over and x.order:
            raise PlanError("an ordered aggregate over a window isn't supported")
        one = lambda *parts: f"{name}({distinct}{', '.join(parts)}){nulls}{tail}{over}"
        if name in _RANKS:
            return f"CAST({one(*[self.text(a, scope) for a in args])} AS BIGINT)"
        if name == "sum" and self.text_summed(args[0], scope):
            return f"sum({distinct}text_to_wide({self.text(args[0].x, scope)})){tail}{over}"
        kind = self.kind(args[0], scope) if args and name in ("sum", "avg") else None
        if name == "sum":
            text = self.text(args[0], scope)
            if kind == "bool":
                text = f"CAST({text} AS INT)"
            return f"sum({distinct}{f'CAST({text} AS DECIMAL(38,0))' if kind in ('int', 'wide', 'bool') else text}){tail}{over}"
        if name == "fsum":
            return f"sum({distinct}CAST({self.text(args[0], scope)} AS DOUBLE)){tail}{over}"
        if name == "avg" and kind in ("int", "wide", "decimal"):
            text = self.text(args[0], scope)
            total = f"CAST({text} AS DECIMAL(38,0))" if kind != "decimal" else text
            return f"(CAST(sum({distinct}{total}){tail}{over} AS DOUBLE) / CAST(count({distinct}{text}){tail}{over} AS DOUBLE))"
        if name == "count":
            if not args or isinstance(args[0], Star):
                return f"count(*){tail}{over}"
            if isinstance(args[0], Row):
                return f"count({distinct}struct({', '.join(self.text(a, scope) for a in args[0].items)})){tail}{over}"
            return one(*[self.text(a, scope) for a in args])
        if name in ("first_value", "last_value", "nth_value", "lag", "lead") and over:
            if name == "last_value" and x.nulls == "IGNORE" or name in ("first_value", "nth_value", "lag", "lead", "last_value"):
                parts = [self.text(a, scope) for a in args]
                if name in ("lag", "lead") and len(parts) > 1 or name == "nth_value":
                    parts[1] = f"CAST({parts[1]} AS INT)" if not isinstance(args[1], (Lit, Unary)) else parts[1]
                return f"{name}({', '.join(parts)}){nulls}{over}"
        if name in ("first", "last", "first_value", "last_value", "any_value") and not over:
            return self.picked(name, args[0], x, tail, scope)
        if name in ("first", "last") and over:
            return f"{name}_value({self.text(args[0], scope)}){nulls}{over}"
        if name == "nth_value":
            listed = self.listed(args[0], x, tail, scope)
            return f"try_element_at({listed}, {self.text(args[1], scope)})"
        if name in ("arg_max", "arg_min"):
            value, by = self.text(args[0], scope), self.text(args[1], scope)
            return f"{'max_by' if name == 'arg_max' else 'min_by'}({value}, CASE WHEN {value} IS NOT NULL THEN {by} END){tail}{over}"
        if name == "list":
            listed = self.listed(args[0], x, tail, scope, over)
            return f"nullif({listed}, array())"
        if name == "string_agg":
            sep = self.text(args[1], scope) if len(args) > 1 else "','"
            value = self.text(args[0], scope)
            if over:
                return f"nullif(array_join(collect_list({value}){over}, {sep}), '')"
            order = f" WITHIN GROUP ({self.order_by(x.order, scope).strip()})" if x.order else ""
            return f"listagg({distinct}{value}, {sep}){order}{tail}"
        if name in ("quantile_cont", "quantile_disc", "percentile_cont", "percentile_disc"):
            kind = "cont" if name.endswith("cont") else "disc"
            value, share = (x.order[0].x, args[0]) if x.order else (args[0], args[1])
            return f"percentile_{kind}({self.text(share, scope)}) WITHIN GROUP (ORDER BY {self.text(value, scope)}){tail}{over}"
        if name == "count_if":
            return f"count(CASE WHEN {self.text(args[0], scope)} THEN 1 END){tail}{over}"
        if name == "product":
            raise NotAllowed("function product isn't allowed")
        if name not in SAME and name not in AGGREGATES and name not in self.functions:
            raise NotAllowed(f"function {name} isn't allowed")
        return one(*[self.text(a, scope) for a in args])

    def text_summed(self, x, scope) -> bool:
        """sum(TRY_CAST(text AS a whole type)) sums the true numbers, however wide."""
        if not (isinstance(x, Cast) and x.may_fail):
            return False
        to = spark_type(x.type)
        return (to in WHOLE or to.startswith("DECIMAL") and to.endswith(",0)")) and self.kind(x.x, scope) == "text"

    def guarded(self, x, name: str, scope):
        """x, in which a TRY_CAST that drops a value refuses: an aggregate would leave it out in silence."""
        if isinstance(x, Cast) and x.may_fail:
            to = spark_type(x.type)
            if to in WHOLE or to.startswith("DECIMAL"):
                said = Call("error", [Lit("text", f"{name} over a TRY_CAST: a value that doesn't fit was dropped by it")])
                return Case(None, [(Binary("AND", Is(x.x, "null", True), Is(x, "null", False)), Cast(said, x.type, True))], x)
        if isinstance(x, (Query, Is)) or not hasattr(x, "__dataclass_fields__"):
            return [self.guarded(i, name, scope) for i in x] if isinstance(x, list) else tuple(self.guarded(i, name, scope) for i in x) if isinstance(x, tuple) else x
        if not any(isinstance(n, Cast) and n.may_fail for n in walk(x)):
            return x
        return replace(x, **{f: self.guarded(getattr(x, f), name, scope) for f in x.__dataclass_fields__})

    def keyed(self, keys: list[Key], scope) -> str:
        """Sort keys as a struct whose own order is theirs, for keys that go up; nulls come last unless said otherwise."""
        return ", ".join(f"({self.text(k.x, scope)} IS {'NOT ' if k.nulls == 'FIRST' else ''}NULL) AS `n{i}`, {self.text(k.x, scope)} AS `k{i}`" for i, k in enumerate(keys))

    def listed(self, value, x: Call, tail: str, scope, over: str = "") -> str:
        """All values, nulls too, in the order asked for."""
        text = self.text(value, scope)
        if x.distinct:
            made = f"collect_set(struct({text} AS `x`)){tail}{over}"
            if x.order and x.order[0].x == value:
                return self.sorted_list(f"transform({made}, e -> e.`x`)", x.order[0].down, x.order[0].nulls == "FIRST")
            return f"transform({made}, e -> e.`x`)"
        if not x.order:
            return f"transform(collect_list(struct({text} AS `x`)){tail}{over}, e -> e.`x`)"
        made = f"collect_list(struct({self.keyed(x.order, scope)}, {text} AS `x`)){tail}{over}"
        if not any(k.down for k in x.order):
            return f"transform(sort_array({made}), e -> e.`x`)"
        test = "0"
        for i, k in reversed(list(enumerate(x.order))):
            up, down = ("1", "-1") if k.down else ("-1", "1")
            test = f"CASE WHEN l.`n{i}` < r.`n{i}` THEN -1 WHEN l.`n{i}` > r.`n{i}` THEN 1 WHEN l.`k{i}` < r.`k{i}` THEN {up} WHEN l.`k{i}` > r.`k{i}` THEN {down} ELSE {test} END"
        return f"transform(array_sort({made}, (l, r) -> {test}), e -> e.`x`)"

    def picked(self, name: str, value, x: Call, tail: str, scope) -> str:
        """The first or last value in the order asked for; without one, any value."""
        last, text = name.startswith("last"), self.text(value, scope)
        if name == "any_value":
            return f"any_value({text}, true){tail}"
        nulls = ", true" if x.nulls == "IGNORE" else ""
        if not x.order:
            return f"{'last' if last else 'first'}({text}{nulls}){tail}"
        if nulls:
            return f"try_element_at(filter({self.listed(value, x, tail, scope)}, e -> e IS NOT NULL), {-1 if last else 1})"
        downs = {k.down for k in x.order}
        if len(downs) == 1 and all(k.nulls is None for k in x.order):
            # Nulls come last in either direction.
            greatest = last != downs.pop()
            empty = "IS NOT NULL" if greatest != last else "IS NULL"
            by = ", ".join(f"({self.text(k.x, scope)} {empty}) AS `n{i}`, {self.text(k.x, scope)} AS `k{i}`" for i, k in enumerate(x.order))
            return f"{'max_by' if greatest else 'min_by'}(struct({text} AS `x`), struct({by})){tail}.`x`"
        return f"try_element_at({self.listed(value, x, tail, scope)}, {-1 if last else 1})"


def function_names() -> list[str]:
    """All functions that a statement may call."""
    own = {n.removeprefix("f_") for n in dir(Writer) if n.startswith("f_")}
    found = own | SAME | set(RENAMED) | AGGREGATES | _BIGS | _RANKS | set(_LAMBDAS) | {p for p in (*PARTS, *_PART_SQL) if len(p) > 2} | {"epoch", "epoch_ms", "epoch_us"}
    return sorted(n for n in found if n not in REFUSED and not n.startswith("duck_"))
