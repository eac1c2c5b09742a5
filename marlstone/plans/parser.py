"""Reads DuckDB's SELECT statements into a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import NotAllowed, ParseError, PlanError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>[eE]?'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d[\d_]*)(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<word>[^\W\d]\w*)|(?P<op>\^@|//|::|:=|->>|->|=>|<>|!=|<=|>=|==|!~~\*?|!~|~~\*?|<<|>>|\|\||\*\*|[-+*/%(),.;=<>\[\]{}:&|^~?!@#$])""",
    re.S | re.X,
)
DEEPEST, MOST_TERMS = 64, 1024


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text if self.kind == "op" else ""


# Expressions


@dataclass
class Lit:
    kind: str  # int, decimal, double, text, null, bool, date, timestamp, interval
    text: str


@dataclass
class Col:
    parts: list[str]


@dataclass
class Star:
    table: str | None = None
    exclude: list[str] = field(default_factory=list)
    replace: list[tuple] = field(default_factory=list)


@dataclass
class Call:
    name: str
    args: list
    named: list[tuple] = field(default_factory=list)
    distinct: bool = False
    order: list = field(default_factory=list)
    where: object = None
    nulls: str | None = None
    over: object = None


@dataclass
class Unary:
    op: str
    x: object


@dataclass
class Binary:
    op: str
    a: object
    b: object


@dataclass
class Cast:
    x: object
    type: str
    may_fail: bool = False


@dataclass
class Case:
    of: object
    whens: list[tuple]
    other: object


@dataclass
class In:
    x: object
    items: object  # a list or a Query
    negate: bool


@dataclass
class Between:
    x: object
    low: object
    high: object
    negate: bool


@dataclass
class Like:
    op: str
    x: object
    pattern: object
    escape: object
    negate: bool


@dataclass
class Is:
    x: object
    what: str  # null, true, false, unknown
    negate: bool


@dataclass
class Differs:
    a: object
    b: object
    negate: bool


@dataclass
class Exists:
    query: object


@dataclass
class Sub:
    query: object


@dataclass
class Row:
    items: list


@dataclass
class ListOf:
    items: list


@dataclass
class Comprehension:
    of: object
    name: str
    source: object
    test: object


@dataclass
class StructOf:
    items: list[tuple]


@dataclass
class MapOf:
    items: list[tuple]


@dataclass
class Index:
    x: object
    at: object


@dataclass
class Slice:
    x: object
    low: object
    high: object


@dataclass
class Field:
    x: object
    name: str


@dataclass
class Lambda:
    names: list[str]
    body: object


@dataclass
class Key:
    """A sort key; direction and nulls as written."""

    x: object
    down: bool
    nulls: str | None


@dataclass
class Window:
    base: str | None
    keys: list
    order: list[Key]
    frame: str | None
    bounds: list


# Queries


@dataclass
class Item:
    x: object
    alias: str | None


@dataclass
class Select:
    items: list[Item]
    distinct: object  # None, True or the list of DISTINCT ON
    source: object
    where: object = None
    group: object = None  # None, "ALL" or a list of (kind, sets)
    having: object = None
    windows: dict[str, Window] = field(default_factory=dict)
    qualify: object = None


@dataclass
class Values:
    rows: list[list]


@dataclass
class SetOp:
    op: str
    all: bool
    by_name: bool
    a: object
    b: object


@dataclass
class Query:
    ctes: list[tuple]  # (name, columns, Query)
    recursive: bool
    body: object
    order: object  # [] or list of Key, or ("ALL", down, nulls)
    limit: object
    offset: object


@dataclass
class Table:
    parts: list[str]
    alias: str | None
    columns: list[str]


@dataclass
class Derived:
    query: object
    alias: str | None
    columns: list[str]
    lateral: bool


@dataclass
class Series:
    name: str
    args: list
    alias: str | None
    columns: list[str]


@dataclass
class Join:
    kind: str
    a: object
    b: object
    on: object = None
    using: list[str] = field(default_factory=list)
    natural: bool = False


#: Words that end an expression or a table, so they are no alias without AS.
STOP = set("""from where group having window qualify order limit offset union intersect except on using join inner left right full cross natural lateral as asc desc nulls when then else end and or
    not in is like ilike between case select with by rows range groups filter over within ignore respect for if exclude replace escape semi anti asof positional similar glob collate fetch values materialized
    pivot unpivot tablesample""".split())
_COMPARE = {"=", "==", "<>", "!=", "<", ">", "<=", ">="}
_OTHER = {"||", "->", "->>", "^@", "&", "|", "<<", ">>", "~", "!~"}
_TYPED = {"date", "timestamp", "timestamptz", "time"}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"can't read {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append(Token(m.lastgroup, m[0], at))
            at = m.end()
        while self.tokens and self.tokens[-1].text == ";":
            self.tokens.pop()
        self.i = 0

    # Tokens
    def peek(self, ahead: int = 0) -> Token:
        i = self.i + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", len(self.text))

    def sees(self, *words: str) -> bool:
        return all(self.peek(k).low == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.sees(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            found = self.peek().text or "the end"
            raise ParseError(f"{' '.join(words).upper()} expected, not {found!r}")

    def name(self) -> str:
        t = self.peek()
        if t.kind == "name":
            self.i += 1
            return t.text[1:-1].replace(t.text[0] * 2, t.text[0])
        if t.kind == "word":
            self.i += 1
            return t.text
        raise ParseError(f"a name expected, not {t.text or 'the end'!r}")

    def alias(self) -> str | None:
        if self.take("as"):
            t = self.peek()
            if t.kind == "text":
                self.i += 1
                return t.text[1:-1].replace("''", "'")
            return self.name()
        t = self.peek()
        return self.name() if t.kind == "name" or t.kind == "word" and t.low not in STOP else None

    def names(self) -> list[str]:
        self.need("(")
        found = [self.name()]
        while self.take(","):
            found.append(self.name())
        self.need(")")
        return found

    # Queries
    def statement(self) -> Query:
        self.guard()
        made = self.query()
        if self.peek().kind != "end":
            raise ParseError(f"can't read {self.peek().text!r}")
        return made

    def guard(self) -> None:
        if not self.tokens:
            raise ParseError("an empty statement")
        if any(t.text == ";" for t in self.tokens):
            raise NotAllowed("one statement at a time")
        first = self.tokens[0].low
        if first in ("pivot", "unpivot"):
            raise PlanError(f"{first.upper()} isn't supported")
        if first not in ("select", "with", "values", "from", "("):
            raise NotAllowed(f"{self.tokens[0].text.upper()} isn't a query")
        depth = deepest = 0
        for t in self.tokens:
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            deepest = max(deepest, depth)
        if deepest > DEEPEST or sum(t.low in ("and", "or", "+", "-", "*", "||") for t in self.tokens) > MOST_TERMS:
            raise PlanError("the statement is too deep or has too many terms")

    def query(self) -> Query:
        ctes, recursive = [], False
        if self.take("with"):
            recursive = self.take("recursive")
            while True:
                name = self.name()
                columns = self.names() if self.sees("(") else []
                if len({c.lower() for c in columns}) < len(columns):
                    raise PlanError(f"the column list of {name} repeats a name")
                self.need("as")
                self.take("not")
                self.take("materialized")
                self.need("(")
                ctes.append((name, columns, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        body = self.set_op()
        order, limit, offset = [], None, None
        if self.take("order", "by"):
            order = self.order(True)
        while self.sees("limit") or self.sees("offset"):
            if self.take("limit"):
                limit = None if self.take("all") else self.expr()
                if self.take("%"):
                    raise PlanError("LIMIT by percent isn't supported")
            elif self.take("offset"):
                offset = self.expr()
                self.take("rows") or self.take("row")
        return Query(ctes, recursive, body, order, limit, offset)

    def order(self, whole: bool):
        if whole and self.sees("all") and self.peek(1).low not in (".", "("):
            self.i += 1
            down = self.direction()
            return ("ALL", down, self.nulls())
        keys = []
        while True:
            x = self.expr()
            if whole and isinstance(x, Lit) and x.kind != "int":
                raise PlanError("ORDER BY a literal that isn't an ordinal")
            keys.append(Key(x, self.direction(), self.nulls()))
            if not self.take(","):
                return keys

    def direction(self) -> bool:
        if self.take("desc"):
            return True
        self.take("asc")
        return False

    def nulls(self) -> str | None:
        if self.take("nulls", "first"):
            return "FIRST"
        return "LAST" if self.take("nulls", "last") else None

    def set_op(self, tight: bool = False):
        made = self.primary_query() if tight else self.set_op(True)
        ops = ("intersect",) if tight else ("union", "except")
        while self.peek().low in ops:
            op = self.name().upper()
            every = self.take("all")
            if not every:
                self.take("distinct")
            by_name = self.take("by", "name")
            made = SetOp(op, every, by_name, made, self.primary_query() if tight else self.set_op(True))
        return made

    def primary_query(self):
        if self.take("("):
            made = self.query()
            self.need(")")
            return made
        if self.take("values"):
            rows = []
            while True:
                self.need("(")
                rows.append(self.exprs())
                self.need(")")
                if not self.take(","):
                    return Values(rows)
        return self.select()

    def select(self) -> Select:
        source, items, distinct = None, None, None
        if self.take("from"):
            source = self.source()
            if not self.sees("select"):
                items = [Item(Star(), None)]
        if items is None:
            self.need("select")
            if self.take("distinct"):
                distinct = True
                if self.take("on"):
                    self.need("(")
                    distinct = self.exprs()
                    self.need(")")
            else:
                self.take("all")
            items = []
            while True:
                items.append(self.item())
                if not self.take(",") or self.peek().kind == "end" or self.peek().low in ("from", "where", "group", "order", "limit") and self.peek(1).text != "(":
                    break
            if source is None and self.take("from"):
                source = self.source()
        made = Select(items, distinct, source)
        if self.take("where"):
            made.where = self.expr()
        if self.take("group", "by"):
            made.group = "ALL" if self.sees("all") and self.peek(1).text not in (".", "(") and self.take("all") else self.groups()
        if self.take("having"):
            made.having = self.expr()
        if self.take("window"):
            while True:
                name = self.name()
                self.need("as")
                made.windows[name] = self.window()
                if not self.take(","):
                    break
        if self.take("qualify"):
            made.qualify = self.expr()
        return made

    def groups(self) -> list[tuple]:
        found = []
        while True:
            if self.sees("cube") or self.sees("rollup"):
                kind = self.name().upper()
                self.need("(")
                found.append((kind, self.exprs()))
                self.need(")")
            elif self.take("grouping", "sets"):
                self.need("(")
                sets = []
                while True:
                    if self.take("("):
                        sets.append([] if self.sees(")") else self.exprs())
                        self.need(")")
                    else:
                        sets.append([self.expr()])
                    if not self.take(","):
                        break
                self.need(")")
                found.append(("SETS", sets))
            else:
                found.append(("", self.expr()))
            if not self.take(","):
                return found

    def item(self) -> Item:
        # alias : expression
        if self.peek().kind in ("word", "name") and self.peek(1).text == ":" and self.peek(2).text != ":":
            name = self.name()
            self.need(":")
            return Item(self.expr(), name)
        x = self.expr()
        return Item(x, None if isinstance(x, Star) else self.alias())

    def star(self, table: str | None) -> Star:
        made = Star(table)
        while True:
            if self.take("exclude"):
                made.exclude = self.names() if self.sees("(") else [self.name()]
            elif self.take("replace"):
                self.need("(")
                while True:
                    x = self.expr()
                    self.need("as")
                    made.replace.append((x, self.name()))
                    if not self.take(","):
                        break
                self.need(")")
            else:
                return made

    # Tables
    def source(self):
        made = self.joined()
        while self.take(","):
            made = Join("CROSS", made, self.joined())
        return made

    def joined(self):
        made = self.table()
        while True:
            natural = self.take("natural")
            kind = None
            for words, k in ((("cross", "join"), "CROSS"), (("inner", "join"), "INNER"), (("left", "outer", "join"), "LEFT"), (("right", "outer", "join"), "RIGHT"), (("full", "outer", "join"), "FULL"), (("left", "join"), "LEFT"), (("right", "join"), "RIGHT"), (("full", "join"), "FULL"), (("semi", "join"), "LEFT SEMI"), (("anti", "join"), "LEFT ANTI"), (("join",), "INNER")):
                if self.take(*words):
                    kind = k
                    break
            if kind is None:
                if self.sees("asof") or self.sees("positional"):
                    raise PlanError(f"{self.peek().text.upper()} JOIN isn't supported")
                return made
            made = Join(kind, made, self.table(), natural=natural)
            if self.take("on"):
                made.on = self.expr()
            elif self.take("using"):
                made.using = self.names()

    def table(self):
        lateral = self.take("lateral")
        t = self.peek()
        if t.kind == "text":
            raise NotAllowed("files can't be read by name")
        if self.take("("):
            if self.peek().low in ("select", "with", "values", "from", "(") and self._is_query():
                query = self.query()
                self.need(")")
                return Derived(query, *self.table_alias(), lateral)
            made = self.joined()
            self.need(")")
            return made
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        if self.sees("("):
            self.need("(")
            args = [] if self.sees(")") else self.exprs()
            self.need(")")
            return Series(".".join(parts).lower(), args, *self.table_alias())
        if len(parts) == 2 and parts[0].lower() in ("parquet", "csv", "json", "orc", "text", "binaryfile", "delta", "avro"):
            raise NotAllowed("files can't be read by name")
        if self.sees("pivot") or self.sees("unpivot"):
            raise PlanError(f"{self.peek().text.upper()} isn't supported")
        made = Table(parts, *self.table_alias())
        if self.sees("tablesample") or self.sees("pivot") or self.sees("unpivot"):
            raise PlanError(f"{self.peek().text.upper()} isn't supported")
        return made

    def _is_query(self) -> bool:
        """Whether what follows an opened bracket is a query and no bracketed join."""
        k = 0
        while self.peek(k).text == "(":
            k += 1
        return self.peek(k).low in ("select", "with", "values", "from")

    def table_alias(self) -> tuple[str | None, list[str]]:
        alias = self.alias()
        return alias, self.names() if alias and self.sees("(") else []

    # Expressions, loosest first
    def exprs(self) -> list:
        found = [self.expr()]
        while self.take(","):
            found.append(self.expr())
        return found

    def expr(self):
        made = self.conjunction()
        while self.take("or"):
            made = Binary("OR", made, self.conjunction())
        return made

    def conjunction(self):
        made = self.negation()
        while self.take("and"):
            made = Binary("AND", made, self.negation())
        return made

    def negation(self):
        if self.sees("not") and not self.sees("not", "exists"):
            self.i += 1
            return Unary("NOT", self.negation())
        return self.test()

    def test(self):
        made = self.comparison()
        while self.take("is"):
            negate = self.take("not")
            if self.take("distinct", "from"):
                made = Differs(made, self.comparison(), negate)
            else:
                made = Is(made, self.name().lower(), negate)
        while self.peek().low in ("isnull", "notnull"):
            made = Is(made, "null", self.name().lower() == "notnull")
        return made

    def comparison(self):
        made = self.matching()
        while self.peek().text in _COMPARE:
            op = {"==": "=", "!=": "<>"}.get(self.peek().text, self.peek().text)
            self.i += 1
            if self.peek().low in ("any", "all", "some") and self.peek(1).text == "(":
                raise PlanError("ANY and ALL aren't supported")
            made = Binary(op, made, self.matching())
        return made

    def matching(self):
        made = self.other()
        while True:
            start, negate = self.i, self.take("not")
            if self.take("between"):
                low = self.other()
                self.need("and")
                made = Between(made, low, self.other(), negate)
            elif self.take("in"):
                if self.take("("):
                    items = self.query() if self.peek().low in ("select", "with", "values", "from") or self.peek().text == "(" and self._is_query() else self.exprs()
                    self.need(")")
                    made = In(made, items, negate)
                else:
                    made = Call("contains", [self.other(), made])
                    made = Unary("NOT", made) if negate else made
            elif self.peek().low in ("like", "ilike", "similar", "glob"):
                op = self.name().upper()
                if op == "GLOB":
                    raise PlanError("GLOB isn't supported")
                if op == "SIMILAR":
                    self.need("to")
                pattern = self.other()
                made = Like(op, made, pattern, self.other() if self.take("escape") else None, negate)
            else:
                self.i = start
                return made

    def other(self):
        made = self.sum()
        while self.peek().text in _OTHER and not (self.peek().text == "->" and isinstance(made, (Col, Row)) and self._lambda_ahead):
            op = self.peek().text
            self.i += 1
            made = Binary(op, made, self.sum())
        return made

    _lambda_ahead = False

    def sum(self):
        made = self.product()
        while self.peek().text in ("+", "-"):
            op = self.peek().text
            self.i += 1
            made = Binary(op, made, self.product())
        return made

    def product(self):
        made = self.power()
        while self.peek().text in ("*", "/", "//", "%"):
            op = self.peek().text
            self.i += 1
            made = Binary(op, made, self.power())
        return made

    def power(self):
        made = self.unary()
        while self.peek().text in ("^", "**"):
            self.i += 1
            made = Call("power", [made, self.unary()])
        return made

    def unary(self):
        if self.peek().text in ("-", "+", "~"):
            op = self.peek().text
            self.i += 1
            x = self.unary()
            return x if op == "+" else Unary(op, x)
        return self.postfix()

    def postfix(self):
        made = self.atom()
        while True:
            if self.take("::"):
                made = Cast(made, self.type())
            elif self.take("["):
                if self.take(":"):
                    made = Slice(made, None, None if self.sees("]") else self.expr())
                else:
                    low = self.expr()
                    made = Slice(made, low, None if self.sees("]") else self.expr()) if self.take(":") else Index(made, low)
                self.need("]")
            elif self.peek().text == "." and not isinstance(made, (Lit, Star)):
                self.i += 1
                if self.take("*"):
                    made = self.star(made.parts[-1])
                    continue
                name = self.name()
                if self.sees("(") :
                    made = self.call(name, [made])
                else:
                    made = Col([*made.parts, name]) if isinstance(made, Col) else Field(made, name)
            else:
                return made

    def type(self) -> str:
        if self.take("struct"):
            self.need("(")
            parts = []
            while True:
                name = self.name()
                parts.append(f"{name} {self.type()}")
                if not self.take(","):
                    break
            self.need(")")
            made = f"STRUCT({', '.join(parts)})"
        else:
            made = self.name().upper()
            if made == "DOUBLE":
                self.take("precision")
            if made in ("TIMESTAMP", "TIME") and (self.take("with", "time", "zone")):
                made += "TZ"
            elif made in ("TIMESTAMP", "TIME"):
                self.take("without", "time", "zone")
            if self.take("("):
                args = [self.peek().text]
                self.i += 1
                while self.take(","):
                    args.append(self.peek().text)
                    self.i += 1
                self.need(")")
                made += f"({', '.join(args)})"
        while self.take("[", "]"):
            made += "[]"
        return made

    def atom(self):
        t = self.peek()
        if t.kind == "number":
            self.i += 1
            text = t.text.replace("_", "")
            if text[:2].lower() == "0x":
                return Lit("int", str(int(text, 16)))
            return Lit("double" if "e" in text.lower() else "decimal" if "." in text else "int", text)
        if t.kind == "text":
            self.i += 1
            if t.text[0] in "eE":
                raise PlanError("text with escapes isn't supported")
            return Lit("text", t.text[1:-1].replace("''", "'"))
        if t.text == "*":
            self.i += 1
            return self.star(None)
        if t.text == "(":
            self.i += 1
            if self._is_query():
                made = Sub(self.query())
            else:
                items = self.exprs()
                if self.take(")") :
                    return items[0] if len(items) == 1 else Row(items)
                raise ParseError(f"a bracket isn't closed before {self.peek().text or 'the end'!r}")
            self.need(")")
            return made
        if t.text == "[":
            self.i += 1
            if self.take("]"):
                return ListOf([])
            first = self.expr()
            if self.take("for"):
                name = self.name()
                self.need("in")
                source = self.expr()
                test = self.expr() if self.take("if") else None
                self.need("]")
                return Comprehension(first, name, source, test)
            items = [first]
            while self.take(","):
                items.append(self.expr())
            self.need("]")
            return ListOf(items)
        if t.text == "{":
            return StructOf(self.pairs(text_keys=True))
        if t.kind == "name":
            name = self.name()
            return self.call(name) if self.sees("(") else Col([name])
        if t.kind != "word":
            raise ParseError(f"an expression expected, not {t.text or 'the end'!r}")
        low, after = t.low, self.peek(1)
        if low in ("null", "true", "false"):
            self.i += 1
            return Lit("null" if low == "null" else "bool", low)
        if low in _TYPED and after.kind == "text":
            self.i += 2
            return Lit("timestamp" if low != "date" else "date", after.text[1:-1])
        if low == "interval" and (after.kind in ("text", "number") or after.text == "("):
            return self.interval()
        if low == "case":
            return self.case()
        if low == "exists" and after.text == "(":
            self.i += 2
            query = self.query()
            self.need(")")
            return Exists(query)
        if low == "not":
            self.i += 1
            return Unary("NOT", self.test())
        if low in ("cast", "try_cast") and after.text == "(":
            self.i += 2
            x = self.expr()
            self.need("as")
            made = Cast(x, self.type(), low == "try_cast")
            self.need(")")
            return made
        if low == "extract" and after.text == "(":
            self.i += 2
            t = self.peek()
            self.i += 1
            part = t.text[1:-1] if t.kind == "text" else t.text
            self.need("from")
            made = Call("date_part", [Lit("text", part.lower()), self.expr()])
            self.need(")")
            return made
        if low == "map" and after.text == "{":
            self.i += 1
            return MapOf(self.pairs(text_keys=False))
        if low == "lambda":
            self.i += 1
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            self.need(":")
            return Lambda(names, self.expr())
        if after.text == "(" and low not in ("select", "from", "where"):
            return self.call(self.name())
        if low in STOP - {"if", "left", "right", "replace", "values", "range", "rows", "groups", "filter", "for"}:
            raise ParseError(f"an expression expected, not {t.text!r}")
        return Col([self.name()])

    def pairs(self, text_keys: bool) -> list[tuple]:
        self.need("{")
        found = []
        while not self.sees("}"):
            t = self.peek()
            if text_keys:
                self.i += 1
                key = t.text[1:-1] if t.kind in ("text", "name") else t.text
            else:
                key = self.expr()
            self.need(":")
            found.append((key, self.expr()))
            if not self.take(","):
                break
        self.need("}")
        return found

    def interval(self) -> Lit:
        self.need("interval")
        t = self.peek()
        if t.text == "(":
            raise PlanError("INTERVAL of an expression isn't supported")
        self.i += 1
        text = t.text[1:-1] if t.kind == "text" else t.text
        if re.fullmatch(r"-?[\d.]+", text.strip()):
            text += " " + self.name()
        return Lit("interval", text)

    def case(self) -> Case:
        self.need("case")
        of = None if self.sees("when") else self.expr()
        whens, other = [], None
        while self.take("when"):
            test = self.expr()
            self.need("then")
            whens.append((test, self.expr()))
        if self.take("else"):
            other = self.expr()
        self.need("end")
        return Case(of, whens, other)

    def call(self, name: str, given: list | None = None) -> Call:
        made = Call(name.lower(), list(given or []))
        self.need("(")
        if made.name in ("substring", "trim", "position", "overlay") and not self.sees(")"):
            return self.spelled(made)
        made.distinct = self.take("distinct")
        while not self.sees(")"):
            if self.sees("order", "by"):
                self.i += 2
                made.order = self.order(False)
                break
            if self.peek().low in ("ignore", "respect") and self.peek(1).low == "nulls":
                made.nulls = self.name().upper()
                self.need("nulls")
                continue
            if self.peek().kind in ("word", "name") and self.peek(1).text in (":=", "=>"):
                key = self.name()
                self.i += 1
                made.named.append((key, self.expr()))
            else:
                made.args.append(self.argument())
            if not self.take(",") and self.peek().low not in ("order", "ignore", "respect"):
                break
        self.need(")")
        if self.take("within", "group"):
            self.need("(")
            self.need("order", "by")
            made.order = self.order(False)
            self.need(")")
        if self.peek().low in ("ignore", "respect") and self.peek(1).low == "nulls" and self.peek(2).low == "over":
            made.nulls = self.name().upper()
            self.need("nulls")
        if self.sees("filter", "("):
            self.need("filter", "(")
            self.need("where")
            made.where = self.expr()
            self.need(")")
        if self.take("over"):
            made.over = self.window() if self.sees("(") else self.name()
        return made

    def argument(self):
        """An argument; name -> body and (a, b) -> body are functions where the function's own argument is one."""
        start, held = self.i, self._lambda_ahead
        names = None
        if self.peek().kind in ("word", "name") and self.peek(1).text == "->" and self.peek(2).kind != "text":
            names = [self.name()]
        elif self.peek().text == "(":
            k = 1
            while self.peek(k).kind == "word" and self.peek(k + 1).text == ",":
                k += 2
            if self.peek(k).kind == "word" and self.peek(k + 1).text == ")" and self.peek(k + 2).text == "->":
                names = self.names()
        if names and self.take("->"):
            return Lambda(names, self.expr())
        self.i, self._lambda_ahead = start, held
        return self.expr()

    def spelled(self, made: Call) -> Call:
        """substring(s FROM a FOR b), trim(BOTH x FROM s), position(x IN s)."""
        if made.name == "trim":
            side = self.name().lower() if self.peek().low in ("both", "leading", "trailing") else "both"
            first = None if self.sees("from") else self.expr()
            made.name = {"both": "trim", "leading": "ltrim", "trailing": "rtrim"}[side]
            if self.take("from"):
                made.args = [self.expr(), *([first] if first else [])]
            else:
                made.args = [first, *(self.exprs() if self.take(",") else [])]
        elif made.name == "position":
            inner = self.other()
            self.need("in")
            made = Call("strpos", [self.expr(), inner])
        else:
            made.args = [self.expr()]
            if self.take("from"):
                made.args.append(self.expr())
                if self.take("for"):
                    made.args.append(self.expr())
            elif self.take("for"):
                made.args += [Lit("int", "1"), self.expr()]
            elif self.take(","):
                made.args += self.exprs()
        self.need(")")
        return made

    def window(self) -> Window:
        self.need("(")
        made = Window(None, [], [], None, [])
        if self.peek().kind in ("word", "name") and self.peek().low not in ("partition", "order", "rows", "range", "groups"):
            made.base = self.name()
        if self.take("partition", "by"):
            made.keys = self.exprs()
        if self.take("order", "by"):
            made.order = self.order(False)
        if self.peek().low in ("rows", "range", "groups"):
            made.frame = self.name().upper()
            if made.frame == "GROUPS":
                raise PlanError("GROUPS frames aren't supported")
            if self.take("between"):
                made.bounds = [self.bound()]
                self.need("and")
                made.bounds.append(self.bound())
            else:
                made.bounds = [self.bound(), "CURRENT ROW"]
            if self.sees("exclude"):
                raise PlanError("EXCLUDE in a frame isn't supported")
        self.need(")")
        return made

    def bound(self):
        if self.take("current", "row"):
            return "CURRENT ROW"
        if self.take("unbounded", "preceding"):
            return "UNBOUNDED PRECEDING"
        if self.take("unbounded", "following"):
            return "UNBOUNDED FOLLOWING"
        x = self.sum()
        return (x, "PRECEDING" if self.take("preceding") else self.need("following") or "FOLLOWING")


def parse(text: str) -> Query:
    return Parser(text).statement()


def walk(node):
    """The node and all nodes in it, queries included."""
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x)
    elif isinstance(node, dict):
        yield from walk(list(node.values()))
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        for f in node.__dataclass_fields__:
            yield from walk(getattr(node, f))
