"""Default names of result columns: an expression without an alias is called what it says, as DuckDB prints it."""

from __future__ import annotations

import re

from .parser import Between, Binary, Call, Case, Cast, Col, Differs, Exists, Field, In, Index, Is, Key, Lambda, Like, ListOf, Lit, MapOf, Row, Slice, Star, StructOf, Sub, Unary, Window

#: How types are written in names.
_TYPES = {"INT": "INTEGER", "TEXT": "VARCHAR", "STRING": "VARCHAR", "BOOL": "BOOLEAN"}
_QUOTED = {"HUGEINT", "UBIGINT", "DOUBLE"}
_KEYWORDS = set("all and any as asc both case cast check collate column constraint create default desc distinct do else end except false fetch for foreign from grant group having in initially intersect into lateral leading limit not null offset on only or order placing primary references returning select show some symmetric table then to trailing true union unique using variadic when where window with by over value values text date year month day hour minute second left right trim substring position overlay inner outer full cross natural join like ilike is similar row map struct".split())


def ident(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) and name.lower() not in _KEYWORDS else '"' + name.replace('"', '""') + '"'


def type_name(text: str) -> str:
    base, _, rest = text.partition("(")
    base = _TYPES.get(base, base)
    made = f"{base}({rest}" if rest else base
    return f'"{made}"' if base in _QUOTED else made


def _list(items) -> str:
    return ", ".join(map(text, items))


def key(k: Key) -> str:
    return text(k.x) + (" DESC" if k.down else "") + (f" NULLS {k.nulls}" if k.nulls else "")


def window(w: Window | str) -> str:
    if isinstance(w, str):
        return ident(w)
    parts = [f"PARTITION BY {_list(w.keys)}"] if w.keys else []
    if w.order:
        parts.append("ORDER BY " + ", ".join(map(key, w.order)))
    if w.frame:
        ends = [b if isinstance(b, str) else f"{text(b[0])} {b[1]}" for b in w.bounds]
        parts.append(f"{w.frame} BETWEEN {ends[0]} AND {ends[1]}")
    return f"({' '.join(parts)})"


def text(x) -> str:
    if isinstance(x, Lit):
        if x.kind == "text":
            return "'" + x.text.replace("'", "''") + "'"
        if x.kind == "bool":
            return f"CAST('{x.text[0]}' AS BOOLEAN)"
        if x.kind in ("date", "timestamp"):
            return f"CAST('{x.text}' AS {x.kind.upper()})"
        return f"'{x.text}'::INTERVAL" if x.kind == "interval" else x.text.upper() if x.kind == "null" else x.text
    if isinstance(x, Col):
        return ".".join(map(ident, x.parts))
    if isinstance(x, Star):
        return f"{x.table}.*" if x.table else "*"
    if isinstance(x, Call):
        if x.name in ("count", "count_star") and (not x.args or isinstance(x.args[0], Star)):
            made = "count_star()"
        else:
            inner = ("DISTINCT " if x.distinct else "") + ", ".join([*map(text, x.args), *(f"{n} := {text(v)}" for n, v in x.named)])
            inner += f" ORDER BY {', '.join(map(key, x.order))}" if x.order else ""
            made = f"{ident(x.name)}({inner}{f' {x.nulls} NULLS' if x.nulls else ''})"
        made += f" FILTER (WHERE {text(x.where)})" if x.where is not None else ""
        return made + (f" OVER {window(x.over)}" if x.over is not None else "")
    if isinstance(x, Unary):
        return f"(NOT {text(x.x)})" if x.op == "NOT" else f"{x.op}{text(x.x)}" if isinstance(x.x, Lit) else f"{x.op}({text(x.x)})" if not isinstance(x.x, Col) else f"-{text(x.x)}"
    if isinstance(x, Binary):
        return f"({text(x.a)} {'!=' if x.op == '<>' else x.op} {text(x.b)})"
    if isinstance(x, Cast):
        return f"{'TRY_CAST' if x.may_fail else 'CAST'}({text(x.x)} AS {type_name(x.type)})"
    if isinstance(x, Case):
        body = " ".join(f"WHEN ({text(a)}) THEN ({text(b)})" for a, b in x.whens)
        return f"CASE {f' {text(x.of)}' if x.of is not None else ''} {body} ELSE {text(x.other) if x.other is not None else 'NULL'} END"
    if isinstance(x, In):
        return f"({text(x.x)} {'NOT ' if x.negate else ''}IN ({_list(x.items) if isinstance(x.items, list) else '...'}))"
    if isinstance(x, Between):
        return f"({text(x.x)} {'NOT ' if x.negate else ''}BETWEEN {text(x.low)} AND {text(x.high)})"
    if isinstance(x, Like):
        return f"({text(x.x)} {'!' if x.negate else ''}{'~~*' if x.op == 'ILIKE' else '~~'} {text(x.pattern)})"
    if isinstance(x, Is):
        return f"({text(x.x)} IS {'NOT ' if x.negate else ''}{x.what.upper()})"
    if isinstance(x, Differs):
        return f"({text(x.a)} IS {'NOT ' if x.negate else ''}DISTINCT FROM {text(x.b)})"
    if isinstance(x, (Exists, Sub)):
        return "EXISTS(...)" if isinstance(x, Exists) else "(subquery)"
    if isinstance(x, ListOf):
        return f"[{_list(x.items)}]" if x.items else "[]"
    if isinstance(x, Row):
        return f'"row"({_list(x.items)})'
    if isinstance(x, StructOf):
        return "struct_pack(" + ", ".join(f"{k} := {text(v)}" for k, v in x.items) + ")"
    if isinstance(x, MapOf):
        return "map([" + _list(k for k, _ in x.items) + "], [" + _list(v for _, v in x.items) + "])"
    if isinstance(x, Index):
        return f"{text(x.x)}[{text(x.at)}]"
    if isinstance(x, Slice):
        return f"{text(x.x)}[{'' if x.low is None else text(x.low)}:{'' if x.high is None else text(x.high)}]"
    if isinstance(x, Field):
        return f"({text(x.x)}).{x.name}"
    if isinstance(x, Lambda):
        return f"(lambda {', '.join(x.names)}: {text(x.body)})"
    return type(x).__name__.lower()


def default(x) -> str:
    """The name of an item without an alias."""
    if isinstance(x, Field):
        return x.name
    if isinstance(x, Sub):
        body = getattr(x.query, "body", None)
        item = body.items[0] if getattr(body, "items", None) else None
        return "(subquery)" if item is None else item.alias or (item.x.parts[-1] if isinstance(item.x, Col) else default(item.x))
    return text(x)
