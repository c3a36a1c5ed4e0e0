"""The expression language of predicates, conditions, returned values and formats.

Text becomes a tree, the tree typed Spark SQL. Types: ``num``, ``text``, ``date``, ``bool``, ``null`` and ``raw``, the text of an
observation's value, which counts as a number beside numbers and as text beside text. Only trees are written as SQL, so what
is not in the language, or does not fit by type, is an error when the program is compiled; and as no Column objects are built,
a program is compiled without a call to the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from .model import RuleError


@dataclass(frozen=True)
class Node:
    kind: str
    value: str = ""
    args: tuple["Node", ...] = ()


@dataclass(frozen=True)
class Typed:
    sql: str
    type: str


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|\.\d+)|(?P<str>'(?:[^']|'')*'|`[^`]*`)|(?P<id>\"[^\"]+\"|[A-Za-z_]\w*)|(?P<op>!\?|<>|!=|<=|>=|\|\||[?=<>+\-*/(),.%]))"
)
_KEYWORDS = {"and", "or", "not", "in", "like", "between", "is", "null", "case", "when", "then", "else", "end", "from", "true", "false"}
#: Columns of an observation; they win over variables of the same name.
OBSERVATION = ("eid", "att", "dt", "val", "loc", "_")
_CONSTANTS = ("sysdate", "lower__bound__dt", "upper__bound__dt")
_COMPARE = {"=": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise RuleError(f"Unexpected character in expression: {text[at:].strip()[:30]!r}")
        kind = m.lastgroup or ""
        value = m.group(kind)
        if kind == "str":
            value = value[1:-1].replace("''", "'") if value[0] == "'" else value[1:-1]
        elif kind == "id":
            value = value.strip('"')
            if value.lower() in _KEYWORDS:
                kind, value = "kw", value.lower()
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.items, self.at = text, tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def take(self, *options: tuple[str, str]) -> bool:
        if self.peek() in options:
            self.at += 1
            return True
        return False

    def expect(self, kind: str, value: str) -> None:
        if not self.take((kind, value)):
            raise RuleError(f"Expected {value!r} in expression: {self.text.strip()[:80]}")

    def whole(self) -> Node:
        n = self.disjunction()
        if self.peek()[0] != "end":
            raise RuleError(f"Unexpected {self.peek()[1]!r} in expression: {self.text.strip()[:80]}")
        return n

    def disjunction(self) -> Node:
        n = self.conjunction()
        while self.take(("kw", "or")):
            n = Node("or", args=(n, self.conjunction()))
        return n

    def conjunction(self) -> Node:
        n = self.negation()
        while self.take(("kw", "and")):
            n = Node("and", args=(n, self.negation()))
        return n

    def negation(self) -> Node:
        return Node("not", args=(self.negation(),)) if self.take(("kw", "not")) else self.comparison()

    def comparison(self) -> Node:
        n = self.sum()
        while True:
            kind, value = self.peek()
            if kind == "op" and value in _COMPARE:
                self.at += 1
                n = Node("compare", _COMPARE[value], (n, self.sum()))
            elif (kind, value) == ("kw", "is"):
                self.at += 1
                inverse = self.take(("kw", "not"))
                self.expect("kw", "null")
                n = Node("notnull" if inverse else "isnull", args=(n,))
            elif kind == "kw" and value in ("in", "like", "between", "not"):
                inverse = self.take(("kw", "not"))
                if self.take(("kw", "in")):
                    self.expect("op", "(")
                    m = Node("in", args=(n, *self.arguments()))
                elif self.take(("kw", "like")):
                    m = Node("like", args=(n, self.sum()))
                elif self.take(("kw", "between")):
                    low = self.sum()
                    self.expect("kw", "and")
                    m = Node("between", args=(n, low, self.sum()))
                else:
                    raise RuleError(f"Unexpected 'not' in expression: {self.text.strip()[:80]}")
                n = Node("not", args=(m,)) if inverse else m
            else:
                return n

    def sum(self) -> Node:
        n = self.product()
        while self.peek() in (("op", "+"), ("op", "-"), ("op", "||")):
            n = Node("binary", self.next()[1], (n, self.product()))
        return n

    def product(self) -> Node:
        n = self.sign()
        while self.peek() in (("op", "*"), ("op", "/"), ("op", "%")):
            n = Node("binary", self.next()[1], (n, self.sign()))
        return n

    def sign(self) -> Node:
        if self.take(("op", "-")):
            return Node("negative", args=(self.sign(),))
        if self.take(("op", "+")):
            return self.sign()
        return self.postfix()

    def postfix(self) -> Node:
        n = self.primary()
        while True:
            if self.take(("op", "?")):
                n = Node("isnull", args=(n,))
            elif self.take(("op", "!?")):
                n = Node("notnull", args=(n,))
            else:
                return n

    def arguments(self) -> tuple[Node, ...]:
        args: list[Node] = []
        if self.take(("op", ")")):
            return ()
        while True:
            args.append(self.disjunction())
            if self.take(("op", ")")):
                return tuple(args)
            self.expect("op", ",")

    def primary(self) -> Node:
        kind, value = self.next()
        if kind == "num":
            return Node("num", value)
        if kind == "str":
            return Node("text", value)
        if kind == "op" and value == ".":
            return Node("bool", "true")
        if kind == "op" and value == "(":
            n = self.disjunction()
            self.expect("op", ")")
            return n
        if kind == "kw" and value in ("true", "false"):
            return Node("bool", value)
        if kind == "kw" and value == "null":
            return Node("null")
        if kind == "kw" and value == "case":
            return self.case()
        if kind == "id":
            if value.lower() in ("date", "timestamp") and self.peek()[0] == "str":
                return Node("datelit", self.next()[1])
            if value.lower() == "extract" and self.take(("op", "(")):
                part = self.next()[1].lower()
                self.expect("kw", "from")
                n = Node("extract", part, (self.disjunction(),))
                self.expect("op", ")")
                return n
            if self.take(("op", "(")):
                return Node("call", value.lower(), self.arguments())
            return Node("name", value)
        raise RuleError(f"Unexpected {value or 'end'!r} in expression: {self.text.strip()[:80]}")

    def case(self) -> Node:
        parts: list[Node] = []
        while self.take(("kw", "when")):
            when = self.disjunction()
            self.expect("kw", "then")
            parts.append(Node("when", args=(when, self.disjunction())))
        other = self.disjunction() if self.take(("kw", "else")) else None
        self.expect("kw", "end")
        if not parts:
            raise RuleError(f"A case needs a condition: {self.text.strip()[:80]}")
        return Node("case", "else" if other else "", (*parts, *((other,) if other else ())))


def parse(text: str) -> Node:
    return _Parser(text).whole()


def names(node: Node) -> set[str]:
    """Variables a tree refers to, lower case; constants are none."""
    own = {node.value.lower()} - set(_CONSTANTS) if node.kind == "name" else set()
    return own.union(*(names(a) for a in node.args))


def variables(text: str | None, observation: bool) -> set[str]:
    """Names in ``text`` that are no columns of an observation, where such columns are in scope."""
    if not text:
        return set()
    found = names(parse(text))
    return found - set(OBSERVATION) if observation else found


def common_type(types: list[str]) -> str:
    kinds = {t for t in types if t != "null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    return "date" if kinds <= {"date"} else "num" if kinds <= {"num", "bool"} else "text"


class Compiler:
    """Trees into SQL, for a scope of named, typed columns."""

    def __init__(self, scope: Callable[[str], Typed | None], sysdate: str | None = None, strict_cast: bool = False):
        self.scope, self.strict = scope, strict_cast
        self.today = f"DATE'{date.fromisoformat(sysdate).isoformat()}'" if sysdate else "current_date()"

    def compile(self, text: str) -> Typed:
        return self.node(parse(text))

    def predicate(self, text: str) -> str:
        return self.boolean(self.compile(text))

    def node(self, n: Node) -> Typed:
        return getattr(self, f"_{n.kind}")(n)

    # conversions

    def number(self, t: Typed) -> str:
        if t.type in ("text", "raw"):
            # a cast alone would also read numbers as Java writes them: 5d, 98.6F, 0x1p3
            return f"{'cast' if self.strict else 'try_cast'}(regexp_replace(trim({t.sql}), '(?<=[0-9.])[dDfFxX]', '?') AS double)"
        if t.type == "bool":
            return f"CAST({t.sql} AS int)"
        if t.type == "null":
            return "CAST(NULL AS double)"
        if t.type == "date":
            raise RuleError("A date stands where a number is needed")
        return t.sql

    @staticmethod
    def text(t: Typed) -> str:
        return f"CAST({t.sql} AS string)"

    @staticmethod
    def date(t: Typed) -> str:
        if t.type in ("num", "bool"):
            raise RuleError("A number stands where a date is needed")
        return f"{'try_cast' if t.type in ('text', 'raw') else 'CAST'}({t.sql} AS date)"

    def whole(self, t: Typed) -> str:
        return f"CAST({self.number(t)} AS int)"

    def boolean(self, t: Typed) -> str:
        if t.type == "bool":
            return t.sql
        return f"({self.number(t)} != 0)" if t.type != "null" else "CAST(NULL AS boolean)"

    def to(self, t: Typed, kind: str) -> str:
        if kind == "num":
            return self.number(t)
        if kind in ("text", "raw"):
            return self.text(t)
        if kind == "date":
            return t.sql if t.type == "date" else self.date(t)
        return self.boolean(t) if kind == "bool" else t.sql

    def unify(self, items: list[Typed]) -> tuple[list[str], str]:
        kind = common_type([t.type for t in items])
        return [self.to(t, kind) for t in items], kind

    # leaves

    def _num(self, n: Node) -> Typed:
        return Typed(n.value if n.value.isdigit() else f"{float(n.value)!r}D", "num")

    def _text(self, n: Node) -> Typed:
        return Typed(literal(n.value), "text")

    def _bool(self, n: Node) -> Typed:
        return Typed(n.value, "bool")

    def _null(self, n: Node) -> Typed:
        return Typed("NULL", "null")

    def _datelit(self, n: Node) -> Typed:
        try:
            day = datetime.fromisoformat(n.value.strip())
        except ValueError:
            raise RuleError(f"This is no date: {n.value}") from None
        return Typed(f"DATE'{day.date()}'" if len(n.value.strip()) <= 10 else f"TIMESTAMP_NTZ'{day.isoformat(sep=' ')}'", "date")

    def _name(self, n: Node) -> Typed:
        low = n.value.lower()
        if low == "sysdate":
            return Typed(self.today, "date")
        if low == "lower__bound__dt":
            return Typed("DATE'0001-01-01'", "date")
        if low == "upper__bound__dt":
            return Typed("DATE'9999-12-31'", "date")
        found = self.scope(low)
        if found is None:
            raise RuleError(f"Undefined variable: {n.value}")
        return found

    # operators

    def _or(self, n: Node) -> Typed:
        return Typed("(" + " OR ".join(self.boolean(self.node(a)) for a in n.args) + ")", "bool")

    def _and(self, n: Node) -> Typed:
        return Typed("(" + " AND ".join(self.boolean(self.node(a)) for a in n.args) + ")", "bool")

    def _not(self, n: Node) -> Typed:
        return Typed(f"(NOT {self.boolean(self.node(n.args[0]))})", "bool")

    def _isnull(self, n: Node) -> Typed:
        return Typed(f"({self.node(n.args[0]).sql} IS NULL)", "bool")

    def _notnull(self, n: Node) -> Typed:
        return Typed(f"({self.node(n.args[0]).sql} IS NOT NULL)", "bool")

    def _pair(self, a: Typed, b: Typed) -> tuple[str, str]:
        """Two sides made comparable: a number beside text reads the text, a date too."""
        kinds = {a.type, b.type}
        if "date" in kinds and kinds & {"num", "bool"}:
            raise RuleError("A date is compared with a number")
        if "num" in kinds or "bool" in kinds and kinds != {"bool"}:
            return self.number(a), self.number(b)
        if "date" in kinds:
            as_date = lambda t: t.sql if t.type in ("date", "null") else self.date(t)
            return as_date(a), as_date(b)
        return a.sql, b.sql

    def _compare(self, n: Node) -> Typed:
        a, b = self._pair(*map(self.node, n.args))
        return Typed(f"({a} {n.value} {b})", "bool")

    def _in(self, n: Node) -> Typed:
        first, *rest = map(self.node, n.args)
        sides: dict[str, list[str]] = {}
        for r in rest:
            a, b = self._pair(first, r)
            sides.setdefault(a, []).append(b)
        return Typed("(" + " OR ".join(f"{a} IN ({', '.join(bs)})" for a, bs in sides.items()) + ")" if rest else "false", "bool")

    def _like(self, n: Node) -> Typed:
        a, p = map(self.node, n.args)
        return Typed(f"({self.text(a)} LIKE {self.text(p)})", "bool")

    def _between(self, n: Node) -> Typed:
        x, low, high = map(self.node, n.args)
        a, b = self._pair(x, low)
        c, d = self._pair(x, high)
        return Typed(f"({a} >= {b} AND {c} <= {d})", "bool")

    def _negative(self, n: Node) -> Typed:
        return Typed(f"(- {self.number(self.node(n.args[0]))})", "num")

    def _binary(self, n: Node) -> Typed:
        a, b = map(self.node, n.args)
        if n.value == "||" or n.value == "+" and "text" in (a.type, b.type):
            return Typed(f"concat({self.text(a)}, {self.text(b)})", "text")
        if n.value == "-" and a.type == "date" and b.type in ("date", "raw", "text"):
            return Typed(f"CAST(datediff({self.date(a)}, {self.date(b)}) AS bigint)", "num")
        if n.value in "+-" and "date" in (a.type, b.type):
            day, shift = (a, b) if a.type == "date" else (b, a)
            if n.value == "-" and day is b or shift.type == "date":
                raise RuleError(f"A date cannot stand there with {n.value!r}")
            return Typed(f"date_{'add' if n.value == '+' else 'sub'}({self.date(day)}, {self.whole(shift)})", "date")
        x, y = self.number(a), self.number(b)
        if n.value == "/":
            return Typed(f"try_divide(CAST({x} AS double), CAST({y} AS double))", "num")
        if n.value == "%":
            return Typed(f"(CASE WHEN {y} != 0 THEN {x} % {y} END)", "num")
        return Typed(f"({x} {n.value} {y})", "num")

    def _case(self, n: Node) -> Typed:
        whens = [a for a in n.args if a.kind == "when"]
        values = [self.node(w.args[1]) for w in whens] + ([self.node(n.args[-1])] if n.value else [])
        return self.choose([self.boolean(self.node(w.args[0])) for w in whens], values)

    def choose(self, conditions: list[str], values: list[Typed]) -> Typed:
        """The value of the first condition that holds; one more value than conditions is the rest's."""
        columns, kind = self.unify(values)
        if not conditions:
            return Typed(columns[0], kind)
        whens = " ".join(f"WHEN {c} THEN {v}" for c, v in zip(conditions, columns))
        return Typed(f"(CASE {whens}{f' ELSE {columns[-1]}' if len(columns) > len(conditions) else ''} END)", kind)

    # functions

    def _extract(self, n: Node) -> Typed:
        part = {"year": "year", "month": "month", "day": "dayofmonth", "hour": "hour", "minute": "minute", "second": "second"}.get(n.value)
        if part is None:
            raise RuleError(f"Unsupported part of a date: {n.value}")
        t = self.node(n.args[0])
        return Typed(f"CAST({part}({self.to(t, 'date')}) AS bigint)", "num")

    def _call(self, n: Node) -> Typed:
        if n.value in ("to_char", "to_date") and len(n.args) == 2 and n.args[1].kind == "text":
            return self._formatted(n.value, self.node(n.args[0]), n.args[1].value)
        f = _FUNCTIONS.get(n.value)
        if f is None:
            raise RuleError(f"Unsupported function in expression: {n.value}")
        least, most, make = f
        if not least <= len(n.args) <= most:
            raise RuleError(f"Wrong number of arguments: {n.value}")
        return make(self, [self.node(a) for a in n.args])

    def _formatted(self, function: str, t: Typed, form: str) -> Typed:
        if function == "to_date":
            return Typed(f"to_date(try_to_timestamp({self.text(t)}, {literal(java_format(form))}))", "date")
        if t.type == "num":
            return Typed(f"to_char({t.sql}, {literal(form)})", "text")
        return Typed(f"date_format({self.to(t, 'date')}, {literal(java_format(form))})", "text")


#: Parts of date formats and their Java forms.
_FORMAT = [("YYYY", "yyyy"), ("YY", "yy"), ("MONTH", "MMMM"), ("MON", "MMM"), ("MM", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("DAY", "EEEE"), ("DY", "EEE"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a")]


def java_format(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        hit = next(((k, v) for k, v in _FORMAT if text[i : i + len(k)].upper() == k), None)
        if hit:
            out += hit[1]
            i += len(hit[0])
        else:
            out += f"'{text[i]}'" if text[i].isalpha() else text[i]
            i += 1
    return out


_MANY = 1000
_Function = tuple[int, int, Callable[[Compiler, list[Typed]], Typed]]


def _coalesce(c: Compiler, args: list[Typed]) -> Typed:
    columns, kind = c.unify(args)
    return Typed(f"coalesce({', '.join(columns)})", kind)


def _extreme(pick: str, skip_nulls: bool) -> _Function:
    def run(c: Compiler, args: list[Typed]) -> Typed:
        if len(args) == 1:
            return args[0]
        columns, kind = c.unify(args)
        best = f"{pick}({', '.join(columns)})"
        return Typed(best if skip_nulls else f"(CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in columns)} THEN {best} END)", kind)

    return 1, _MANY, run


def _numeric(form: str, least: int = 1, most: int = 1) -> _Function:
    return least, most, lambda c, args: Typed(form.format(", ".join(c.number(a) for a in args)), "num")


def _textual(name: str, least: int = 1, most: int = 1) -> _Function:
    return least, most, lambda c, args: Typed(f"{name}({', '.join(c.text(a) for a in args)})", "text")


def _substr(c: Compiler, args: list[Typed]) -> Typed:
    return Typed(f"substr({', '.join([c.text(args[0]), *(c.whole(a) for a in args[1:])])})", "text")


def _to_char(c: Compiler, args: list[Typed]) -> Typed:
    if len(args) == 1:
        return Typed(c.text(args[0]), "text")
    raise RuleError("The format of to_char must be a literal")


def _round(c: Compiler, args: list[Typed]) -> Typed:
    return Typed(f"round({', '.join([c.number(args[0]), *(c.whole(a) for a in args[1:])])})", "num")


def _nullif(c: Compiler, args: list[Typed]) -> Typed:
    a, b = c._pair(*args)
    return Typed(f"(CASE WHEN coalesce({a} = {b}, false) THEN NULL ELSE {args[0].sql} END)", args[0].type)


def _trunc(c: Compiler, args: list[Typed]) -> Typed:
    if args[0].type == "date":
        return Typed(c.date(args[0]), "date")
    x = c.number(args[0])
    return Typed(f"(floor(abs({x})) * signum({x}))", "num")


def _log(c: Compiler, args: list[Typed]) -> Typed:
    x = [f"ln({c.number(a)})" for a in args]
    return Typed(x[0] if len(x) == 1 else f"({x[1]} / {x[0]})", "num")


def _mod(c: Compiler, args: list[Typed]) -> Typed:
    x, y = map(c.number, args)
    return Typed(f"(CASE WHEN {y} != 0 THEN {x} % {y} END)", "num")


_FUNCTIONS: dict[str, _Function] = {
    "nvl": (2, 2, _coalesce), "coalesce": (1, _MANY, _coalesce), "nullif": (2, 2, _nullif), "isnull": (2, 2, _coalesce),
    "to_number": (1, 1, lambda c, a: Typed(f"CAST({c.number(a[0])} AS double)", "num")),
    "to_char": (1, 2, _to_char), "substr": (2, 3, _substr), "substring": (2, 3, _substr),
    "to_date": (1, 1, lambda c, a: Typed(c.date(a[0]), "date")), "trunc": (1, 1, _trunc),
    "least": _extreme("least", False), "greatest": _extreme("greatest", False), "least_date": _extreme("least", True), "greatest_date": _extreme("greatest", True),
    "ceil": _numeric("ceil({})"), "floor": _numeric("floor({})"), "abs": _numeric("abs({})"), "sqrt": _numeric("sqrt({})"), "exp": _numeric("exp({})"), "ln": _numeric("ln({})"), "sign": _numeric("signum({})"),
    "power": _numeric("power({})", 2, 2), "round": (1, 2, _round), "log": (1, 2, _log), "mod": (2, 2, _mod),
    "upper": _textual("upper"), "lower": _textual("lower"), "trim": _textual("trim"), "ltrim": _textual("ltrim"), "rtrim": _textual("rtrim"),
    "concat": _textual("concat", 1, _MANY), "replace": _textual("replace", 2, 3),
    "length": (1, 1, lambda c, a: Typed(f"CAST(length({c.text(a[0])}) AS bigint)", "num")),
    "instr": (2, 2, lambda c, a: Typed(f"CAST(instr({c.text(a[0])}, {c.text(a[1])}) AS bigint)", "num")),
    "date_add": (2, 2, lambda c, a: Typed(f"date_add({c.date(a[0])}, {c.whole(a[1])})", "date")),
    "date_diff": (2, 2, lambda c, a: Typed(f"CAST(datediff({c.date(a[0])}, {c.date(a[1])}) AS bigint)", "num")),
    "months_between": (2, 2, lambda c, a: Typed(f"months_between({c.date(a[0])}, {c.date(a[1])})", "num")),
    "add_months": (2, 2, lambda c, a: Typed(f"add_months({c.date(a[0])}, {c.whole(a[1])})", "date")),
}
