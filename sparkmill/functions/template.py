"""Prompt templates compiled into one Spark expression.

A template holds `{{ expr }}`, `{% if cond %}…{% else %}…{% endif %}`, `{% for i in range(n) %}…{% endfor %}` and
`{% for x in path %}…{% endfor %}` over the elements of an array or the sorted keys of an object. An expression joins terms
by `~`; a term is a quoted literal, a number, a dotted path or one in parentheses, with `| tojson` if wanted. Within a
loop, `loop.index`, `loop.index0`, `loop.length`, `loop.first` and `loop.last` are known. A condition compares two
expressions, asks whether a path is defined, or is a path, with `not` before it if wanted: false, null, 0 and what is empty
do not hold. An undefined path makes the whole text null, which the engine rejects as `template`; so does a loop over what
is no array or object, and a text beyond 8 MiB. A loop's steps, nested ones multiplied, are bounded by MOST_STEPS: when
the template is compiled, and for loops over data when it is rendered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 8 << 20
MOST_STEPS = 100_000
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_PART = re.compile(r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\d+(?:\.\d+)?|[A-Za-z_][\w.]*|[~|()]|==|!=)")


class TemplateError(ValueError):
    pass


def _quoted(text: Column) -> Column:
    """A text as a JSON string; null stays null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), listed.substr(F.lit(2), F.length(listed) - 2))


def text_variant(text: Column) -> Column:
    """A text as a variant of its own."""
    return F.try_variant_get(F.to_variant_object(F.struct(text.alias("t"))), "$.t", "variant")


class _Compiler:
    def __init__(self, context: dict[str, Column], record: Column):
        self.context, self.record, self.loops = context, record, {}

    def variant(self, path: str) -> Column:
        head, *rest = path.split(".")
        base, steps = (self.context[head], rest) if head in self.context else (self.record, [head, *rest])
        where = "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)
        return F.try_variant_get(base, where, "variant")

    def text(self, path: str, as_json: bool) -> Column:
        if path in self.loops:
            return self.loops[path].cast("string")
        v = self.variant(path)
        if as_json:
            return F.when(v.isNotNull(), F.to_json(v))
        return F.when(F.is_variant_null(v), "none").otherwise(F.try_variant_get(v, "$", "string"))

    def parts(self, source: str) -> list[str]:
        found, at = [], 0
        while source[at:].strip():
            m = _PART.match(source, at)
            if not m:
                raise TemplateError(f"cannot read the expression at {at}")
            found.append(m.group(1))
            at = m.end()
        return found

    def expression(self, parts: list[str]) -> Column:
        terms = [self.term(parts)]
        while parts and parts[0] == "~":
            parts.pop(0)
            terms.append(self.term(parts))
        return terms[0] if len(terms) == 1 else F.concat(*terms)

    def term(self, parts: list[str]) -> Column:
        if not parts:
            raise TemplateError("an expression ends early")
        p = parts.pop(0)
        if p == "(":
            inner = self.expression(parts)
            if not parts or parts.pop(0) != ")":
                raise TemplateError("a parenthesis is open")
            plain = lambda j: _quoted(inner) if j else inner
        elif p[0] in "'\"":
            literal = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), p[1:-1])
            plain = lambda j: _quoted(F.lit(literal)) if j else F.lit(literal)
        elif p[0].isdigit():
            plain = lambda _: F.lit(p)
        elif re.match(r"[A-Za-z_]", p):
            plain = lambda j: self.text(p, j)
        else:
            raise TemplateError(f"unexpected {p}")
        as_json = False
        while parts and parts[0] == "|":
            parts.pop(0)
            if not parts or parts.pop(0) != "tojson":
                raise TemplateError("the one filter is tojson")
            as_json = True
        return plain(as_json)

    def condition(self, source: str) -> Column:
        if m := re.fullmatch(r"\s*([A-Za-z_][\w.]*)\s+is\s+(not\s+)?defined\s*", source):
            there = F.lit(True) if m[1] in self.loops else self.variant(m[1]).isNotNull()
            return ~there if m[2] else there
        if m := re.fullmatch(r"(.*?)(==|!=)(.*)", source, re.S):
            a, b = (self.expression(self.parts(x)) for x in (m[1], m[3]))
            return a == b if m[2] == "==" else a != b
        if m := re.fullmatch(r"\s*(not\s+)?([A-Za-z_][\w.]*)\s*", source):
            holds = self.holds(m[2])
            return ~holds if m[1] else holds
        raise TemplateError("a condition is `a == b`, `a != b`, `path is defined` or `path`")

    def holds(self, path: str) -> Column:
        """Whether a value counts as true; null where it is undefined."""
        if path in self.loops:
            return self.loops[path].cast("boolean")
        v = self.variant(path)
        text = F.to_json(v)
        number = F.try_variant_get(v, "$", "double")
        empty = F.is_variant_null(v) | text.isin("false", '""', "[]", "{}") | F.coalesce((number == 0) & ~F.substring(text, 1, 1).isin('"', "t", "f"), F.lit(False))
        return F.when(v.isNotNull(), ~empty)

    def body(self, tokens: list[tuple[str, str]], ends: tuple[str, ...], steps: int | Column) -> tuple[Column, str]:
        out = []
        while tokens:
            kind, value = tokens.pop(0)
            if kind == "text":
                out.append(F.lit(value))
            elif kind == "value":
                parts = self.parts(value)
                out.append(self.expression(parts))
                if parts:
                    raise TemplateError("an expression has a rest")
            else:
                word, _, rest = value.strip().partition(" ")
                if word in ends:
                    return F.concat(F.lit(""), *out), word
                if word == "if":
                    when = self.condition(rest)
                    yes, end = self.body(tokens, ("else", "endif"), steps)
                    no = self.body(tokens, ("endif",), steps)[0] if end == "else" else F.lit("")
                    # An undefined operand is an error, not false.
                    out.append(F.when(when.isNull(), F.lit(None).cast("string")).when(when, yes).otherwise(no))
                elif word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s+range\((\d+)\)", rest.strip())):
                    out.append(self.loop(m[1], int(m[2]), tokens, steps))
                elif word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s+([A-Za-z_][\w.]*)", rest.strip())):
                    out.append(self.over(m[1], m[2], tokens, steps))
                else:
                    raise TemplateError(f"unknown tag {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return F.concat(F.lit(""), *out), ""

    def bound(self, names: dict[str, Column], values: dict[str, Column], tokens: list[tuple[str, str]], steps: int | Column) -> Column:
        """The body of a loop with its names; those of loops around it are there again after it."""
        loops, context = dict(self.loops), dict(self.context)
        for n in (*names, *values):  # a name of an inner loop hides the same one of an outer loop
            self.loops.pop(n, None)
        self.loops |= names
        self.context |= values
        out = self.body(tokens, ("endfor",), steps)[0]
        self.loops, self.context = loops, context
        return out

    @staticmethod
    def places(i: Column, n: Column) -> dict[str, Column]:
        return {"loop.index": i + 1, "loop.index0": i, "loop.length": n, "loop.first": i == 0, "loop.last": i == n - 1}

    @staticmethod
    def joined(items: Column) -> Column:
        return F.when(F.exists(items, lambda x: x.isNull()), F.lit(None).cast("string")).otherwise(F.array_join(items, ""))

    def loop(self, name: str, n: int, tokens: list[tuple[str, str]], steps: int | Column) -> Column:
        total = steps * max(n, 1)
        if isinstance(total, int) and total > MOST_STEPS:
            raise TemplateError("the template has too many steps")
        one = lambda i: self.bound({name: i, **self.places(i, F.lit(n))}, {}, tokens, total)
        items = self.joined(F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), one))
        if not n:
            return F.lit("")
        return items if isinstance(total, int) else F.when(total <= MOST_STEPS, items)

    def over(self, name: str, path: str, tokens: list[tuple[str, str]], steps: int | Column) -> Column:
        """A loop over the elements of an array or the keys of an object."""
        v = self.variant(path)
        keys = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.transform(keys, text_variant))
        n = F.size(items)
        total = n.cast("long") * steps
        one = lambda x, i: self.bound(self.places(i, n), {name: x}, tokens, total)
        return F.when(items.isNotNull() & (total <= MOST_STEPS), self.joined(F.transform(items, one)))


def compile_template(source: str, record: Column, context: dict[str, Column] | None = None) -> Column:
    """The text of the template; null where it fails. `record` and the context's values are variants."""
    tokens, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            tokens.append(("text", source[at : m.start()]))
        tokens.append(("value", m[1]) if m[1] is not None else ("tag", m[2]))
        at = m.end()
    if at < len(source):
        tokens.append(("text", source[at:]))
    out, _ = _Compiler({"record": record, **(context or {})}, record).body(tokens, (), 1)
    return F.when(F.octet_length(out) <= MOST_BYTES, out)


def parts(source: str) -> int:
    """The number of parts of a template whose form is right; TemplateError where it is not."""
    depth, seen = [], 0
    for m in _TAG.finditer(source):
        seen += 1
        if m[1] is not None:
            if not m[1].strip():
                raise TemplateError("an expression is empty")
            continue
        word = m[2].strip().partition(" ")[0]
        if word in ("if", "for"):
            depth.append(word)
        elif word in ("endif", "endfor"):
            if not depth or depth.pop() != word[3:]:
                raise TemplateError(f"{word} without its beginning")
        elif word != "else":
            raise TemplateError(f"unknown tag {word}")
    if depth:
        raise TemplateError(f"end{depth[-1]} is missing")
    return seen
