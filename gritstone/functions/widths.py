"""Safe evaluation of width expressions: + - * / << >> unary minus, parentheses, $clog2. Never eval."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(\$clog2|[A-Za-z_]\w*|\d+'[hHdDbBoO][0-9a-fA-F_]+|0[xX][0-9a-fA-F]+|\d+|<<|>>|[-+*/()])")


class WidthError(ValueError):
    pass


class _Form(WidthError):
    """Not an expression."""


def clog2(n: int) -> int:
    if n < 1:
        raise WidthError("clog2 of a number below 1")
    return (n - 1).bit_length()


def evaluate(expr: str, params: dict[str, int] | None = None) -> int | str:
    """The value, or the text itself where it names something unknown or is no expression; what has no value raises."""
    try:
        return _evaluate(expr, params)
    except _Form:
        return expr.strip()


def _evaluate(expr: str, params: dict[str, int] | None) -> int | str:
    params = params or {}
    tokens, at = [], 0
    expr = expr.strip()
    while at < len(expr):
        m = _TOKEN.match(expr, at)
        if not m:
            raise _Form(f"unexpected {expr[at]!r}")
        tokens.append(m[1])
        at = m.end()
    unknown = [t for t in tokens if re.match(r"[A-Za-z_]", t) and t not in params]
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else None

    def take():
        nonlocal place
        place += 1
        return tokens[place - 1] if place <= len(tokens) else None

    def atom() -> int:
        t = take()
        if t is None:
            raise _Form("the expression ends early")
        if t == "-":
            return -atom()
        if t == "(":
            v = shift()
            if take() != ")":
                raise _Form("a parenthesis stays open")
            return v
        if t == "$clog2":
            if take() != "(":
                raise _Form("$clog2 needs an argument")
            v = shift()
            if take() != ")":
                raise _Form("a parenthesis stays open")
            return clog2(v) if not unknown else 1
        if t in params:
            return int(params[t])
        if "'" in t:
            return int(t.split("'")[1][1:].replace("_", ""), {"h": 16, "d": 10, "b": 2, "o": 8}[t.split("'")[1][0].lower()])
        if t[0].isdigit():
            return int(t, 0) if t[:2].lower() == "0x" else int(t)
        if re.match(r"[A-Za-z_]", t):
            return 1  # unknown: only the form is checked
        raise _Form(f"unexpected {t!r}")

    def product() -> int:
        v = atom()
        while peek() in ("*", "/"):
            op, r = take(), atom()
            if op == "/" and r == 0 and not unknown:
                raise WidthError("division by zero")
            v = v * r if op == "*" else v // (r or 1)
        return v

    def total() -> int:
        v = product()
        while peek() in ("+", "-"):
            v = v + product() if take() == "+" else v - product()
        return v

    def shift() -> int:
        v = total()
        while peek() in ("<<", ">>"):
            op, r = take(), total()
            v = v << min(max(r, 0), 4096) if op == "<<" else v >> max(r, 0)
        return v

    v = shift()
    if place != len(tokens):
        raise _Form(f"unexpected {peek()!r}")
    return expr if unknown else v
