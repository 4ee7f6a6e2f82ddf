"""Canonical JSON by RFC 8785: the one text of a value over which a hash is taken."""

from __future__ import annotations

import json
import math
from decimal import Decimal

_quote = json.JSONEncoder(ensure_ascii=False).encode


def number(x: int | float) -> str:
    """A number as ECMAScript writes it: the shortest digits that read back as the same double, 1e21 and 1e-7 with an exponent.

    ValueError for what is no finite double, and for integers that no double is equal to.
    """
    if isinstance(x, int):
        if abs(x) <= 1 << 53:
            return str(x)
        if abs(x) >= 1 << 1023 or int(float(x)) != x:
            raise ValueError(f"{x} is no double")
    if not math.isfinite(x):
        raise ValueError(f"{x} is not finite")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(x))).as_tuple()
    text = "".join(map(str, digits))
    short = text.rstrip("0")
    point = len(text) + exponent  # digits before the decimal point
    if len(short) <= point <= 21:
        out = short + "0" * (point - len(short))
    elif 0 < point <= 21:
        out = f"{short[:point]}.{short[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{short}"
    else:
        out = f"{short[0]}{'.' if len(short) > 1 else ''}{short[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return f"-{out}" if sign else out


def _string(s: str) -> str:
    s.encode("utf-8")  # a lone surrogate is no text: UnicodeEncodeError, a ValueError
    return _quote(s)


def encode(x: object) -> str:
    """Keys in the order of their UTF-16 code units, no spaces, strings escaped no more than they must be."""
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, str):
        return _string(x)
    if isinstance(x, int | float):
        return number(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{_string(k)}:{encode(v)}" for k, v in sorted(x.items(), key=lambda kv: kv[0].encode("utf-16-be"))) + "}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(encode, x)) + "]"
    raise TypeError(f"no JSON value: {type(x).__name__}")
