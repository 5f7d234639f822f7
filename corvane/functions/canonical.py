"""Canonical JSON and what is hashed from it."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal


def canonical_json(value) -> str:
    """Members sorted by UTF-16 code units, no spaces, least escapes; whole numbers only."""

    def check(v, path: str) -> None:
        if isinstance(v, float):
            raise ValueError(f"{path}: a number that isn't whole; carry it as text")
        if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
            raise ValueError(f"{path}: out of range")
        if isinstance(v, dict):
            for k, x in v.items():
                check(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                check(x, f"{path}[{i}]")

    def ordered(v):
        if isinstance(v, dict):
            return {k: ordered(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be"))}
        return [ordered(x) for x in v] if isinstance(v, list) else v

    check(value, "$")
    return json.dumps(ordered(value), ensure_ascii=False, separators=(",", ":"))


def canonical_sha256(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def float_text(x: float) -> str:
    """The shortest digits that read back as the same number, without an exponent."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    text = format(Decimal(repr(float(x))), "f")
    return text[:-2] if text.endswith(".0") else text


def _number(x: float) -> str:
    """A number as JSON's canonical form writes it: with an exponent from 1e21 up and below 1e-6."""
    if x == 0:
        return "0"
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("a number that JSON doesn't have")
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        out = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return ("-" if sign else "") + out


def jcs(value) -> str:
    """Canonical JSON (RFC 8785) with numbers of any kind, all as doubles."""
    if isinstance(value, dict):
        members = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{jcs(value[k])}" for k in members) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(jcs, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return _number(float(value))
