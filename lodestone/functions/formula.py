"""Chemical formulas as text: parsing, reducing and writing."""

from __future__ import annotations

import re
from fractions import Fraction
from math import gcd

from lodestone.operators.crystals import NUMBER

_PIECE = re.compile(r"([A-Z][a-z]?)|([(\[{])|([)\]}])|(\d+\.?\d*|\.\d+)|([·.*])|(\s+|_|\$|\\mathrm|\\rm|\\|,)")
#: Subscript digits.
_SUBSCRIPT = str.maketrans("₀₁₂₃₄₅₆₇₈₉", "0123456789")


def parse_formula(text: str | None) -> dict[str, float] | None:
    """'Cs 3 Te 1', 'Sb_{8}Cd', 'Ca(OH)2', 'AuSb', 'CuSO4·5H2O' to counts by symbol, in order of appearance; None for null, empty or unreadable text.

    A number after a symbol or bracket multiplies it; braces around a number only mark a subscript; a leading number after a dot multiplies
    the rest of that part. Deuterium and tritium count as hydrogen.
    """
    if text is None:
        return None
    s = re.sub(r"_?\{\s*(\d+\.?\d*|\.\d+)\s*\}", r"\1", text.translate(_SUBSCRIPT).strip())
    total: dict[str, float] = {}
    for part in re.split(r"[·•*]", s):
        m = re.match(r"\s*(\d+\.?\d*)\s*(?=[A-Z(\[])", part)
        factor = float(m[1]) if m else 1.0
        one = _parse_part(part[m.end() :] if m else part)
        if one is None:
            return None
        for k, v in one.items():
            total[k] = total.get(k, 0.0) + factor * v
    return total or None


def _parse_part(s: str) -> dict[str, float] | None:
    last: dict[str, float] | None = None
    groups: list[list[dict[str, float]]] = [[]]
    at = 0
    while at < len(s):
        m = _PIECE.match(s, at)
        if not m:
            return None
        at = m.end()
        sym, opens, closes, number, dot, _ = m.groups()
        if sym:
            if sym not in NUMBER:
                return None
            last = {"H" if sym in ("D", "T") else sym: 1.0}
            groups[-1].append(last)
        elif opens:
            groups.append([])
            last = None
        elif closes:
            if len(groups) == 1:
                return None
            inner = _sum(groups.pop())
            last = inner
            groups[-1].append(inner)
        elif number:
            if last is None:
                return None
            for k in last:
                last[k] *= float(number)
            last = None
        elif dot:
            return None
    return _sum(groups[0]) if len(groups) == 1 else None


def _sum(parts: list[dict[str, float]]) -> dict[str, float]:
    out: dict[str, float] = {}
    for p in parts:
        for k, v in p.items():
            out[k] = out.get(k, 0.0) + v
    return out


def reduce_counts(counts: dict[str, float], max_denominator: int = 64) -> dict[str, int]:
    """The smallest whole numbers in the same ratio; zero counts are left out."""
    fr = {k: Fraction(v).limit_denominator(max_denominator) for k, v in counts.items() if v > 0}
    if not fr:
        return {}
    den = 1
    for f in fr.values():
        den = den * f.denominator // gcd(den, f.denominator)
    whole = {k: int(f * den) for k, f in fr.items()}
    g = gcd(*whole.values())
    return {k: v // g for k, v in whole.items()}


def format_formula(counts: dict[str, float], style: str = "plain") -> str:
    """'Cs2Te' in order of symbol; style 'latex' writes $\\mathrm{Cs_{2}Te}$."""

    def num(v: float) -> str:
        t = "" if v == 1 else f"{v:g}"
        return f"_{{{t}}}" if t and style == "latex" else t

    body = "".join(f"{k}{num(v)}" for k, v in sorted(counts.items()) if v > 0)
    return f"$\\mathrm{{{body}}}$" if style == "latex" else body
