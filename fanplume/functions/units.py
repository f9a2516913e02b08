"""Units of values as text, such as `mm`, `km/h` or `W/m²`; empty text is a pure number and `?` an unknown unit."""

from __future__ import annotations

from collections import Counter

UNKNOWN = "?"
HOURS = "h"
#: What follows a symbol that is multiplied more than once.
RAISED = {1: "", 2: "²", 3: "³"}


def factors(unit: str) -> Counter[str]:
    """How often each symbol is a factor; of divisors, a negative number."""
    found: Counter[str] = Counter()
    for k, part in enumerate(unit.split("/")):
        for word in part.split("·"):
            symbol, times = _raised(word)
            if symbol:
                found[symbol] += -times if k else times
    return found


def _raised(word: str) -> tuple[str, int]:
    """A symbol and how often it is multiplied: `m³` and `m^4`; the number 1 has no symbol."""
    symbol, raised, times = word.partition("^")
    if raised:
        return symbol, int(times)
    symbol = word.rstrip("²³")
    return ("", 0) if word == "1" else (symbol, next(n for n, mark in RAISED.items() if word == symbol + mark))


def spelled(found: Counter[str]) -> str:
    """The unit with these factors; divisors follow one by one, each behind its own stroke."""
    words = {way: [s + RAISED.get(way * n, f"^{way * n}") for s, n in sorted(found.items()) if way * n > 0] for way in (1, -1)}
    return "/".join(["·".join(words[1]) or ("1" if words[-1] else ""), *words[-1]])


def _joined(a: str, b: str, way: int) -> str:
    if UNKNOWN in (a, b):
        return UNKNOWN
    one, two = factors(a), factors(b)
    return spelled(Counter({s: one[s] + way * two[s] for s in {*one, *two}}))


def product(a: str, b: str) -> str:
    return _joined(a, b, 1)


def quotient(a: str, b: str) -> str:
    return _joined(a, b, -1)


def power(a: str, n: float) -> str:
    """`?` where a factor would not be whole, as in the square root of a length."""
    if a == UNKNOWN or any(k * n != int(k * n) for k in factors(a).values()):
        return UNKNOWN
    return spelled(Counter({s: int(k * n) for s, k in factors(a).items()}))
