"""Base rules for personal data: e-mail and IP addresses, card and phone numbers."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")

# The local part is taken leftwards from each ``@``: a search from every letter would be quadratic in long words.
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    """Whether digits are at most 255, leading zeros aside."""
    short = part.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[str, int, int]]:
    out, free = [], 0
    for m in HOST.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            free = m.end()
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed; none for a null text."""
    if not text or not ANCHOR.search(text):
        return []
    out = emails(text) if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
