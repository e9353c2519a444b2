"""Validation rules of a cell: what both the Column functions and the wrappers of fetched rows go by."""

from __future__ import annotations

# The messages of broken rules, the characters that trimming takes away, what counts as true, and the form of an address.
MESSAGES = {
    "required": "Field is required",
    "numeric": "Value must be numeric",
    "email": "Invalid email",
    "min": "Too short",
    "max": "Too long",
}
TRIMMED = " \t\n\r\x00\x0b"
TRUE_WORDS = ("1", "true", "yes", "on", "y")
EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$"


def parse(rule: str) -> tuple[str, int | None] | None:
    """A rule's name and its number of bytes; None for a rule that isn't known or lacks its number."""
    name, _, number = rule.partition(":")
    if name not in MESSAGES or (name in ("min", "max") and not number):
        return None
    return name, int(number) if name in ("min", "max") else None
