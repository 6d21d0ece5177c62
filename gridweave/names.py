"""Scalars that are checked once, where they enter: names, units, formats and days of the year."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidName, InvalidUnit, InvalidMonthDay

_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def name(value) -> str:
    """A non-empty string without outer white space and control characters; case is kept, order is by bytes."""
    if not isinstance(value, str) or not value:
        raise InvalidName(value=value, why="empty")
    if not value.strip():
        raise InvalidName(value=value, why="only white space")
    if any(ord(c) < 0x20 or 0x7F <= ord(c) < 0xA0 for c in value):
        raise InvalidName(value=value, why="a control character")
    if value != value.strip():
        raise InvalidName(value=value, why="white space at an end")
    return value


def unit(value) -> str:
    """Like a name, but control characters may be inside."""
    if not isinstance(value, str) or not value.strip() or value != value.strip():
        raise InvalidUnit(value=value)
    return value


def by_bytes(text: str) -> bytes:
    """Sort key of names: the order of their UTF-8 bytes, which is also Spark's order of strings."""
    return text.encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class MonthDay:
    """A day that every year has: 29 February is none."""

    month: int
    day: int

    def __post_init__(self):
        if not 1 <= self.month <= 12 or not 1 <= self.day <= _DAYS[self.month - 1]:
            raise InvalidMonthDay(month=self.month, day=self.day)

    def to_json(self) -> dict:
        return {"month": self.month, "day": self.day}

    @classmethod
    def from_json(cls, data: dict) -> MonthDay:
        return cls(data["month"], data["day"])
