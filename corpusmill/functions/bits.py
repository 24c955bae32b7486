"""Shifts and gates on bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of shifts (SHL moves right and SHR left) and names of gates.
SHIFTS = ("ROT", "SHL", "SHR")
GATES = ("AND", "ANDN", "OR", "ORN", "XOR", "XORN")


def shift8(value: Column, kind: str, by: int) -> Column:
    """A byte rotated left, or moved right (SHL) or left (SHR) by 1 to 7 places."""
    v = value.cast("int").bitwiseAND(255)
    left, right = F.shiftleft(v, by), F.shiftright(v, by)
    if kind == "ROT":
        return left.bitwiseOR(F.shiftright(v, 8 - by)).bitwiseAND(255)
    if kind not in SHIFTS:
        raise KeyError(kind)
    return right if kind == "SHL" else left.bitwiseAND(255)


def gate8(a: Column, b: Column, name: str) -> Column:
    """A gate of two bytes; names with N negate the second."""
    if name not in GATES:
        raise KeyError(name)
    x, y = a.cast("int").bitwiseAND(255), b.cast("int").bitwiseAND(255)
    if name.endswith("N"):
        y = y.bitwiseXOR(255)
    stem = name.removesuffix("N")
    return x.bitwiseAND(y) if stem == "AND" else x.bitwiseOR(y) if stem == "OR" else x.bitwiseXOR(y)


def bit_array(text: Column) -> Column:
    """Ones and zeros of a bit string."""
    return F.transform(F.split(text, ""), lambda c: (c == "1").cast("int"))
