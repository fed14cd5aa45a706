"""Language-neutral roles of tree nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Role names in their order; the place of a name is its number.
ROLES = """
Invalid Identifier Qualified Operator Binary Unary Left Right Infix Postfix Bitwise Boolean Unsigned
LeftShift RightShift Or Xor And Expression Statement Equal Not LessThan LessThanOrEqual GreaterThan
GreaterThanOrEqual Identical Contains Increment Decrement Negative Positive Dereference TakeAddress File
Add Substract Multiply Divide Modulo Package Declaration Import Pathname Alias Function Body Name Receiver
Argument Value ArgsList Base Implements Instance Subtype Subpackage Module Friend World If Condition Then
Else Switch Case Default For Initialization Update Iterator While DoWhile Break Continue Goto Block Scope
Return Try Catch Finally Throw Assert Call Callee Positional Noop Literal Byte ByteString Character List Map
Null Number Regexp Set String Tuple Type Entry Key Primitive Assignment This Comment Documentation
Whitespace Incomplete Unannotated Visibility Annotation Anonymous Enumeration Arithmetic Relational Variable
""".split()
INVALID, UNANNOTATED = "Invalid", "Unannotated"
_NUMBER = {name: i for i, name in enumerate(ROLES)}


def from_string(name: str) -> str:
    """The role of that name; Invalid if there is none."""
    return name if name in _NUMBER else INVALID


def from_number(i: int) -> str:
    return ROLES[i] if 0 <= i < len(ROLES) else f"Role({i})"


def number(name: str) -> int:
    return _NUMBER.get(name, 0)


def valid(name: str) -> bool:
    return name in _NUMBER and name != INVALID


def dimension(spark: SparkSession) -> DataFrame:
    """(name, id) of all roles: a fixed table of some hundred rows."""
    return spark.createDataFrame(list(_NUMBER.items()), "name string, id int")
