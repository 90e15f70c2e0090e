"""Translations of format codes and types."""

from __future__ import annotations

from pyspark.sql import types as T

# Strftime codes and the pattern letters of Spark's date_format.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "l": "h", "k": "H", "M": "mm", "S": "ss",
    "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "%": "%",
}


def date_pattern(codes: str) -> str:
    """A strftime format as a pattern of Spark's date_format; other letters are quoted."""
    out, quoted, i = [], "", 0

    def close() -> None:
        nonlocal quoted
        if quoted:
            out.append("'" + quoted.replace("'", "''") + "'")
        quoted = ""

    while i < len(codes):
        c = codes[i]
        if c == "%" and i + 1 < len(codes):
            if codes[i + 1] not in STRFTIME:
                raise ValueError(f"the date code %{codes[i + 1]} isn't known")
            close()
            out.append(STRFTIME[codes[i + 1]])
            i += 1
        elif c.isalpha() or c == "'":
            quoted += c
        else:
            close()
            out.append(c)
        i += 1
    close()
    return "".join(out)


# Declared types by name.
TYPES: dict[str, T.DataType] = {
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "MEDIUMINT": T.IntegerType(), "BIGINT": T.LongType(), "SERIAL": T.LongType(),
    "FLOAT": T.DoubleType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampType(), "TIMESTAMP": T.TimestampType(), "TIME": T.StringType(),
    "VARCHAR": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(),
    "ENUM": T.StringType(), "SET": T.StringType(), "JSON": T.StringType(), "JSONB": T.StringType(),
}
# The next wider type of unsigned ones.
UNSIGNED: dict[str, T.DataType] = {"TINYINT": T.ShortType(), "SMALLINT": T.IntegerType(), "INT": T.LongType(), "INTEGER": T.LongType(), "MEDIUMINT": T.LongType(), "BIGINT": T.DecimalType(20, 0)}


def spark_type(name: str, arguments: list[str], unsigned: bool = False) -> T.DataType:
    """The type of a declared column."""
    name = name.upper()
    if name in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(*[int(x) for x in arguments] or [10, 0])
    if unsigned and name in UNSIGNED:
        return UNSIGNED[name]
    if name not in TYPES:
        raise ValueError(f"the type {name} isn't known")
    return TYPES[name]
