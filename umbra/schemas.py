"""Schemas and the category dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECT = "struct<x:double,y:double,w:double,h:double>"
SPANS = "array<struct<start:int,length:int,category:string,confidence:double,rule:string,seq:int,text:string>>"
PAGES = "doc_id string, page int, width double, height double, text string, from_ocr boolean"
WORDS = f"doc_id string, page int, idx int, text string, text_start int, line int, rect {RECT}"

# The closed list of categories in declaration order, their display names, and whether a finding is offered as accepted.
CATEGORIES = (
    ("Name", "Name", True),
    ("DateOfBirth", "Date of birth", True),
    ("Date", "Other date", False),
    ("SocialSecurityNumber", "Social Security number", True),
    ("DriverLicense", "Driver's license / state ID", True),
    ("PassportNumber", "Passport number", True),
    ("Address", "Address", True),
    ("PhoneNumber", "Phone number", True),
    ("EmailAddress", "Email address", True),
    ("FinancialAccount", "Financial account", True),
    ("VehicleIdentifier", "Vehicle ID / plate", True),
    ("CriminalJusticeIdentifier", "Criminal justice ID (FBI/SID/booking)", True),
    ("PlaceOfBirth", "Place of birth", True),
    ("MaidenName", "Mother's maiden name", True),
    ("IpAddress", "IP address", False),
    ("OnlineHandle", "Username / online handle", True),
    ("WebAddress", "Web link", True),
    ("CustomTerm", "Custom term", True),
    ("Manual", "Manual selection", True),
)
NOT_OFFERED = tuple(name for name, _, offered in CATEGORIES if not offered)


def values_sql(rows: list[tuple], names: str) -> str:
    """A VALUES relation that Spark and DuckDB read alike."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def categories_sql() -> str:
    return values_sql([(i, *c) for i, c in enumerate(CATEGORIES)], "ordinal, category, display_name, accepted_by_default")


def categories(spark: SparkSession) -> DataFrame:
    """The 19-row dimension of categories."""
    rows = [(i, *c) for i, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "ordinal int, category string, display_name string, accepted_by_default boolean")
