"""Declared schemas of the five tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(
        id=T.LongType(),
        name=T.StringType(),
        email=T.StringType(),
        role=T.StringType(),
        is_active=T.BooleanType(),
        created_at=T.TimestampNTZType(),
        updated_at=T.TimestampNTZType(),
    ),
    "courses": _struct(
        id=T.LongType(),
        name=T.StringType(),
        price=MONEY,
        description=T.StringType(),
        is_active=T.BooleanType(),
        created_at=T.TimestampNTZType(),
        updated_at=T.TimestampNTZType(),
    ),
    "students": _struct(
        id=T.LongType(),
        student_id=T.StringType(),
        first_name=T.StringType(),
        last_name=T.StringType(),
        email=T.StringType(),
        phone=T.StringType(),
        address=T.StringType(),
        course_id=T.LongType(),
        enrollment_date=T.DateType(),
        is_active=T.BooleanType(),
        created_at=T.TimestampNTZType(),
        updated_at=T.TimestampNTZType(),
    ),
    "payments": _struct(
        id=T.LongType(),
        student_id=T.LongType(),
        amount_paid=MONEY,
        payment_method=T.StringType(),
        payment_date=T.DateType(),
        collected_by=T.LongType(),
        notes=T.StringType(),
        created_at=T.TimestampNTZType(),
    ),
    "logs": _struct(
        id=T.LongType(),
        user_id=T.LongType(),
        action=T.StringType(),
        role=T.StringType(),
        created_at=T.TimestampNTZType(),
    ),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the declared columns and types; absent ones become NULL, others go.

    Columns outside the schema (such as password hashes) never enter the ledger.
    """
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[table].fields
        ]
    )
