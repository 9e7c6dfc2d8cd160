"""Decode the responder's binary packets with Column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import byte_of, fold_xor, little_endian_u32, unsigned_at

FULL = 18
LEGACY = (7, 8)


def packet_log(
    df: DataFrame,
    payload: str = "payload",
    accept_legacy: bool = True,
    magic: int = 0xAA,
    max_angle: int = 180,
) -> DataFrame:
    """Add header, fire, angle, packet_id, packet_state, risk, zone, the sent and the
    computed checksum, and `valid`.

    Full packets are 18 bytes. The older short form has no checksum; with the compiler's
    padding byte it is 8 bytes long, packed it is 7.
    """
    raw = F.col(payload)
    size = F.length(raw)
    full = size == FULL
    short = size.isin(*LEGACY) if accept_legacy else F.lit(False)
    # Three numbers hold all 18 bytes; every field is a few bits of one of them.
    df = df.withColumns(
        {
            "_a": unsigned_at(raw, 0, 7),
            "_b": unsigned_at(raw, 7, 7),
            "_c": unsigned_at(raw, 14, 4),
            "zone": F.when(
                full,
                F.regexp_replace(F.substring(raw, 10, 8).cast("string"), "\\x00.*$", ""),
            ),
        }
    )
    padded = little_endian_u32(
        F.shiftleft(F.col("_a").bitwiseAND(0xFFFFFF), 8).bitwiseOR(F.col("_b"))
    )
    plain = little_endian_u32(F.col("_a").bitwiseAND(0xFFFFFFFF))
    total = fold_xor(
        F.col("_a").bitwiseXOR(F.col("_b")).bitwiseXOR(F.shiftright("_c", 8))
    )
    df = df.withColumns(
        {
            "header": byte_of("_a", 48),
            "fire": byte_of("_a", 40) == 1,
            "angle": byte_of("_a", 32),
            "packet_id": F.when(
                full | short, F.when(size == LEGACY[1], padded).otherwise(plain)
            ),
            "packet_state": F.when(full, byte_of("_b", 48)),
            "risk": F.when(full, byte_of("_b", 40)),
            "checksum": F.when(full, byte_of("_c", 0)),
            "computed_checksum": F.when(full, total),
        }
    ).drop("_a", "_b", "_c")
    right = F.col("header") == magic
    return df.withColumn(
        "valid",
        F.when(
            full,
            right
            & (F.col("angle") <= max_angle)
            & (F.col("computed_checksum") == F.col("checksum")),
        )
        .when(short, right)
        .otherwise(F.lit(False)),
    )
