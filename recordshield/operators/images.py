"""Masking of image header tables (patient > study > series > instance), one row per instance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import birth_year, shift_column


def surrogate_uid(parts: Sequence[str], salt: str, root: str) -> Column:
    """A uid that stays the same for the same level key: ``root`` and 112 bits of a keyed hash, as up to 34 digits.

    Two blocks of 56 bits; the second is filled up to 17 digits, so that the digits tell the blocks apart.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(salt), *[F.col(p).cast("string") for p in parts]), 256)
    high, low = F.conv(F.substring(digest, 1, 14), 16, 10), F.conv(F.substring(digest, 15, 14), 16, 10)
    return F.concat(F.lit(root + "."), high, F.lpad(low, 17, "0"))


def mask_headers(
    headers: DataFrame,
    uids: dict[str, Sequence[str]],
    salt: str,
    root: str,
    patients: DataFrame,
    patient_column: str,
    map_column: str,
    names: dict[str, str] | None = None,
    births: Sequence[str] = (),
    shifted: Sequence[str] = (),
    blanked: Sequence[str] = (),
) -> DataFrame:
    """New uids per level, patient id to its surrogate, names masked, birth dates to the year, dates moved, listed tags blank.

    Headers of unknown patients are dropped.
    """
    side = patients.select(F.col(map_column).alias("__k"), "sur_patient_id", "day_offset")
    joined = headers.join(side, headers[patient_column] == side["__k"], "inner")
    out = []
    for f in headers.schema.fields:
        c, text = f.name, f.dataType.simpleString() == "string"
        if c in uids:
            out.append(surrogate_uid(uids[c], salt, root).alias(c))
        elif c == patient_column:
            out.append(F.col("sur_patient_id").alias(c))
        elif names and c in names:
            out.append(F.lit(names[c]).alias(c))
        elif c in births:
            out.append(birth_year(c, text).alias(c))
        elif c in shifted:
            out.append(shift_column(c, "day_offset", text).alias(c))
        elif c in blanked:
            out.append(F.lit("").alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
