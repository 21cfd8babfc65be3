"""Structured names, stringified tuples and digit timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def face_key(name: Column, index: Column) -> Column:
    """stem_face_index.suffix"""
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.concat(stem, F.lit("_face_"), index.cast("string"), suffix)


def frame_key(channel: Column, ts: Column) -> Column:
    return F.concat(channel, F.lit("_frame_"), F.date_format(ts, "yyyyMMddHHmmssSSSSSS"), F.lit(".png"))


def parse_key(name: Column) -> Column:
    """channel, ts and face index of a five-part key; null for any other."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    made = F.struct(parts[0].alias("channel"), digit_timestamp(parts[2]).alias("ts"), parts[4].cast("int").alias("face"))
    return F.when(F.size(parts) == 5, made)


def digit_timestamp(digits: Column) -> Column:
    """A timestamp from yyyyMMddHHmmss and up to six digits of microseconds."""
    seconds = F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss"))
    micros = F.rpad(F.substring(digits, 15, 6), 6, "0").cast("long")
    return F.timestamp_micros(F.unix_micros(seconds) + F.coalesce(micros, F.lit(0)))


def tuple_of_ints(text: Column) -> Column:
    """'(1, 2)' or '[1, 2]' to an array."""
    return F.transform(F.split(F.btrim(text, F.lit("()[] ")), r"\s*,\s*"), lambda x: x.cast("int"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(",", a.cast("string"), b.cast("string"))


def swap_suffix(name: Column, old: str, new: str) -> Column:
    return F.regexp_replace(name, rf"\.{old}$", f".{new}")


def params_of(path: Column) -> Column:
    """'k_80_th_0.7' to a map of names and values."""
    return F.str_to_map(F.regexp_replace(path, r"([a-z]+)_([0-9.]+)(?:_|$)", "$1=$2;"), F.lit(";"), F.lit("="))
