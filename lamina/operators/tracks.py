"""Tracks of bit cells and intervals: writing sectors as tracks, and reading them back by marks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codec

ENCODINGS = ("MFM", "FM", "C64", "APPLE", "AMIGA")
#: Bytes of a sector in each encoding.
SIZES = {"MFM": 128, "FM": 128, "C64": 256, "APPLE": 256, "AMIGA": 512}


def encode(sectors: DataFrame, encoding: str, damage: Column | None = None) -> DataFrame:
    """(track, cells) of (track, sector, data as digits). A track holds what fits the medium: its sectors are one row, and
    are collected as bytes before they become cells. The number of the track is kept modulo 160 in its headers.

    damage, if given, is the position of a cell of the sector's end to turn round, or null."""
    cut = F.lit(None) if damage is None else damage
    one = F.struct(F.col("sector").cast("long").alias("sector"), F.unhex("data").alias("data"), cut.cast("long").alias("damage"))
    kind = sectors.schema["track"].dataType.simpleString()
    by = sectors.groupBy("track").agg(F.array_sort(F.collect_list(one)).alias("sectors"))
    return by.mapInArrow(partial(codec.written, encoding=encoding), f"track {kind}, cells string")


def _decoder(encoding: str, doc: str):
    def run(tracks: DataFrame, size: int = 128) -> DataFrame:
        kind = tracks.schema["track"].dataType.simpleString()
        return tracks.select("track", "cells").mapInArrow(partial(codec.read, encoding=encoding, size=size), f"track {kind}, {codec.FOUND}")

    run.__doc__ = doc
    return run


decode_mfm = _decoder("MFM", "(track, cyl, head, sector, data, header_ok, data_ok): three syncs, an address or data mark, checksums over both.")
decode_fm = _decoder("FM", "As decode_mfm for single density: marks are known by the clocks that they lack, checksums start at the mark.")
decode_c64 = _decoder("C64", "Ten ones or more are a sync; header and data blocks in group code with exclusive-or checks.")
decode_apple = _decoder("APPLE", "Prologues of three bytes, addresses in odd and even bits, data in six-bit codes with a running difference.")
decode_amiga = _decoder("AMIGA", "Any run of syncs; fields of odd bits, then even bits; exclusive-or checks over header and data.")
DECODERS = {"MFM": decode_mfm, "FM": decode_fm, "C64": decode_c64, "APPLE": decode_apple, "AMIGA": decode_amiga}


def decode(tracks: DataFrame) -> DataFrame:
    """Sectors of (track, encoding, cells): every track goes to its encoding's decoder."""
    out = None
    for name, decoder in DECODERS.items():
        got = decoder(tracks.where(F.col("encoding") == name)).withColumn("encoding", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def intervals(tracks: DataFrame) -> DataFrame:
    """(track, idx from 0, cells): how many cells lie between the ones of (track, cells); what follows the last one is lost."""
    runs = F.regexp_extract_all("cells", F.lit("0*1"), F.lit(0))
    return tracks.select("track", F.posexplode(runs).alias("idx", "run")).select("track", F.col("idx").cast("long").alias("idx"), F.length("run").cast("long").alias("cells"))


def from_intervals(runs: DataFrame) -> DataFrame:
    """(track, cells) again from (track, idx, cells)."""
    one = F.struct("idx", F.concat(F.repeat(F.lit("0"), (F.col("cells") - 1).cast("int")), F.lit("1")).alias("c"))
    return runs.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["c"]), "").alias("cells"))  # a track of the medium


def runs(tracks: DataFrame) -> DataFrame:
    """(track, runs) of (track, cells): intervals with a track's in one array, in their order, no row each."""
    return tracks.select("track", F.transform(F.regexp_extract_all("cells", F.lit("0*1"), F.lit(0)), lambda r: F.length(r)).alias("runs"))


def from_runs(tracks: DataFrame) -> DataFrame:
    """(track, cells) again from (track, runs)."""
    return tracks.select("track", F.array_join(F.transform("runs", lambda n: F.lpad(F.lit("1"), n, "0")), "").alias("cells"))
