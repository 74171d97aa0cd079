"""File-system records over hexadecimal columns: packed tables, chains, directories, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import octets

# Marks of a 12-bit table.
FREE, BAD, LAST = 0x000, 0xFF7, 0xFFF


def pack12(entries: Column) -> Column:
    """Digits of a 12-bit table: two entries in three bytes."""
    at = lambda i: F.coalesce(F.get(entries, i), F.lit(0))

    def three(i: Column) -> Column:
        a, b = at(i * 2), at(i * 2 + 1)
        middle = F.shiftright(a, 8).bitwiseOR(F.shiftleft(b.bitwiseAND(15), 4))
        return F.concat(octets.digits(a.bitwiseAND(255), 1), octets.digits(middle, 1), octets.digits(F.shiftright(b, 4), 1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(entries) - 1) / 2).cast("int")), three), "")


def entry12(table: Column, k: Column) -> Column:
    """Entry k of a packed 12-bit table."""
    at = F.floor(k * 3 / 2).cast("int")
    pair = octets.byte(table, at) + octets.byte(table, at + 1) * 256
    return F.when(k % 2 == 1, F.shiftright(pair, 4)).otherwise(pair.bitwiseAND(0xFFF))


def find_paths(entries: DataFrame, paths: DataFrame, root: int = 0) -> DataFrame:
    """(path_id, found, depth): each path's components are looked up one after another, whatever their case.

    entries: parent, name, id; paths: path_id, path. Each round resolves one component of all paths that are still
    open; there are as many rounds as the longest path has components."""
    names = F.upper(F.col("name"))
    table = entries.select(F.col("parent").alias("_parent"), names.alias("_name"), F.col("id").alias("_id"))
    parts = F.filter(F.split(F.upper("path"), "/"), lambda x: x != "")
    at = paths.select("path_id", parts.alias("_parts"), F.lit(root).cast("long").alias("_at"), F.lit(0).cast("long").alias("depth"))
    most = at.agg(F.max(F.size("_parts"))).first()[0] or 0
    for i in range(most):
        step = at.join(table, (F.col("_at") == F.col("_parent")) & (F.get("_parts", F.lit(i)) == F.col("_name")) & (F.col("depth") == i), "left")
        moved = F.col("_id").isNotNull()
        at = step.select("path_id", "_parts", F.when(moved, F.col("_id")).otherwise(F.col("_at")).alias("_at"), F.when(moved, i + 1).otherwise(F.col("depth")).cast("long").alias("depth"))
    return at.select("path_id", F.when(F.col("depth") == F.size("_parts"), F.col("_at")).alias("found"), "depth")


def chain_positions(links: DataFrame, store) -> DataFrame:
    """(id, head, pos) of every node of (id, next) that hangs on a head, by pointer jumping over the links turned round.

    Each round doubles the distance; store() writes a round's table where lineage must be cut. Nodes in a cycle have
    no head and are left out."""
    back = links.where("next IS NOT NULL").select(F.col("next").alias("id"), F.col("id").alias("up"))
    at = store(links.select("id").join(back, "id", "left").select("id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("pos"), F.coalesce("up", "id").alias("head")))
    total = links.count()
    reach = 1
    while reach < total and not at.where("up IS NOT NULL").isEmpty():
        far = at.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("pos").alias("more"), F.col("head").alias("top"))
        at = store(at.join(far, "up", "left").select("id", F.col("far").alias("up"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.coalesce("top", "head").alias("head")))
        reach *= 2
    return at.where("up IS NULL").select("id", "head", "pos")


def carry_sum(longs: Column) -> Column:
    """Sum of 32-bit numbers modulo 2 to the 32nd."""
    return F.aggregate(longs, F.lit(0).cast("long"), lambda a, x: (a + x) % 4294967296)


def longs(hexed: Column, n: int) -> Column:
    """n big-endian 32-bit numbers; what is missing is zero."""
    return F.transform(F.regexp_extract_all(F.rpad(hexed, 8 * n, "0"), F.lit(".{8}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))


def name_hash(name: Column, slots: int = 72) -> Column:
    """Slot of a name in a hashed directory."""
    up = F.upper(name)
    h = F.aggregate(F.split(up, ""), F.length(up).cast("long"), lambda h, c: (h * 13 + F.ascii(c)).bitwiseAND(0x7FFFFFFF))
    return h % slots


def disk_parameters(block: Column, entries: Column, data_bytes: Column) -> dict[str, Column]:
    """Parameters derived from block size, directory entries and data bytes; null where the block size is none of the five."""
    shift = F.log2(block / 128).cast("int")
    known = block.isin(1024, 2048, 4096, 8192, 16384)
    total = F.floor(data_bytes / block).cast("long")
    wide = total - 1 > 255
    dirs = F.floor((entries * 32 + block - 1) / block).cast("long")
    mask = sum((F.when(dirs > i, 0x8000 >> i).otherwise(0) for i in range(16)), F.lit(0).cast("long"))
    out = {"bsh": shift.cast("long"), "blm": (block / 128).cast("long") - 1, "dsm": total - 1, "drm": entries - 1, "al0": F.shiftright(mask, 8), "al1": mask.bitwiseAND(255),
           "exm": F.when(wide, (block / 256).cast("long") - 1).otherwise((block / 128).cast("long") - 1), "cks": F.floor((entries + 3) / 4).cast("long"), "wide": wide}
    return {k: F.when(known & (total > 0), v).alias(k) for k, v in out.items()}
