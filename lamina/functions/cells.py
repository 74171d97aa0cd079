"""Bit cells as strings of 0 and 1: the codes that tracks are written in, as column expressions.

Everything stays inside Spark's own string and array functions; a block between two marks is worked on as a whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import octets
from .scalars import crc16_ccitt

# Sync words and marks as cells, the two group codes.
SYNC = "0100010010001001"
FM_ADDRESS, FM_DATA = "1111010101111110", "1111010101101111"
GROUPS = "01010 01011 10010 10011 01110 01111 10110 10111 01001 11001 11010 11011 01101 11101 11110 10101".split()
APPLE_ADDRESS, APPLE_DATA, APPLE_END = "D5AA96", "D5AAAD", "DEAAEB"
#: CRC-16 register after the three sync bytes.
AFTER_SYNC = 0xCDB4


def _six_codes() -> list[int]:
    """Disk bytes of the 6-bit values: high bit set, two ones side by side in the other bits, at most one pair of zeros, none of the two reserved bytes."""
    out = []
    for b in range(0x96, 0x100):
        low = f"{b:08b}"
        if "11" in low[1:] and sum(low[i : i + 2] == "00" for i in range(7)) <= 1 and b not in (0xAA, 0xD5):
            out.append(b)
    return out


SIX = _six_codes()


def bits(hexed: Column) -> Column:
    return F.array_join(F.transform(octets.values(hexed), lambda v: F.lpad(F.bin(v), 8, "0")), "")


def groups(digits: Column, n: int) -> Column:
    return F.regexp_extract_all(digits, F.lit(f".{{{n}}}"), F.lit(0))


def octets_of(digits: Column) -> Column:
    """Hexadecimal bytes of a string of bits; bits after the last whole byte are left out."""
    return F.array_join(F.transform(groups(digits, 8), lambda g: F.lpad(F.conv(g, 2, 16), 2, "0")), "")


def mfm(digits: Column, last: int = 0) -> Column:
    """Each bit after its clock, which stands between two zeros; last is the bit before."""
    zero = "(?<=0)0|^0" if last == 0 else "(?<=0)0"
    marked = F.translate(F.regexp_replace(digits, zero, "A"), "01A", "xyz")
    return F.replace(F.replace(F.replace(marked, F.lit("x"), F.lit("00")), F.lit("y"), F.lit("01")), F.lit("z"), F.lit("10"))


def fm(digits: Column) -> Column:
    """Each bit after a clock that is always there."""
    return F.regexp_replace(digits, "(.)", "1$1")


def data_bits(cells: Column) -> Column:
    """The second cell of every pair."""
    return F.regexp_replace(cells, ".(.)", "$1")


def five(hexed: Column) -> Column:
    """Five bits for each half byte."""
    out = F.translate(hexed, "0123456789ABCDEF", "abcdefghijklmnop")
    for letter, code in zip("abcdefghijklmnop", GROUPS, strict=True):
        out = F.replace(out, F.lit(letter), F.lit(code))
    return out


def four(cells: Column) -> Column:
    """Half bytes of five-bit groups as digits; ? where a group is none of the sixteen."""
    table = F.create_map(*[F.lit(x) for i, c in enumerate(GROUPS) for x in (c, f"{i:X}")])
    return F.array_join(F.transform(groups(cells, 5), lambda g: F.coalesce(F.try_element_at(table, g), F.lit("?"))), "")


def xor_bytes(hexed: Column) -> Column:
    return F.aggregate(octets.values(hexed), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def with_crc(hexed: Column, preset: int) -> Column:
    return F.concat(hexed, octets.digits(crc16_ccitt(hexed, preset), 2))


def _number(c: Column) -> Column:
    return octets.digits(c.cast("long"), 1)


def mfm_sector(cyl: Column, head: Column, sector: Column, size_code: int, data: Column) -> Column:
    """Cells of one sector: zeros, syncs, address, gap, zeros, syncs, data, gap."""
    lead, gap = F.lit("10" * 96 + SYNC * 3), mfm(bits(F.lit("4E" * 22)))
    address = with_crc(F.concat(F.lit("FE"), _number(cyl), _number(head), _number(sector), F.lit(f"{size_code:02X}")), AFTER_SYNC)
    body = with_crc(F.concat(F.lit("FB"), data), AFTER_SYNC)
    return F.concat(lead, mfm(bits(address), 1), gap, lead, mfm(bits(body), 1), gap)


def fm_sector(cyl: Column, head: Column, sector: Column, size_code: int, data: Column) -> Column:
    lead, gap = F.lit("10" * 48), fm(bits(F.lit("FF" * 11)))
    address = F.substring(with_crc(F.concat(F.lit("FE"), _number(cyl), _number(head), _number(sector), F.lit(f"{size_code:02X}")), 0xFFFF), 3, 12)
    body = F.substring(with_crc(F.concat(F.lit("FB"), data), 0xFFFF), F.lit(3), F.length(data) + 4)
    return F.concat(lead, F.lit(FM_ADDRESS), fm(bits(address)), gap, lead, F.lit(FM_DATA), fm(bits(body)), gap)


def c64_sector(cyl: Column, sector: Column, data: Column) -> Column:
    ids = F.concat(_number(sector), _number(cyl + 1), F.lit("3241"))
    header = F.concat(F.lit("08"), _number(xor_bytes(ids)), ids, F.lit("0F0F"))
    body = F.concat(F.lit("07"), data, _number(xor_bytes(data)), F.lit("0000"))
    gap = F.lit("01010101" * 9)
    return F.concat(F.lit("1" * 40), five(header), gap, F.lit("1" * 40), five(body), gap)


def _pairs44(v: Column) -> Column:
    """Odd and even bits of a byte in two bytes."""
    return F.concat(_number(F.shiftright(v, 1).bitwiseOR(0xAA)), _number(v.bitwiseOR(0xAA)))


def apple_sector(cyl: Column, sector: Column, data: Column) -> Column:
    volume = F.lit(254).cast("long")
    cyl, sector = cyl.cast("long"), sector.cast("long")
    check = volume.bitwiseXOR(cyl).bitwiseXOR(sector)
    address = F.concat(F.lit(APPLE_ADDRESS), _pairs44(volume), _pairs44(cyl), _pairs44(sector), _pairs44(check), F.lit(APPLE_END))
    codes = F.array(*[F.lit(f"{c:02X}") for c in SIX])

    def coded(v: Column) -> Column:
        at = lambda i: F.coalesce(F.get(v, i), F.lit(0))
        low = lambda i: F.shiftleft(at(i).bitwiseAND(1), 1).bitwiseOR(F.shiftright(at(i), 1).bitwiseAND(1))
        aux = F.transform(F.sequence(F.lit(0), F.lit(85)), lambda j: low(j) + low(j + 86) * 4 + low(j + 172) * 16)
        return octets.once(F.concat(aux, F.transform(v, lambda x: F.shiftright(x, 2))), lambda six: F.concat(
            F.array_join(F.transform(six, lambda x, i: F.get(codes, x.bitwiseXOR(F.when(i > 0, F.get(six, i - 1)).otherwise(0)).cast("int"))), ""), F.get(codes, F.element_at(six, -1).cast("int"))))

    body = octets.once(octets.values(data), coded)
    return F.concat(bits(F.lit("FF" * 8)), bits(address), bits(F.lit("FF" * 6)), bits(F.concat(F.lit(APPLE_DATA), body, F.lit(APPLE_END))))


def apple_data(hexed: Column) -> Column:
    """(data, ok) of 343 disk bytes: the running difference is undone, low bits go back under the high six."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(SIX) for x in (f"{c:02X}", i)])
    codes = F.transform(groups(hexed, 2), lambda g: F.coalesce(F.try_element_at(place, g), F.lit(0)))
    zero = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all"))
    undone = F.aggregate(codes, zero, lambda a, c: F.struct(a["last"].bitwiseXOR(c).alias("last"), F.concat(a["all"], F.array(a["last"].bitwiseXOR(c))).alias("all")))["all"]

    def joined(six: Column) -> Column:
        def one(i: Column) -> Column:
            two = F.get(six, i % 86)
            for k in (2, 4):
                two = F.when(i >= 43 * k, F.floor(F.get(six, i % 86) / (1 << k)).cast("int")).otherwise(two)
            low = two.bitwiseAND(1) * 2 + F.shiftright(two, 1).bitwiseAND(1)
            return octets.digits(F.get(six, i + 86) * 4 + low, 1)

        return F.struct(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), one), "").alias("data"), (F.get(six, F.lit(342)) == 0).alias("ok"))

    return octets.once(undone, joined)


def _odd_even(hexed: Column) -> Column:
    """Odd bits of a field, then its even ones."""
    return octets.once(bits(hexed), lambda b: F.concat(F.regexp_replace(b, "(.).", "$1"), F.regexp_replace(b, ".(.)", "$1")))


def _xor16(digits: Column) -> Column:
    """Exclusive or of a field's 16-bit groups, as bits with a zero before each."""
    x = F.aggregate(groups(digits, 16), F.lit(0).cast("long"), lambda a, g: a.bitwiseXOR(F.conv(g, 2, 10).cast("long")))
    return F.regexp_replace(F.lpad(F.bin(x), 16, "0"), "(.)", "0$1")


def amiga_sector(track: Column, sector: Column, data: Column) -> Column:
    head = F.concat(_odd_even(F.concat(F.lit("FF"), _number(track), _number(sector), F.lit("01"))), _odd_even(F.lit("00" * 16)))
    body = _odd_even(data)
    check = lambda d: _odd_even(octets_of(_xor16(d)))
    return F.concat(F.lit("10" * 16 + SYNC * 2), mfm(F.concat(head, check(head), check(body), body), 1))


def together(odd: Column, even: Column) -> Column:
    """Bytes of a field from its odd and even bits."""
    return octets_of(F.array_join(F.zip_with(F.split(odd, ""), F.split(even, ""), lambda a, b: F.concat(a, b)), ""))
