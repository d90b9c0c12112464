"""Keys that carry time: UUIDv7 and declared text ids, to and from native microseconds.

Digits are taken in chunks that fit 54 bits. Numbers wider than a long are sums of chunk halves times constant limbs of 32
bits, so a 160-bit id is exact in plain arithmetic that Spark compiles. Every decode checks the declared shape first: ``refuse=True`` raises on a bad value, otherwise it is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public alphabets of text ids, digits in order.
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TextTime:
    """prefix, then ``width`` digits of ``radix``; units of ``unit_us`` since ``epoch_us`` after dropping low bits."""

    prefix: str
    width: int
    radix: int
    unit_us: int
    alphabet: str = BASE36
    discard_bits: int = 0
    epoch_us: int = 0

    def __post_init__(self):
        if self.radix > len(self.alphabet) or self.radix < 2:
            raise ValueError("the alphabet has fewer digits than the radix")
        if list(self.alphabet) != sorted(set(self.alphabet)):
            raise ValueError("the alphabet's digits must ascend, so that ids sort by time")
        if (self.radix**self.width - 1 >> self.discard_bits).bit_length() > 62:
            raise ValueError("the part that carries time is wider than 62 bits")

    @property
    def digits(self) -> str:
        return self.alphabet[: self.radix]

    @property
    def chunk(self) -> int:
        """The most digits that stay under 54 bits."""
        return max(k for k in range(1, 55) if self.radix**k < 1 << 54)


CUID = TextTime("c", 8, 36, 1000)
ULID = TextTime("", 10, 32, 1000, CROCKFORD)
KSUID = TextTime("", 27, 62, 1_000_000, BASE62, 128, 1_400_000_000_000_000)
OBJECT_ID = TextTime("", 8, 16, 1_000_000)


def shaped(value: Column, spec: TextTime) -> Column:
    """Whether a value begins with the prefix and ``width`` digits of the alphabet."""
    return value.rlike(f"^\\Q{spec.prefix}\\E[{spec.digits}]{{{spec.width}}}")


def radix_decode(text: Column, radix: int, alphabet: str = BASE36) -> Column:
    """Horner's rule over the digits, for values that fit a long; null if a character is no digit."""
    digits = alphabet[:radix]
    fold = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: acc * radix + _digit_of(c, digits))
    return F.when(text.rlike(f"^[{digits}]+$"), fold)


def _digit_of(char: Column, digits: str) -> Column:
    return (F.call_function("locate", char, F.lit(digits)) - 1).cast("long")


def radix_encode(value: Column, radix: int, width: int, alphabet: str = BASE36) -> Column:
    """``width`` digits, zeros in front; null if the value needs more."""
    places = [F.substring(F.lit(alphabet), (F.pmod(F.call_function("div", value, F.lit(radix**k)), F.lit(radix)) + 1).cast("int"), F.lit(1)) for k in range(width - 1, -1, -1) if radix**k < 1 << 63]
    pad = alphabet[0] * (width - len(places))
    fits = (value >= 0) & (value < F.lit(min(radix**width, (1 << 63) - 1)))
    return F.when(fits, F.concat(F.lit(pad), *places))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def text_time_decode(value: Column, spec: TextTime, refuse: bool = False) -> Column:
    """Microseconds of a text id. The digits are folded into limbs; the low bits are dropped; null if it isn't shaped."""
    starts, numbers = range(0, spec.width, spec.chunk), []
    for low in starts:  # from the last digit on
        number = F.lit(0).cast("long")
        for k in range(min(spec.chunk, spec.width - low)):
            place = len(spec.prefix) + spec.width - low - k
            number = number + _digit_of(F.substring(value, place, 1), spec.digits) * spec.radix**k
        numbers.append(number)

    def units(held: Column) -> Column:
        limbs: dict[int, Column] = {}
        for k, low in enumerate(starts):
            low_half, high_half = held[k].bitwiseAND(F.lit((1 << 27) - 1)), F.shiftright(held[k], 27)
            for half, scale in ((low_half, spec.radix**low), (high_half, spec.radix**low << 27)):
                for at in range(-(-scale.bit_length() // 32)):
                    part = half * (scale >> 32 * at & (1 << 32) - 1)
                    limbs[at] = limbs[at] + part if at in limbs else part
        skip, rest = divmod(spec.discard_bits, 32)
        carry = F.lit(0).cast("long")
        for at in range(skip):
            carry = F.shiftright(limbs.get(at, F.lit(0).cast("long")) + carry, 32)
        for at in sorted(k for k in limbs if skip <= k < skip + 2):
            carry = carry + F.shiftleft(limbs[at], 32 * (at - skip))
        return F.shiftright(carry, rest)

    native = _let(F.array(*numbers), units) * spec.unit_us + spec.epoch_us
    wrong = F.raise_error(F.concat(F.lit("not of the declared shape: "), F.coalesce(value, F.lit("null")))) if refuse else F.lit(None).cast("long")
    return F.when(shaped(value, spec), native).otherwise(wrong)


def text_time_encode(native: Column, spec: TextTime) -> Column:
    """The smallest id of an instant: its units, zero low bits; null if they don't fit the width."""
    units = F.call_function("div", native - spec.epoch_us, F.lit(spec.unit_us))
    limit = spec.radix**spec.width >> spec.discard_bits
    if not spec.discard_bits:
        short = lambda u: F.when(u < min(limit, (1 << 63) - 1), F.concat(F.lit(spec.prefix), radix_encode(u, spec.radix, spec.width, spec.alphabet)))
        return _let(units, short)
    base = F.lit(spec.radix**spec.chunk).cast("decimal(20,0)")

    def digits(u: Column, low: int, scale: int, carry: Column) -> Column:
        """The id's digits but for the last ``low``: units times what is left of 2 ** discard_bits, chunk by chunk."""
        if low >= spec.width:
            return F.lit("")
        total = u.cast("decimal(19,0)") * F.lit(str(scale % spec.radix**spec.chunk)).cast("decimal(18,0)") + carry

        def both(t: Column) -> Column:
            own = _let(F.pmod(t, base).cast("long"), lambda n: radix_encode(n, spec.radix, min(spec.chunk, spec.width - low), spec.alphabet))
            ahead = digits(u, low + spec.chunk, scale // spec.radix**spec.chunk, F.call_function("div", t, base).cast("decimal(20,0)"))
            return F.concat(ahead, own)

        return _let(total, both)

    whole = lambda u: F.when((u >= 0) & (u < min(limit, 1 << 62)), F.concat(F.lit(spec.prefix), digits(u, 0, 1 << spec.discard_bits, F.lit(0).cast("decimal(20,0)"))))
    return _let(units, whole)


# --- UUIDv7 ---


def uuid_decode(value: Column) -> Column:
    """Microseconds of a UUID's leading 48 bits (UUIDv7 and ULIDs kept as uuid); null if it is no UUID."""
    shape = value.rlike("^[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}$")
    ms = F.conv(F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")
    return F.when(shape, ms * 1000)


def uuid_bound(native: Column) -> Column:
    """The smallest UUID of an instant's millisecond: a range bound on a uuid column."""
    ms = F.lower(F.lpad(F.hex(F.call_function("div", native, F.lit(1000))), 12, "0"))
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-0000-0000-000000000000"))
