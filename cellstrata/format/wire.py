"""Variable-length numbers and a schema-less protobuf codec."""

from __future__ import annotations

from cellstrata.format.errors import FormatError


def read_vint(b: bytes, at: int) -> tuple[int, int]:
    """A writable-utils number: one byte from -112 up is itself; below, it tells sign and size. Returns (value, next)."""
    if at >= len(b):
        raise FormatError("number past the end")
    lead = b[at] - 256 if b[at] > 127 else b[at]
    if lead >= -112:
        return lead, at + 1
    negative = lead < -120
    size = -120 - lead if negative else -112 - lead
    if at + 1 + size > len(b):
        raise FormatError("number past the end")
    value = int.from_bytes(b[at + 1 : at + 1 + size], "big")
    if negative:
        value = ~value
    return (value + (1 << 63)) % (1 << 64) - (1 << 63), at + 1 + size


def write_vint(value: int) -> bytes:
    if -112 <= value <= 127:
        return bytes([value % 256])
    base = -120 if value < 0 else -112
    body = ~value if value < 0 else value
    size = (body.bit_length() + 7) // 8
    return bytes([(base - size) % 256]) + body.to_bytes(size, "big")


def read_compact(b: bytes, at: int) -> tuple[int, int]:
    """Seven bits a byte, the lowest first, at most five bytes."""
    value = 0
    for i in range(5):
        if at + i >= len(b):
            raise FormatError("compact number past the end")
        byte = b[at + i]
        value |= (byte & 0x7F) << (7 * i)
        if byte < 0x80:
            if value >= 1 << 31:
                break
            return value, at + i + 1
    raise FormatError("compact number too large")


def write_compact(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        if at >= len(b) or shift > 63:
            raise FormatError("bad varint")
        byte = b[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value % (1 << 64), at
        shift += 7


def write_varint(value: int) -> bytes:
    value %= 1 << 64
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_message(b: bytes) -> dict[int, list]:
    """Field number to its values in order: numbers, or bytes of strings and messages."""
    out: dict[int, list] = {}
    at = 0
    while at < len(b):
        tag, at = read_varint(b, at)
        field, kind = tag >> 3, tag & 7
        if not field:
            raise FormatError("bad protobuf field")
        if kind == 0:
            value, at = read_varint(b, at)
        elif kind == 2:
            size, at = read_varint(b, at)
            if at + size > len(b):
                raise FormatError("protobuf field past the end")
            value, at = b[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(b):
                raise FormatError("protobuf field past the end")
            value, at = int.from_bytes(b[at : at + size], "little"), at + size
        else:
            raise FormatError("bad protobuf wire type")
        out.setdefault(field, []).append(value)
    return out


def encode_message(fields: list[tuple[int, int | bytes | str | None]]) -> bytes:
    out = bytearray()
    for number, value in fields:
        if value is None:
            continue
        if isinstance(value, str):
            value = value.encode()
        if isinstance(value, int):
            out += write_varint(number << 3) + write_varint(value)
        else:
            out += write_varint(number << 3 | 2) + write_varint(len(value)) + value
    return bytes(out)


def last(message: dict[int, list], field: int, default=None, kind: type | None = None):
    """The last value of a field, as protobuf has it; of the wanted kind or refused."""
    values = message.get(field)
    if not values:
        return default
    value = values[-1]
    if kind is not None and not isinstance(value, kind):
        raise FormatError("protobuf field of another type")
    return value
