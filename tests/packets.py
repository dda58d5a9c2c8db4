"""Hand-built export packets."""

import struct

STANDARD = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (2, 4), (1, 4), (22, 4), (21, 4), (6, 1)]


def v5_record(src=(10, 0, 0, 1), dst=(10, 0, 0, 2), sport=1024, dport=80, proto=6, packets=100, octets=5000, flags=2,
              start=0, end=0):
    return (bytes(src) + bytes(dst) + bytes(8) + struct.pack(">IIIIHH", packets, octets, start, end, sport, dport)
            + bytes([0, flags, proto]) + bytes(9))


def v5(*records, count=None, version=5):
    return struct.pack(">HH", version, len(records) if count is None else count) + bytes(20) + b"".join(records)


def cut(set_id, body, length=None):
    return struct.pack(">HH", set_id, len(body) + 4 if length is None else length) + body


def v9(*sets, domain=1):
    return struct.pack(">HH", 9, len(sets)) + bytes(12) + struct.pack(">I", domain) + b"".join(sets)


def ipfix(*sets, domain=1):
    return struct.pack(">HH", 10, 0) + bytes(8) + struct.pack(">I", domain) + b"".join(sets)


def template(template_id, fields, count=None):
    out = struct.pack(">HH", template_id, len(fields) if count is None else count)
    for field in fields:
        kind, width, *vendor = field
        out += struct.pack(">HH", kind | (0x8000 if vendor else 0), width)
        if vendor:
            out += struct.pack(">I", vendor[0])
    return out


def record(fields=STANDARD, **values):
    known = {8: 0x0A000001, 12: 0x0A000002, 7: 1024, 11: 80, 4: 6, 2: 100, 1: 5000, 22: 1000, 21: 2000, 6: 2}
    known.update({int(k[2:]): v for k, v in values.items()})
    return b"".join(known.get(kind, 0).to_bytes(width, "big") for kind, width, *_ in fields)
