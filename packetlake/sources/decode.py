"""Frames to packets: Ethernet, VLAN tags, IPv4, IPv6 with extension headers, ARP, TCP, UDP, ICMP and ICMPv6.

Status is valid, truncated (bytes are missing), malformed (a field contradicts
another) or unsupported; fields read before the fault are kept. Later fragments
have protocol OTHER. Addresses of the link layer aren't kept.

Whole TCP and UDP packets over IPv4 without VLAN tags, which are nearly all of
ordinary traffic, are decoded a batch at a time in numpy (``_plain``); all other
frames one by one (``decode_frame``), which is the definition of both.
"""

from __future__ import annotations

import socket
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from packetlake import schema

VLAN_TYPES = (0x8100, 0x88A8, 0x9100)
MAX_TAGS, MAX_EXTENSIONS = 8, 16
#: IPv6 extension headers that give their length in units of eight bytes; 44 is the fragment header (fixed values).
EXTENSIONS = (0, 43, 60, 135, 139)
NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPV6"}


class _Fault(Exception):
    def __init__(self, status: str, what: str):
        self.status, self.what = status, what


def _need(data: bytes, at: int, n: int, what: str) -> None:
    if at + n > len(data):
        raise _Fault("truncated", f"{what} is cut off")


def decode_frame(frame: bytes, captured: int | None = None, original: int | None = None) -> dict:
    p: dict = {"vlan_ids": [], "vlan_priorities": [], "payload": b"", "details": {}}
    try:
        if captured is not None and (captured != len(frame) or (original is not None and original < captured)):
            raise _Fault("malformed", "captured and original length contradict the bytes")
        _need(frame, 0, 14, "Ethernet header")
        kind, at = int.from_bytes(frame[12:14]), 14
        while kind in VLAN_TYPES:
            if len(p["vlan_ids"]) == MAX_TAGS:
                raise _Fault("malformed", "too many VLAN tags")
            _need(frame, at, 4, "VLAN tag")
            tci, kind = struct.unpack_from(">HH", frame, at)
            p["vlan_ids"].append(tci & 0xFFF)
            p["vlan_priorities"].append(tci >> 13)
            at += 4
        p["ether_type"] = kind
        if kind == 0x0800:
            _ipv4(p, frame[at:])
        elif kind == 0x86DD:
            _ipv6(p, frame[at:])
        elif kind == 0x0806:
            p["protocol"] = "ARP"
            _need(frame, at, 28, "ARP")
            p["src_ip"], p["dst_ip"] = socket.inet_ntoa(frame[at + 14 : at + 18]), socket.inet_ntoa(frame[at + 24 : at + 28])
            p["details"]["arp_op"] = str(int.from_bytes(frame[at + 6 : at + 8]))
        else:
            raise _Fault("unsupported", f"EtherType {kind:#06x}")
        p["status"] = "valid"
    except _Fault as e:
        p["status"], p["error"] = e.status, e.what
    return p


def _ipv4(p: dict, b: bytes, inner: bool = False) -> None:
    _need(b, 0, 20, "IPv4 header")
    head, total = (b[0] & 15) * 4, int.from_bytes(b[2:4])
    if b[0] >> 4 != 4 or head < 20 or total < head:
        raise _Fault("malformed", "IPv4 header lengths")
    _need(b, 0, head, "IPv4 options")
    part = int.from_bytes(b[6:8])
    p.update(ip_version=4, ttl=b[8], ip_id=int.from_bytes(b[4:6]), ip_protocol=b[9], total_length=total, fragment_offset=(part & 0x1FFF) * 8, more_fragments=bool(part & 0x2000))
    p.update(fragment_id=p["ip_id"], fragmented=bool(p["fragment_offset"] or p["more_fragments"]), src_ip=socket.inet_ntoa(b[12:16]), dst_ip=socket.inet_ntoa(b[16:20]))
    if not inner and total > len(b):
        _transport(p, b[head:], cut=True)
    else:
        _transport(p, b[head : max(head, min(total, len(b)))], cut=inner and total > len(b))  # link padding ends here


def _ipv6(p: dict, b: bytes) -> None:
    _need(b, 0, 40, "IPv6 header")
    if b[0] >> 4 != 6:
        raise _Fault("malformed", "IPv6 version")
    size, kind, at = int.from_bytes(b[4:6]), b[6], 40
    p.update(ip_version=6, ttl=b[7], total_length=40 + size, src_ip=socket.inet_ntop(socket.AF_INET6, b[8:24]), dst_ip=socket.inet_ntop(socket.AF_INET6, b[24:40]), fragmented=False, fragment_offset=0, more_fragments=False)
    cut, b = 40 + size > len(b), b[: 40 + size]
    for _ in range(MAX_EXTENSIONS):
        if kind in EXTENSIONS:
            _need(b, at, 8, "extension header")
            kind, n = b[at], (b[at + 1] + 1) * 8
            _need(b, at, n, "extension header")
            at += n
        elif kind == 44:
            _need(b, at, 8, "fragment header")
            part = int.from_bytes(b[at + 2 : at + 4])
            p.update(fragmented=True, fragment_offset=part & 0xFFF8, more_fragments=bool(part & 1), fragment_id=int.from_bytes(b[at + 4 : at + 8]))
            kind, at = b[at], at + 8
        else:
            break
    else:
        raise _Fault("malformed", "too many extension headers")
    p["ip_protocol"] = kind
    _transport(p, b[at:], cut)


def _transport(p: dict, b: bytes, cut: bool) -> None:
    kind = p["ip_protocol"]
    if p["fragment_offset"]:
        p.update(protocol="OTHER", payload=b)
    elif kind == 6:
        p["protocol"] = "TCP"
        _need(b, 0, 20, "TCP header")
        sport, dport, seq, ack, off, flags, window = struct.unpack_from(">HHIIBBH", b)
        head = (off >> 4) * 4
        if head < 20:
            raise _Fault("malformed", "TCP header length")
        _need(b, 0, head, "TCP options")
        p.update(src_port=sport, dst_port=dport, tcp_sequence=seq, tcp_acknowledgment=ack, tcp_flags=flags & 0x3F, tcp_window=window, tcp_header_length=head, payload=b[head:])
    elif kind == 17:
        p["protocol"] = "UDP"
        _need(b, 0, 8, "UDP header")
        p["src_port"], p["dst_port"], n = struct.unpack_from(">HHH", b)
        if n < 8:
            raise _Fault("malformed", "UDP length")
        p.update(udp_length=n, payload=b[8:n])
    elif kind in (1, 58):
        p["protocol"] = NAMES[kind]
        _need(b, 0, 4, "ICMP header")
        p.update(icmp_type=b[0], icmp_code=b[1], payload=b[8:])
        if b[0] in (0, 8, 128, 129) and len(b) >= 8:
            p["icmp_id"], p["icmp_sequence"] = struct.unpack_from(">HH", b, 4)
        if (kind, b[0]) in ((1, 3), (1, 11), (58, 1), (58, 3)) and len(b) > 8:
            _quoted(p, b[8:])
    else:
        p.update(protocol="OTHER", payload=b)
    if cut:
        raise _Fault("truncated", "payload is cut off")


def _quoted(p: dict, b: bytes) -> None:
    """The packet that an ICMP error quotes; what can't be read stays empty."""
    q: dict = {"details": {}, "payload": b""}
    try:
        _ipv4(q, b, inner=True) if p["ip_version"] == 4 else _ipv6(q, b)
    except _Fault:
        pass
    if q.get("protocol") in ("TCP", "UDP") and q.get("src_port") is None and len(b) >= 24 and p["ip_version"] == 4:
        at = (b[0] & 15) * 4
        q["src_port"], q["dst_port"] = struct.unpack_from(">HH", b, at) if len(b) >= at + 4 else (None, None)
    p.update({f"icmp_inner_{k}": q.get(k) for k in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")})


_KEEP = ("packet_id", "ts", "ts_us", "captured_length", "original_length")


_ARROW = to_arrow_schema(schema.PACKETS)


def _record_batch(b: pa.RecordBatch, cols: dict) -> pa.RecordBatch:
    """The packets of a batch of frames: ``cols``, nulls where it has none, and what the frames came with."""
    cols = cols | {k: b.column(i).cast(_ARROW.field(k).type) for i, k in enumerate(_KEEP)}
    cols["length"] = b.column(_KEEP.index("original_length")).cast(pa.int32())
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(b.num_rows, f.type) for f in _ARROW], schema=_ARROW)


def _one_by_one(b: pa.RecordBatch) -> pa.RecordBatch:
    at = dict(zip((*_KEEP, "frame"), b.columns, strict=True))
    found = [decode_frame(f or b"", c, o) for f, c, o in zip(at["frame"].to_pylist(), at["captured_length"].to_pylist(), at["original_length"].to_pylist(), strict=True)]
    cols = {f.name: pa.array([p.get(f.name) for p in found], f.type) for f in _ARROW if f.name not in (*_KEEP, "length", "details")}
    return _record_batch(b, cols | {"details": pa.array([list(p["details"].items()) for p in found], _ARROW.field("details").type)})


def _big_endian(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The unsigned numbers of ``n`` bytes at the given places; 0 beyond the end."""
    out = np.zeros(len(at), np.int64)
    for i in range(n):
        inside = at + i < len(data)
        out = out << 8 | np.where(inside, data[np.where(inside, at + i, 0)] if len(data) else 0, 0)
    return out


def _addresses(ip: np.ndarray) -> pa.Array:
    known, at = np.unique(ip, return_inverse=True)
    return pa.array([socket.inet_ntoa(x.to_bytes(4)) for x in known.tolist()], pa.string()).take(pa.array(at.reshape(-1)))


def _bytes(frame: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and ends in them."""
    frame = frame.cast(pa.large_binary())
    _, places, values = frame.buffers()
    places = np.frombuffer(places, np.int64)[frame.offset : frame.offset + len(frame) + 1]
    return np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8), places[:-1], places[1:]


def _plain(b: pa.RecordBatch) -> tuple[np.ndarray, dict]:
    """Which frames are whole TCP or UDP packets, unfragmented or first pieces, over IPv4 without tags; and their columns."""
    frame = b.column(len(_KEEP))
    data, begin, end = _bytes(frame)
    ip, size = begin + 14, end - begin
    captured, original = (b.column(_KEEP.index(k)) for k in ("captured_length", "original_length"))
    number = lambda c, null: c.fill_null(null).to_numpy(zero_copy_only=False)
    missing = number(captured.is_null(), False)
    captured = np.where(missing, size, number(captured, 0))
    original = np.where(missing | number(original.is_null(), False), captured, number(original, 0))
    ok = number(frame.is_valid(), False) & (size >= 34) & (captured == size) & (original >= captured)
    at = np.flatnonzero(ok & (_big_endian(data, begin + 12, 2) == 0x0800))
    get = lambda where, n: _big_endian(data, where[at], n)
    first, total, part, kind = get(ip, 1), get(ip + 2, 2), get(ip + 6, 2), get(ip + 9, 1)
    head, stop = (first & 15) * 4, ip[at] + total
    seg = ip[at] + head
    tcp = kind == 6
    inner = np.where(tcp, (_big_endian(data, seg + 12, 1) >> 4) * 4, 8)
    udp_length = _big_endian(data, seg + 4, 2)
    whole = (first >> 4 == 4) & (head >= 20) & (stop <= end[at]) & (part & 0x1FFF == 0) & (tcp | (kind == 17)) & (seg + np.where(tcp, 20, 8) <= stop) & np.where(tcp, (inner >= 20) & (seg + inner <= stop), udp_length >= 8)
    at, total, part, kind, stop, seg, tcp, inner, udp_length = (x[whole] for x in (at, total, part, kind, stop, seg, tcp, inner, udp_length))
    n, plain = len(at), np.zeros(len(begin), bool)
    plain[at] = True
    low, high = seg + inner, np.where(tcp, stop, np.minimum(stop, seg + udp_length))
    # payloads lie in order and never touch, so they are the bytes between their marks
    some, marks = high > low, np.zeros(len(data) + 1, np.int8)
    marks[low[some]], marks[high[some]] = 1, -1
    payload = data[np.cumsum(marks, dtype=np.int8)[:-1].view(bool)]
    places = np.r_[0, np.cumsum(np.where(some, high - low, 0))].astype(np.int32)
    more = part & 0x2000 > 0
    both = {"ether_type": np.full(n, 0x0800), "ip_version": np.full(n, 4), "ttl": get(ip + 8, 1), "ip_id": get(ip + 4, 2), "ip_protocol": kind, "total_length": total, "fragment_offset": np.zeros(n, np.int64), "src_port": _big_endian(data, seg, 2), "dst_port": _big_endian(data, seg + 2, 2)}
    both |= {"fragment_id": both["ip_id"], "more_fragments": more, "fragmented": more}
    cols = {k: pa.array(v, _ARROW.field(k).type) for k, v in both.items()}
    of_tcp = {"tcp_sequence": (4, 4), "tcp_acknowledgment": (8, 4), "tcp_window": (14, 2), "tcp_flags": (13, 1)}
    of_tcp = {k: _big_endian(data, seg + i, w) for k, (i, w) in of_tcp.items()}
    of_tcp |= {"tcp_flags": of_tcp["tcp_flags"] & 0x3F, "tcp_header_length": inner}
    cols |= {k: pa.array(v, _ARROW.field(k).type, mask=~tcp) for k, v in of_tcp.items()} | {"udp_length": pa.array(udp_length, _ARROW.field("udp_length").type, mask=tcp)}
    cols |= {"src_ip": _addresses(get(ip + 12, 4)), "dst_ip": _addresses(get(ip + 16, 4)), "payload": pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(payload)])}
    cols |= {"protocol": pa.array(["TCP", "UDP"]).take(pa.array(np.where(tcp, 0, 1))), "status": pa.array(["valid"] * n, pa.string())}
    return plain, cols | {k: pa.array([[]] * n, _ARROW.field(k).type) for k in ("vlan_ids", "vlan_priorities", "details")}


def _decode(batches):
    for b in batches:
        if not b.num_rows:
            continue
        plain, cols = _plain(b)
        if plain.any():
            yield _record_batch(b.filter(pa.array(plain)), cols)
        if not plain.all():
            yield _one_by_one(b.filter(pa.array(~plain)))


def packets(frames: DataFrame) -> DataFrame:
    """The packet relation of frames; per-packet work only, no shuffle."""
    return frames.select(*_KEEP, "frame").mapInArrow(_decode, schema.PACKETS)


def counters(packets_: DataFrame) -> DataFrame:
    """Frames by kind, in one row."""
    n = lambda name, cond: F.count_if(cond).alias(name)
    return packets_.agg(
        F.count("*").alias("frames"), n("ipv4", F.col("ip_version") == 4), n("ipv6", F.col("ip_version") == 6), n("vlan", F.size("vlan_ids") > 0), *(n(x.lower(), F.col("protocol") == x) for x in ("TCP", "UDP", "ICMP", "ICMPV6", "ARP")), n("faulty", F.col("status") != "valid"), F.sum(F.col("captured_length").cast("bigint")).alias("bytes"),
    )


def previews(packets_: DataFrame) -> DataFrame:
    """Adds a printable preview (64 characters) and the first 32 bytes in hexadecimal."""
    text = F.regexp_replace(F.decode(F.substring("payload", 1, 64), "ISO-8859-1"), "[^ -~]", ".")
    return packets_.withColumns({"payload_preview": text, "payload_hex": F.lower(F.hex(F.substring("payload", 1, 32)))})
