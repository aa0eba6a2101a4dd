import struct

import pytest

from packetlake.operators import reassembly
from packetlake.sources import decode, pcap


def ipv4(payload, proto, src="10.0.0.1", dst="10.0.0.2", frag=0, ident=7):
    import socket

    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), ident, frag, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)) + payload


def ether(payload, kind=0x0800, tags=()):
    tag = b"".join(struct.pack(">HH", t, v) for t, v in tags)
    return b"\x02" * 12 + (tag[:2] + tag[2:] + struct.pack(">H", kind) if tags else struct.pack(">H", kind)) + payload


def tcp(payload=b"", flags=2, sport=1000, dport=80):
    return struct.pack(">HHIIBBHHH", sport, dport, 4_000_000_000, 0, 5 << 4, flags, 100, 0, 0) + payload


def udp(payload, sport=1234, dport=53):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def test_decode_tcp_and_padding():
    p = decode.decode_frame(ether(ipv4(tcp(b"abc"), 6)) + b"\0" * 6)
    assert (p["status"], p["protocol"], p["src_ip"], p["dst_port"], p["payload"], p["tcp_sequence"]) == ("valid", "TCP", "10.0.0.1", 80, b"abc", 4_000_000_000)


def test_decode_vlan_and_qinq():
    frame = b"\x02" * 12 + struct.pack(">HHHH", 0x88A8, 200, 0x8100, (3 << 13) | 100) + struct.pack(">H", 0x0800) + ipv4(udp(b"x"), 17)
    p = decode.decode_frame(frame)
    assert (p["vlan_ids"], p["vlan_priorities"], p["protocol"]) == ([200, 100], [0, 3], "UDP")


@pytest.mark.parametrize(("frame", "status"), [(b"\0" * 10, "truncated"), (ether(b"\x41" + ipv4(b"", 6)[1:]), "malformed"), (ether(ipv4(tcp(b"abc"), 6))[:-1], "truncated"), (ether(b"", 0x1234), "unsupported"), (b"", "truncated")])
def test_decode_faults(frame, status):
    assert decode.decode_frame(frame)["status"] == status


def test_decode_fragments_ipv6_and_errors():
    assert decode.decode_frame(ether(ipv4(b"12345678", 6, frag=1)))["protocol"] == "OTHER"
    v6 = struct.pack(">IHBB", 6 << 28, 8 + 8 + 4, 0, 64) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + bytes([44, 0, 0, 0, 0, 0, 0, 0]) + struct.pack(">BBHI", 17, 0, 1, 99) + b"1234"
    p = decode.decode_frame(ether(v6, 0x86DD))
    assert (p["ip_version"], p["src_ip"], p["fragment_id"], p["more_fragments"]) == (6, "::1", 99, True)
    quoted = struct.pack(">BBHI", 3, 3, 0, 0) + ipv4(udp(b"")[:8], 17, "10.0.0.2", "10.0.0.1")
    p = decode.decode_frame(ether(ipv4(quoted, 1)))
    assert (p["protocol"], p["icmp_inner_protocol"], p["icmp_inner_dst_port"]) == ("ICMP", "UDP", 53)


def test_batches_decode_like_single_frames():
    """Whole, cut, damaged, tagged, fragmented, padded, empty and null frames, in batches and one by one."""
    import random

    import pyarrow as pa

    r = random.Random(7)
    options = ipv4(b"", 6)[1:]
    whole = [
        ether(ipv4(tcp(b"abc"), 6)), ether(ipv4(tcp(), 6)), ether(ipv4(udp(b"x" * 30), 17)), ether(ipv4(udp(b""), 17)), ether(ipv4(udp(b"xyz"), 17)) + b"\0" * 9, ether(ipv4(udp(b"y" * 9)[:12], 17, frag=0x2000)), ether(ipv4(b"12345678", 17, frag=1)),
        ether(ipv4(udp(b"x"), 17), tags=((0x8100, 5),)), ether(ipv4(b"\x03\x03" + b"\0" * 6, 1)), ether(b"\0" * 40, 0x86DD), ether(b"\0" * 28, 0x0806), ether(b"\x46" + options[:1] + struct.pack(">H", 44) + options[3:] + b"\1" * 4 + tcp(), 0x0800),
    ]
    frames = [*whole, b"", None]
    for _ in range(4000):
        f = bytearray(r.choice(whole))
        for _ in range(r.randrange(3)):
            f[r.choice((12, 13, 14, 16, 17, 20, 21, 23, r.randrange(len(f))))] = r.choice((0, 1, 0x45, 0x50, 6, 17, 40, 255, r.randrange(256)))
        frames.append(bytes(f[: r.choice((len(f), len(f), r.randrange(len(f) + 1)))]))
    captured = [None if f is None or r.random() < 0.2 else len(f) + (r.random() < 0.03) - 2 * len(f) * (r.random() < 0.02) for f in frames]
    original = [None if r.random() < 0.2 else (c or 0) + r.choice((0, 0, 5, -1)) for c in captured]
    n = len(frames)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.timestamp("us", "UTC")), pa.array([0] * n, pa.int64()), pa.array(captured, pa.int32()), pa.array(original, pa.int32()), pa.array(frames, pa.binary())], [*decode._KEEP, "frame"])
    want = decode._one_by_one(batch).to_pylist()
    for cut in (batch, batch.slice(3, n - 5), batch.slice(n - 1), batch.slice(0, 0)):
        got = sorted((p for b in decode._decode([cut]) for p in b.to_pylist()), key=lambda p: p["packet_id"])
        ids = cut.column(0).to_pylist()
        assert got == [want[i] for i in ids]
    assert 500 < decode._plain(batch)[0].sum() < n - 500


def capture(frames, order="<"):
    return struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(order + "IIII", 100 + int(t), 5, len(f), len(f)) + f for t, f in frames)


@pytest.mark.parametrize("order", ["<", ">"])
def test_capture_files(spark, tmp_path, order):
    frames = [(0, ether(ipv4(udp(b"hi"), 17))), (2, ether(ipv4(tcp(), 6))), (1, ether(ipv4(tcp(), 6)))]
    (tmp_path / "a.pcap").write_bytes(capture(frames, order) + b"\1\2\3")
    assert [f for part in pcap.records((tmp_path / "a.pcap").read_bytes()[:-5]) for f in part[3]] == [f for _, f in frames[:2]]
    df = pcap.read(spark, str(tmp_path))
    assert [r["ts_us"] for r in df.orderBy("packet_id").collect()] == [100_000_005, 102_000_005, 101_000_005]
    assert [r["ts_us"] for r in pcap.read(spark, str(tmp_path), monotonic=True).orderBy("packet_id").collect()] == [100_000_005, 102_000_005, 102_000_005]
    p = decode.packets(df)
    assert sorted((r["protocol"], r["status"]) for r in p.collect()) == [("TCP", "valid"), ("TCP", "valid"), ("UDP", "valid")]
    assert decode.counters(p).first().asDict()["tcp"] == 2
    assert decode.previews(p).where("protocol = 'UDP'").first()["payload_preview"] == "hi"


def test_stream_of_captures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(capture([(0, ether(ipv4(udp(b"hi"), 17)))]))
    q = decode.packets(pcap.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("captured").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert spark.table("captured").count() == 1


def test_source_options():
    pcap.check_source(path="x")
    for bad in ({}, {"path": "x", "interface": "y"}, {"path": "x", "snaplen": 0}, {"path": "x", "timeout_ms": -1}):
        with pytest.raises(ValueError):
            pcap.check_source(**bad)
    with pytest.raises(ValueError):
        list(pcap.records(b"nothing"))


def test_fold_stream():
    data, what = reassembly.fold_stream([100, 104, 102, 100, 105], [b"ab", b"ef", b"cd", b"ab", b"fg"])
    assert (data, what) == (b"abcdefg", ["accepted", "accepted", "accepted", "retransmission", "overlap"])
    assert reassembly.fold_stream([0, 0, 5], [b"ab", b"xb", b""])[1] == ["accepted", "conflicting_overlap", "ignored"]
    assert reassembly.fold_stream([0, 5], [b"ab", b"x"])[0] == b"ab"


def test_fold_stream_without_limits():
    part = bytes(range(256)) * 4096  # 1 MiB
    data, what = reassembly.fold_stream([i << 20 for i in range(65)], [part] * 65)
    assert data == part * 65 and what == ["accepted"] * 65


def test_stream_of_many_segments(spark):
    """50,001 segments sent twice, as tcp_reassembly does, and a stream with a gap."""
    n = 50_001
    turns = spark.range(n).selectExpr("1 AS conv_id", "1000 + 5 * id AS tcp_sequence", "encode(lpad(id, 5, '0'), 'UTF-8') AS payload", "id")
    rows = turns.selectExpr("conv_id", "tcp_sequence", "payload", "explode(array(xxhash64(id), xxhash64(id, 1))) AS packet_id")
    rows = rows.union(spark.sql("SELECT 2, s, encode('ab', 'UTF-8'), s FROM VALUES (10L), (12L), (20L) AS t(s)"))
    big, gap = sorted(reassembly.tcp_streams(rows, ["conv_id"]).collect())
    assert (bytes(big["data"]), big["segments"], big["retransmissions"], big["overlaps"], big["gaps"]) == ("".join(f"{i:05}" for i in range(n)).encode(), 2 * n, n, 0, False)
    assert (bytes(gap["data"]), gap["segments"], gap["gaps"]) == (b"abab", 3, True)
