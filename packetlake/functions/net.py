"""Address, port, flag and severity expressions, all built-in columns."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
FLAG_LETTERS = {"F": FIN, "S": SYN, "R": RST, "P": PSH, "A": ACK, "U": URG}
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

#: Ranges that aren't globally routable (fixed values), as first and last address.
LOCAL_RANGES = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")


def ip_long(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    p = F.split(ip, r"\.")
    value = reduce(lambda a, i: a * 256 + F.try_element_at(p, F.lit(i)).try_cast("long"), range(2, 5), F.try_element_at(p, F.lit(1)).try_cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), value)


def in_cidr(ip: Column, cidr: str) -> Column:
    """IPv4 membership by range, IPv6 by prefix of the expanded address; false for the other family."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4:
        n = ip_long(ip)
        return F.coalesce(n.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    groups = F.split(ip, ":")
    missing = F.greatest(F.lit(0), 8 - F.size(F.filter(groups, lambda g: g != "")))
    head, tail = F.split(F.substring_index(ip, "::", 1), ":"), F.when(F.contains(ip, F.lit("::")), F.split(F.substring_index(ip, "::", -1), ":")).otherwise(F.array().cast("array<string>"))
    keep = lambda a: F.filter(a, lambda g: g != "")
    full = F.concat(keep(head), F.array_repeat(F.lit("0"), missing), keep(tail))
    bits = F.array_join(F.transform(full, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    want = bin(int(net.network_address))[2:].zfill(128)[: net.prefixlen]
    return F.coalesce(F.contains(ip, F.lit(":")) & F.startswith(bits, F.lit(want)), F.lit(False))


def is_private(ip: Column) -> Column:
    """Whether an IPv4 address is in one of the local ranges; the number is worked out once."""
    nets = [ipaddress.ip_network(r) for r in LOCAL_RANGES]
    inside = lambda n: reduce(lambda a, b: a | b, (n.between(int(x.network_address), int(x.broadcast_address)) for x in nets))
    return F.coalesce(F.exists(F.array(ip_long(ip)), inside), F.lit(False))


def same_subnet(a: Column, b: Column) -> Column:
    """Both local, and equal up to the last dotted group."""
    return is_private(a) & is_private(b) & (F.substring_index(a, ".", 3) == F.substring_index(b, ".", 3))


def target_scope(src: Column, dst: Column) -> Column:
    return F.when(same_subnet(src, dst), "local").when(is_private(dst), "private").otherwise("public")


def flags_value(letters: Column) -> Column:
    """Bits of a flag string; unknown letters don't count, null is no flags."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.contains(F.upper(letters), F.lit(k)), v).otherwise(0) for k, v in FLAG_LETTERS.items()))


def flag_letters(flags: Column) -> Column:
    return F.concat(*(F.when(flags.bitwiseAND(F.lit(v)) != 0, k).otherwise("") for k, v in FLAG_LETTERS.items()))


def has(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) == bits


def probe_class(flags: Column) -> Column:
    """The kind of TCP probe a packet could be; null where it is none (also for SYN with FIN)."""
    low = flags.bitwiseAND(F.lit(0x3F))
    return (
        F.when(has(flags, SYN | FIN), None)
        .when(has(flags, SYN) & ~has(flags, ACK) & ~has(flags, RST), "syn")
        .when(low == ACK, "ack").when(low == (FIN | ACK), "maimon").when(low == FIN, "fin").when(low == 0, "null").when(low == (FIN | PSH | URG), "xmas")
    )


def endpoint(ip: Column, port: Column) -> Column:
    """addr:port, [v6]:port, the bare address without a port, or - without an address."""
    v6 = F.contains(ip, F.lit(":"))
    return F.when(ip.isNull() | (ip == ""), "-").when(port.isNull(), ip).when(v6, F.concat(F.lit("["), ip, F.lit("]:"), port.cast("string"))).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.lit(list(SEVERITIES)), F.upper(severity)).cast("int") - 1, F.lit(0))


def port_matches(port: Column, ranges: Column) -> Column:
    """No ranges: any port, a missing one too; else within one of them."""
    return F.coalesce(F.size(ranges) == 0, F.lit(True)) | F.coalesce(F.exists(ranges, lambda r: port.between(r["first"], r["last"])), F.lit(False))


def risk(severity: Column, confidence: Column) -> Column:
    return F.least(F.lit(100), severity_rank(severity) * 20 + F.floor(confidence / 2)).cast("int")


def priority(risk_score: Column) -> Column:
    return F.when(risk_score > 0, F.greatest(F.lit(1), F.lit(5) - F.floor(risk_score / 25))).otherwise(3).cast("int")
