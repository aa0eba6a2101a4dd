"""Signature rules: the rule language (driver side), and matching as DataFrame expressions."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlake import schema
from packetlake.functions import net
from packetlake.operators import windows as W

ANY: list[tuple[int, int]] = []
#: Built-in port variables (fixed values).
PORT_VARIABLES = {"HTTP_PORTS": "80,8080,8000", "HTTPS_PORTS": "443,8443", "SSH_PORTS": "22", "DNS_PORTS": "53", "FTP_PORTS": "21"}
ACTIONS, DIRECTIONS = ("alert", "log"), ("->", "<>", "<-")
PROTOCOLS = ("ip", "tcp", "udp", "icmp", "icmpv6", "arp", "ipv6")
OPTIONS = frozenset("msg sid gid rev content pcre regex nocase priority classtype severity threshold suppression_key flow offset depth distance within".split())
#: Buffers and services that rules may name (fixed values).
BUFFERS = ("payload", "stream", "http_uri", "http_method", "http_host", "http_user_agent", "http_headers", "dns_query", "dns_response", "tls_handshake", "tcp", "udp", "icmp")
SERVICES = ("HTTP", "DNS", "TLS", "SSH", "FTP", "SMTP", "SMB", "ICMP", "GENERIC_TCP", "GENERIC_UDP")
#: Protocols that a rule for IP also covers, and those that need no content.
IP_FAMILY = ("IP", "IPV6", "TCP", "UDP", "ICMP", "ICMPV6")
BARE = ("ICMP", "ICMPV6", "ARP")


class RuleError(ValueError):
    """A rule that can't be used: the field and what is wrong with it."""

    def __init__(self, field: str, problem: str):
        self.field, self.problem = field, problem
        super().__init__(f"{field}: {problem}")


def parse_ports(text, variables: dict[str, str] | None = None, field: str = "port") -> list[tuple[int, int]]:
    """Sorted disjoint ranges of an expression like ``[80,443]``, ``1:1024``, ``:1023`` or ``$HTTP_PORTS``; empty for any."""
    known = PORT_VARIABLES | {k.upper(): v for k, v in (variables or {}).items()}
    todo = list(text) if isinstance(text, list) else [text]
    found: list[tuple[int, int]] = []
    while todo:
        t = todo.pop(0)
        if isinstance(t, int) and not isinstance(t, bool):
            t = str(t)
        if t is None or (isinstance(t, str) and t.strip().lower() in ("", "any")):
            continue
        if not isinstance(t, str):
            raise RuleError(field, f"{t!r} is no port")
        t = t.strip()
        if t.startswith("[") and t.endswith("]"):
            t = t[1:-1]
        if "," in t:
            todo = [x for x in t.split(",") if x.strip()] + todo
        elif t.startswith("$"):
            if (name := t[1:].upper()) not in known:
                raise RuleError(field, f"unknown port variable {t}")
            todo.insert(0, known[name])
        elif m := re.fullmatch(r"(\d*)\s*(:?)\s*(\d*)", t.strip()):
            low, colon, high = m.groups()
            a = int(low) if low else 0
            b = int(high) if high else 65535 if colon else a
            if not (low or high) or a > b or b > 65535:
                raise RuleError(field, f"bad port or range {t!r}")
            found.append((a, b))
        else:
            raise RuleError(field, f"bad port expression {t!r}")
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def canonical_ports(ranges: list[tuple[int, int]]) -> str:
    return ",".join(str(a) if a == b else f"{a}:{b}" for a, b in ranges) or "any"


def decode_content(text: str) -> bytes:
    """Bytes of a content string; hexadecimal bytes stand between bars, as in ``a|3a 20|b``."""
    parts = text.split("|")
    if len(parts) % 2 == 0:
        raise RuleError("content", "unbalanced bars")
    try:
        return b"".join(bytes.fromhex(p) if i % 2 else p.encode("utf-8") for i, p in enumerate(parts))
    except ValueError as e:
        raise RuleError("content", "bad hexadecimal bytes") from e


_RULE = re.compile(r"\s*(\w+)\s+(\w+)\s+(\S+)\s+(\[[^\]]*\]|\S+)\s+(->|<>|<-)\s+(\S+)\s+(\[[^\]]*\]|\S+)\s*\((.*)\)\s*\Z", re.S)
_OPTION = re.compile(r"\s*([\w-]+)\s*(?::\s*((?:\"(?:[^\"\\]|\\.)*\"|[^;\"])*))?;?", re.S)


def parse_rule(text: str, variables: dict[str, str] | None = None) -> dict:
    """A rule line as a record in the fields of ``schema.RULES``; RuleError says what is wrong."""
    m = _RULE.match(text)
    if not m:
        raise RuleError("rule", "expected: action protocol source port -> destination port (options)")
    action, protocol, src, sport, arrow, dst, dport, body = m.groups()
    if action.lower() not in ACTIONS:
        raise RuleError("action", f"{action} is not one of {', '.join(ACTIONS)}")
    if protocol.lower() not in PROTOCOLS:
        raise RuleError("protocol", f"{protocol} is not one of {', '.join(PROTOCOLS)}")
    options: dict[str, list[str]] = {}
    at = 0
    while at < len(body) and body[at:].strip():
        o = _OPTION.match(body, at)
        if not o or o.end() == at:
            raise RuleError("options", f"can't read {body[at:at + 20]!r}")
        value = (o[2] or "").strip()
        if len(value) > 1 and value[0] == value[-1] == '"':
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        options.setdefault(o[1].lower(), []).append(value)
        at = o.end()
    if unknown := sorted(set(options) - OPTIONS):
        raise RuleError("options", f"unknown: {', '.join(unknown)}")
    one = lambda k, default=None: options[k][-1] if k in options else default
    return record(
        {
            "action": action.upper(), "protocol": protocol.upper(), "src_ip": src, "dst_ip": dst, "src_port": sport, "dst_port": dport, "direction": arrow, "content": options.get("content", []), "regex": one("pcre", one("regex")), "nocase": "nocase" in options, "message": one("msg", ""), "rule_text": text.strip(),
            "severity": one("severity"), "category": one("classtype"), "suppression_key": one("suppression_key"), "threshold": _pairs("threshold", one("threshold")), "flow": one("flow"), **{k: one(k) for k in ("sid", "gid", "rev", "priority", "offset", "depth", "distance", "within")},
        },
        variables,
    )


def _pairs(field: str, text: str | None) -> dict | None:
    """``count 5, seconds 60`` (or with colons) as numbers by name; other names are passed on as text."""
    if not text:
        return None
    out: dict = {}
    for part in text.split(","):
        name, _, value = part.strip().replace(":", " ").partition(" ")
        if not value:
            raise RuleError(field, f"can't read {part.strip()!r}")
        out[name.lower()] = int(value) if value.strip().isdigit() else value.strip()
    return out


#: Words of the flow option and the directions that they ask for.
FLOW_WORDS = {"to_server": "to_server", "from_client": "to_server", "to_client": "to_client", "from_server": "to_client"}


def _flow(text: str | None) -> str | None:
    """The direction that a flow option asks for; ``established`` and ``stateless`` ask for none."""
    words = [w.strip().lower() for w in (text or "").split(",") if w.strip()]
    if unknown := [w for w in words if w not in FLOW_WORDS and w not in ("established", "stateless", "any")]:
        raise RuleError("flow", f"unknown: {', '.join(unknown)}")
    found = {FLOW_WORDS[w] for w in words if w in FLOW_WORDS}
    if len(found) > 1:
        raise RuleError("flow", "both directions")
    return next(iter(found), None)


def record(given: dict, variables: dict[str, str] | None = None) -> dict:
    """Checks and completes the fields of a rule, from text or JSON."""
    number = lambda k, default: default if given.get(k) in (None, "") else int(given[k])
    try:
        out = {k: number(k, d) for k, d in (("gid", 1), ("sid", None), ("rev", 1), ("priority", 3), ("offset", 0), ("depth", None), ("distance", None), ("within", None))}
    except (TypeError, ValueError) as e:
        raise RuleError("number", str(e)) from e
    if out["sid"] is None or out["sid"] <= 0:
        raise RuleError("sid", "a positive number is needed")
    message = given.get("message") or given.get("msg") or ""
    if not message or len(message) > 512:
        raise RuleError("msg", "1 to 512 characters are needed")
    if given.get("regex"):
        try:
            re.compile(given["regex"])
        except re.error as e:
            raise RuleError("regex", str(e)) from e
        if re.search(r"\(\?P|\(\?\(|\\Z", given["regex"]):
            raise RuleError("regex", "syntax that Java doesn't know")
    content = given.get("content") or []
    content = [content] if isinstance(content, str) else content
    protocol = (given.get("protocol") or "IP").upper()
    content = [decode_content(c) if isinstance(c, str) else bytes(c) for c in content]
    if not content and not given.get("regex") and protocol not in BARE:
        raise RuleError("content", f"a rule for {protocol} needs content or a regular expression")
    threshold = given.get("threshold") or {}
    if threshold and not (isinstance(threshold, dict) and all(isinstance(threshold.get(k), int) and threshold[k] > 0 for k in ("count", "seconds"))):
        raise RuleError("threshold", "positive count and seconds are needed")
    if (direction := given.get("direction") or "->") not in DIRECTIONS:
        raise RuleError("direction", f"{direction} is not one of {', '.join(DIRECTIONS)}")
    if given.get("buffer") and given["buffer"] not in BUFFERS:
        raise RuleError("buffer", f"{given['buffer']} is not one of {', '.join(BUFFERS)}")
    if given.get("service") and given["service"].upper() not in SERVICES:
        raise RuleError("service", f"{given['service']} is not one of {', '.join(SERVICES)}")
    return out | {
        "action": (given.get("action") or "ALERT").upper(), "protocol": protocol, "src_ip": given.get("src_ip") or "any", "dst_ip": given.get("dst_ip") or "any", "src_ports": parse_ports(given.get("src_port"), variables, "src_port"), "dst_ports": parse_ports(given.get("dst_port"), variables, "dst_port"),
        "direction": direction, "flow": _flow(given.get("flow")), "service": given.get("service"), "buffer": given.get("buffer"), "content": content, "regex": given.get("regex"), "nocase": bool(given.get("nocase")), "threshold_count": threshold.get("count"), "threshold_seconds": threshold.get("seconds"),
        "suppression_key": given.get("suppression_key"), "category": given.get("category"), "severity": (given.get("severity") or "LOW").upper(), "message": message, "rule_text": given.get("rule_text"), "enabled": given.get("enabled", True),
    }


def load_rules(entries: Iterable[dict], variables: dict[str, str] | None = None) -> list[dict]:
    """All rules or, if any is wrong or a (sid, rev) comes twice, an error that names the first."""
    rules, seen = [], set()
    for e in entries:
        r = record(e, variables)
        if (r["sid"], r["rev"]) in seen:
            raise RuleError("sid", f"{r['sid']} revision {r['rev']} comes twice")
        seen.add((r["sid"], r["rev"]))
        rules.append(r)
    return rules


def port_variables(path: str | None = None, env: str = "PACKETLAKE_PORT_VARIABLES") -> dict[str, str]:
    """The port groups: built in, then those of a JSON file, then those of the environment (names to lists of ports, the later one counts).

    Groups that aren't lists of ports from 0 to 65535 are left out, as are files that can't be read.
    """
    found = dict(PORT_VARIABLES)

    def add(text: str) -> None:
        try:
            given = json.loads(text)
        except ValueError:
            return
        for name, ports in given.items() if isinstance(given, dict) else ():
            if isinstance(ports, list) and ports and all(isinstance(p, int) and not isinstance(p, bool) and 0 <= p <= 65535 for p in ports):
                found[str(name).upper()] = ",".join(map(str, ports))

    if path and os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                add(f.read())
        except OSError:
            pass
    add(os.environ.get(env) or "{}")
    return found


def rules_file(spark: SparkSession, path: str, variables: dict[str, str] | None = None) -> list[dict]:
    """All rules of a JSON file (an array of objects, or such an array under ``rules``), by a path that Spark can open; an error if any is wrong."""
    texts = spark.read.text(path, wholetext=True).collect()
    rules: list[dict] = []
    for row in texts:
        try:
            entries = json.loads(row[0])
        except ValueError as e:
            raise RuleError("file", str(e)) from e
        entries = entries.get("rules") if isinstance(entries, dict) else entries
        if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
            raise RuleError("file", "an array of rules is needed")
        rules += [e if "direction" not in e or e["direction"] in DIRECTIONS else e | _named_direction(e) for e in entries]
    return load_rules(rules, variables)


def _named_direction(entry: dict) -> dict:
    """Directions by name are those of the flow; the addresses stand as given."""
    names = {"client_to_server": "to_server", "server_to_client": "to_client", "any": None}
    if entry["direction"] not in names:
        raise RuleError("direction", f"unsupported: {entry['direction']}")
    return {"direction": "->", "flow": names[entry["direction"]]}


class LiveRules:
    """Rules that are read again for each micro-batch; ``changed`` tells when they differ, so that what was suppressed under the old ones can be let go."""

    def __init__(self, load):
        self.load, self.signature, self.rules, self.changed = load, None, [], False

    def __call__(self) -> list[dict]:
        fresh = [r for r in self.load() if r["enabled"]]
        signature = tuple((r["gid"], r["sid"], r["rev"], repr(sorted(r.items(), key=lambda x: x[0]))) for r in sorted(fresh, key=lambda r: (r["gid"], r["sid"], r["rev"])))
        self.changed = signature != self.signature
        if self.changed:
            self.rules, self.signature = fresh, signature
        return self.rules


def rule_text(r: dict) -> str:
    """The canonical line of a rule; parsing it gives the rule back."""
    quote = lambda s: '"' + re.sub(r'(["\;])', r"\\\1", s) + '"'
    hexed = lambda b: "".join(chr(c) if 32 <= c < 127 and c not in b'|";\\' else f"|{c:02x}|" for c in b).replace("||", " ")
    options = [f"msg:{quote(r['message'])}", *(f"content:{quote(hexed(c))}" for c in r["content"])]
    options += [f"regex:{quote(r['regex'])}"] if r["regex"] else []
    options += ["nocase"] if r["nocase"] else []
    options += [f"{k}:{r[k]}" for k in ("offset", "depth", "distance", "within") if r[k] is not None and (r[k] or k != "offset")]
    options += [f"threshold:count {r['threshold_count']}, seconds {r['threshold_seconds']}"] if r["threshold_count"] else []
    options += [f"flow:{r['flow']}"] if r.get("flow") else []
    options += [f"severity:{r['severity']}", f"priority:{r['priority']}", f"sid:{r['sid']}", f"gid:{r['gid']}", f"rev:{r['rev']}"]
    return f"{r['action'].lower()} {r['protocol'].lower()} {r['src_ip']} {canonical_ports(r['src_ports'])} {r['direction']} {r['dst_ip']} {canonical_ports(r['dst_ports'])} ({'; '.join(options)};)"


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.RULES) for r in rules], schema.RULES)


# ---- matching -----------------------------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def latin(payload: Column) -> Column:
    """Bytes as text of one character each, without loss."""
    return F.decode(payload, "ISO-8859-1")


def contains_in(text: Column, value: bytes, nocase: bool = False, offset: int = 0, depth: int | None = None) -> Column:
    """Whether the bytes occur within [offset, offset + depth)."""
    want = value.decode("latin-1")
    part = text if not offset and depth is None else F.substring(text, offset + 1, depth if depth is not None else 2**31 - 1)
    return F.contains(F.translate(part, _UPPER, _LOWER), F.lit(want.translate(str.maketrans(_UPPER, _LOWER)))) if nocase else F.contains(part, F.lit(want))


def chain_position(text: Column, values: list[bytes], distance: int | None = None, within: int | None = None, offset: int = 0, depth: int | None = None, nocase: bool = False) -> Column:
    """Where the first value of an ordered chain starts (from 1), or 0 if the chain doesn't hold.

    Each value is looked for from the end of the one before plus ``distance``;
    with ``within`` it has to end at most so far behind that place, and all have
    to lie in [offset, offset + depth). The first place counts, there is no going
    back.
    """
    if nocase:
        text, values = F.translate(text, _UPPER, _LOWER), [v.lower() for v in values]  # of bytes, only A-Z change
    if depth is not None:
        text = F.substring(text, 1, offset + depth)
    first = F.call_function("locate", F.lit(values[0].decode("latin-1")), text, F.lit(offset + 1))
    start, ok, end = first, first > 0, first + len(values[0])
    for v in values[1:]:
        begin = end + (distance or 0)
        at = F.call_function("locate", F.lit(v.decode("latin-1")), text, begin)
        ok = ok & (at > 0)
        if within is not None:
            ok = ok & (at + len(v) <= begin + within)
        end = at + len(v)
    return F.when(ok, start).otherwise(0)


def is_chain(r: dict) -> bool:
    """Whether the contents of a rule have to come in order; without distance and within each may stand anywhere."""
    return len(r["content"]) > 1 and (r["distance"] is not None or r["within"] is not None)


def condition(r: dict, columns: set[str], text: Column | None) -> Column:
    """One rule as a condition on packets; cheap tests come first. Rules that need a text don't hold without one.

    Contents and patterns are looked for in the rule's buffer where the packets
    have a column of its name (``http_uri`` and so on), in ``text`` for the
    payload; a rule for a buffer that isn't there doesn't hold. A service and the
    direction of a flow (column ``dir``: c2s, s2c) are asked where there is such a
    column.
    """
    parts: list[Column] = []
    if r["protocol"] != "IP":
        parts.append(F.upper("protocol") == r["protocol"])
    else:
        parts.append(F.upper("protocol").isin(*IP_FAMILY))
    ports = lambda c, ranges: reduce(lambda a, b: a | b, (F.col(c).between(x, y) for x, y in ranges))
    nets = lambda c, net_: net.in_cidr(F.col(c), net_) if "/" in net_ else F.col(c) == net_
    forward = [ports(c, r[k]) for c, k in (("src_port", "src_ports"), ("dst_port", "dst_ports")) if r[k]] + [nets(c, r[c]) for c in ("src_ip", "dst_ip") if r[c] != "any"]
    backward = [ports(c, r[k]) for c, k in (("dst_port", "src_ports"), ("src_port", "dst_ports")) if r[k]] + [nets(c, r[k]) for c, k in (("dst_ip", "src_ip"), ("src_ip", "dst_ip")) if r[k] != "any"]
    every = lambda cs: reduce(lambda a, b: a & b, cs, F.lit(True))
    parts.append(every(forward) if r["direction"] == "->" else every(backward) if r["direction"] == "<-" else every(forward) | every(backward))
    if r["service"] and "service" in columns:
        parts.append(F.upper("service") == r["service"].upper())
    if r.get("flow") and "dir" in columns:
        parts.append(F.col("dir") == ("c2s" if r["flow"] == "to_server" else "s2c"))
    if r["buffer"] and r["buffer"] != "payload":
        text = F.col(r["buffer"]) if r["buffer"] in columns else None
    if r["content"] or r["regex"]:
        if text is None:
            return F.lit(False)
        if is_chain(r):
            parts.append(chain_position(text, r["content"], r["distance"], r["within"], r["offset"], r["depth"], r["nocase"]) > 0)
        else:
            parts += [contains_in(text, c, r["nocase"], r["offset"], r["depth"]) for c in r["content"]]
        if r["regex"]:
            parts.append(text.rlike(("(?i)" if r["nocase"] else "") + r["regex"]))
    return F.coalesce(every(parts), F.lit(False))


def evidence(r: dict) -> str:
    """What a match of the rule is put down to."""
    found = ", ".join(c.decode("utf-8", "replace") for c in r["content"]) or "protocol match"
    return f"payload_match={found}"


def match(packets: DataFrame, rules: list[dict], text: Column | None = None, most: int | None = None) -> DataFrame:
    """Packets with the rules that match them: sid, rule_order, severity, priority, message, evidence and explanation.

    The rules become one array, which the explode itself works out, so each packet
    is read and each rule evaluated once, patterns are compiled once, and nothing
    is joined. ``most`` keeps the first matches in rule order of each packet.
    """
    if text is None and "payload" in packets.columns:
        text = latin(F.col("payload"))
    protocol = F.upper("protocol")
    hits = [
        F.when(
            condition(r, set(packets.columns), text),
            F.struct(
                F.lit(r["sid"]).cast("bigint").alias("sid"), F.lit(i).alias("rule_order"), F.lit(r["severity"]).alias("severity"), F.lit(r["priority"]).alias("priority"), F.lit(r["message"]).alias("message"),
                F.concat(F.lit("protocol="), protocol, F.lit("; " + evidence(r))).alias("evidence"), F.concat(F.lit(f"rule {r['sid']} matched buffer {r['buffer'] or 'payload'} on protocol "), protocol).alias("explanation"),
            ),
        )
        for i, r in enumerate(rules) if r["enabled"]
    ]
    added = ["sid", "rule_order", "severity", "priority", "message", "evidence", "explanation"]
    kept = [c for c in packets.columns if c not in added]
    if not hits:
        return packets.limit(0).select(*kept).selectExpr("*", "0L AS sid", "0 AS rule_order", "'' AS severity", "0 AS priority", "'' AS message", "'' AS evidence", "'' AS explanation")
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    found = F.slice(found, 1, most) if most else found
    return packets.select(*kept, F.explode(found).alias("__hit")).select(*kept, "__hit.*")


def _net_bounds(c: str) -> tuple[Column, Column]:
    """First and last address of an IPv4 net or address in a column; null for any and for IPv6."""
    ip, bits = F.substring_index(c, "/", 1), F.when(F.contains(c, F.lit("/")), F.substring_index(c, "/", -1).try_cast("int")).otherwise(32)
    size = F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    first = F.floor(net.ip_long(ip) / size).cast("bigint") * size
    return first, first + size - 1


def match_many(packets: DataFrame, rules: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """Rules as a table (``schema.RULES``), for sets too large for one expression: an equi-join on the protocol, all else as residual condition.

    Gives the rows of ``match`` (packet columns, rule_sid, rule_rev,
    rule_severity, rule_message) for rules with the same meaning: direction,
    ports, IPv4 nets (other addresses as text), service, flow, offset, depth, ordered
    chains, case and regular expressions. The rules are broadcast if they are at
    most ``broadcast_rows``; beyond it the planner shuffles both sides by protocol
    and splits skewed ones.
    """
    fold = lambda on, c: F.when(on, F.translate(c, _UPPER, _LOWER)).otherwise(c)
    family = F.when(F.col("protocol") == "IP", F.lit(list(IP_FAMILY))).otherwise(F.array("protocol"))
    names = [f.name for f in schema.RULES if f.name != "protocol"]
    r = rules.where("enabled").select(F.explode(family).alias("__protocol"), *(F.col(c).alias(f"rule_{c}") for c in names))
    for side in ("src", "dst"):
        first, last = _net_bounds(f"rule_{side}_ip")
        r = r.withColumns({f"rule_{side}_first": first, f"rule_{side}_last": last})
    r = r.withColumn("rule_content", F.transform("rule_content", lambda c: fold(F.col("rule_nocase"), latin(c))))
    r = r.withColumn("rule_regex", F.when(F.col("rule_nocase"), F.concat(F.lit("(?i)"), "rule_regex")).otherwise(F.col("rule_regex")))
    r = F.broadcast(r) if rules.count() <= broadcast_rows else r

    def there(ip: str, side: str) -> Column:
        want, n = F.col(f"rule_{side}_ip"), net.ip_long(F.col(ip))
        return (want == "any") | F.coalesce(n.between(F.col(f"rule_{side}_first"), F.col(f"rule_{side}_last")), F.col(ip) == want, F.lit(False))

    def headed(src: str, dst: str) -> Column:
        return net.port_matches(F.col(f"{src}_port"), F.col("rule_src_ports")) & net.port_matches(F.col(f"{dst}_port"), F.col("rule_dst_ports")) & there(f"{src}_ip", "src") & there(f"{dst}_ip", "dst")

    way = F.col("rule_direction")
    header = F.when(way == "->", headed("src", "dst")).when(way == "<-", headed("dst", "src")).otherwise(headed("src", "dst") | headed("dst", "src"))
    if "service" in packets.columns:
        header = header & (F.col("rule_service").isNull() | (F.upper("service") == F.upper("rule_service")))
    if "dir" in packets.columns:
        header = header & (F.col("rule_flow").isNull() | (F.col("dir") == F.when(F.col("rule_flow") == "to_server", "c2s").otherwise("s2c")))
    text = F.coalesce(latin(F.col("payload")), F.lit(None).cast("string"))
    other = [b for b in BUFFERS if b != "payload" and b in packets.columns]
    whole = F.when(F.coalesce(F.col("rule_buffer"), F.lit("payload")) == "payload", text)
    for b in other:
        whole = whole.when(F.col("rule_buffer") == b, F.col(b))
    offset = F.coalesce("rule_offset", F.lit(0))
    folded = fold(F.col("rule_nocase"), whole)
    part = F.when(F.col("rule_depth").isNotNull(), F.substring(folded, 1, offset + F.col("rule_depth"))).otherwise(folded)
    # the chain's state is the place after the last value found, 0 once one wasn't
    distance, within = F.coalesce("rule_distance", F.lit(0)), F.col("rule_within")

    def chained(state: Column, value: Column, i: Column) -> Column:
        begin = state + F.when(i == 0, 0).otherwise(distance)
        at = F.call_function("locate", value, part, begin)
        near = (i == 0) | within.isNull() | (at + F.length(value) <= begin + within)
        return F.when((state > 0) & (at > 0) & near, at + F.length(value)).otherwise(0)

    steps = F.transform("rule_content", lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    chain = F.aggregate(steps, offset + 1, lambda s, e: chained(s, e["v"], e["i"])) > 0
    anywhere = F.forall("rule_content", lambda v: F.contains(F.substring(part, offset + 1, F.lit(2**31 - 1)), v))
    ordered = (F.size("rule_content") > 1) & (F.col("rule_distance").isNotNull() | within.isNotNull())
    content = (F.size("rule_content") == 0) | F.coalesce(F.when(ordered, chain).otherwise(anywhere), F.lit(False))
    pattern = F.col("rule_regex").isNull() | F.coalesce(F.regexp_like(whole, F.col("rule_regex")), F.lit(False))
    out = packets.join(r, (F.upper(packets["protocol"]) == r["__protocol"]) & header & content & pattern)
    return out.select(*packets.columns, "rule_sid", "rule_rev", "rule_severity", "rule_message")


def thresholded(matches: DataFrame, rules: list[dict], keys: tuple[str, ...] = ("src_ip",)) -> DataFrame:
    """Matches that raise alerts: all of rules without a threshold, and of the others those at which the rule's own count within its own seconds is reached."""
    bounds = {r["sid"]: (r["threshold_count"], r["threshold_seconds"] * 1_000_000) for r in rules if r["threshold_count"]}
    plain = matches.where(~F.col("sid").isin(*bounds)) if bounds else matches
    by_bound: dict[tuple[int, int], list[int]] = {}
    for sid, bound in bounds.items():
        by_bound.setdefault(bound, []).append(sid)
    parts = [enforce_threshold(matches.where(F.col("sid").isin(*sids)), [*keys, "sid"], n, w).drop("n") for (n, w), sids in sorted(by_bound.items())]
    return reduce(DataFrame.unionByName, parts, plain)


def enforce_threshold(matches: DataFrame, keys: list[str], count: int, window_us: int) -> DataFrame:
    """Matches at which a rule's count in its window reaches the threshold."""
    return W.rising_edge(W.sliding_count(matches, keys, window_us), keys, count)


def deduplicated(matches: DataFrame, keys: list[str], window_us: int, most: int = 2) -> DataFrame:
    """Matches that open a window of their key, and of these the first ``most`` of each packet in rule order."""
    opened = W.anchored(matches, [*keys, "sid"], window_us)
    return opened.withColumn("__n", F.row_number().over(Window.partitionBy("packet_id").orderBy("rule_order"))).where(F.col("__n") <= most).drop("__n")
