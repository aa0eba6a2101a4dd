"""Service identification, protocol fields and detection buffers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Evidence (fixed values): ports of 25 points, and payload beginnings with theirs.
PORT_HINTS = {"HTTP": (80, 8080, 8000), "TLS": (443, 8443), "SSH": (22,), "FTP": (21,), "SMTP": (25, 587, 465), "SMB": (445, 139)}
SIGNATURES = (("HTTP", 80, ("GET ", "POST ", "PUT ", "HEAD ", "HTTP/1.")), ("SSH", 80, ("SSH-",)), ("SMTP", 70, ("220 ", "EHLO ", "HELO ")), ("FTP", 60, ("USER ", "220-")))
BUFFER_CAP = 65_536


def _starts(text: Column, strings: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.startswith(s) for s in strings))


def service(transport: Column, port: Column, text: Column) -> Column:
    """(service, score, confidence) of a packet, from its transport, server port and payload (as text of one character a byte)."""
    entry = lambda cond, name, points: F.when(cond, F.struct(F.lit(name).alias("service"), F.lit(points).alias("points")))
    tcp, udp = transport == "TCP", transport == "UDP"
    tls = (F.substring(text, 1, 2) == "\x16\x03") & (F.ascii(F.substring(text, 3, 1)) <= 4) & (F.length(text) >= 3)
    found = [entry(tcp & port.isin(*ports), name, 25) for name, ports in PORT_HINTS.items()]
    found += [entry(tcp & _starts(text, strings), name, points) for name, points, strings in SIGNATURES]
    found += [entry(tcp & tls, "TLS", 80), entry(udp & (port == 53), "DNS", 25), entry(udp & (F.length(text) >= 12), "DNS", 55)]
    evidence = F.filter(F.array(*found), lambda e: e.isNotNull())
    top = F.array_max(F.transform(evidence, lambda e: e["points"]))
    winner = F.element_at(F.filter(evidence, lambda e: e["points"] == top), 1)["service"]
    conflict = F.exists(evidence, lambda a: (a["points"] >= 70) & F.exists(evidence, lambda b: (b["service"] != a["service"]) & (b["points"] >= 25)))
    none = F.struct(F.when(tcp, "GENERIC_TCP").otherwise("GENERIC_UDP").alias("service"), F.lit(10).alias("score"), F.lit("suspected").alias("confidence"))
    icmp = F.struct(F.lit("ICMP").alias("service"), F.lit(100).alias("score"), F.lit("identified").alias("confidence"))
    some = F.struct(winner.alias("service"), top.alias("score"), F.when(conflict, "conflicted").when(top >= 70, "identified").otherwise("suspected").alias("confidence"))
    return F.when(transport.isin("ICMP", "ICMPV6"), icmp).when(F.size(evidence) == 0, none).otherwise(some)


def sticky_service(packets: DataFrame, keys: list[str]) -> DataFrame:
    """One service for a flow: the last identified one, else the first seen."""
    known = F.when(F.col("confidence") == "identified", F.col("service"))
    at = F.struct("ts_us", "packet_id")
    return packets.groupBy(*keys).agg(F.coalesce(F.max_by(known, F.when(known.isNotNull(), at)), F.min_by("service", at)).alias("service"))


def http_fields(text: Column) -> Column:
    """Status and fields of a request or response head: incomplete without an empty line, malformed with a bad first line or header."""
    head = F.substring_index(text, "\r\n\r\n", 1)
    lines = F.split(head, "\r\n")
    first = F.element_at(lines, 1)
    words = F.filter(F.split(first, " "), lambda w: w != "")
    response = first.startswith("HTTP/")
    status = F.try_element_at(words, F.lit(2)).try_cast("int")
    good = F.when(response, F.coalesce(status.between(100, 999), F.lit(False))).otherwise((F.size(words) >= 3) & F.coalesce(F.try_element_at(words, F.lit(3)).startswith("HTTP/"), F.lit(False)))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    fine = F.forall(rest, lambda x: F.locate(":", x) > 1)
    # the last of equal headers counts
    headers = F.aggregate(rest, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(F.substring_index(x, ":", 1))), F.create_map(F.lower(F.substring_index(x, ":", 1)), F.ltrim(F.substring(x, F.locate(":", x) + 1, F.length(x))))))
    state = F.when(~F.contains(text, F.lit("\r\n\r\n")), "incomplete").when(~good | ~fine, "malformed").otherwise("complete")
    when = lambda c: F.when((state == "complete"), c)
    return F.struct(
        state.alias("status"), when(F.when(~response, F.element_at(words, 1))).alias("method"), when(F.when(~response, F.try_element_at(words, F.lit(2)))).alias("uri"), when(F.when(~response, F.replace(F.try_element_at(words, F.lit(2)), F.lit("\\"), F.lit("/")))).alias("normalized_uri"),
        when(F.when(response, F.element_at(words, 1)).otherwise(F.try_element_at(words, F.lit(3)))).alias("version"), when(F.when(response, status)).alias("response_status"), when(headers["host"]).alias("host"), when(headers["user-agent"]).alias("user_agent"),
        when(headers["content-type"]).alias("content_type"), when(headers["content-length"]).alias("content_length"), when(headers).alias("headers"),
    )


def normalized_uri(uri: Column) -> Column:
    """Valid percent escapes decoded, all else as it is, backslashes as slashes."""
    safe = F.regexp_replace(F.replace(uri, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.replace(F.coalesce(F.try_url_decode(safe), uri), F.lit("\\"), F.lit("/"))


def tls_record(text: Column) -> Column:
    """Status, content type, minor version, length and handshake type of a TLS record (text of one character a byte)."""
    byte = lambda i: F.ascii(F.substring(text, i, 1))
    n = F.length(text)
    size = byte(4) * 256 + byte(5)
    status = F.when(n < 5, "incomplete").when(~byte(1).between(20, 24) | (byte(2) != 3) | (byte(3) > 4), "malformed").when(n < size + 5, "incomplete").otherwise("complete")
    return F.struct(status.alias("status"), F.when(n >= 5, byte(1)).alias("content_type"), F.when(n >= 5, byte(3)).alias("minor"), F.when(n >= 5, size).alias("length"), F.when((byte(1) == 22) & (n >= 6), byte(6)).alias("handshake_type"))


#: Services with an inspector.
INSPECTED = ("HTTP", "DNS", "TLS", "SSH", "ICMP", "GENERIC_TCP", "GENERIC_UDP")


def plain_fields(service_: Column, text: Column) -> Column:
    """Status, length and banner of SSH, ICMP and unknown services: SSH has to begin with its banner."""
    n, banner = F.coalesce(F.length(text), F.lit(0)), text.startswith("SSH-")
    bad = (service_ == "SSH") & (n >= 4) & ~banner
    status = F.when(bad, "malformed").when(n == 0, "incomplete").otherwise("complete")
    return F.struct(status.alias("status"), n.alias("payload_length"), F.when((service_ == "SSH") & banner, "SSH-").alias("banner_prefix"))


def inspected(df: DataFrame, service_col: str = "service", payload_col: str = "payload", cap: int = BUFFER_CAP) -> DataFrame:
    """Adds ``inspection`` (status and the fields of the service, as text by name): dispatch by service.

    Services without an inspector are malformed, payloads over the cap exceed a
    limit. DNS messages are walked in Arrow batches, all else are expressions.
    """
    text, s = F.decode(payload_col, "ISO-8859-1") if dict(df.dtypes)[payload_col] == "binary" else F.col(payload_col), F.upper(service_col)
    out = dns_inspect(df.withColumn("__bytes", F.when(s == "DNS", F.col(payload_col).cast("binary"))), "__bytes")
    http, tls, plain = http_fields(F.when(s == "HTTP", text)), tls_record(F.when(s == "TLS", text)), plain_fields(s, text)
    out = out.withColumns({"__http": F.when(s == "HTTP", http), "__tls": F.when(s == "TLS", tls), "__plain": plain})

    def named(source: str, *names: str) -> Column:
        pairs = F.array(*(F.struct(F.lit(n).alias("k"), F.col(f"{source}.{n}").cast("string").alias("v")) for n in names))
        return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))

    fields = (
        F.when(s == "HTTP", named("__http", "method", "uri", "normalized_uri", "version", "response_status", "host", "user_agent", "content_type", "content_length")).when(s == "DNS", named("dns", "id", "response", "questions", "answers", "rcode", "qname", "qtype"))
        .when(s == "TLS", named("__tls", "content_type", "minor", "length", "handshake_type")).otherwise(named("__plain", "payload_length", "banner_prefix"))
    )
    status = F.when(~s.isin(*INSPECTED), "malformed").when(F.length(text) > cap, "limit_exceeded").when(s == "HTTP", F.col("__http.status")).when(s == "DNS", F.col("dns.status")).when(s == "TLS", F.col("__tls.status")).otherwise(F.col("__plain.status"))
    return out.withColumn("inspection", F.struct(status.alias("status"), F.when(s.isin(*INSPECTED) & (status != "limit_exceeded"), fields).otherwise(F.create_map().cast("map<string,string>")).alias("fields"))).drop("__bytes", "__http", "__tls", "__plain", "dns")


def inspection_buffers(df: DataFrame, service_col: str = "service") -> DataFrame:
    """Adds the buffers that rules may name as columns, from ``inspection``: null where a service has none of the kind."""
    f, s, done = F.col("inspection.fields"), F.upper(service_col), F.col("inspection.status") == "complete"
    of = {"http_uri": ("HTTP", "normalized_uri"), "http_method": ("HTTP", "method"), "http_host": ("HTTP", "host"), "http_user_agent": ("HTTP", "user_agent"), "http_headers": ("HTTP", "host"), "dns_query": ("DNS", "qname")}
    cols = {name: F.when((s == service_) & done, f[key]) for name, (service_, key) in of.items()}
    text = F.decode("payload", "ISO-8859-1") if dict(df.dtypes)["payload"] == "binary" else F.col("payload")
    cols |= {"dns_response": F.when((s == "DNS") & done & (f["response"] == "true"), text), "tls_handshake": F.when((s == "TLS") & f["handshake_type"].isNotNull(), text)}
    transport = F.upper("protocol") if "protocol" in df.columns else F.lit(None).cast("string")
    cols |= {name: F.when(transport.isin(*kinds), F.lit("")) for name, kinds in (("tcp", ("TCP",)), ("udp", ("UDP",)), ("icmp", ("ICMP", "ICMPV6")))}
    return df.withColumns(cols)


def dns_fields(payloads) -> list[dict]:
    """Status, id, kind, counts, response code, first name and type of DNS messages; for Arrow batches of bytes."""
    out = []
    for b in payloads:
        d: dict = {"status": "malformed", "id": None, "response": None, "questions": None, "answers": None, "rcode": None, "qname": None, "qtype": None}
        if b is None or len(b) < 12:
            d["status"] = "incomplete"
            out.append(d)
            continue
        word = lambda i, b=b: b[i] << 8 | b[i + 1]
        d |= {"id": word(0), "response": bool(b[2] & 0x80), "rcode": b[3] & 15, "questions": word(4), "answers": word(6)}
        labels, at, ok = [], 12, True
        while d["questions"] and ok:
            if at >= len(b):
                ok = False
            elif b[at] == 0:
                at += 1
                break
            elif b[at] & 0xC0 or at + 1 + b[at] > len(b):  # pointers aren't followed
                ok = False
            else:
                labels.append(b[at + 1 : at + 1 + b[at]].decode("latin-1"))
                at += 1 + b[at]
        name = ".".join(labels)
        if ok and len(name) <= 253 and (not d["questions"] or at + 4 <= len(b)):
            d["status"] = "complete"
            if d["questions"]:
                d["qname"], d["qtype"] = name.lower(), word(at)
        out.append(d)
    return out


def dns_inspect(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds ``dns``: the fields of each payload (a byte walk, so in Arrow batches)."""
    kind = T.StructType([T.StructField(n, t) for n, t in (("status", T.StringType()), ("id", T.IntegerType()), ("response", T.BooleanType()), ("questions", T.IntegerType()), ("answers", T.IntegerType()), ("rcode", T.IntegerType()), ("qname", T.StringType()), ("qtype", T.IntegerType()))])

    def read(payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dns_fields(payloads), columns=kind.names).astype({"id": "Int32", "questions": "Int32", "answers": "Int32", "rcode": "Int32", "qtype": "Int32"})

    read = F.pandas_udf(read, kind)
    return df.withColumn("dns", read(F.col(payload_col)))


def buffers(payload: Column, http: Column | None = None, cap: int = BUFFER_CAP) -> Column:
    """Detection buffers by name, in a fixed order; one that would go over the cap in all is left out."""
    named = [("payload", payload)] + ([(f"http_{k}", http[k]) for k in ("uri", "method", "host", "user_agent")] if http is not None else [])
    total, entries = F.lit(0), []
    for name, value in named:
        fits = value.isNotNull() & (total + F.length(value) <= cap)
        entries.append(F.when(fits, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))))
        total = total + F.when(fits, F.length(value)).otherwise(0)
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
