"""Thresholds and windows of the detectors; times are seconds of event time."""

from __future__ import annotations

import dataclasses
import os


@dataclasses.dataclass(frozen=True)
class DetectorConfig:
    scan_window: float = 30
    port_threshold: int = 8
    ping_threshold: int = 30
    remote_sweep_threshold: int = 200
    remote_sweep_enabled: bool = False
    dns_threshold: int = 50
    brute_force_threshold: int = 10
    syn_flood_threshold: int = 100
    icmp_flood_threshold: int = 30
    ssh_brute_force_threshold: int = 10
    ssh_brute_force_window: float = 60
    ssh_banner_grab_threshold: int = 1
    ssh_banner_grab_window: float = 60
    ftp_brute_force_threshold: int = 10
    ftp_brute_force_window: float = 60
    ftp_grab_threshold: int = 1
    ftp_enum_window: float = 60
    http_enum_threshold: int = 40
    http_enum_window: float = 60
    http_banner_grab_threshold: int = 1
    http_banner_grab_window: float = 60
    reverse_shell_min_duration: float = 30
    connection_idle_timeout: float = 120
    correlation_window: float = 600
    frame_dedup_window: float = 1
    rule_dedup_window: float = 30
    max_alerts_per_packet: int = 2
    incident_window: float = 30
    flow_idle: float = 300
    flow_lifetime: float = 86_400
    alert_dedup_window: float = 60
    enable_ipv6: bool = False

    def __post_init__(self):
        """Lower bounds: thresholds of 2, banner grabs 1, enumeration 5; windows 5 s, idle 10 s, correlation 30 s."""
        least = {"port_threshold": 2, "ping_threshold": 2, "remote_sweep_threshold": 2, "dns_threshold": 2, "brute_force_threshold": 2, "syn_flood_threshold": 2, "icmp_flood_threshold": 2, "ssh_brute_force_threshold": 2, "ftp_brute_force_threshold": 2, "ssh_banner_grab_threshold": 1, "ftp_grab_threshold": 1, "http_banner_grab_threshold": 1, "http_enum_threshold": 5, "ssh_brute_force_window": 5, "ssh_banner_grab_window": 5, "ftp_brute_force_window": 5, "ftp_enum_window": 5, "http_enum_window": 5, "http_banner_grab_window": 5, "reverse_shell_min_duration": 1, "connection_idle_timeout": 10, "correlation_window": 30}
        for name, low in least.items():
            if getattr(self, name) < low:
                object.__setattr__(self, name, low)

    @classmethod
    def from_env(cls, prefix: str = "PACKETLAKE_") -> DetectorConfig:
        """Fields overridden by environment variables, as in PACKETLAKE_PORT_THRESHOLD=20."""
        given = {}
        for f in dataclasses.fields(cls):
            if (v := os.environ.get(prefix + f.name.upper())) is not None:
                given[f.name] = v.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(float(v))
        return cls(**given)

    def us(self, name: str) -> int:
        return round(getattr(self, name) * 1_000_000)
