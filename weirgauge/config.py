"""Thresholds and switches of the detectors, checked before a job starts."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults every existing deployment relies on.
WINDOW_SECS = (10, 60, 300)
TICK_SECS = 10
TOP_TALKERS = 5
EXPORTER_ACTIVE_SECS = 300
KNOWN_VERSIONS = (5, 9, 10)


@dataclass(frozen=True)
class UdpFloodConfig:
    enabled: bool = True
    min_packets_per_sec: float = 1000.0
    min_udp_ratio: float = 0.80
    min_unique_sources: int = 10


@dataclass(frozen=True)
class SynFloodConfig:
    enabled: bool = True
    min_packets_per_sec: float = 500.0
    min_syn_ratio: float = 0.70
    max_avg_flow_duration_ms: int = 500


@dataclass(frozen=True)
class PortScanConfig:
    enabled: bool = True
    min_unique_dst_ports: int = 50
    max_bytes_per_flow: float = 100.0
    window_secs: int = 60
    # False: one alert per tick (widest source, then lowest address).
    all_sources: bool = False


@dataclass(frozen=True)
class DestinationHotspotConfig:
    enabled: bool = True
    min_traffic_ratio: float = 0.80
    min_bytes_per_sec: float = 100.0


@dataclass(frozen=True)
class DetectionConfig:
    enabled: bool = True
    cooldown_secs: int = 60
    udp_flood: UdpFloodConfig = field(default_factory=UdpFloodConfig)
    syn_flood: SynFloodConfig = field(default_factory=SynFloodConfig)
    port_scan: PortScanConfig = field(default_factory=PortScanConfig)
    destination_hotspot: DestinationHotspotConfig = field(default_factory=DestinationHotspotConfig)


@dataclass(frozen=True)
class EngineConfig:
    accepted_versions: tuple[int, ...] = ()
    snapshot_interval_secs: int = TICK_SECS
    detection: DetectionConfig = field(default_factory=DetectionConfig)


def validate_config(config: EngineConfig) -> EngineConfig:
    """Return the configuration, or raise ``ValueError`` naming the first bad setting."""
    detection = config.detection
    if config.snapshot_interval_secs <= 0:
        raise ValueError("snapshot_interval_secs must be > 0")
    if detection.cooldown_secs <= 0:
        raise ValueError("cooldown_secs must be > 0")
    unknown = [v for v in config.accepted_versions if v not in KNOWN_VERSIONS]
    if unknown:
        raise ValueError(f"accepted_versions contains unsupported version {unknown[0]}")
    thresholds = [
        ("udp_flood", "min_packets_per_sec"),
        ("udp_flood", "min_udp_ratio"),
        ("syn_flood", "min_packets_per_sec"),
        ("syn_flood", "min_syn_ratio"),
        ("destination_hotspot", "min_traffic_ratio"),
        ("destination_hotspot", "min_bytes_per_sec"),
        ("port_scan", "max_bytes_per_flow"),
    ]
    for rule, name in thresholds:
        if getattr(getattr(detection, rule), name) < 0:
            raise ValueError(f"{rule}.{name} must be >= 0")
    return config
