"""Data model: schemas, fixed vocabularies and default parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SERIES_KEYS = ("host", "metric")
POINT_KEYS = ("host", "measurement", "field")

POINTS = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

SUBMITTED_METRIC = T.StructType(
    [
        T.StructField("measurement", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("fields", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("timestamp", T.StringType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("host", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# --- Fixed values: collected fields per measurement -------------------------------
COLLECTED_FIELDS = {
    "cpu": ["usage_user", "usage_system", "usage_idle", "usage_iowait", "usage_steal"],
    "mem": ["available", "free", "total", "used", "used_percent", "available_percent"],
    "disk": ["free", "total", "used", "used_percent", "inodes_free", "inodes_total", "inodes_used"],
    "diskio": ["reads", "writes", "read_bytes", "write_bytes", "read_time", "write_time", "io_time"],
    "net": [
        "bytes_sent", "bytes_recv", "packets_sent", "packets_recv",
        "err_in", "err_out", "drop_in", "drop_out",
    ],
    "netstat": ["tcp_established", "tcp_listen", "tcp_time_wait", "udp_socket"],
    "system": ["load1", "load5", "load15", "n_cpus", "n_users"],
    "processes": ["total", "running", "sleeping", "stopped", "zombie", "blocked"],
    "kernel": ["boot_time", "context_switches", "interrupts", "processes_forked"],
    "smart": [
        "temperature", "power_on_hours", "reallocated_sector_ct",
        "pending_sector_ct", "uncorrectable_errors",
    ],
    "docker": [
        "cpu_usage", "mem_usage", "mem_limit", "net_rx_bytes", "net_tx_bytes",
        "block_read", "block_write",
    ],
}

# --- Fixed values: tag filters, field types, names ----------------------------------
IGNORED_FILESYSTEMS = ["tmpfs", "devtmpfs", "overlay", "squashfs"]
DISK_DEVICES = ["sda", "sdb", "nvme0n1", "vda"]
NET_INTERFACES = ["eth0", "enp0s3", "en0", "wlan0"]
INTEGER_FIELDS = ["bytes_sent", "bytes_recv", "read_bytes", "write_bytes"]
FLOAT_FIELDS = ["used_percent", "available_percent"]
BASIC_STATS_MEASUREMENTS = ["cpu", "mem", "disk", "diskio"]
MONITORED_METRICS = ["cpu_usage", "memory_usage", "disk_usage", "network_rx", "network_tx"]
METRIC_TYPES = ["cpu", "mem", "disk", "net", "system"]
AGGREGATIONS = ["mean", "max", "min", "sum", "count"]
OPERATORS = ["gt", "lt", "eq", "gte", "lte"]
SEVERITIES = ["info", "warning", "critical"]
SMART_FEATURES = [
    "temperature", "power_on_hours", "reallocated_sector_ct",
    "pending_sector_ct", "uncorrectable_errors",
]
SMART_SCORE_ATTRIBUTES = [
    "reallocated_sector_ct", "pending_sector_ct", "uncorrectable_errors",
    "temperature_celsius", "power_on_hours",
]
METHODS = ["zscore", "iqr", "ma", "ewma", "pattern"]

# --- Fixed values: limits -----------------------------------------------------------
MAX_BATCH = 1000
MAX_LIMIT = 10_000
SLOTS = 24


@dataclass(frozen=True)
class RiskParams:
    """Defaults of the scorers, the ensemble and the levels."""

    zscore_threshold: float = 2.5
    iqr_multiplier: float = 1.5
    ma_window: int = 7
    ma_std_multiplier: float = 2.0
    ewma_alpha: float = 0.3
    ewma_deviations: float = 3.0
    weights: dict[str, float] = field(
        default_factory=lambda: {"zscore": 0.25, "iqr": 0.20, "ma": 0.25, "ewma": 0.20, "pattern": 0.10}
    )
    missing_weight: float = 0.2
    warning: float = 0.5
    critical: float = 0.7
    trend_bonus: float = 0.1
    trend_min_r2: float = 0.5


DEFAULT_RISK = RiskParams()
