"""Fixed values that results depend on: enumerations, word lists, patterns, lookup tables.

Everything in this file is a fixed value: it is part of the data contract (OCSF 1.1.0
codes, vendor vocabularies, log-line patterns), not logic. Patterns are in Java dialect
with positional groups; ``(?d)`` makes ``$`` and ``.`` treat only ``\\n`` as a line end.
"""

# --- fixed values: OCSF enumerations -------------------------------------------------
SEVERITY_NAMES = {
    0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium",
    4: "High", 5: "Critical", 6: "Fatal", 99: "Other",
}
DISPOSITION_NAMES = {
    0: "Unknown", 1: "Allowed", 2: "Blocked", 3: "Denied", 4: "Quarantined",
    5: "Isolated", 6: "Dropped", 7: "Reset", 99: "Other",
}
STATUS_NAMES = {0: "Unknown", 1: "Success", 2: "Failure", 99: "Other"}
DIRECTION_NAMES = {1: "Inbound", 2: "Outbound", 3: "Lateral"}
PROTOCOL_NUMBERS = {
    "HOPOPT": 0, "ICMP": 1, "IGMP": 2, "GGP": 3, "IP-IN-IP": 4, "ST": 5, "TCP": 6,
    "CBT": 7, "EGP": 8, "IGP": 9, "UDP": 17, "GRE": 47, "ESP": 50, "AH": 51,
    "ICMPV6": 58, "OSPF": 89, "SCTP": 132,
}
CLASS_NETWORK_ACTIVITY = 4001
CLASS_SECURITY_FINDING = 2001
OCSF_VERSION = "1.1.0"
MAPPING_VERSION = "1.0.0"
PROFILES = ["host", "security_control"]

# --- fixed values: severity and disposition vocabularies of the normaliser ----------
SEVERITY_WORDS = {
    6: ["fatal", "emergency"],
    5: ["critical", "crit"],
    4: ["high", "error", "err"],
    3: ["medium", "warn", "warning"],
    2: ["low", "notice"],
    1: ["info", "informational", "debug"],
}
STATUS_FAILURE_MARKS = ["fail", "err", "deny"]
BLOCK_ACTIONS = [
    "deny", "denied", "drop", "dropped", "block", "blocked", "reject", "rejected", "quarantine",
]

# --- fixed values: keys of a parsed line that have a place of their own in the document
KNOWN_KEYS = [
    "src_ip", "src_port", "src_hostname", "src_mac", "src_zone",
    "dst_ip", "dst_port", "dst_hostname", "dst_mac", "dst_zone",
    "protocol", "protocol_num", "direction", "app_name",
    "bytes_in", "bytes_out", "bytes", "packets_in", "packets_out", "packets",
    "severity", "severity_id", "status", "status_id", "disposition", "disposition_id",
    "action", "activity_name", "activity_id", "rule_name", "rule_id", "message",
    "device_vendor", "device_product", "device_version", "event_name", "timestamp",
    "target_class_uid", "signature", "signature_id", "category", "finding_info",
]

# --- fixed values: format detection ---------------------------------------------------
SYSLOG_5424 = r"(?d)^<(\d{1,3})>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)?\s*([\s\S]*)$"
SYSLOG_3164 = (
    r"(?d)^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([^\s:]+)\s+([^:]+):\s*([\s\S]*)$"
)
ASA_CODE_ANY_CASE = r"(?i)(?:%ASA-\d+-\d+|%FTD-\d+-\d+)"
FORTINET_KV = (
    r"(?i)(?:date=\S+\s+time=\S+\s+devname=\S+|type=(?:traffic|utm|event)\s+subtype=)"
)
SQUID_HEAD = (
    r"^\d{10}\.\d{3}\s+\d+\s+\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+[A-Z_]+/\d{3}\s+\d+\s+[A-Z]+\s+"
)
CHECKPOINT_MARKS = ["CheckPoint", "fw1", "log_uid"]
KEY_VALUE_MARKS = ["src", "dst", "action", "proto"]

# --- fixed values: parser identities in matching order ----------------------------------
# (id, vendor, product, format)
BUILT_IN_PARSERS = [
    ("cisco-asa-firewall-parser", "Cisco", "ASA", "syslog_rfc3164"),
    ("palo-alto-panos-parser", "Palo Alto Networks", "PAN-OS", "cef"),
    ("fortinet-fortios-parser", "Fortinet", "FortiOS", "syslog_rfc3164"),
    ("checkpoint-fw1-parser", "Checkpoint", "Firewall-1", "syslog_rfc3164"),
    ("suricata-eve-json-parser", "Suricata", "EVE-IDS", "json"),
    ("zeek-conn-parser", "Zeek", "Network-Monitor", "json"),
    ("squid-proxy-parser", "Squid", "Proxy", "proprietary"),
    ("cef-standard-parser", "ArcSight", "CEF-Engine", "cef"),
    ("leef-standard-parser", "IBM-QRadar", "LEEF-Engine", "leef"),
    ("json-generic-parser", "Generic", "JSON-Log", "json"),
    ("syslog-rfc5424-generic", "Generic", "Syslog-RFC5424", "syslog_rfc5424"),
    ("syslog-rfc3164-generic", "Generic", "Syslog-RFC3164", "syslog_rfc3164"),
]
ONBOARDING_QUEUE = "drain3-onboarding-queue"

# --- fixed values: Cisco ASA / FTD --------------------------------------------------------
ASA_CODE = r"%ASA-\d+-\d+|%FTD-\d+-\d+"
ASA_HEADER = r"(?d)%(ASA|FTD)-(\d+)-(\d+):\s*(.*)$"
ASA_SEVERITY = {1: 5, 2: 5, 3: 4, 4: 3, 5: 2}
ASA_BUILT = (
    r"(?i)Built\s+(inbound|outbound)?\s*(\w+)\s+connection\s+(\d+)\s+for\s+(?:([\w-]+):)?([0-9.]+)/(\d+)"
    r"(?:\s*\([^\)]+\))?\s+to\s+(?:([\w-]+):)?([0-9.]+)/(\d+)"
)
ASA_TEARDOWN = (
    r"(?i)Teardown\s+(?:(inbound|outbound)\s+)?(\w+)\s+connection\s+(\d+)\s+for\s+(?:([\w-]+):)?([0-9.]+)/(\d+)"
    r"(?:\s*\([^\)]+\))?\s+to\s+(?:([\w-]+):)?([0-9.]+)/(\d+)(?:\s*\([^\)]+\))?"
    r"\s+duration\s+([0-9:]+)\s+bytes\s+(\d+)"
)
ASA_DENY = (
    r"(?i)Deny\s+(\w+)\s+src\s+(?:([\w-]+):)?([0-9.]+)/(\d+)\s+dst\s+(?:([\w-]+):)?([0-9.]+)/(\d+)"
    r'(?:\s+by\s+access-group\s+"([^"]+)")?'
)
ASA_DENIED = (
    r"(?i)(?:(Inbound|Outbound)\s+)?(\w+)?\s*connection\s+denied\s+from\s+([0-9.]+)/(\d+)\s+to\s+([0-9.]+)/(\d+)"
    r"(?:\s+flags\s+(\w+))?(?:\s+on\s+interface\s+([\w-]+))?"
)
ASA_NAT = (
    r"(?i)Built\s+(?:dynamic|static)\s+(\w+)\s+translation\s+from\s+(?:([\w-]+):)?([0-9.]+)/(\d+)"
    r"\s+to\s+(?:([\w-]+):)?([0-9.]+)/(\d+)"
)

# --- fixed values: Palo Alto PAN-OS ---------------------------------------------------------
PANOS_MARKS = ["palo alto", "pan-os", "panos"]
PANOS_CSV_MARK = "1,202"
PANOS_CEF_BLOCK = ["deny", "drop", "reset-client", "reset-server", "reset-both", "block"]
PANOS_CSV_BLOCK = ["drop", "deny", "reset-both", "block"]
PANOS_KV = r"([a-zA-Z0-9_]+)=([^\s,]+)"

# --- fixed values: Fortinet FortiOS -----------------------------------------------------------
FORTINET_MARKS = ["devname=", "fortigate", "fortios"]
FORTINET_PROTOCOLS = {
    "1": "ICMP", "6": "TCP", "17": "UDP", "47": "GRE", "50": "ESP", "51": "AH", "58": "ICMPv6",
}
FORTINET_BLOCK = ["deny", "drop", "block", "close", "timeout", "client-rst", "server-rst"]
FORTINET_LEVELS = {5: ["critical", "emergency", "alert"], 4: ["error"], 3: ["warning"], 2: ["notice"]}
QUOTED_KV = r'([a-zA-Z0-9_]+)=(?:"(?=[^"]*"))?((?<=")[^"]*(?=")|[^\s]+)'

# --- fixed values: Check Point ------------------------------------------------------------------
CHECKPOINT_LOWER_MARKS = ["checkpoint", "fw1", "log_uid="]
CHECKPOINT_KV = r'([a-zA-Z0-9_]+)[:=](?:"(?=[^"]*"))?((?<=")[^"]*(?=")|[^\s;]+)'
CHECKPOINT_BLOCK = ["drop", "reject", "block", "deny"]

# --- fixed values: Suricata, Zeek, Squid --------------------------------------------------------
SURICATA_SEVERITY = {1: 4, 2: 3, 3: 2}
SURICATA_BLOCK = ["blocked", "drop", "reject"]
ZEEK_REJECTED = ["REJ", "RSTO", "RSTR", "RSTOS0"]
SQUID_LINE = (
    r"^(\d+\.\d+)\s+(\d+)\s+([0-9.]+)\s+([A-Z_]+)/(\d{3})\s+(\d+)\s+([A-Z]+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)$"
)
SQUID_MARKS = ["TCP_DENIED/", "TCP_MISS/"]
URL_HOST = r"https?://([^/:]+)(?::(\d+))?"

# --- fixed values: CEF and LEEF -------------------------------------------------------------------
CEF_ALLOW = ["allow", "allowed", "permit", "permitted", "accept", "pass"]
CEF_BLOCK = [
    "deny", "denied", "drop", "dropped", "block", "blocked",
    "reset", "reset-both", "reset-client", "reset-server",
]
CEF_SEVERITY_FLOORS = [(9, 5), (7, 4), (4, 3), (2, 2)]
CEF_SEVERITY_WORDS = {
    5: ["critical", "crit", "very-high"],
    4: ["high", "err", "error"],
    3: ["medium", "med", "warning", "warn"],
    2: ["low", "notice"],
    1: ["info", "informational", "debug", "unknown"],
}
LEEF_BLOCK = ["deny", "denied", "drop", "dropped", "block", "blocked", "close", "reject"]
LEEF_SEVERITY_FLOORS = [(8, 4), (5, 3), (3, 2)]
LEEF_LOOSE_PAIR = r"(?d)(\w+)=([^\n]*?)(?=(?:\s+\w+=|$))"

# --- fixed values: syslog and generic JSON ----------------------------------------------------------
SYSLOG_5424_SEVERITY = {0: 6, 1: 5, 2: 5, 3: 4, 4: 3, 5: 2, 6: 1, 7: 1}
SYSLOG_3164_BLOCK = ["deny", "denied", "drop", "dropped", "block", "blocked", "reject"]
JSON_SRC_IP = ["src_ip", "src", "source_ip", "client_ip", "srcip", "ip_src"]
JSON_DST_IP = ["dst_ip", "dst", "dest_ip", "destination_ip", "server_ip", "dstip", "ip_dst"]
JSON_SRC_PORT = ["src_port", "spt", "source_port", "client_port", "srcport"]
JSON_DST_PORT = ["dst_port", "dpt", "dest_port", "destination_port", "server_port", "dstport"]
JSON_PROTOCOL = ["proto", "protocol", "proto_name"]
JSON_BLOCK = ["deny", "drop", "block", "reject", "reset"]
MINED_BLOCK = ["deny", "drop", "block", "reject", "reset"]
IPV4_SHAPE = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
IPV4_IN_TEXT = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"

# --- fixed values: line masks for template mining, applied in this order ------------------------------
LINE_MASKS = [
    ("IP", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("HEX", r"\b[0-9a-fA-F]{32,64}\b"),
    ("TIMESTAMP", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"),
    ("STR", r'"[^"]*"'),
    ("NUM", r"\b\d+\b"),
]
DRAIN_SIMILARITY = 0.5
DRAIN_MAX_CHILDREN = 100
WILDCARD = "<*>"

# --- fixed values: field discovery ----------------------------------------------------------------------
NAMED_PLACEHOLDERS = ["ip", "num", "timestamp", "str", "uuid", "rule", "proto", "action", "bytes", "dev"]
GROUP_IP = r"((?:[0-9]{1,3}\.){3}[0-9]{1,3})"
GROUP_NUMBER = r"(\d+)"
GROUP_TIME = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
GROUP_UUID = r"([0-9a-fA-F-]{36})"
GROUP_TEXT = r"""("[^"]*"|'[^']*'|[^\s,;|]+)"""
PROTOCOL_WORDS = ["TCP", "UDP", "ICMP", "GRE", "ESP", "AH", "HTTP", "HTTPS", "DNS", "SSH"]
ACTION_WORDS = ["ALLOW", "DENY", "DROP", "BLOCK", "REJECT", "ACCEPT", "PERMIT", "PASS"]
#: A variable's group in a template's pattern: mask, marks in the variable's name, group; the first row that fits.
VARIABLE_GROUPS = [
    ("IP", ["ip"], GROUP_IP),
    ("NUM", ["port", "bytes"], GROUP_NUMBER),
    ("TIMESTAMP", ["time", "date"], GROUP_TIME),
    ("STR", ["reason", "msg"], GROUP_TEXT),
    ("UUID", [], GROUP_UUID),
]
#: Fields by hints: marks in the variable's name, words its first value may be, a mask, a pattern of its first value;
#: then type, OCSF field, confidence and transform. The first row of which one hint fits.
FIELD_HINTS = [
    (["proto"], PROTOCOL_WORDS, None, None, "protocol", "protocol", 0.95, "to_upper"),
    (["action", "act"], ACTION_WORDS, None, None, "action", "action", 0.95, "to_lower"),
    (["time", "date"], [], "<TIMESTAMP>", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "timestamp", "timestamp", 0.90, None),
    (["byte", "size"], [], None, None, "integer", "bytes", 0.90, "to_int"),
    (["rule", "policy"], [], None, None, "string", "rule_name", 0.88, None),
    (["user", "usr"], [], None, None, "string", "user_name", 0.85, None),
    (["reason", "msg"], [], None, None, "string", "message", 0.80, None),
]
ADDRESS_CONFIDENCE, PORT_CONFIDENCE, NUMBER_CONFIDENCE, TEXT_CONFIDENCE = 0.95, 0.92, 0.70, 0.65
SESSION_CONFIDENCE = 0.88

# --- fixed values: default enrichment dimensions ------------------------------------------------------------
ASSETS = [
    # ip, name, role, zone, criticality
    ("10.0.0.1", "CORE-GW-01", "Core Perimeter Gateway", "DMZ", "High"),
    ("10.0.0.5", "DC-PRIMARY-01", "Domain Controller Active Directory", "Internal-Core", "Critical"),
    ("10.0.0.10", "DB-PROD-CLUSTER", "Primary Database Cluster", "Database-Secure", "Critical"),
    ("10.0.1.50", "WEB-FRONTEND-01", "Public Web Portal", "DMZ-Public", "High"),
    ("192.168.1.1", "FW-EDGE-PRIMARY", "NextGen Perimeter Firewall", "Perimeter", "Critical"),
    ("192.168.1.100", "ADMIN-SEC-STATION", "SOC Analyst Workstation", "Management", "Medium"),
    ("192.168.1.105", "DEV-BUILD-RUNNER", "Internal Build Agent", "Development", "Low"),
    ("172.16.0.1", "VPN-CONCENTRATOR", "Remote Access Gateway", "VPN-Edge", "High"),
]
# The 203.0.113 and 198.51.100 networks are special-use, hence classed private and never
# matched under the default special ranges; their labels cannot reach a result.
GEO_NETWORKS = [
    # network, country, country_code, city, as_name, as_num
    ("8.8.8.0/24", "United States", "US", "Mountain View", "Google LLC", 15169),
    ("1.1.1.0/24", "Australia", "AU", "Sydney", "Cloudflare Inc", 13335),
    ("203.0.113.0/24", "India", "IN", "New Delhi", "Secure Backbone", 55836),
    ("198.51.100.0/24", "Germany", "DE", "Frankfurt", "European IX", 24940),
    ("185.220.101.0/24", "Netherlands", "NL", "Amsterdam", "Tor Exit Node Network", 60729),
]
# IANA special-purpose IPv4 ranges that Python's ``ipaddress`` treats as private, with the
# two carve-outs; 127/8 doubles as the loopback range.
PRIVATE_NETWORKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
LOOPBACK_NETWORK = "127.0.0.0/8"

# --- fixed values: limits ---------------------------------------------------------------------------------------
MAX_PAYLOAD_BYTES = 10 * 1024 * 1024
MAX_DELIVERY_ATTEMPTS = 5
RETRY_BASE_SECONDS = 2.0
RETRY_MAX_SECONDS = 60.0
RETRY_JITTER_SECONDS = 0.5
RATE_WINDOW_SECONDS = 60
DISCOVERED_SAMPLES = 5
SEARCH_LIMIT_MAX = 500
