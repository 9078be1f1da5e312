"""Column expressions: names, roles, scales, text clean-up. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that decide results.
INFRA_SERVICES = ("jaeger", "prometheus", "loadbalancer", "nginx", "istio", "loki", "grafana", "otel", "opentelemetry", "chaos", "kube", "metrics-server", "wrk2-job", "wrk", "loadgenerator")
ROLE_WORDS = (
    ("OBSERVABILITY", ("jaeger", "prometheus", "grafana", "otel", "opentelemetry", "opensearch", "opamp", "telemetry", "loki", "chaos", "metrics-server", "mcp", "chatbot")),
    ("LOADGEN", ("load-generator", "loadgenerator", "wrk", "wrk2-job", "locust")),
    ("BROKER", ("kafka", "rabbitmq", "nats", "zookeeper")),
    ("DATASTORE", ("mongodb", "mysql", "postgres", "redis", "valkey", "memcached", "-db", "tidb", "etcd", "consul")),
    ("GATEWAY", ("frontend-proxy", "frontend-web", "nginx", "istio", "envoy", "ingress", "loadbalancer")),
    ("ASYNC_CONSUMER", ("fraud-detection", "accounting", "email")),
)
ROLE_PRIORS = {"APP": 1.0, "GATEWAY": 0.5, "DATASTORE": 0.4, "BROKER": 0.3, "ASYNC_CONSUMER": 0.25, "OBSERVABILITY": 0.1, "LOADGEN": 0.1, "UNKNOWN": 1.0}
TOKEN_PREFIXES = ("HTTP_", "LOG_", "ERROR", "TIMEOUT", "HIGH_", "POD_", "STATUS_")
TOKEN_NAMES = ("SYSTEM", "INCIDENT")
SECRET_KEYS = ("password", "pass", "secret", "token", "authorization", "api_key", "apikey", "openai_api_key", "neo4j_password")
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
LOG_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[\d.:Z+-]*"
LOG_ID = r"(?i)\b[0-9a-f]{8,}\b"
LOG_IP = r"\b\d+\.\d+\.\d+\.\d+(:\d+)?\b"


def filled(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def is_request(operation: Column) -> Column:
    """Request handlers: operations that start with / or HTTP and a blank."""
    return F.coalesce(operation.startswith("/") | F.upper(operation).startswith("HTTP "), F.lit(False))


def failed(has_error: Column, response: Column) -> Column:
    """Flagged, or an all-digit response of 500 or more."""
    return F.coalesce(has_error, F.lit(False)) | (response.rlike(r"^\s*\d+\s*$") & F.coalesce(F.trim(response).try_cast("long") >= 500, F.lit(False)))


def unknown_response(response: Column) -> Column:
    return F.lower(F.trim(F.coalesce(response, F.lit("Unknown")))).isin("", "unknown")


def canonical_service(name: Column, strict_hash: bool = False) -> Column:
    """The name without a pod's hash pair or ordinal. strict_hash: a hash must hold a digit, so that `post-storage-service` stays."""
    s = F.trim(F.trim(F.trim(name), F.lit('"')), F.lit("'"))
    first = "(?=[a-z]*[0-9])" if strict_hash else ""
    return F.coalesce(F.regexp_replace(s, rf"^(?:(.+)-{first}[a-z0-9]{{5,}}-[a-z0-9]{{4,}}|(.+)-\d+)$", "$1$2"), F.lit(""))


def service_role(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(n == "", F.lit("UNKNOWN"))
    for role, words in ROLE_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | n.contains(w)
        out = out.when(hit, F.lit(role))
    return out.otherwise(F.lit("APP"))


def is_token(name: Column) -> Column:
    """Names that stand for signals, not services; null and empty too."""
    hit = name.isNull() | (name == "") | name.isin(*TOKEN_NAMES)
    for p in TOKEN_PREFIXES:
        hit = hit | name.startswith(p)
    return hit


def usage_kind(metric: Column) -> Column:
    """cpu, mem, or null for what isn't usage: fixed limits and period counters."""
    n = F.lower(metric)
    skip = n.startswith("container_spec_") | n.endswith("_periods_total")
    return F.when(skip, F.lit(None)).when(n.contains("cpu"), F.lit("cpu")).when(n.contains("mem"), F.lit("mem"))


def pod_of(cmdb_id: Column) -> Column:
    """The last segment of instance.pod."""
    return F.element_at(F.split(cmdb_id, r"\."), -1)


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals by its product, halves away from zero: 0.145 * 100 lies below 14.5 and gives 0.14, where F.round takes the printed digits and gives 0.15."""
    scale = 10.0**digits

    def at(x: Column) -> Column:
        v = x * scale
        near = F.rint(v)  # halves to even, so that they are set apart
        r = F.when(F.abs(v - near) == 0.5, v + F.signum(v) * 0.5).otherwise(near) / scale
        return F.when(F.abs(r) < float("inf"), r).otherwise(x)

    return F.transform(F.array(x.cast("double")), at)[0]  # x as a variable: roundings of roundings would repeat it many times over


def linear_relevance(count: Column, cap: int = 10) -> Column:
    return F.bround(F.least(F.lit(1.0), count.cast("double") / cap), 3)


def log_relevance(count: Column, saturate: float) -> Column:
    return F.bround(F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), count.cast("double"))) / F.log1p(F.lit(float(max(1.0, saturate))))), 3)


def ratio_relevance(ratio: Column, saturate: float = 1000.0) -> Column:
    return F.bround(F.least(F.lit(1.0), F.log10(F.greatest(ratio, F.lit(1.0001))) / F.log10(F.lit(saturate))), 3)


def normalize_log(line: Column) -> Column:
    """A log line without time stamps; ids and addresses as <id> and <ip>."""
    s = F.regexp_replace(line, LOG_TIME, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, LOG_ID, "<id>"), LOG_IP, "<ip>"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def redact(text: Column) -> Column:
    """Keys and passwords in free text become [REDACTED]."""
    s = F.regexp_replace(text, r"sk-[A-Za-z0-9]{16,}", "sk-[REDACTED]")
    for name in (r"api[_-]?key", r"password"):
        s = F.regexp_replace(s, rf"(?i)({name}\s*[:=]\s*)([^\s,'\"]+)", "$1[REDACTED]")
    return s


def redact_map(m: Column) -> Column:
    """Values of secret keys become [REDACTED], the others are redacted as text."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(F.trim(k)).isin(*SECRET_KEYS), F.lit("[REDACTED]")).otherwise(redact(v)))


def clip_middle(text: Column, most: int) -> Column:
    """Both ends of a text of more than `most` characters, with a note of what is left out between them."""
    half, n = most // 2, F.length(text)
    note = F.concat(F.lit("\n...[TRUNCATED "), (n - most).cast("string"), F.lit(" chars]...\n"))
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), F.lit(half)), note, F.substring(text, n - half + 1, F.lit(half))))
