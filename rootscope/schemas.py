"""Column layouts that the operators share, as DDL."""

SPAN = (
    "trace_id string, span_id string, parent_span string, service_name string, operation_name string, start_time long, duration long, "
    "duration_ms double, has_error boolean, response string, status string, end_time string, tags map<string,string>, ingest_seq long"
)
FACT = "source string, relationship string, target string, citation_quote string, relevance double, source_type string"
INCIDENT = "id string, ts timestamp, root_cause string, affected_services array<string>, signature string, signature_full string, resolution string, confidence double, outcome string, metadata map<string,string>"
ACTION = "action string, target string, service string, command string, priority double, title string, description string, category string, confidence double, sequence int"
METRIC = "metric string, service string, ts double, value double"
LOG_LINE = "service string, line_no long, line string"
