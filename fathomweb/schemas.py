"""Schemas of the crawl tables. Nothing is inferred."""

RESPONSE = "struct<headers: map<string, string>, status: int, body: string, error: string>"
STORED = "url string, headers map<string, string>, status int, body string"
VISIT_STATE = "authority string, ip string, next_fetch bigint, retries int, last_exception string, path_queries array<string>"
ENTRY = "ip string, next_fetch bigint, busy boolean"
SEEN = "url string, seq bigint"
SPOOL = "authority string, seq bigint, path_query string"
HOST_IP = "host string, ip string, ts bigint"
COOKIE = "struct<name: string, value: string, domain: string, path: string>"
