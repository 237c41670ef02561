"""Schemas and fixed values of the log model.

A log table has a row for each record. Recency is (segment_id, pos), the larger the newer: neither
times nor sequence numbers order versions. Keys and values are strings or binary; both compare by
unsigned bytes.
"""

from __future__ import annotations

LOG_COLUMNS = ("segment_id", "pos", "next_pos", "version", "rtype", "ts_ns", "expires_ns", "seq", "key", "value", "crc", "batch_pos")
LOG_SCHEMA = "segment_id bigint, pos bigint, next_pos bigint, version int, rtype int, ts_ns bigint, expires_ns bigint, seq bigint, key binary, value binary, crc bigint, batch_pos bigint"
CATALOG_SCHEMA = "segment_id bigint, bytes bigint, n_records bigint, n_keys bigint, max_seq bigint, dropped boolean, frozen boolean, min_key binary, max_key binary, path string"

NORMAL, DELETED, MARKER = 0, 1, 2
LIVE, GONE, EXPIRED, NOT_FOUND = "LIVE", "DELETED", "EXPIRED", "NOT_FOUND"

#: Fixed values of the format: header bytes by version byte (0 and 1 are the oldest layout, whose version byte is the type).
HEADER_BYTES = {0: 13, 1: 13, 2: 22, 3: 30, 4: 30, 5: 38}
#: Defaults of a store.
SEGMENT_BYTES = 4 << 20
MERGE_TRIGGER = 2
BLOOM_LEAST_KEYS = 4096
FEED_BYTES = 1 << 20
WRITER_QUEUE = 1024
