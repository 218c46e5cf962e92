"""Row types of the engine's tables, fixed by hand: nothing is inferred from values."""

from __future__ import annotations


FRAMES = "traj_id BIGINT, joint INT, frame BIGINT, x DOUBLE"
PACKET = "path STRING, content BINARY"
HEADER = "wire_version INT, frames BIGINT, joints INT, keep INT, crc BIGINT, payload_bytes BIGINT, error STRING"
RECORD = "index BIGINT, topic STRING, timestamp_ns BIGINT, robot STRING, joint_names ARRAY<STRING>, quality DOUBLE, encoding STRING, blob BINARY"
BAG_ROWS = "path STRING, index BIGINT, topic STRING, timestamp_ns BIGINT, robot STRING, joint_names ARRAY<STRING>, quality DOUBLE, encoding STRING, blob BINARY, error STRING"
EPISODE = "path STRING, structure STRING, joint_positions ARRAY<ARRAY<FLOAT>>, timestamps ARRAY<DOUBLE>, episode_metadata MAP<STRING, STRING>, error STRING"
QUALIFICATION = (
    "repo_id STRING, path STRING, parquet_count BIGINT, selected_field STRING, joint_count INT, fps DOUBLE, total_episodes BIGINT, total_frames BIGINT, is_real BOOLEAN, qualifies BOOLEAN, reason STRING"
)
BENCHMARK = (
    "tool_id STRING, raw_size_bytes BIGINT, compressed_size_bytes BIGINT, compression_ratio DOUBLE, encode_time_ms_p50 DOUBLE, encode_time_ms_p95 DOUBLE, decode_time_ms_p50 DOUBLE, decode_time_ms_p95 DOUBLE, bit_exact_replay BOOLEAN, searchable_without_decode BOOLEAN, max_abs_error DOUBLE"
)
