"""Declared schemas of the engine's tables."""

from __future__ import annotations

FRAMES = "video_id bigint, frame_idx bigint, mag double, ts timestamp"
VIDEOS = "video_id bigint, total_frames bigint, fps double, width int, height int, duration double"
DETECTIONS = "video_id bigint, frame_idx bigint, face_id int, confidence double, bbox array<double>, landmarks array<double>"
VALID_FRAMES = "video_id bigint, score double, frame_idx bigint"
CACHE = "signature string, file_path string, valid_frames map<string,array<bigint>>, cached_at double"
CACHE_FILE = "cache map<string,struct<file_path:string,valid_frames:map<string,array<bigint>>,cached_at:double>>"
SEGMENTS = "video_id bigint, start_time double, end_time double, key_frame_idx bigint, key_frame_time double"
STATUS = "path string, status string, error string"
REQUEST = "input_path string, output_path string, resolution string"
POSE_CSV = "path string, x_min double, y_min double, x_max double, y_max double, yaw double, pitch double, roll double"
FFPROBE = "format struct<duration:string>, streams array<struct<codec_type:string,r_frame_rate:string>>"
