"""Schemas of the JSON manifests and annotation files."""

from __future__ import annotations

_PERSON = "struct<bbox: array<double>, confidence: double, area: long, track_id: long>"
DETECTION_MANIFEST = (
    "video_stem string, n_frames long, frames array<struct<frame_id: long, frame_file: string, crop_file: string, detected: boolean, "
    f"bbox: array<double>, bbox_padded: array<double>, confidence: double, track_id: long, persons: array<{_PERSON}>>>")
TRACK_MANIFEST = (
    "video_stem string, n_frames long, selected_track_id long, merged_tracks array<long>, track_score double, identity_guard_rejections long, "
    "velocity_stats struct<mean_speed: double, max_speed: double, mean_vy: double>, "
    "candidate_pool_stats struct<conflict_frames: long, of_available: long, avg_margin: double>, frames array<struct<"
    "frame_id: long, frame_file: string, detected: boolean, interpolated: boolean, of_synthetic: boolean, bbox: array<double>, "
    "bbox_padded: array<double>, confidence: double, track_id: long, flow_displacement: array<double>, of_predicted: array<double>, "
    "velocity: array<double>, speed_px_per_frame: double>>")
VELOCITY_MANIFEST = (
    "video_stem string, n_frames long, summary struct<mean_speed: double, max_speed: double, n_jumps: long>, jumps array<struct<start_idx: long, end_idx: long, peak_idx: long, start_frame_id: long, "
    "end_frame_id: long, peak_frame_id: long, airtime_frames: long, peak_speed_px_per_frame: double>>, frames array<struct<frame_id: long, "
    "frame_file: string, center_x: double, center_y: double, camera_flow_dx: double, camera_flow_dy: double, athlete_vel_dx: double, "
    "athlete_vel_dy: double, compensated_vel_dx: double, compensated_vel_dy: double, speed_raw: double, speed_smoothed: double, "
    "acceleration: double, in_jump: boolean>>")
POSE_2D_MANIFEST = (
    "keypoint_names array<string>, frames array<struct<frame_id: long, frame_file: string, keypoints: array<array<double>>, bbox: array<double>>>")
POSE_3D_MANIFEST = "keypoint_names array<string>, frames array<struct<frame_id: long, keypoints_3d: array<array<double>>>>"
PROJECTION_MANIFEST = (
    "video_stem string, interp_mode string, projected_positions array<struct<frame_id: long, venue_x: double, venue_y: double>>")
TRACE_MANIFEST = "seed_idx long, forward_frames long, backward_frames long, trace array<struct<idx: long, x: double, y: double, ok: boolean>>"
FRAMES_META = (
    "source_fps double, effective_fps double, step int, target_fps double, total_source_frames long, extracted_frames long, "
    "trim_start_seconds double, trim_end_seconds double")
START_REGION = "x1 long, y1 long, x2 long, y2 long, venue_w long, venue_h long, venue_image string"

GT_CENTERS = "frame_no long, track_id long, center_x double, center_y double"
GT_JUMPS = "jump_id long, start_frame long, end_frame long, start_source_frame long, end_source_frame long"
GT_VENUE = "frame_no long, venue_x double, venue_y double"
