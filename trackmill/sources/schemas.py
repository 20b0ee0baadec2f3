"""Explicit schemas of the match tables; reading never infers."""

from __future__ import annotations

#: Columns of each table (DDL).
TABLES = {
    "matches": "id bigint, name string, date string, team0_name string, team1_name string, pitch_length double, pitch_width double, half_length int, kickoff double, kickoff2 double",
    "clips": "id bigint, match_id bigint, filename string, order_idx int, period int, start_minute double, fps double, duration double, width int, height int, status string, gps_lat double, gps_lon double, gps_acc double, rec_start double, flip boolean, train_ok boolean",
    "frames": "clip_id bigint, idx int, t double",
    "motion": "clip_id bigint, idx int, h array<double>",
    "detections": "clip_id bigint, idx int, track_id int, x1 double, y1 double, x2 double, y2 double, conf double",
    "ball": "clip_id bigint, idx int, x double, y double, conf double, src string",
    "ball_manual": "clip_id bigint, t double, x double, y double",
    "tracks": "clip_id bigint, track_id int, n_frames int, t_start double, t_end double, color string, team int, team_auto int, jersey_guess string, jersey_conf double, player_id bigint",
    "players": "id bigint, match_id bigint, name string, number string, team int",
    "keyframes": "id bigint, clip_id bigint, t double, points array<struct<name:string,img:array<double>,pitch:array<double>>>, auto boolean, score string, accepted boolean, source string, yaw double",
    "shots": "id bigint, match_id bigint, clip_id bigint, t double, t_end double, status string, goal boolean, on_target boolean, team int, player_id bigint, x double, y double, goal_x double",
    "sounds": "clip_id bigint, kind string, t double, t_end double, score double",
    "track_embeds": "clip_id bigint, track_id int, emb array<float>",
    "player_profiles": "squad_id bigint, name string, match_player_id bigint, emb array<float>, n int",
}
