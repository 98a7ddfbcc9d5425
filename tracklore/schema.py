"""Explicit schemas of the canonical tables."""

from __future__ import annotations

PLAYS_DDL = (
    "play_id bigint, track_id bigint, album_id bigint, artist_id bigint, ts timestamp, "
    "duration_ms bigint, ms_played bigint, source string, country string, region string, "
    "city string, is_duplicate boolean, duplicate_of bigint"
)

STREAMING_HISTORY_DDL = (
    "ts string, platform string, ms_played bigint, conn_country string, ip_addr string, "
    "master_metadata_track_name string, master_metadata_album_artist_name string, "
    "master_metadata_album_album_name string, spotify_track_uri string, episode_name string, "
    "episode_show_name string, spotify_episode_uri string, audiobook_title string, "
    "audiobook_uri string, audiobook_chapter_uri string, audiobook_chapter_title string, "
    "reason_start string, reason_end string, shuffle boolean, skipped boolean, offline boolean, "
    "offline_timestamp bigint, incognito_mode boolean"
)

# Input shape of the encyclopedia dump, one JSON object per line.
MB_ARTIST_DDL = (
    "id string, name string, `sort-name` string, country string, type string, disambiguation string, "
    "tags array<struct<name: string, count: bigint>>"
)
_CREDIT = "array<struct<name: string, artist: struct<id: string, name: string>>>"
MB_RELEASE_GROUP_DDL = (
    "id string, title string, `primary-type` string, `first-release-date` string, "
    f"`artist-credit` {_CREDIT}, tags array<struct<name: string, count: bigint>>"
)
MB_RECORDING_DDL = (
    f"id string, title string, length bigint, `artist-credit` {_CREDIT}, "
    "releases array<struct<id: string, title: string, date: string, "
    "`release-group`: struct<id: string, title: string, `primary-type`: string>>>"
)
