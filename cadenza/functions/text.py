"""String, path and key functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a title and the difficulty they tell, in order.
DIFFICULTY = {
    "beginner": "easy", "easy": "easy", "elementary": "easy", "intermediate": "intermediate",
    "advanced": "advanced", "expert": "expert", "hard": "advanced", "difficult": "advanced",
}
#: What is cut from titles, in order, as written and in lower case.
TITLE_NOISE = (
    " EASY Piano", " HARD Piano", " (Piano Cover)", " Piano Cover", " Piano Tutorial", " Easy Piano", " Piano", " Tutorial", " (Cover)",
    " Cover", " (Easy)", " (Hard)", " (Advanced)", " (Expert)", " - Easy", " - Hard", " - Advanced", " - Expert",
)


def stripped(s: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def parsed_title(raw: Column) -> Column:
    """struct<artist, title, difficulty, genre> of a video's title.

    What follows the first bar is dropped; then "artist - title", "title by artist" or "artist: title", in that order.
    Difficulty is empty if no word tells it.
    """
    t = F.replace(raw, F.lit("｜"), F.lit("|"))
    t = F.when(F.contains(t, F.lit("|")), stripped(F.substring_index(t, "|", 1))).otherwise(t)

    def after(s: Column, mark: str) -> Column:
        return stripped(F.substring(s, F.instr(s, mark) + len(mark), F.length(s)))

    def before(s: Column, mark: str) -> Column:
        return stripped(F.substring_index(s, mark, 1))

    has = lambda mark: F.contains(t, F.lit(mark))
    artist = F.when(has(" - "), before(t, " - ")).when(has(" by "), after(t, " by ")).when(has(": "), before(t, ": ")).otherwise("")
    title = F.when(has(" - "), after(t, " - ")).when(has(" by "), before(t, " by ")).when(has(": "), after(t, ": ")).otherwise(t)
    hard = F.lit("")
    for word, level in reversed(DIFFICULTY.items()):
        hard = F.when(F.contains(F.lower(title), F.lit(word)), level).otherwise(hard)
    for noise in TITLE_NOISE:
        title = stripped(F.replace(F.replace(title, F.lit(noise), F.lit("")), F.lit(noise.lower()), F.lit("")))
    return F.struct(artist.alias("artist"), title.alias("title"), hard.alias("difficulty"), F.lit("Piano").alias("genre"))


def source_key(channel: Column, path: Column) -> Column:
    """Key of what is stored per source: its channel's, else one made of its path. Empty channels count as none."""
    return F.coalesce(F.concat(F.lit("channel-"), F.nullif(channel, F.lit(""))), F.concat(F.lit("path-"), F.left(F.sha1(path), F.lit(16))))


def file_name_of(key: Column) -> Column:
    """A key as a file name: anything but letters, digits, '-', '_' and '.' becomes '_'."""
    return F.regexp_replace(key, r"[^\p{L}\p{N}\-_.]", "_")


def without_suffix(path: Column) -> Column:
    """/a/b/piece of /a/b/piece.fingering.json, .json or .mid."""
    return F.regexp_replace(path, r"(\.fingering\.json|\.json|\.mid)$", "")


def without_extension(path: Column) -> Column:
    """/a/b.c/piece of /a/b.c/piece.mid; names that only begin with dots have no extension."""
    return F.regexp_replace(path, r"(?s)^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", "$1")


def without_json(path: Column) -> Column:
    """A path without .fingering.json or .json, else without its extension."""
    bare = F.regexp_replace(path, r"(\.fingering)?\.json$", "")
    return F.when(F.endswith(path, F.lit(".json")), bare).otherwise(without_extension(path))


def folder_of(path: Column) -> Column:
    """A path up to its last slash, that slash included; empty if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def output_path(midi: Column) -> Column:
    """Where a song's result goes if nothing else is told: beside its MIDI file."""
    return F.concat(without_extension(midi), F.lit(".fingering.json"))


def video_output_path(video: Column, folder: Column) -> Column:
    """Where the result of a video goes: into ``folder``, by the video's name."""
    return F.concat(F.regexp_replace(folder, "/*$", "/"), name_of(output_path(video)))


def bundle_path(output: Column, suffix: str) -> Column:
    """The bundle beside a result."""
    return F.concat(F.regexp_replace(output, r"(\.fingering)?\.json$", ""), F.lit(suffix))


def truth_path(output: Column) -> Column:
    """The file of true fingers beside a result."""
    return F.concat(folder_of(output), F.regexp_replace(name_of(output), r"(\.fingering)?\.json$", ""), F.lit(".truth.json"))


def watch_url(url: Column) -> Column:
    """A video's address without list and time parameters; other addresses as they are."""
    long, short = F.contains(url, F.lit("youtube.com")), F.contains(url, F.lit("youtu.be"))
    u = F.when(long, F.substring_index(url, "&", 1)).otherwise(url)
    return F.when(short & F.contains(u, F.lit("?")), F.substring_index(u, "?", 1)).when(short, F.substring_index(u, "&", 1)).otherwise(u)


def unbraced(path: Column) -> Column:
    """A dropped path without the braces around it."""
    return F.regexp_replace(stripped(path), r"^\{(.*)\}$", "$1")


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100.0)


def utc_stamp(at: Column) -> Column:
    """A moment as text, in UTC to the second: 2024-01-31T09:05:00Z."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
