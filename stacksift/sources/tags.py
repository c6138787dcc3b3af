"""Tags of media files, read from maps of their frames: one table of keys for each kind of container."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import leading_int, pair_of, year_in

FIELDS = ("title", "artist", "albumartist", "album", "date", "genre", "composer", "isrc", "comment", "lyrics", "mb_recording_id", "mb_release_id", "mb_artist_id", "acoustid", "apple_id")
#: Keys of the text fields by kind, in order of preference (fixed values).
ID3 = {"title": ("TIT2",), "artist": ("TPE1",), "albumartist": ("TPE2",), "album": ("TALB",), "date": ("TDRC", "TYER", "TDAT"), "genre": ("TCON",), "composer": ("TCOM",), "isrc": ("TSRC",), "comment": ("COMM",), "lyrics": ("USLT",), "mb_recording_id": ("TXXX:MusicBrainz Release Track Id", "TXXX:MusicBrainz Track Id"), "mb_release_id": ("TXXX:MusicBrainz Album Id",), "mb_artist_id": ("TXXX:MusicBrainz Artist Id",), "acoustid": ("TXXX:Acoustid Id",)}
VORBIS = {"title": ("title",), "artist": ("artist",), "albumartist": ("albumartist", "album artist"), "album": ("album",), "date": ("date", "year", "originaldate"), "genre": ("genre",), "composer": ("composer",), "isrc": ("isrc",), "comment": ("comment", "description"), "lyrics": ("lyrics", "unsyncedlyrics"), "mb_recording_id": ("musicbrainz_trackid", "musicbrainz_recordingid"), "mb_release_id": ("musicbrainz_albumid",), "mb_artist_id": ("musicbrainz_artistid",), "acoustid": ("acoustid_id",)}
MP4 = {"title": ("\xa9nam",), "artist": ("\xa9ART",), "albumartist": ("aART",), "album": ("\xa9alb",), "date": ("\xa9day",), "genre": ("\xa9gen",), "composer": ("\xa9wrt",), "isrc": ("----:com.apple.iTunes:ISRC",), "comment": ("\xa9cmt",), "lyrics": ("\xa9lyr",), "mb_recording_id": ("----:com.apple.iTunes:MusicBrainz Track Id",), "mb_release_id": ("----:com.apple.iTunes:MusicBrainz Album Id",), "mb_artist_id": ("----:com.apple.iTunes:MusicBrainz Artist Id",), "acoustid": ("----:com.apple.iTunes:Acoustid Id",), "apple_id": ("cnID",)}
ASF = {"title": ("Title",), "artist": ("Author",), "albumartist": ("WM/AlbumArtist",), "album": ("WM/AlbumTitle",), "date": ("WM/Year",), "genre": ("WM/Genre",), "composer": ("WM/Composer",), "isrc": ("WM/ISRC",), "comment": ("Description",), "lyrics": ("WM/Lyrics",)}
GENERIC = {"title": ("title",), "artist": ("artist",), "albumartist": ("albumartist",), "album": ("album",), "date": ("date", "year"), "genre": ("genre",)}
KINDS = {"id3": ID3, "vorbis": VORBIS, "mp4": MP4, "asf": ASF, "generic": GENERIC}
#: Keys of track and disc numbers by kind: those that may hold 'number/total', and those of the totals (fixed values).
NUMBERS = {"id3": (("TRCK",), (), ("TPOS",), ()), "vorbis": (("tracknumber",), ("tracktotal", "totaltracks"), ("discnumber",), ("disctotal", "totaldiscs")), "mp4": (("trkn",), (), ("disk",), ()), "asf": (("WM/TrackNumber",), (), ("WM/PartOfSet",), ()), "generic": (("tracknumber", "track"), (), (), ())}
#: Keys and values that mark a compilation by kind (fixed values).
COMPILATION = {"id3": ("TCMP", ("1",)), "vorbis": ("compilation", ("1", "true", "yes")), "mp4": ("cpil", ("True", "1"))}
PAIRED = ("id3", "mp4")


def _first(tags: Column, keys: tuple[str, ...]) -> Column:
    """The first value of the first of the keys that is there; keys are compared without regard to case."""
    entries = F.map_entries(tags)
    found = [F.get(F.get(_entries(entries, k), 0)["value"], 0) for k in keys]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _entries(entries: Column, key: str) -> Column:
    return F.filter(entries, lambda e: F.lower(e["key"]) == key.lower())


def read(kind: Column, tags: Column) -> Column:
    """Struct of FIELDS, year, track_no, total_tracks, disc_no, total_discs, compilation of `tags` (MAP<STRING, ARRAY<STRING>>) of a file of `kind`.

    Unknown kinds are read like generic ones; a missing map or key gives null, of several values the first counts.
    """

    def by_kind(of) -> Column:
        out = F.when(kind == "id3", of("id3"))
        for k in ("vorbis", "mp4", "asf"):
            out = out.when(kind == k, of(k))
        return out.otherwise(of("generic"))

    text = {f: by_kind(lambda k, f=f: _first(tags, KINDS[k].get(f, ()))) for f in FIELDS}

    def number(k: str, place: int) -> Column:
        own, total = NUMBERS[k][place], NUMBERS[k][place + 1]
        p = pair_of(_first(tags, own))
        if k in PAIRED:
            return F.struct(p["number"].alias("number"), p["total"].alias("total"))
        return F.struct(leading_int(_first(tags, own)).alias("number"), leading_int(_first(tags, total)).alias("total"))

    track, disc = by_kind(lambda k: number(k, 0)), by_kind(lambda k: number(k, 2))
    marked = by_kind(lambda k: F.coalesce(F.trim(_first(tags, (COMPILATION[k][0],))).isin(*COMPILATION[k][1]), F.lit(False)) if k in COMPILATION else F.lit(False))
    return F.struct(*[text[f].alias(f) for f in FIELDS], year_in(text["date"]).alias("year"), track["number"].alias("track_no"), track["total"].alias("total_tracks"), disc["number"].alias("disc_no"), disc["total"].alias("total_discs"), marked.alias("compilation"))
