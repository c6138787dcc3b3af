"""Where files should lie: rendered targets, collisions numbered, tidy files left alone."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.session import cut
from ..functions.media import unsafe_replaced

#: Path templates (fixed values).
TEMPLATES = {"album": "{albumartist}/{year} - {album}/{track:02d} - {title}", "compilation": "Compilations/{year} - {album}/{track:02d} - {artist} - {title}", "single": "{albumartist}/Singles/{title}"}
MOST_NUMBERS = 100


def fields() -> dict[str, Column]:
    text = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) if isinstance(x, str) else x for x in c])
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    return {
        "artist": unsafe_replaced(text("artist", "albumartist", F.lit("Unknown Artist"))), "albumartist": unsafe_replaced(text("albumartist", "artist", F.lit("Unknown Artist"))),
        "album": unsafe_replaced(text("album", F.lit("Unknown Album"))), "title": unsafe_replaced(F.coalesce(F.nullif("title", F.lit("")), stem)), "year": F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("0000")),
        "genre": unsafe_replaced(text("genre", F.lit("Unknown"))), "track": F.coalesce("track_no", F.lit(0)), "disc": F.coalesce(F.nullif("disc_no", F.lit(0)), F.lit(1)), "codec": text("codec", F.lit("unknown")), "ext": F.regexp_replace("ext", r"^\.+", ""),
    }


def rendered(template: str) -> Column:
    """A template as one concat expression, each component made safe; an unknown field reads Unknown."""
    known = fields()
    parts = []
    for component in template.split("/"):
        pieces = []
        for literal, name, width in re.findall(r"([^{]*)(?:\{(\w+)(?::0(\d+)d)?\})?", component):
            if literal:
                pieces.append(F.lit(literal))
            if name:
                c = known.get(name, F.lit("Unknown")).cast("string")
                pieces.append(F.when(F.length(c) < int(width), F.lpad(c, int(width), "0")).otherwise(c) if width else c)
        parts.append(unsafe_replaced(F.concat(*pieces)))
    return F.concat_ws("/", *parts)


def targets(tracks: DataFrame, root: str = "") -> DataFrame:
    """(id, path, target): where each track should lie; the template follows from its album."""
    various = F.lower(F.trim(F.coalesce("albumartist", F.lit("")))).isin("various artists", "various", "va")
    where = F.when(F.coalesce("album", F.lit("")) == "", rendered(TEMPLATES["single"])).when(various, rendered(TEMPLATES["compilation"])).otherwise(rendered(TEMPLATES["album"]))
    ext = F.concat(F.lit("."), F.regexp_replace("ext", r"^\.+", ""))
    name = F.when(F.endswith(F.lower(where), F.lower(ext)), where).otherwise(F.concat(where, ext))
    return tracks.select("id", "path", F.concat(F.lit(root), name).alias("target"))


def numbered(plan: DataFrame, occupied: DataFrame | None = None) -> DataFrame:
    """(id, path, target, changed): targets unique without regard to case, later ids taking ' (2)', ' (3)', ...

    A target wanted by several tracks, or where another track's file or one of `occupied` (path; other files
    on the disk) lies, is settled by claims in order of id
    among the names that differ in a number at most, because a made-up name may be another's real one; all
    other targets skip that step. A file that already lies on its target keeps it. A track that finds none of
    its MOST_NUMBERS - 1 names free stays where it is, unchanged. So do all but the first MOST_NUMBERS - 1
    that want one target (the first ones hold its names, or none was free but where the track itself lies),
    hence they need no claim and a hot target's group is bounded.
    """
    base = lambda c: F.lower(F.regexp_replace(c, r"( \(\d+\))+(?=\.[^./]*$)", ""))
    p = cut(plan.withColumn("base", base("target")))  # rendered once, used four times
    lying_ = p.select("path") if occupied is None else p.select("path").unionByName(occupied.select("path"))
    files = lying_.where("path is not null").select(base("path").alias("base"), F.lower("path").alias("file")).distinct()
    wanted = p.groupBy("base").agg(F.count("*").alias("n"))
    others = p.where(~F.lower("path").eqNullSafe(F.lower("target"))).select("base").join(files, "base", "left_semi").select("base").distinct()
    repeated = wanted.where("n > 1").select("base").unionByName(others).distinct()
    plain = p.join(repeated, "base", "left_anti").select("id", "path", "target")

    def settle(pdf: pd.DataFrame, occupied: pd.DataFrame) -> pd.DataFrame:
        taken, lying = set(), set(occupied["file"])
        out = []
        for r in pdf.sort_values("id").itertuples(index=False):
            stem, dot, ext = r.target.rpartition(".")
            own, target = r.path.lower(), r.path
            for k in range(1, MOST_NUMBERS):
                name = r.target if k == 1 else f"{stem} ({k}){dot}{ext}"
                if name.lower() not in taken and (name.lower() not in lying or name.lower() == own):
                    target = name
                    break
            taken.add(target.lower())
            out.append((r.id, r.path, target))
        return pd.DataFrame(out, columns=["id", "path", "target"])

    several = p.join(repeated, "base", "left_semi")
    # a limit per target, which Spark applies before the exchange, so a hot target is never sorted whole
    first = cut(several.withColumn("rank", F.row_number().over(W.partitionBy(F.lower("target")).orderBy("id"))).where(F.col("rank") < MOST_NUMBERS).drop("rank"))
    stay = several.join(first.select("id"), "id", "left_anti").select("id", "path", F.col("path").alias("target"))
    settled = first.groupBy("base").cogroup(files.join(repeated, "base", "left_semi").groupBy("base")).applyInPandas(settle, "id bigint, path string, target string")
    return plain.unionByName(settled).unionByName(stay).withColumn("changed", F.lower("target") != F.lower("path"))
