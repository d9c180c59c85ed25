"""Rules over assets and their outputs: cached paths, heuristic maps, output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.operators import containers as B

IMAGE = r"(?i)\.(png|dds|tga|ktx2|jpg|jpeg|bmp|tif|tiff|json)$"


def probable_path(text: Column) -> Column:
    """Whether a stored string looks like a file path: one line, an image's extension, a folder or a leading dot."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.rlike(IMAGE) & ~t.contains("://") & ~t.startswith("data:") & ~t.rlike(r"[\r\n]") & t.rlike(r"[/\\]")


def heuristic_issues(kind: Column, has_pbr: Column, has_normal: Column) -> Column:
    """Warnings on maps that were made from a colour map alone."""
    colour = kind.isin("diffuse", "albedo", "unknown")
    return F.filter(F.array(F.when(colour & has_pbr, F.lit("pbr_from_colour")), F.when(colour & has_normal, F.lit("normal_from_colour"))), lambda x: x.isNotNull())


def file_issues(name: Column, raw: Column) -> Column:
    """Checks of an output file by its bytes: empty, or not what its extension says; containers in full."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    case = F
    for k in B.MAGIC:
        case = case.when(ext.isin(*(("jpg", "jpeg") if k == "jpg" else (k,))), B.has_magic(raw, k))
    found = F.filter(F.array(F.when(~case.otherwise(F.lit(True)), F.lit("magic_bytes"))), lambda x: x.isNotNull())
    return F.when(F.length(raw) == 0, F.array(F.lit("non_zero_size"))).when(ext == "dds", B.dds_issues(raw)).when(ext == "ktx2", B.ktx2_issues(raw)).otherwise(found)


def issues(files: DataFrame, name: str = "file", raw: str = "content") -> DataFrame:
    """A row (file, check) for each failed check."""
    return files.select(F.col(name).alias("file"), F.explode(file_issues(F.col(name), F.col(raw))).alias("check"))
