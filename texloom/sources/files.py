"""Files in: directory scans, manifests, checkpoints and colour tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import catalog as C
from texloom.functions import tables as T
from texloom.sources import images

MANIFEST = (
    "filepath string, filename string, texture_type string, original_width int, original_height int, channels int, has_alpha string, is_tileable string, is_hero string, material_category string, "
    "file_size_kb double, file_hash string, is_gloss string, status string"
)
PROBED = pa.schema([("filepath", pa.string()), ("original_width", pa.int32()), ("original_height", pa.int32()), ("channels", pa.int32()), ("has_alpha", pa.bool_()), ("file_size_kb", pa.float64()), ("file_hash", pa.string())])
FLAGS = ("has_alpha", "is_tileable", "is_hero", "is_gloss")


def scan(spark: SparkSession, root: str, max_pixels: int = 67_108_864, min_side: int = 4) -> DataFrame:
    """One row per readable image under a folder.

    Extension and size are tested before any content is read; names classify, pixels only say whether
    alpha matters. Files that cannot be decoded are dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace("\\", "/").split("://")[-1] + "/", "")
    files = files.where(C.extension(F.col("path")).isin(*T.INPUT_EXTENSIONS) & (F.col("length") > 0)).select(rel.alias("filepath"), "length", F.sha2("content", 256).alias("file_hash"), "content")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                path, length, digest, content = (batch.column(c)[i].as_py() for c in range(4))
                try:
                    head = images.probe(content, path)
                    if (max_pixels and head.width * head.height > max_pixels) or min(head.width, head.height) < min_side:
                        continue
                    alpha = head.mode in ("LA", "RGBA") and bool((images.decode(content, path)[..., -1] < 1).any())
                except images.BROKEN:
                    continue
                row = {"filepath": path, "original_width": head.width, "original_height": head.height, "channels": head.bands, "has_alpha": alpha, "file_size_kb": round(length / 1024, 1), "file_hash": digest}
                yield pa.RecordBatch.from_pylist([row], PROBED)

    rows = files.mapInArrow(probe, "filepath string, original_width int, original_height int, channels int, has_alpha boolean, file_size_kb double, file_hash string")
    p = F.col("filepath")
    return rows.select(
        "filepath", F.regexp_extract(p, "[^/]*$", 0).alias("filename"), C.texture_type(p).alias("texture_type"), "original_width", "original_height", "channels", "has_alpha",
        C.is_tileable(p).alias("is_tileable"), C.is_hero(p).alias("is_hero"), C.material(p).alias("material_category"), "file_size_kb", "file_hash", C.is_gloss(p).alias("is_gloss"), F.lit("pending").alias("status"),
    )


def flag(text: Column) -> Column:
    """1/true/yes/y/on and 0/false/no/n/off/blank; anything else is an error."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off", ""), False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), t)).cast("boolean"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV by header names: unknown columns are dropped, is_gloss and status may be absent, bad numbers fail."""
    raw = spark.read.option("header", "true").csv(path)
    kinds = dict(c.strip().split(" ") for c in MANIFEST.split(","))
    missing = [c for c in kinds if c not in raw.columns and c not in ("is_gloss", "status")]
    if missing:
        raise ValueError(f"manifest lacks columns: {missing}")
    out = []
    for name, kind in kinds.items():
        if name not in raw.columns:
            out.append((F.lit(False) if name == "is_gloss" else F.lit("pending")).alias(name))
        elif name in FLAGS:
            out.append(flag(F.col(name)).alias(name))
        else:
            # ANSI casts fail on text that is no number.
            out.append(F.col(name).cast(kind).alias(name))
    return raw.select(*out)


def write_manifest(assets: DataFrame, path: str) -> None:
    assets.write.mode("overwrite").option("header", "true").csv(path)


CHECKPOINT = "config_fingerprint string, last_saved string, completed map<string, struct<hash: string, phases: array<string>>>"


def write_checkpoint(done: DataFrame, path: str) -> None:
    """State rows (filepath, hash, phase, fingerprint) as documents of one asset each, a line for each; the old state is replaced.

    Files of a task appear when the write is committed, so a lost task leaves no half state.
    """
    entry = F.struct("hash", F.col("phases"))
    per = done.groupBy("fingerprint", "filepath", "hash").agg(F.array_sort(F.collect_set("phase")).alias("phases"))
    doc = F.struct(F.col("fingerprint").alias("config_fingerprint"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("last_saved"), F.create_map(F.col("filepath"), entry).alias("completed"))
    per.select(F.to_json(doc).alias("value")).write.mode("overwrite").text(path)


def read_checkpoint(spark: SparkSession, path: str, mark: str, lines: bool = False) -> DataFrame:
    """(filepath, hash, phase, fingerprint) of a checkpoint document (or of ``lines``, each one); nothing from what is malformed
    or of another configuration."""
    text = spark.read.text(path, wholetext=not lines)
    doc = text.select(F.from_json("value", CHECKPOINT).alias("d")).where(F.col("d.config_fingerprint") == F.lit(mark))
    rows = doc.select("d.config_fingerprint", F.explode("d.completed").alias("filepath", "e")).where(F.col("e.hash").isNotNull())
    return rows.select("filepath", "e.hash", F.explode("e.phases").alias("phase"), F.col("config_fingerprint").alias("fingerprint"))


def parse_cube(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A .cube table indexed [blue, green, red], and its domain."""
    n, lo, hi, rows = 0, [0.0] * 3, [1.0] * 3, []
    for line in text.splitlines():
        part = line.split("#")[0].split()
        if not part or part[0] == "TITLE":
            continue
        if part[0] == "LUT_3D_SIZE":
            n = int(part[1])
        elif part[0] == "DOMAIN_MIN":
            lo = [float(x) for x in part[1:4]]
        elif part[0] == "DOMAIN_MAX":
            hi = [float(x) for x in part[1:4]]
        elif len(part) == 3:
            rows.append([float(x) for x in part])
    if n < 2 or len(rows) != n**3:
        raise ValueError(f"expected {n}^3 rows, found {len(rows)}")
    return np.array(rows).reshape(n, n, n, 3), np.array(lo), np.array(hi)
