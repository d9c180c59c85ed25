"""Column functions on asset paths, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from texloom.functions import tables as T


def stem(path: Column) -> Column:
    """The last part of a path without its extension, in lower case."""
    return F.lower(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+?)(\.[^./]*)?$", 1))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1))


def texture_type(path: Column) -> Column:
    """The type of the longest suffix that the stem ends with; ties to the earlier type; else unknown."""
    pairs = [(s, t) for t, suffixes in T.TYPE_SUFFIXES.items() for s in suffixes]
    name, case = stem(path), F
    for suffix, kind in sorted(pairs, key=lambda p: -len(p[0])):
        case = case.when(F.endswith(name, F.lit(suffix)), F.lit(kind))
    return case.otherwise(F.lit("unknown"))


def is_gloss(path: Column) -> Column:
    return F.endswith(stem(path), F.lit(T.GLOSS_SUFFIXES[0])) | F.endswith(stem(path), F.lit(T.GLOSS_SUFFIXES[1]))


def _word(path: Column, words: str) -> Column:
    return F.lower(path).rlike(f"(?<![a-z])({words})(?![a-z])")


def material(path: Column) -> Column:
    """The first material of the list that stands as a word of its own, letters on neither side; else default."""
    case = F
    for m in T.MATERIALS:
        case = case.when(_word(path, m), F.lit(m))
    return case.otherwise(F.lit("default"))


def is_tileable(path: Column) -> Column:
    return _word(path, "|".join(T.TILEABLE_WORDS))


def is_hero(path: Column) -> Column:
    return _word(path, "|".join(T.HERO_WORDS))


def normal_path(path: Column) -> Column:
    """A relative path with forward slashes, without empty or '.' parts and with '..' folded.

    Null for absolute, drive and UNC paths, for paths that leave the root, and for empty ones.
    """
    raw = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        up, n = part == "..", F.size(acc["parts"])
        parts = F.when(up, F.slice(acc["parts"], 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(acc["parts"], F.array(part)))
        return F.struct(parts.alias("parts"), (acc["ok"] & ~(up & (n == 0))).alias("ok"))

    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(parts, start, step)
    joined = F.aggregate(parts, start, step, lambda a: F.when(a["ok"] & (F.size(a["parts"]) > 0), F.array_join(a["parts"], "/")))
    return F.when(folded.isNotNull() & ~raw.startswith("/") & (F.substring(raw, 2, 1) != ":"), joined)


def output_path(path: Column, root: str, suffix: Column, ext: Column | None = None) -> Column:
    """Path of a derived map of a normal path: root, folders, stem plus suffix, extension."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    own = F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)
    return F.concat(F.lit(root.rstrip("/") + "/"), folder, name, suffix, F.coalesce(ext, own) if ext is not None else own)


def map_suffix(text: Column) -> Column:
    """'base' and blanks name the base map; others get one leading underscore, in lower case."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("", "base", "_base"), F.lit("")).when(F.startswith(t, F.lit("_")), t).otherwise(F.concat(F.lit("_"), t))


def safe_tag(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z]", "_"), "^_+|_+$", "")


def human_bytes(n: Column, largest: str = "TiB") -> Column:
    """B whole, larger units with two decimals, up to ``largest`` (KiB to TiB); negative: n/a."""
    units = ("KiB", "MiB", "GiB", "TiB")
    units = units[: units.index(largest) + 1]
    case = F.when(n < 0, F.lit("n/a")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        value = F.concat(F.format_string("%.2f", F.bround(n / float(1 << 10 * k), 2)), F.lit(f" {unit}"))
        case = case.when(n < 1 << 10 * (k + 1), value) if unit != largest else case.otherwise(value)
    return case


def size_change(before: Column, after: Column, largest: str = "TiB") -> Column:
    """Sizes in units up to ``largest``, the difference and its share; n/a if either is unknown (negative)."""
    delta = after - before
    text = F.concat(F.when(delta >= 0, "+").otherwise("-"), human_bytes(F.abs(delta), largest))
    sizes = F.concat(F.lit("size="), human_bytes(before, largest), F.lit("->"), human_bytes(after, largest))
    percent = F.when(before > 0, F.concat(F.lit(", "), F.format_string("%+.1f", F.bround(delta / before * 100.0, 1)), F.lit("%"))).otherwise("")
    return F.when((before < 0) | (after < 0), F.lit("size=n/a")).otherwise(F.concat(sizes, F.lit(" ("), text, percent, F.lit(")")))


def floor_log2(n: Column) -> Column:
    """Exact for positive whole numbers."""
    return (F.length(F.bin(n.cast("long"))) - 1).cast("int")


def nearest_power(n: Column) -> Column:
    """Nearest power of two, ties up."""
    low = F.call_function("shiftleft", F.lit(1), floor_log2(n))
    return F.when(n <= 1, F.lit(1)).otherwise(F.when(n - low < 2 * low - n, low).otherwise(2 * low))


def is_power(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def target_size(h: Column, w: Column, resolution: int, powers: bool = False) -> Column:
    """struct(h, w): the longer side meets the resolution, the ratio is kept (half-even); or both are powers of two."""
    most = F.greatest(h, w)
    keep = lambda x: F.greatest(F.bround(x * (F.lit(float(resolution)) / most), 0).cast("int"), F.lit(1))
    if not powers:
        out = F.struct(keep(h).alias("h"), keep(w).alias("w"))
        return F.when(most <= 0, F.struct(F.lit(resolution).alias("h"), F.lit(resolution).alias("w"))).otherwise(out)
    major = 1 << max(0, resolution.bit_length() - 1)
    major = major if resolution - major < 2 * major - resolution else 2 * major
    ratio = most / F.greatest(F.least(h, w), F.lit(1))
    ideal = F.greatest(F.bround(F.least(h, w) * F.lit(float(major)) / most, 0).cast("int"), F.lit(1))
    low = F.call_function("shiftleft", F.lit(1), floor_log2(ideal))
    off = lambda x: F.abs(F.lit(float(major)) / x - ratio)
    minor = F.when(ideal <= 1, F.lit(1)).otherwise(F.when(off(low) <= off(2 * low), low).otherwise(2 * low))
    tall = h >= w
    return F.struct(F.when(tall, F.lit(major)).otherwise(minor).alias("h"), F.when(tall, minor).otherwise(F.lit(major)).alias("w"))


def mip_levels(h: Column, w: Column, min_resident: int = 3) -> Column:
    """array of struct(level, width, height), until both sides are below 2^min_resident."""
    least = 1 << min_resident
    every = F.transform(F.sequence(F.lit(0), floor_log2(F.greatest(h, w))), lambda k: F.struct(k.alias("level"), F.greatest(F.call_function("shiftright", w, k), F.lit(1)).alias("width"), F.greatest(F.call_function("shiftright", h, k), F.lit(1)).alias("height")))
    return F.filter(every, lambda m: (m["width"] >= least) | (m["height"] >= least))


def linear_size(w: Column, h: Column, block: Column) -> Column:
    """Bytes of one level of a block-compressed texture."""
    blocks = lambda x: F.greatest(F.floor((x + 3) / 4), F.lit(1))
    return (blocks(w) * blocks(h) * block).cast("long")


def lookup(key: Column, table: dict, default: str | None = None) -> Column:
    """A small fixed table as one CASE; the value of ``default`` for other keys, or null."""
    case = F
    for k, v in table.items():
        case = case.when(key == F.lit(k), F.lit(v))
    return case.otherwise(F.lit(table[default]) if default is not None else F.lit(None))


def codec(kind: Column, has_alpha: Column) -> Column:
    """Block codec of a base map; colour types with alpha take bc3."""
    return F.when(has_alpha & kind.isin(*T.SRGB_TYPES), F.lit("bc3")).otherwise(lookup(kind, T.CODECS, "unknown"))
