"""Settings of the library: dataclasses with defaults, a typed merge of YAML, and one check of all ranges."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

LOG = logging.getLogger(__name__)


@dataclass
class Scan:
    max_image_pixels: int = 67_108_864
    min_texture_dim: int = 4


@dataclass
class Upscale:
    target_resolution: int = 2048
    hero_resolution: int = 4096
    enforce_power_of_two: bool = True
    tile_size: int = 512
    tile_pad: int = 32


@dataclass
class Material:
    delight_strength: float = 1.0
    delight_method: str = "multifrequency"
    shadow_lift: float = 0.12
    highlight_suppress: float = 0.25
    low_frequency_sigma: float = 48.0
    mid_frequency_sigma: float = 12.0
    zone_blur_radius: int = 5
    ao_radius: int = 8
    ao_strength: float = 1.0
    metalness_threshold: float = 0.5


@dataclass
class Mipmap:
    roughness_increase: float = 0.04
    min_resident: int = 3
    filter_method: str = "lanczos"
    sharpen_strength: float = 0.3
    sharpen_radius: int = 1


@dataclass
class Validation:
    max_allowed_diff: float = 0.15
    albedo_min: float = 0.02
    albedo_max: float = 0.90
    black_ratio_max: float = 0.02
    white_ratio_max: float = 0.02
    normal_tolerance: float = 0.02
    warn_score: float = 0.75
    fail_score: float = 0.55
    flag_top: int = 20
    roughness_min_stddev: float = 0.01
    ao_min_stddev: float = 0.005
    metalness_nonmetal_max_mean: float = 0.25
    metalness_metal_min_mean: float = 0.55
    metalness_midband_max_ratio: float = 0.25
    strict_material_semantics: bool = True
    warn_on_heuristic_maps: bool = True
    fail_on_heuristic_maps: bool = False
    regression_threshold: float = 0.15
    require_full_mipchain: bool = True


@dataclass
class Normal:
    method: str = "hybrid"
    strength: float = 1.0
    nz_scale: float = 2.0
    sobel_weight: float = 0.6
    height_contrast: float = 1.5


@dataclass
class Parallax:
    min_samples: int = 8
    max_samples: int = 32
    bilateral_filter_d: int = 5
    bilateral_sigma_color: float = 0.3
    bilateral_sigma_space: float = 10.0
    depth_detail_multiplier: float = 1.3


@dataclass
class Roughness:
    base_value: float = 0.5
    variance_weight: float = 0.5
    sobel_weight: float = 0.3
    laplacian_weight: float = 0.2


@dataclass
class Grading:
    white_balance_shift: float = 0.0
    exposure_ev: float = 0.0
    midtone_gamma: float = 1.0
    saturation: float = 1.0
    lut_strength: float = 0.0
    denoise_strength: float = 0.0
    sharpen_strength: float = 0.0
    sharpen_radius: int = 1
    plausible_albedo_min: float = 0.02
    plausible_albedo_max: float = 0.90


@dataclass
class Emissive:
    luminance_threshold: float = 0.80
    saturation_threshold: float = 0.50
    value_threshold: float = 0.90
    min_region_ratio: float = 0.0005
    boost: float = 1.0


@dataclass
class Reflection:
    metalness_weight: float = 0.65
    gloss_weight: float = 0.35


@dataclass
class SeamRepair:
    repair_border_width: int = 12
    detect_threshold: float = 0.08
    blend_strength: float = 0.85
    inpaint_radius: int = 2


@dataclass
class SpecularAA:
    kernel_size: int = 3
    max_roughness_increase: float = 0.15


@dataclass
class Packing:
    preset: str = "unreal_orm"
    r_channel: str = "ao"
    g_channel: str = "roughness"
    b_channel: str = "metalness"
    alpha_channel: str = "none"
    output_suffix: str = "_orm"
    gloss_source: str = "roughness"


@dataclass
class Compression:
    quality: float = 0.85
    tool: str = "compressonator"
    tool_timeout_seconds: int = 60


@dataclass
class Run:
    failure_abort_ratio: float = 0.5
    failure_abort_min: int = 10


@dataclass
class Settings:
    version: int = 1
    scan: Scan = field(default_factory=Scan)
    upscale: Upscale = field(default_factory=Upscale)
    material: Material = field(default_factory=Material)
    mipmap: Mipmap = field(default_factory=Mipmap)
    validation: Validation = field(default_factory=Validation)
    normal: Normal = field(default_factory=Normal)
    parallax: Parallax = field(default_factory=Parallax)
    roughness: Roughness = field(default_factory=Roughness)
    grading: Grading = field(default_factory=Grading)
    emissive: Emissive = field(default_factory=Emissive)
    reflection: Reflection = field(default_factory=Reflection)
    seam_repair: SeamRepair = field(default_factory=SeamRepair)
    specular_aa: SpecularAA = field(default_factory=SpecularAA)
    packing: Packing = field(default_factory=Packing)
    compression: Compression = field(default_factory=Compression)
    run: Run = field(default_factory=Run)


#: Where a setting lies, its least and greatest value.
RANGES = {
    "scan.max_image_pixels": (0, None), "scan.min_texture_dim": (1, None), "upscale.target_resolution": (1, 65536), "upscale.hero_resolution": (1, 65536), "material.delight_strength": (0, 1),
    "material.low_frequency_sigma": (0, None), "material.mid_frequency_sigma": (0, None), "material.zone_blur_radius": (0, None), "material.ao_radius": (1, None), "material.ao_strength": (0, 2),
    "material.metalness_threshold": (0, 1), "mipmap.roughness_increase": (0, None), "mipmap.min_resident": (1, None), "validation.max_allowed_diff": (0, None), "validation.albedo_min": (0, 1),
    "validation.albedo_max": (0, 1), "validation.black_ratio_max": (0, 1), "validation.white_ratio_max": (0, 1), "validation.normal_tolerance": (0, 1), "validation.warn_score": (0, 1),
    "validation.fail_score": (0, 1), "validation.flag_top": (0, None), "run.failure_abort_ratio": (0, 1), "run.failure_abort_min": (1, None), "version": (1, 1),
    "upscale.tile_size": (64, None), "upscale.tile_pad": (0, None), "material.shadow_lift": (0, 1), "material.highlight_suppress": (0, 1),
    "validation.roughness_min_stddev": (0, 1), "validation.ao_min_stddev": (0, 1), "validation.metalness_nonmetal_max_mean": (0, 1), "validation.metalness_metal_min_mean": (0, 1), "validation.metalness_midband_max_ratio": (0, 1),
    "normal.strength": (0, 100), "normal.nz_scale": (0, None), "normal.sobel_weight": (0, 1), "normal.height_contrast": (0, None),
    "parallax.min_samples": (1, None), "parallax.bilateral_filter_d": (0, None), "parallax.bilateral_sigma_color": (0, 1), "parallax.bilateral_sigma_space": (0, 100), "parallax.depth_detail_multiplier": (0, None),
    "roughness.base_value": (0, 1), "roughness.variance_weight": (0, None), "roughness.sobel_weight": (0, None), "roughness.laplacian_weight": (0, None),
    "grading.white_balance_shift": (-1, 1), "grading.exposure_ev": (-5, 5), "grading.midtone_gamma": (0, None), "grading.saturation": (0, None), "grading.lut_strength": (0, 1), "grading.denoise_strength": (0, None),
    "grading.sharpen_strength": (0, None), "grading.sharpen_radius": (0, None), "grading.plausible_albedo_min": (0, 1), "grading.plausible_albedo_max": (0, 1),
    "emissive.luminance_threshold": (0, 1), "emissive.saturation_threshold": (0, 1), "emissive.value_threshold": (0, 1), "emissive.min_region_ratio": (0, 1), "emissive.boost": (0, None),
    "reflection.metalness_weight": (0, None), "reflection.gloss_weight": (0, None), "seam_repair.repair_border_width": (1, None), "seam_repair.detect_threshold": (0, None), "seam_repair.blend_strength": (0, 1),
    "seam_repair.inpaint_radius": (0, None), "specular_aa.kernel_size": (1, None), "specular_aa.max_roughness_increase": (0, None), "mipmap.sharpen_strength": (0, None), "mipmap.sharpen_radius": (0, None),
    "compression.quality": (0, 1), "compression.tool_timeout_seconds": (1, None),
}
#: Settings whose least value is itself refused.
ABOVE = (
    "material.low_frequency_sigma", "material.mid_frequency_sigma", "validation.max_allowed_diff", "validation.normal_tolerance", "normal.strength", "normal.nz_scale", "normal.height_contrast",
    "parallax.bilateral_sigma_space", "grading.midtone_gamma", "seam_repair.detect_threshold", "compression.quality", "run.failure_abort_ratio",
)
# The names that a setting may take.
CHANNELS = ("ao", "roughness", "metalness", "gloss", "smoothness", "one", "zero", "none")
CHOICES = {
    "material.delight_method": ("gaussian", "multifrequency"), "normal.method": ("sobel", "hybrid", "deepbump"), "mipmap.filter_method": ("lanczos", "area", "bilinear", "linear", "nearest", "box", "cubic"),
    "compression.tool": ("compressonator", "texconv"), "packing.preset": ("unreal_orm", "unity_mas", "source_phong", "idtech_rma", "custom"), "packing.gloss_source": ("roughness", "gloss"),
    "packing.r_channel": CHANNELS, "packing.g_channel": CHANNELS, "packing.b_channel": CHANNELS, "packing.alpha_channel": CHANNELS,
}


def merge(settings: object, values: dict, where: str = "") -> object:
    """Take over values of fitting type; unknown names and others are logged and left. Whole floats become ints and ints floats."""
    known = {f.name for f in fields(settings)}
    for name, value in values.items():
        path = f"{where}{name}"
        if name not in known:
            LOG.warning("unknown setting %s", path)
            continue
        now = getattr(settings, name)
        if is_dataclass(now):
            if isinstance(value, dict):
                merge(now, value, f"{path}.")
            else:
                LOG.warning("%s is a section", path)
        elif isinstance(now, bool) != isinstance(value, bool):
            LOG.warning("%s has the wrong type", path)
        elif isinstance(now, float) and isinstance(value, int):
            setattr(settings, name, float(value))
        elif isinstance(now, int) and isinstance(value, float) and value.is_integer():
            setattr(settings, name, int(value))
        elif isinstance(value, type(now)):
            setattr(settings, name, value)
        else:
            LOG.warning("%s has the wrong type", path)
    return settings


def at(settings: Settings, path: str) -> object:
    value: object = settings
    for part in path.split("."):
        value = getattr(value, part)
    return value


def clashes(s: Settings) -> dict[str, bool]:
    """Rules over several settings: what is wrong, and whether it is."""
    packed = [c for c in (s.packing.r_channel, s.packing.g_channel, s.packing.b_channel) if c not in ("zero", "one", "none")]
    return {
        "validation.albedo_min is not below albedo_max": s.validation.albedo_min >= s.validation.albedo_max,
        "validation.fail_score is above warn_score": s.validation.fail_score > s.validation.warn_score,
        "validation.metalness_metal_min_mean is below metalness_nonmetal_max_mean": s.validation.metalness_metal_min_mean < s.validation.metalness_nonmetal_max_mean,
        "upscale.hero_resolution is below target_resolution": s.upscale.hero_resolution < s.upscale.target_resolution,
        "upscale.tile_pad is not below half of tile_size": s.upscale.tile_pad >= s.upscale.tile_size // 2,
        "parallax.max_samples is below min_samples": s.parallax.max_samples < s.parallax.min_samples,
        "roughness has no weight above 0": s.roughness.variance_weight + s.roughness.sobel_weight + s.roughness.laplacian_weight <= 0,
        "grading.plausible_albedo_min is not below plausible_albedo_max": s.grading.plausible_albedo_min >= s.grading.plausible_albedo_max,
        "reflection has no weight above 0": s.reflection.metalness_weight == 0 and s.reflection.gloss_weight == 0,
        "specular_aa.kernel_size is even": s.specular_aa.kernel_size % 2 == 0,
        "packing has a map in two channels": len(set(packed)) < len(packed),
        "packing.output_suffix does not start with _": not s.packing.output_suffix.startswith("_"),
    }


def check(settings: Settings) -> None:
    """One error that names every setting out of range and every clash."""
    bad = []
    for path, (lo, hi) in RANGES.items():
        value = at(settings, path)
        if value != value or (lo is not None and value < lo) or (hi is not None and value > hi):
            bad.append(f"{path}={value} is not within {lo}..{hi}")
        elif path in ABOVE and value == lo:
            bad.append(f"{path}={value} is not above {lo}")
    bad += [f"{path}={at(settings, path)!r} is none of {', '.join(names)}" for path, names in CHOICES.items() if at(settings, path) not in names]
    bad += [what for what, wrong in clashes(settings).items() if wrong]
    if bad:
        raise ValueError("; ".join(bad))


def load(path: str) -> Settings:
    import yaml

    settings = merge(Settings(), yaml.safe_load(Path(path).read_text()) or {})
    check(settings)
    return settings


def save(settings: Settings, path: str) -> None:
    from dataclasses import asdict

    import yaml

    Path(path).write_text(yaml.safe_dump(asdict(settings), sort_keys=False))
