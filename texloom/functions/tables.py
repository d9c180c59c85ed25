"""Fixed values that results depend on: word lists, codes, defaults, in natural order."""

TEXTURE_TYPES = ("diffuse", "albedo", "normal", "height", "roughness", "metalness", "ao", "specular", "emissive", "opacity", "mask", "ui", "orm", "unknown")
TYPE_SUFFIXES = {
    "diffuse": ("_diff", "_diffuse", "_color", "_col", "_c", "_d", "_basecolor", "_base", "_bc"),
    "albedo": ("_albedo", "_alb"),
    "normal": ("_norm", "_normal", "_nrm", "_n"),
    "height": ("_height", "_h", "_disp", "_displacement", "_parallax", "_bump"),
    "roughness": ("_rough", "_roughness", "_r", "_gloss", "_glossiness"),
    "metalness": ("_metal", "_metalness", "_metallic", "_met"),
    "ao": ("_ao", "_ambient", "_occlusion", "_ambientocclusion"),
    "specular": ("_spec", "_specular"),
    "emissive": ("_emissive", "_emit", "_glow"),
    "opacity": ("_opacity", "_alpha", "_transparency"),
    "mask": ("_mask", "_msk"),
    "ui": ("_ui", "_hud", "_gui", "_icon"),
    "orm": ("_orm", "_rma", "_arm"),
}
GLOSS_SUFFIXES = ("_gloss", "_glossiness")
MATERIALS = (
    "cobblestone", "concrete", "leather", "plastic", "ceramic", "copper", "silver", "fabric", "rubber", "glass", "brick", "metal",
    "stone", "grass", "paint", "cloth", "iron", "gold", "wood", "rock", "tile", "sand", "dirt", "skin",
)
TILEABLE_WORDS = ("floor", "wall", "ground", "brick", "tile", "wood", "stone", "concrete", "metal", "fabric", "grass", "dirt", "sand", "rock")
HERO_WORDS = ("character", "face", "hero", "main", "player", "weapon")
INPUT_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tga", ".bmp", ".tiff", ".tif", ".dds")
OUTPUT_PRIORITY = ("png", "dds", "tga", "ktx2", "jpg", "jpeg", "bmp", "tif", "tiff")
METALS = ("metal", "gold", "silver", "iron", "copper")
NON_METALS = ("wood", "stone", "brick", "fabric", "plastic", "glass", "skin", "leather", "concrete", "default", "unknown")
ROUGHNESS = {"metal": 0.25, "wood": 0.65, "stone": 0.7, "brick": 0.75, "fabric": 0.85, "plastic": 0.4, "glass": 0.1, "skin": 0.55, "leather": 0.6, "concrete": 0.8, "rubber": 0.9, "paint": 0.35, "ceramic": 0.3, "default": 0.5}
METALNESS = {"metal": 0.95, "gold": 1.0, "silver": 1.0, "iron": 0.9, "copper": 0.95, "rubber": 0.0, "paint": 0.0, "ceramic": 0.0, "default": 0.0}
HEIGHT_SCALE = {"brick": 0.05, "cobblestone": 0.08, "stone": 0.06, "wood": 0.03, "fabric": 0.02, "metal": 0.01, "tile": 0.04, "concrete": 0.03, "default": 0.04}
ZONE_ROUGHNESS = {"metal": -0.22, "cloth": 0.18, "leather": 0.08, "skin": 0.02}
ZONE_METALNESS = {"metal": 0.75, "cloth": 0.0, "leather": 0.0, "skin": 0.0}
#: Output map suffix, its texture type and its mip key.
MAPS = (
    ("", "unknown", "main"), ("_albedo", "albedo", "albedo"), ("_roughness", "roughness", "roughness"), ("_metalness", "metalness", "metalness"), ("_ao", "ao", "ao"),
    ("_gloss", "roughness", "gloss"), ("_normal", "normal", "normal"), ("_height", "height", "height"), ("_orm", "orm", "orm"), ("_emissive", "emissive", "emissive"),
    ("_envmask", "mask", "envmask"), ("_zones", "mask", "zone_mask"), ("_emissive_mask", "mask", "emissive_mask"),
)
CODECS = {"diffuse": "bc7", "albedo": "bc7", "normal": "bc5", "height": "bc4", "roughness": "bc4", "metalness": "bc4", "ao": "bc4", "specular": "bc7", "emissive": "bc7", "opacity": "bc4", "mask": "bc4", "ui": "bc7", "orm": "bc7", "unknown": "bc7"}
SRGB_TYPES = ("diffuse", "albedo", "specular", "emissive", "ui", "unknown")
DXGI_CODECS = {71: "bc1", 72: "bc1", 74: "bc2", 75: "bc2", 77: "bc3", 78: "bc3", 80: "bc4", 81: "bc4", 83: "bc5", 84: "bc5", 95: "bc6h", 96: "bc6h", 98: "bc7", 99: "bc7"}
FOURCC_CODECS = {"DXT1": "bc1", "DXT3": "bc2", "DXT5": "bc3", "ATI1": "bc4", "BC4U": "bc4", "BC4S": "bc4", "ATI2": "bc5", "BC5U": "bc5", "BC5S": "bc5"}
DXGI_SRGB = {71: 72, 74: 75, 77: 78, 98: 99}
BLOCK_BYTES = {"bc1": 8, "bc2": 16, "bc3": 16, "bc4": 8, "bc5": 16, "bc6h": 16, "bc7": 16}
PHASES = ("upscale", "pbr", "normal", "pom", "postprocess", "mipmap", "validate")
#: Words in a file's name that let its map be uniform.
UNIFORM_OK_TAGS = ("_metalness", "_ao", "_height", "_mask", "_zones", "_envmask", "_emissive_mask")
#: Suffixes of outputs that may be flat.
FLAT_OK_SUFFIXES = ("_roughness", "_metalness", "_ao", "_orm", "_opacity", "_mask", "_height", "_gloss", "_envmask", "_zones", "_emissive_mask", "_emissive")
#: Extensions that an output of a suffix may have beside the asset's own.
EXTRA_EXTENSIONS = (".png", ".dds", ".ktx2", ".tga")
#: Phases in the order in which they run.
ALL_PHASES = ("scan", "upscale", "pbr", "normal", "pom", "postprocess", "mipmap", "validate")
#: Channel layouts of packed maps: red, green, blue, alpha.
LAYOUTS = {"unreal_orm": ("ao", "roughness", "metalness", "none"), "unity_mas": ("metalness", "ao", "smoothness", "none"), "source_phong": ("ao", "roughness", "metalness", "gloss"), "idtech_rma": ("roughness", "metalness", "ao", "none")}
#: What a channel of a packed map may hold.
PACK_SOURCES = frozenset(("ao", "roughness", "metalness", "gloss", "smoothness", "one", "zero", "none"))
#: Linear sRGB to XYZ and back, and the white point, as used for 8-bit Lab.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
XYZ_TO_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE = (0.950456, 1.0, 1.088754)
#: Types that are graded, and materials that get a detail normal.
GRADED_TYPES = ("diffuse", "albedo", "specular", "emissive", "ui", "unknown")
DETAIL_MATERIALS = ("stone", "concrete", "brick", "wood", "metal", "fabric")
#: The phases that each phase builds on.
PHASE_NEEDS = {"upscale": (), "pbr": ("upscale",), "normal": ("upscale", "pbr"), "pom": ("normal",), "mipmap": ("upscale",), "postprocess": ("pbr", "normal"), "validate": ()}
