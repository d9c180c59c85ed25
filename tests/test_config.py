import pytest

from texloom import config


def test_merge_and_check(tmp_path):
    s = config.merge(config.Settings(), {"material": {"ao_radius": 4.0, "ao_strength": 2, "nothing": 1}, "version": "x", "scan": 3, "upscale": {"enforce_power_of_two": 1}})
    assert (s.material.ao_radius, s.material.ao_strength, s.version, s.upscale.enforce_power_of_two) == (4, 2.0, 1, True)
    config.check(s)
    s.validation.albedo_min, s.material.ao_radius = 0.95, 0
    with pytest.raises(ValueError, match="ao_radius.*albedo_min"):
        config.check(s)
    config.save(config.Settings(), str(tmp_path / "c.yaml"))
    assert config.load(str(tmp_path / "c.yaml")) == config.Settings()


def put(settings, path, value):
    *sections, name = path.split(".")
    setattr(config.at(settings, ".".join(sections)) if sections else settings, name, value)


@pytest.mark.parametrize("path", config.RANGES)
def test_each_range(path):
    lo, hi = config.RANGES[path]
    for value, fine in ((lo, path not in config.ABOVE), (hi, True), (None if lo is None else lo - 1, False), (None if hi is None else hi + 1, False), (float("nan"), False)):
        if value is None:
            continue
        s = config.Settings()
        put(s, path, value)
        try:
            config.check(s)
            found = ""
        except ValueError as e:
            found = str(e)
        assert (f"{path}=" in found) != fine


@pytest.mark.parametrize("path", config.CHOICES)
def test_each_choice(path):
    s = config.Settings()
    put(s, path, "other")
    with pytest.raises(ValueError, match=path):
        config.check(s)


@pytest.mark.parametrize("path, value, word", [
    ("validation.metalness_metal_min_mean", 0.1, "nonmetal"), ("upscale.hero_resolution", 1024, "hero"), ("upscale.tile_pad", 256, "tile_pad"), ("parallax.max_samples", 4, "max_samples"), ("grading.plausible_albedo_min", 0.9, "plausible"),
    ("specular_aa.kernel_size", 4, "even"), ("packing.g_channel", "ao", "two channels"), ("packing.output_suffix", "", "suffix"), ("validation.fail_score", 0.9, "above warn_score"),
])
def test_each_clash(path, value, word):
    s = config.Settings()
    put(s, path, value)
    with pytest.raises(ValueError, match=word):
        config.check(s)


def test_weights_that_are_all_zero():
    s = config.Settings()
    s.roughness = config.Roughness(0.5, 0.0, 0.0, 0.0)
    s.reflection = config.Reflection(0.0, 0.0)
    with pytest.raises(ValueError, match="roughness has.*reflection has"):
        config.check(s)
    s.packing.g_channel = s.packing.r_channel = "one"
    s.roughness, s.reflection = config.Roughness(), config.Reflection()
    config.check(s)
