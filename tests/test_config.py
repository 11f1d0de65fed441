"""Configuration files: what is read, and where each error is."""

import pytest

from codestrata import config

GOOD = """# comment
version: 1
modules:
  core:
    paths: ["src/core/**", 'src/base/**']  # two
  ui-x:
    paths:
    - src/ui/**
rules:
  - type: layers
    name: order
    layers: [ui-x, core]
  - name: apart
    type: independence
    modules: [core, ui-x]
  -
    type: forbidden
    name: no
    from: [core]
    to:
      - ui-x
thresholds:
  chain_length: 7
  diff_max_added_lines: 5
classification:
  extra_test_dirs: [checks]
"""


def test_everything_is_read():
    c = config.read(GOOD)
    assert c.modules == {"core": ("src/core/**", "src/base/**"), "ui-x": ("src/ui/**",)}
    assert [(r.type, r.name, r.members, r.targets) for r in c.rules] == [("layers", "order", ("ui-x", "core"), ()), ("independence", "apart", ("core", "ui-x"), ()), ("forbidden", "no", ("core",), ("ui-x",))]
    t = c.options.thresholds
    assert (t.chain_length, t.mass_added_lines, t.god_header_fan_in) == (7, 5, 50) and c.options.extras.test_dirs == ("checks",)
    assert config.read("version: 1\nmodules:\n  a:\n    paths: [x]\nrules: []\n").rules == ()


@pytest.mark.parametrize("old, new, at, part", [
    ("version: 1", "version: 2", "2:10", "not supported"), ("version: 1\n", "", "1:1", "'version'"), ("rules:\n", "rule:\n", "9:1", "unknown key 'rule'"), ("  core:\n", "  Core:\n", "4:3", "bad module name"),
    ("    paths:\n    - src/ui/**\n", "    x: y\n", "7:5", "needs a list 'paths'"), ("type: layers", "type: layer", "10:11", "unknown type"), ("name: apart", "name: order", "13:5", "occurs twice"), ("    layers: [ui-x, core]\n", "", "10:5", "needs a list 'layers'"),
    ("[ui-x, core]", "[ui-x, other]", "1:1", "'other' in 'layers' is unknown"), ("[core, ui-x]", "[core, core]", "1:1", "occurs twice in 'modules'"), ("from: [core]", "from: [ui-x]", "1:1", "in both lists"), ("chain_length: 7", "chain_length: 0", "23:17", "positive integer"),
    ("chain_length: 7", "chain: 7", "23:3", "unknown key 'chain'"), ("extra_test_dirs: [checks]", "extra_test_dirs: []", "26:20", "not empty"), ("[checks]", "[checks", "26:20", "unclosed list"), ("version: 1", "version: 1\nversion: 1", "3:1", "duplicate key"), ("rules:\n", "rules: x\n", "10:3", "unexpected indentation"), ("modules:\n", "\tmodules:\n", "3:1", "tab"),
])
def test_errors_have_a_place(old, new, at, part):
    assert old in GOOD
    with pytest.raises(config.ConfigError) as e:
        config.read(GOOD.replace(old, new, 1), "f.yml")
    assert str(e.value).startswith(f"f.yml:{at}: ") and part in str(e.value), str(e.value)


def test_the_nearest_file_above_counts(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / config.NAME).write_text(GOOD)
    assert config.find(str(deep)) == str(tmp_path / config.NAME) and config.discover(str(deep)).rules
    (tmp_path / "a" / config.NAME).write_text("version: 3")
    with pytest.raises(config.ConfigError):
        config.discover(str(deep))
    with pytest.raises(config.ConfigError, match="cannot open"):
        config.load(str(tmp_path / "none.yml"))
