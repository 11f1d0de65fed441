"""Predicates over paths and file heads, as Column expressions (no Python at run time)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.options import Extras

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADER_EXT = "h hh hpp hxx inc inl ipp tpp".split()
PROJECT_EXT = sorted({*HEADER_EXT, *"C c cc cpp cxx".split()})
EXCLUDED_DIRS = sorted("out build .vscode .idea .git .cache".split())
VENDOR_DIRS = sorted("contrib dep deps dependencies extern external externals externallibraries nodemodules submodule submodules thirdparty 3rdparty vendor vendored vendors".split(), reverse=True)
VENDOR_LIBS = sorted("agg bzip2 fmt freetype glew glfw glulibtess hidapi jpeglib libigl libjpeg libpng mcut qhull zlib".split(), reverse=True)
GENERATED_SUFFIX = r"(-upb\.[ch]|_wrap\.(c|cpp|cxx))$"
GENERATED_MARKERS = sorted(".g.cpp .generated. .pb.cc .pb.cpp .pb.h .tab.c .tab.h .upb. /generated/ /moc_ /qrc_ /ui_ _generated. _generated_ lempar lex.yy".split(), reverse=True)
INLINE_IMPL = r"(\.(hxx|icc|inl|ipp|tcc|tpp|impl\.h|tmpl\.h)|[-_]inl\.h|_impl\.(h|hh|hpp|hxx))$"
PCH = sorted(f"{x}.h" for x in ("stdafx", "precompiled_header", "precompiled", "pch"))
VENDOR_STEMS = sorted("cjson lodepng miniz pugixml qcustomplot sqlite3 tinyxml2".split(), reverse=True)
VENDOR_FILES = sorted("catch.hpp doctest.h entt.hpp glad.c httplib.h json.hpp lua.c miniaudio.h nuklear.h td_api.h uni_algo.h vulkan.hpp".split(), reverse=True)
LICENSE_MARKERS = ["boost software license", "licensed under the apache", "permission is hereby granted", "redistribution and use in source", "released into the public domain", "zlib license"]
BANNER_MARKERS = ["a bison parser, made by gnu bison", "a lexical scanner generated by flex", "coco/r", "linux-syscall-note", "skeleton implementation for bison", "skeleton interface for bison"]
TEST_DIRS = sorted("test tests testlib testlibs testutil testutils tst unittest unittests".split(), reverse=True)
C_HEADERS = sorted(f"{x}.h" for x in "wctype wchar uchar time threads tgmath string stdnoreturn stdlib stdio stdint stddef stdbool stdatomic stdarg stdalign signal setjmp math locale limits iso646 inttypes float fenv errno ctype complex assert".split())
MIRROR = r"(^|/)(amalgamated?|dist|generated|release/include|single_include)/"
FLAG_PREFIX = "allow disable enable force is no skip use with without".split()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _any(markers, text: Column) -> Column:
    return text.rlike("|".join(re.escape(m) for m in markers))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def is_project_file(path: Column) -> Column:  # P1
    return extension(path).isin(PROJECT_EXT)


def is_header(path: Column) -> Column:  # P2
    return extension(path).isin(HEADER_EXT)


def is_excluded_dir(segment: Column) -> Column:  # P3
    return segment.isin(EXCLUDED_DIRS) | segment.startswith("cmake-build-")


def segment_key(segment: Column) -> Column:  # P4
    return F.translate(ascii_lower(segment), "_- ", "")


def any_dir(path: Column, predicate) -> Column:  # P5
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), predicate)


def has_excluded_dir(path: Column) -> Column:
    return any_dir(path, is_excluded_dir)


def is_vendored_dir(segment: Column, extras: Extras = Extras()) -> Column:  # P6, P7
    key = segment_key(segment)
    own = re.sub(r"[_\- ]", "", extras.self_dir).lower()
    libs = [x for x in VENDOR_LIBS if x != own]
    versioned = "^(" + "|".join(map(re.escape, libs)) + r")[0-9.]*\.[0-9.]*$"
    return key.isin(VENDOR_DIRS + libs + list(extras.vendored_dirs)) | key.rlike(versioned)


def has_vendored_dir(path: Column, extras: Extras = Extras()) -> Column:
    return any_dir(path, lambda s: is_vendored_dir(s, extras))


def is_generated_path(path: Column, extras: Extras = Extras()) -> Column:  # P8
    low = ascii_lower(path)
    return low.rlike(GENERATED_SUFFIX) | _any([*GENERATED_MARKERS, *extras.generated_markers], low)


def is_inline_impl(path: Column) -> Column:  # P9
    return path.rlike(INLINE_IMPL)


def is_pch(path: Column) -> Column:  # P10
    return base_name(path).isin(PCH)


def is_vendored_base(path: Column) -> Column:  # P11
    name = ascii_lower(base_name(path))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return name.startswith("stb_") | name.startswith("imgui") | stem.isin(VENDOR_STEMS) | name.isin(VENDOR_FILES)


def head(content: Column, size: int = 2000) -> Column:
    """The first bytes of a file as lower-case text, one character a byte."""
    return ascii_lower(F.decode(F.substring(content.cast("binary"), 1, size), "ISO-8859-1"))


def has_license_banner(content: Column) -> Column:  # P12
    return _any(LICENSE_MARKERS, head(content))


def has_generated_banner(content: Column) -> Column:  # P13
    h = head(content)
    at = F.instr(h, "@generated")
    tag = (at > 0) & (at <= 257)
    alone = ~F.substring(F.substr(h, F.greatest(at, F.lit(1)) + 10), 1, 1).rlike("^[a-z0-9_]")
    flex = h.contains("#define flex_scanner") & h.contains("yy_flex_major_version")
    return _any(BANNER_MARKERS, h) | F.when(tag, alone).otherwise(flex)


def is_minified(content: Column) -> Column:  # P14
    b = content.cast("binary")
    sample = F.decode(F.substring(b, 1, 64 * 1024), "ISO-8859-1")
    span = F.length(sample)
    lines = span - F.length(F.translate(sample, "\n", "")) + 1
    return (F.octet_length(b) >= 4096) & (F.floor(span / lines) > 110)


def _camel_test(stem: Column) -> Column:
    return stem.rlike("[a-z]Tests?$")


def is_test_dir(segment: Column, extras: Extras = Extras()) -> Column:  # P15
    return _camel_test(segment) | segment_key(segment).isin(TEST_DIRS + list(extras.test_dirs))


def has_test_dir(path: Column, extras: Extras = Extras()) -> Column:
    return any_dir(path, lambda s: is_test_dir(s, extras))


def is_test_base(path: Column) -> Column:
    base = base_name(path)
    name, cut = ascii_lower(base), r"\.[^.]*$"
    stem = F.regexp_replace(name, cut, "")
    return stem.rlike(r"^tests?$|^test[_-]|[_-](tests?|spec)$") | name.rlike(r"\.(test|spec)\.") | _camel_test(F.regexp_replace(base, cut, ""))


def path_excluded(path: Column, extras: Extras = Extras()) -> Column:  # P16
    return has_vendored_dir(path, extras) | has_test_dir(path, extras) | is_test_base(path) | is_vendored_base(path) | is_generated_path(path, extras)


def is_system_header(token: Column) -> Column:  # P18
    return ~token.contains("/") & (~token.contains(".") | token.isin(C_HEADERS))


def is_mirror(path: Column) -> Column:  # P19
    return path.rlike(MIRROR)


def churn_bucket(path: Column, extras: Extras = Extras()) -> Column:  # P20
    """prod, test or other by what follows the first rename arrow of the path."""
    to = F.when(path.contains(" => "), F.substr(path, F.instr(path, " => ") + 4)).otherwise(path)
    test = has_test_dir(to, extras) | is_test_base(to)
    vendored = has_vendored_dir(to, extras) | is_vendored_base(to)
    return F.when(~is_project_file(to) | vendored, "other").when(test, "test").otherwise("prod")


def is_production(path: Column, extras: Extras = Extras()) -> Column:  # P21
    return ~path_excluded(path, extras) & is_project_file(path)


FIX = r"(?i)\b(bug|crash|fault|fix(ed|es)?|hotfix|leak|oops|regress(ed|ion)?|segfault)\b"


def is_fix(subject: Column) -> Column:  # P22
    return subject.rlike(FIX)


def satd_rule(comment: Column) -> Column:  # P24, P25
    """SATD.2 for a FIXME or HACK without an issue id, SATD.1 for any other marker, else null."""
    marker = comment.rlike(r"\b(FIXME|HACK|TEMP|TODO|XXX)\b") | comment.rlike(r"(?i)\b(temporary|workaround|dirty)\b|quick.?fix")
    urgent = comment.rlike(r"\b(FIXME|HACK)\b") & ~comment.rlike(r"#\d+|[A-Z][A-Z0-9]+-\d+|\b(issue|gh)[/-]\d+")
    return F.when(urgent, "SATD.2").when(marker, "SATD.1")


def is_flag_name(name: Column) -> Column:  # P27
    return name.rlike("^(?i:" + "|".join(FLAG_PREFIX) + ")(_|[A-Z]|$)")


def short_name(qualified: Column) -> Column:
    return F.substring_index(qualified, "::", -1)


TEST_MACROS = sorted("BENCHMARK MOCK_METHOD TEST TEST_F TEST_P TYPED_TEST".split(), reverse=True)


def is_test_macro(name: Column) -> Column:  # P26
    return short_name(name).isin(TEST_MACROS)


GATES = {"check": ["SF.9"], "drift": ["DRIFT.1", "DRIFT.2", "DRIFT.4.CYCLE"], "diff": []}


def gates(rule: Column, mode: str) -> Column:  # P28
    return rule.isin(GATES[mode]) if GATES[mode] else F.lit(False)


# -- places of a path ------------------------------------------------------------------------------------------------

WRAPPERS = "inc include includes lib libs source sources src".split()
NOISE = "_build example examples generated testing".split()


def _is_noise(segment: Column, extras: Extras) -> Column:
    low = ascii_lower(segment)
    return is_excluded_dir(low) | is_vendored_dir(low, extras) | is_test_dir(low, extras) | low.isin(NOISE) | low.rlike("^(build[_-]|mock)|override")


def module_of(path: Column, extras: Extras = Extras()) -> Column:  # G10
    """First directory after wrappers; empty for files at the root and for paths with any noise segment."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    inner = F.filter(F.transform(dirs, lambda s, i: F.when(F.exists(F.slice(dirs, F.lit(1), i + 1), lambda t: ~ascii_lower(t).isin(WRAPPERS)), s)), lambda s: s.isNotNull())
    return F.when(F.exists(parts, lambda s: _is_noise(s, extras)) | (F.size(inner) == 0), "").otherwise(F.element_at(inner, 1))


def diff_area_of(path: Column, second_level: Column) -> Column:  # G11
    first, two = F.regexp_extract(path, "^([^/]*)/", 1), F.regexp_extract(path, "^([^/]*/[^/]*)/", 1)
    return F.when(~path.contains("/"), "<root>").when(second_level & (two != ""), two).otherwise(first)


def normalise_path(path: Column) -> Column:  # G13
    # most paths are normal, which two plain comparisons tell
    return F.when(path.contains("\\") | path.startswith("./"), F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")).otherwise(path)


def lexical_normal(path: Column) -> Column:
    """``a/../b`` and ``.`` collapsed, leading ``..`` kept: a fold over the segments."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def component_stem(path: Column) -> Column:
    base = base_name(path)
    return F.when(base.rlike(INLINE_IMPL), F.regexp_replace(base, INLINE_IMPL, "")).otherwise(F.regexp_replace(base, r"\.(h|hh|hpp)$", ""))


def suffixes(path: Column) -> Column:  # T13
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
