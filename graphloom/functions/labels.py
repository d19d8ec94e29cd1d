"""Column functions over package names: types, versions, categories, prefixes and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Package types by the first pattern that the lower-cased name matches, else "application".
PACKAGE_TYPES = [
    ("kernel", [r"^linux-\d", r"-modules\.drv$"]),
    ("firmware", [r"^firmware"]),
    ("service", [r"^systemd-", r"-service\.drv$", r"-unit\.drv$"]),
    ("python-package", [r"^python\d+\.\d+-"]),
    ("perl-package", [r"^perl\d+\.\d+-"]),
    ("library", [r"-lib\.drv$", r"^glibc-", r"^openssl-", r"^zlib-", r"^libffi-"]),
    ("development", [r"^gcc-", r"^clang-", r"^binutils-", r"^cmake-", r"^meson-", r"-dev\.drv$"]),
    ("bootstrap", [r"^bootstrap-", r"^stdenv-"]),
    ("configuration", [r"\.json\.drv$", r"\.conf\.drv$", r"\.sh\.drv$", r"-config\.drv$", r"^etc\.drv$"]),
    ("documentation", [r"-doc\.drv$", r"-man\.drv$", r"-info\.drv$"]),
    ("font", [r"font", r"nerd-fonts"]),
]

# Names of dependencies that are needed at build time only.
BUILD_NAMES = [
    r"^gcc-\d", r"^clang-\d", r"^cmake-", r"^cargo-", r"^rustc-", r"^meson-", r"^ninja-", r"^make-\d", r"^gnumake-", r"-hook$", r"^stdenv-",
    r"^bootstrap-", r"-wrapper$", r"^binutils-", r"^pkg-config-", r"^autoconf-", r"^automake-", r"^libtool-", r"^m4-", r"^perl-.*-for-build$",
    r"^python.*-for-build$", r"-dev$", r"-headers$", r"-dev\.drv$", r"-headers", r"include",
]

# Categories of differences by the first pattern that matches, whatever the case.
CATEGORIES = [
    ("Desktop Environment", [r"^gnome-", r"^kde-", r"^plasma-", r"^gtk[234]", r"^wayland", r"^xorg-", r"^mutter", r"^kwin", r"^qt[56]-", r"^sddm", r"^gdm", r"^lightdm"]),
    ("System Services", [r"^systemd-", r"-service$", r"^dbus", r"^polkit", r"^udev", r"^acpid", r"^cron", r"^logrotate"]),
    ("Development Tools", [r"^gcc-", r"^clang-", r"^rustc", r"^cargo", r"^nodejs", r"^go-", r"^cmake", r"^make-", r"^autoconf", r"^automake", r"^pkg-config", r"^binutils"]),
    ("Networking", [r"^networkmanager", r"^wpa_supplicant", r"^iwd", r"^curl", r"^wget", r"^openssh", r"^openssl", r"^nss", r"^iptables", r"^nftables", r"^wireguard"]),
    ("Multimedia", [r"^pulseaudio", r"^pipewire", r"^alsa-", r"^ffmpeg", r"^gstreamer", r"^vlc", r"^mpv", r"^libav"]),
    ("Core Libraries", [r"^glibc", r"^zlib", r"^libffi", r"^ncurses", r"^readline", r"^bzip2", r"^xz", r"^lz4", r"^zstd"]),
    ("Security", [r"^gnupg", r"^gpg", r"^libgcrypt", r"^pam", r"^sudo", r"^shadow", r"^audit"]),
    ("Fonts", [r"^font-", r"-font$", r"^noto-", r"^liberation-", r"^dejavu-", r"^roboto", r"^freefont"]),
    ("Documentation", [r"^man-", r"-man$", r"-doc$", r"^texinfo", r"^groff"]),
    ("Python Packages", [r"^python\d", r"^python3\.\d+-"]),
]
CATEGORY_OF_TYPE = {"font": "Fonts", "documentation": "Documentation", "python-package": "Python Packages", "development": "Development Tools", "service": "System Services", "library": "Core Libraries"}

# The shorter table that looks at labels only.
LABEL_CATEGORIES = [
    ("Desktop Environment", [r"^gnome-", r"^kde-", r"^plasma-", r"^gtk[234]", r"^wayland", r"^xorg-", r"^mutter", r"^kwin", r"^xfce", r"^lxqt", r"^qt[56]-"]),
    ("System Services", [r"^systemd-", r"-service$", r"^dbus", r"^polkit", r"^udev", r"^acpid", r"^cron"]),
    ("Development Tools", [r"^gcc-", r"^clang-", r"^rustc", r"^cargo", r"^python\d", r"^nodejs", r"^go-", r"-dev$", r"^cmake", r"^make", r"^binutils"]),
    ("Networking", [r"^networkmanager", r"^wpa_supplicant", r"^iwd", r"^curl", r"^wget", r"^openssh", r"^openssl", r"^iptables", r"^nftables"]),
    ("Multimedia", [r"^pulseaudio", r"^pipewire", r"^alsa-", r"^ffmpeg", r"^gstreamer", r"^vlc", r"^mpv", r"^libav"]),
    ("Core Libraries", [r"^glibc", r"^zlib", r"^libffi", r"^ncurses", r"^readline", r"^libiconv", r"^libunistring", r"^libxcrypt"]),
    ("Fonts", [r"^font-", r"-font$", r"^noto-", r"^dejavu", r"^liberation-", r"^freefont"]),
    ("Documentation", [r"-man$", r"-doc$", r"^man-pages", r"-info$"]),
]

# Version formats at the end of a label, the first that matches.
VERSION_FORMATS = [
    r"(?i)^(.+?)-(\d+(?:\.\d+)*(?:-\d+)?)$",
    r"(?i)^(.+?)-(\d+(?:\.\d+)*(?:[-_]?(?:alpha|beta|rc|pre|post|dev|git|svn|hg|p)\d*)?)$",
    r"(?i)^(.+?)-(\d{8}|\d{4}-\d{2}-\d{2})$",
    r"(?i)^(.+?)-(unstable-\d{4}-\d{2}-\d{2})$",
    r"(?i)^(.+?)-(\d+)$",
]
PRERELEASE_RANK = {"dev": -1, "alpha": 0, "pre": 0, "beta": 1, "rc": 2, "post": 3, "": 4}

# Language prefixes that stand for themselves, then a name before a version.
LABEL_PREFIXES = [
    r"^(python\d+\.\d+-)", r"^(perl\d+\.\d+-)", r"^(ghc\d+\.\d+\.\d+-)", r"^(ruby\d+\.\d+-)", r"^(nodejs-\d+\.)", r"^(go_\d+_\d+-)", r"^(rust_\d+_\d+-)",
    r"^([a-zA-Z][a-zA-Z0-9_-]*?)-\d",
]

# Packages of services whose names differ; a service not listed is its own package.
SERVICE_PACKAGES = {
    "apache": ["apacheHttpd"], "mysql": ["mysql", "mariadb"], "sshd": ["openssh"], "libvirtd": ["libvirt", "qemu"], "xserver": ["xorg-server", "xwayland"],
    "displayManager": [], "wireguard": ["wireguard-tools"], "printing": ["cups"], "resolved": ["systemd"],
}


def one_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _first_match(column: Column, table: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    out = F
    for name, patterns in table:
        out = out.when(column.rlike(one_of(patterns)), name)
    return out.otherwise(otherwise)


def package_type(name: Column) -> Column:
    return _first_match(F.lower(name), PACKAGE_TYPES, F.lit("application"))


def edge_type(dependency_name: Column) -> Column:
    """`build` or `runtime`, by the name of the dependency alone."""
    return F.when(F.lower(dependency_name).rlike(one_of(BUILD_NAMES)), "build").otherwise("runtime")


def module_type(source: Column) -> Column:
    """Kind of module that names a top-level package; null is `other`."""
    return (
        F.when(source.isin("systemPackages", "environment.systemPackages"), "systemPackages")
        .when(source.startswith("programs."), "programs")
        .when(source.startswith("services."), "services")
        .otherwise("other")
    )


def category(label: Column, kind: Column) -> Column:
    """Category of a difference by its label, then by its package type."""
    by_type = F
    for name, found in CATEGORY_OF_TYPE.items():
        by_type = by_type.when(kind == name, found)
    return _first_match(F.lower(label), CATEGORIES, by_type.otherwise("Other"))


def label_category(label: Column) -> Column:
    """Category of a difference by its label alone, from the shorter table."""
    return _first_match(F.lower(label), LABEL_CATEGORIES, F.lit("Other"))


def version_parts(label: Column) -> tuple[Column, Column]:
    """Name and version of a label; without a version the label and null."""
    name, version = label, F.lit(None).cast("string")
    for pattern in reversed(VERSION_FORMATS):
        fits = label.rlike(pattern)
        name = F.when(fits, F.regexp_extract(label, pattern, 1)).otherwise(name)
        version = F.when(fits, F.regexp_extract(label, pattern, 2)).otherwise(version)
    return name, version


def version_components(version: Column) -> Column:
    """Numbers and lower-cased words of a version, as strings."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"([0-9]+|[a-zA-Z]+)"), 1), F.lower)


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1: numbers by value, words by pre-release rank and then by letter, numbers above words; 0 if either is null."""
    a, b = version_components(left), version_components(right)

    def is_number(x: Column) -> Column:
        return x.rlike("^[0-9]+$")

    def rank(x: Column) -> Column:
        out = F
        for word, value in PRERELEASE_RANK.items():
            out = out.when(x == word, value)
        return out.otherwise(5)

    def sign(p: Column, q: Column) -> Column:
        return F.when(p < q, -1).when(p > q, 1).otherwise(0)

    def one(x: Column, y: Column) -> Column:
        # the shorter version is filled with 0 against a number, with nothing against a word
        x = F.coalesce(x, F.when(is_number(y), "0").otherwise(""))
        y = F.coalesce(y, F.when(is_number(x), "0").otherwise(""))
        numbers = sign(F.when(is_number(x), x).otherwise("0").cast("decimal(38,0)"), F.when(is_number(y), y).otherwise("0").cast("decimal(38,0)"))
        words = F.when(rank(x) != rank(y), sign(rank(x), rank(y))).otherwise(sign(x, y))
        return F.when(is_number(x) & is_number(y), numbers).when(~is_number(x) & ~is_number(y), words).when(is_number(x), 1).otherwise(-1)

    found = F.aggregate(F.zip_with(a, b, one), F.lit(0), lambda seen, now: F.when(seen != 0, seen).otherwise(now))
    return F.when(left.isNull() | right.isNull(), 0).otherwise(found)


def version_change(same_hash: Column, left: Column, right: Column) -> Column:
    order = compare_versions(left, right)
    return (
        F.when(same_hash | left.eqNullSafe(right), "rebuild")
        .when(left.isNull() | right.isNull(), "unknown")
        .when(order < 0, "upgrade")
        .when(order > 0, "downgrade")
        .otherwise("rebuild")
    )


def label_prefix(label: Column) -> Column:
    """Prefix by which a label is aggregated: language prefix, name before a version, up to a digit, or 15 characters."""
    found = F.when(F.length(label) > 15, F.substring(label, 1, 15)).otherwise(label)
    # the first digit after the third character ends the prefix, less trailing separators
    found = F.when(label.rlike(r"^.{3}.*[0-9]"), F.regexp_replace(F.regexp_extract(label, r"^(.{3}[^0-9]*)[0-9]", 1), r"[-_]+$", "")).otherwise(found)
    for pattern in reversed(LABEL_PREFIXES):
        found = F.when(label.rlike(pattern), F.regexp_extract(label, pattern, 1)).otherwise(found)
    return found


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before and one behind."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two texts."""
    a, b = trigrams(left), trigrams(right)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def importance(kind: Column, impact: Column) -> Column:
    """How much a difference matters: its package type and, up to 5, its closure impact by the hundred."""
    by_type = F.when(kind == "application", 5.0).when(kind == "service", 4.0).when(kind == "font", 2.0).when(kind == "library", -2.0).when(kind == "documentation", -1.0).otherwise(0.0)
    return by_type + F.least(F.abs(impact) / 100.0, F.lit(5.0))


def label_importance(group: Column, kind: Column, top_level: Column, impact: Column) -> Column:
    """The variant with top-level packages and label categories (``group``)."""
    by_type = F.when(kind == "application", 5.0).when(kind == "service", 4.0).when(kind == "development", 3.0).when(kind == "library", -2.0).when(kind == "documentation", -3.0).when(kind == "font", -1.0).otherwise(0.0)
    by_group = F.when(group == "Desktop Environment", 3.0).when(group.isin("System Services", "Development Tools"), 2.0).when(group.isin("Core Libraries", "Fonts"), -1.0).when(group == "Documentation", -2.0).otherwise(0.0)
    return F.when(top_level, 10.0).otherwise(0.0) + by_type + by_group + F.least(F.abs(impact) / 100.0, F.lit(5.0))


def truncated(label: Column, most: int) -> Column:
    """The label, or its first characters and dots."""
    return F.when(F.length(label) > most, F.concat(F.left(label, F.lit(most)), F.lit("..."))).otherwise(label)
