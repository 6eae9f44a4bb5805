"""Scalar column functions: hashes, distances, scores, formats. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MatchConfig


def parse_hash(text: Column) -> Column:
    """16 hex digits to the signed long with the same 64 bits."""
    return F.conv(text, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def parse_color_sig(text: Column) -> Column:
    """Hex digits to an array of 0..15; null and empty text give null."""
    digits = F.transform(F.split(text, ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.when(F.length(text) > 0, digits)


def color_distance(a: Column, b: Column) -> Column:
    """Share of the greatest L1 distance; 0 where a side is missing or the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total / (F.lit(15.0) * F.size(a))).otherwise(F.lit(0.0))


def packed_color(color: Column) -> Column:
    """An array of 0..15 as longs: how many there are, then 16 to a long; null for null."""
    n = F.size(color)
    word = lambda k: F.aggregate(
        F.slice(color, k * 16 + 1, F.lit(16)), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 4).bitwiseOR(x.cast("long"))
    )
    words = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), word)
    return F.when(n > 0, F.concat(F.array(n.cast("long")), words))


def packed_color_distance(a: Column, b: Column) -> Column:
    """color_distance of packed colours. A long's digits are compared all at once, each in a byte of its
    own: 16 + x - y keeps its bit of 16 where x isn't less than y, and no byte borrows from the next."""
    every = lambda byte: F.lit(int(f"{byte:02x}" * 8, 16)).cast("long")
    low = lambda v: v.bitwiseAND(every(15))

    def apart(x: Column, y: Column) -> Column:
        d = x.bitwiseOR(every(16)) - y
        less = every(1).bitwiseXOR(F.shiftrightunsigned(d, 4).bitwiseAND(every(1)))
        return low(d).bitwiseXOR(less * 15) + less

    def digits(x: Column, y: Column) -> Column:
        high = lambda v: low(F.shiftrightunsigned(v, 4))
        each = apart(low(x), low(y)) + apart(high(x), high(y))
        two = F.lit(0x00FF00FF00FF00FF)
        pairs = each.bitwiseAND(two) + F.shiftrightunsigned(each, 8).bitwiseAND(two)
        for shift in (32, 16):
            pairs = pairs + F.shiftrightunsigned(pairs, shift)
        return pairs.bitwiseAND(F.lit(0xFFFF))

    # up to 64 digits without a lambda, so that Spark compiles it
    few = sum((F.coalesce(digits(F.get(a, F.lit(k)), F.get(b, F.lit(k))), F.lit(0)) for k in range(2, 5)), digits(F.get(a, F.lit(1)), F.get(b, F.lit(1))))
    words = F.zip_with(F.slice(a, F.lit(2), F.size(a)), F.slice(b, F.lit(2), F.size(b)), digits)
    total = F.when(F.size(a) <= 5, few).otherwise(F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s + x))
    far = F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), total / (F.lit(15.0) * F.get(a, F.lit(0))))
    return F.when(a == b, F.lit(0.0)).otherwise(F.coalesce(far, F.lit(0.0)))


def parse_chromaprint(text: Column) -> Column:
    """The integers of a raw fingerprint, or null if one can't be read or there is none."""
    parts = F.filter(F.split(F.translate(text, ",", " "), r"\s+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("bigint"))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def audio_similarity(a: Column, b: Column) -> Column:
    """Share of positions of the common prefix whose values differ in at most 4 bits of magnitude."""
    n = F.least(F.size(a), F.size(b))
    agree = F.filter(
        F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(F.abs(x.bitwiseXOR(y))) <= 4), lambda x: x
    )
    return F.when(a.isNotNull() & b.isNotNull(), F.size(agree) / n).otherwise(F.lit(0.0))


def combined_score(visual: Column, audio: Column, cfg: MatchConfig = MatchConfig()) -> Column:
    return F.when(audio.isNotNull(), cfg.visual_weight * visual + cfg.audio_weight * audio).otherwise(visual)


def one_decimal(value: Column) -> Column:
    """value, not negative, with one digit after the point, halves to even as C and Python print it;
    Java's %.1f rounds them up. Of a whole number over a power of 1024 the tenths are exact."""
    tenths = F.rint((value - F.floor(value)) * 10).cast("long")
    whole = F.floor(value) + F.floor(tenths / 10)
    return F.concat(whole.cast("string"), F.lit("."), (tenths % 10).cast("string"))


def fmt_size(size: Column) -> Column:
    """Bytes in the largest unit under 1024 of them; a dash for null."""
    value, out = size.cast("double"), F.when(size.isNull(), F.lit("—"))
    for unit, digits in (("B", 0), ("KB", 0), ("MB", 1), ("GB", 1)):
        shown = F.rint(value).cast("long").cast("string") if not digits else one_decimal(value)
        out = out.when(value < 1024, F.concat(shown, F.lit(f" {unit}")))
        value = value / 1024
    return out.otherwise(F.concat(one_decimal(value), F.lit(" TB")))


def fmt_duration(seconds: Column) -> Column:
    """1h 15m, 3m 20s or 45s; seconds are rounded half to even and not below 0."""
    total = F.greatest(F.rint(seconds.cast("double")).cast("long"), F.lit(0))
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(seconds.isNull(), F.lit("—"))
        .when(h > 0, text(h, "h ", m, "m"))
        .when(m > 0, text(m, "m ", s, "s"))
        .otherwise(text(s, "s"))
    )


def resolution(width: Column, height: Column) -> Column:
    known = F.coalesce((width != 0) & (height != 0), F.lit(False))
    return F.when(known, F.concat(width.cast("string"), F.lit("x"), height.cast("string"))).otherwise(F.lit("—"))


def video_meta(duration: Column, width: Column, height: Column, size: Column) -> Column:
    return F.concat_ws(" · ", fmt_duration(duration), resolution(width, height), fmt_size(size))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def extract_timeout(duration: Column) -> Column:
    return F.greatest(F.lit(300.0), F.least(F.coalesce(duration, F.lit(0.0)), F.lit(3600.0)))


def oversized(width: Column, height: Column, limit: int) -> Column:
    """Whether both sides are known and the longer one exceeds the limit."""
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return known & (F.greatest(width, height) > limit) & F.lit(limit > 0)


def decode_max_dim(width: Column, height: Column, limit: int) -> Column:
    """The scaling limit to apply: 0 where the video is known to fit it already."""
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    fits = known & (F.greatest(width, height) <= limit)
    return F.when(fits, 0).otherwise(F.lit(limit))


def decode_hwaccel(width: Column, height: Column, limit: int, hwaccel: str, force: bool, device: bool) -> Column:
    chosen = oversized(width, height, limit) & F.lit(force and device and hwaccel != "vaapi")
    return F.when(chosen, F.lit("vaapi")).otherwise(F.lit(hwaccel))


def under_any_root(path: Column, roots: list[str]) -> Column:
    """Equal to a root, or below it at a path boundary."""
    out = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        out = out | (path == root) | path.startswith(root + "/")
    return out


def fmt_time(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def percent(score: Column) -> Column:
    return F.round(score * 100).cast("int")


def clamp_workers(target: Column, current: int, most: int) -> Column:
    """The wanted number of workers within 2..most; the current one where none is wanted."""
    return F.when(target.isNull(), F.lit(current)).otherwise(F.greatest(F.lit(2), F.least(F.lit(most), target)))


def failure_summary(stage: Column, output: Column, fallback: Column, log_name: str = "subprocess.log") -> Column:
    """The last line of output that isn't blank, at most 200 characters of it."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(output, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""
    )
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), fallback)
    return F.concat(stage, F.lit(" failed: "), F.substring(last, 1, 200), F.lit(f" (see {log_name} for full output)"))


def median_sign_hash(values: Column, terms: int = 64) -> Column:
    """Bits, first value first, of `terms` values over the median of all but the first."""
    rest = F.array_sort(F.slice(values, 2, terms - 1))
    median = F.element_at(rest, terms // 2)
    return F.aggregate(
        F.slice(values, 1, terms), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > median, 1).otherwise(0).cast("long"))
    )


def quantise_share(share: Column) -> Column:
    """A histogram share as a nibble."""
    return F.least(F.lit(15), F.floor(share * 15)).cast("int")
