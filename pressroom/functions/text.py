"""Text rules of the desk as column expressions: all run inside the JVM."""

from __future__ import annotations

import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")


#: Lower-case letters of the Latin blocks whose canonical form is a letter with marks.
_MARKED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and len(_plain(c)) == 1 and _plain(c) != c)
_BASE = "".join(map(_plain, _MARKED))
_COMBINING = "".join(map(chr, range(0x300, 0x370)))


def strip_marks(c: Column) -> Column:
    """Lower case without diacritics; letters that no mark makes (as the barred d) stay.
    Texts of as many bytes as characters have no marks."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.lower(c), _MARKED + _COMBINING, _BASE))


def fold_radar(c: Column) -> Column:
    """For headlines: everything but a-z, 0-9 and blank becomes a blank, the barred d too."""
    return F.regexp_replace(strip_marks(c), "[^a-z0-9 ]", " ")


def fold_keep(c: Column) -> Column:
    """Barred d is d; punctuation stays."""
    bare = strip_marks(c)
    return F.when(F.contains(bare, F.lit("đ")), F.translate(bare, "đ", "d")).otherwise(bare)


def fold_name(c: Column) -> Column:
    """For names: other characters become blanks, ends trimmed, inner runs kept. Without a
    barred d that is ``fold_radar``, which stands beside it in one pass."""
    barred = F.contains(strip_marks(c), F.lit("đ"))
    return F.trim(F.when(barred, F.regexp_replace(fold_keep(c), "[^a-z0-9 ]", " ")).otherwise(fold_radar(c)))


def fold_match(c: Column) -> Column:
    """As ``fold_name`` with runs of other characters as one blank."""
    return F.trim(F.regexp_replace(fold_keep(c), "[^a-z0-9]+", " "))


def words_match(c: Column) -> Column:
    """The words of ``fold_match``, in one pass over the folded text."""
    folded = F.translate(F.lower(c), _MARKED + "đ" + _COMBINING, _BASE + "d")
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda t: t != "")


def first_words(c: Column, n: int, head: int = 400) -> Column:
    """The first ``n`` words of ``fold_match`` (an array; of fewer words, all). Where the
    first ``head`` characters hold more words than that, only they are folded."""
    words = F.split(fold_match(F.substring(c, 1, head)), " ")
    return F.slice(F.when(F.size(words) > n, words).otherwise(F.split(fold_match(c), " ")), 1, n)


def slug(c: Column, most: int = 42) -> Column:
    """Runs of other characters as one hyphen; as ``fold_match``, with which it shares the pass."""
    cut = F.substring(F.regexp_replace(fold_keep(c), "[^a-z0-9]+", " "), 1, most)
    return F.translate(F.trim(cut), " ", "-")


def _entity(segment: Column) -> Column:
    """What follows an ampersand, its entity decoded if it begins with a whole one. The
    names are those of the standard library's table."""
    name = F.regexp_extract(segment, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    hex_digits = F.when(name.rlike("^#[xX]"), F.substring(name, 3, 8)).otherwise(F.conv(F.substring(name, 2, 8), 10, 16))
    code = F.conv(hex_digits, 16, 10).cast("long")
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    by_number = F.when(sound, F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")).otherwise("\ufffd")
    names = F.create_map(*[F.lit(x) for k, v in sorted(html5.items()) if k.endswith(";") for x in (k[:-1], v)])
    char = F.when(name == "", None).when(name.startswith("#"), by_number).otherwise(F.try_element_at(names, name))
    rest = F.substring(segment, F.length(name) + 2, F.length(segment))
    return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), segment))


def unescape(c: Column) -> Column:
    """HTML entities decoded once: named ones and numbers; unknown ones stay. An entity
    ends in a semicolon."""
    parts = F.split(c, "&")
    decoded = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), _entity), ""))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def clean_text(c: Column, rounds: int = 3) -> Column:
    """Tags out, HTML entities decoded up to ``rounds`` times (an entity may be escaped
    twice), white space collapsed. Once nothing is left to decode, a further round
    changes nothing."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for _ in range(rounds):
        out = unescape(out)
    return F.trim(F.regexp_replace(out, "[\\s\u00a0]+", " "))


def keywords(c: Column, stop: list[str], least: int = 4) -> Column:
    """Distinct words of a headline, at least ``least`` letters, stop words left out."""
    words = F.split(fold_radar(c), " +")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least))


def sentences(c: Column) -> Column:
    """Cut after . ! ? or ellipsis (and a closing quote), but not before a domain's end."""
    one = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.split(one, "(?<=[.!?…]|[.!?…][\"”'])\\s+(?!(?:Com|Net|Org|Vn|Id)\\b)")


def word_count(c: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def speech_seconds(words: Column, per_minute: int = 258) -> Column:
    return words * 60.0 / per_minute


def word_budget(seconds: Column, per_minute: int = 258) -> Column:
    return (seconds * per_minute / 60.0).cast("int")


def feed_time(c: Column) -> Column:
    """Four date formats in turn, as UTC if no zone is named; null if none fits."""
    bare = F.regexp_replace(F.trim(c), "^[A-Za-z]{3}, *", "")
    formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def age_hours(published: Column, now: Column) -> Column:
    """Hours since publication; 999 if that is unknown."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(published)) / 3.6e9, F.lit(999.0))


def short_id(title: Column) -> Column:
    return F.substring(F.md5(fold_radar(title)), 1, 6)


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("\\b(20[0-9][0-9])\\b"), F.lit(1)))


def one_year(c: Column) -> Column:
    """Of several years only the latest stays; commas go and blanks collapse."""
    latest = F.array_max(years(c))
    other = F.regexp_replace(c, F.concat(F.lit("\\b(?!"), latest, F.lit(")20[0-9][0-9]\\b")), F.lit(""))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(other, "[,;]", " "), "\\s+", " "))
    return F.when(F.size(years(c)) >= 2, tidy).otherwise(c)


def queries_per_year(sentence: Column, subject: Column, given: Column, most: int = 4) -> Column:
    """One query for each of several years of a sentence, unless two were given."""
    found = years(sentence)
    return F.when((F.size(found) >= 2) & (F.size(given) < 2), F.transform(F.slice(found, 1, most), lambda y: F.concat_ws(" ", subject, y))).otherwise(given)


def lenient_json(c: Column, schema: str) -> Column:
    """The outermost array or object in a text with fences and talk around it."""
    bare = F.regexp_replace(c, "```[a-z]*", "")
    return F.from_json(F.regexp_extract(bare, "(?s)([\\[{].*[\\]}])", 1), schema)


def size_pair(c: Column) -> Column:
    """"WxH" as a struct of two whole numbers; anything else is null."""
    w, h = (F.try_element_at(F.split(F.lower(c), "x"), F.lit(i)).try_cast("int") for i in (1, 2))
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("w"), h.alias("h")))


def clip_code(c: Column) -> Column:
    """``clip::file::from::to[::x,y,w,h]`` as a struct; a bad frame is null, fewer than
    four parts make the whole null."""
    p = F.split(c, "::")
    frame = F.transform(F.split(F.try_element_at(p, F.lit(5)), ","), lambda x: x.try_cast("double"))
    good = (F.size(frame) == 4) & ~F.exists(frame, lambda x: x.isNull())
    return F.when((F.size(p) >= 4) & (p[0] == "clip"), F.struct(p[1].alias("file"), F.try_element_at(p, F.lit(3)).try_cast("double").alias("from"), F.try_element_at(p, F.lit(4)).try_cast("double").alias("to"), F.when(good, frame).alias("frame")))


def duration_text(seconds: Column, units: tuple[str, str, str] = ("h", "m", "s")) -> Column:
    h, m, s = units
    whole = F.floor(seconds).cast("long")
    return F.when(whole >= 3600, F.concat(F.floor(whole / 3600), F.lit(f" {h} "), F.floor(whole % 3600 / 60), F.lit(f" {m}"))).when(whole >= 60, F.concat(F.floor(whole / 60), F.lit(f" {m} "), whole % 60, F.lit(f" {s}"))).otherwise(F.concat(whole, F.lit(f" {s}")))


def has_marks(c: Column) -> Column:
    return fold_keep(c) != F.lower(c)


def marked_section(c: Column, opening: str, closing: str) -> Column:
    """The text between two markers, all of it where they are absent."""
    inner = F.regexp_extract(c, f"(?s){opening}(.*?){closing}", 1)
    return F.when(inner != "", inner).otherwise(c)


def day_shift(hour: Column) -> Column:
    return F.when(hour < 10, "morning").when(hour < 16, "noon").otherwise("evening")


def anchored(c: Column, pattern: str, anchor: str) -> Column:
    """``anchor`` added to queries without a word of the domain."""
    return F.when(c.rlike(f"(?i){pattern}"), c).otherwise(F.concat_ws(" ", c, F.lit(anchor)))


def tag_list(c: Column, budget: int = 490, longest: int = 60) -> Column:
    """Tags cut at / | and ;, each with its unaccented twin, first spelling kept, up to
    the first that would pass the budget of characters (two more for each tag)."""
    raw = F.transform(F.split(c, "[/|;]"), lambda t: F.regexp_replace(t, "^[ .,;:\\-]+|[ .,;:\\-]+$", ""))
    good = F.filter(raw, lambda t: (F.length(t) > 0) & (F.length(t) <= longest))
    twins = F.flatten(F.transform(good, lambda t: F.array(t, fold_keep(t))))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(s: Column, t: Column) -> Column:
        again, used = F.array_contains(s["seen"], F.lower(t)), s["used"] + F.length(t) + 2
        take = ~s["full"] & ~again & (used <= budget)
        return F.struct(F.when(take, F.array_append(s["kept"], t)).otherwise(s["kept"]).alias("kept"), F.when(take, F.array_append(s["seen"], F.lower(t))).otherwise(s["seen"]).alias("seen"), F.when(take, used).otherwise(s["used"]).alias("used"), (s["full"] | (~again & (used > budget))).alias("full"))

    return F.aggregate(twins, start, step, lambda s: s["kept"])


def proper_runs(c: Column, stop: list[str]) -> Column:
    """Runs of capitalised words, not at the start and not stop words."""
    words = F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " ")
    start = F.struct(F.lit("").alias("run"), F.array().cast("array<string>").alias("runs"))

    def close(s: Column) -> Column:
        return F.when(s["run"] != "", F.array_append(s["runs"], s["run"])).otherwise(s["runs"])

    def step(s: Column, w: Column) -> Column:
        bare = F.regexp_replace(w, "[^\\p{L}\\p{N}]+$", "")
        proper = bare.rlike("^\\p{Lu}") & ~F.lower(bare).isin(*stop)
        ends = ~proper | (bare != w)
        run = F.when(proper, F.trim(F.concat_ws(" ", s["run"], bare))).otherwise(s["run"])
        done = F.when(run != "", F.array_append(s["runs"], run)).otherwise(s["runs"])
        return F.struct(F.when(ends, F.lit("")).otherwise(run).alias("run"), F.when(ends, done).otherwise(s["runs"]).alias("runs"))

    return F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), start, step, close)


def difference_bits(v: Column, n: int = 63) -> Column:
    """Bit i is v[i] > v[i + 1], the first bit highest, as a long."""
    flags = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.element_at(v, i.cast("int")) > F.element_at(v, (i + 1).cast("int"))).cast("long"))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))


def motion_style(w: Column, h: Column, wide: float = 2.0, upscale: float = 2.3, frame: tuple[int, int] = (1080, 1920)) -> Column:
    ratio = w / h
    needed = F.greatest(F.lit(frame[0]) / w, F.lit(frame[1]) / h)
    return F.when((ratio >= wide) | (needed > upscale), "fit").when(ratio >= 1, "pan").otherwise("zoom")


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership 0 outside (a, d), 1 from b to c, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a), (d - x) / (d - c)))
