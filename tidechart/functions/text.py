"""Text functions on columns: Column -> Column, no Python rows.

Case folding is Spark's `lower`; accents are removed by decomposing letters through a translation table made
from Unicode and then dropping combining marks.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# They have to equal those of the data's publishers for equal results.
BRACKET_WORDS = "feat|ft|with|w/|prod|official|mv|m/v|lyric|lyrics|audio|video|visuali[sz]er|teaser|performance|vietsub|karaoke|4k|hd|from|ost|soundtrack|nhạc phim|theme song"
VIDEO_WORDS = "official|music video|mv|m/v|lyric|lyrics|audio|visuali[sz]ed?r?|album|track no|chapter|teaser|trailer|live stage|performance|vietsub|karaoke|4k"
CHANNEL_WORDS = r"-\s*topic|official|music|entertainment|channel|records|media|vevo|tv"
ARTIST_MARKS = r",|&|;|/|×|\+|\bx\b|\bft\.?(?=\s)|\bfeat\.?(?=\s)|\bfeaturing\b|\bwith\b|\bvà\b"
COUNT_UNITS = {"K": 1e3, "N": 1e3, "M": 1e6, "TR": 1e6, "B": 1e9, "T": 1e9}
TONE_PAIRS = {"oà": "òa", "oá": "óa", "oả": "ỏa", "oã": "õa", "oạ": "ọa", "uỳ": "ùy", "uý": "úy", "uỷ": "ủy", "uỹ": "ũy", "uỵ": "ụy"}
# End of fixed values.

QUOTES = " '\"“”‘’"
_U = "(?iU)"


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str]:
    """Letters of the BMP whose decomposition starts with another letter, and that letter; đ and Đ besides."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            pairs[c] = d[0]
    return "".join(pairs), "".join(pairs.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_accents(c: Column) -> Column:
    """Letters without their marks; null is empty."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), *_letters()), r"\p{Mn}+", "")


def norm_text(c: Column) -> Column:
    """Lower case, no accents, only 0-9 and a-z with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^0-9a-z]+", " "))


def slug(c: Column) -> Column:
    return F.replace(norm_text(c), F.lit(" "), F.lit("-"))


def compact(c: Column) -> Column:
    return F.replace(norm_text(c), F.lit(" "), F.lit(""))


def has_diacritics(c: Column) -> Column:
    return strip_accents(c) != F.coalesce(c, F.lit(""))


def _or(c: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), other)


def _strip(c: Column, chars: str = " \t\n\r\f\v") -> Column:
    return F.trim(c, F.lit(chars))


def clean_title(c: Column) -> Column:
    """A title without bracketed remarks, featured artists and what follows a pipe; itself if nothing is left."""
    own = _strip(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(own, _U + rf"\s*[(\[【][^)\]】]*?\b(?:{BRACKET_WORDS})\b[^)\]】]*[)\]】]", " ")
    t = F.regexp_replace(t, _U + r"\s+(?:feat\.?|ft\.?|featuring)\s+.*$", "")
    t = F.regexp_replace(t, r"\s*[|｜]\s*.*$", "")
    return _or(_strip(F.regexp_replace(t, r"(?U)\s+", " ")), own)


def split_artists(c: Column) -> Column:
    """Names in one string as an array."""
    parts = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(" ")), _U + rf"\s*(?:{ARTIST_MARKS})\s*")
    return F.filter(F.transform(parts, lambda x: _strip(x)), lambda x: x != "")


def split_artist_list(c: Column) -> Column:
    """Names in an array of strings, each of which may hold several."""
    return F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: split_artists(x)))


def clean_channel_name(c: Column) -> Column:
    """A channel's name without up to two trailing words that say it is a channel."""
    own = _strip(F.coalesce(c, F.lit("")))
    n = own
    for _ in range(2):
        n = _strip(F.regexp_replace(n, _U + rf"\s*(?:{CHANNEL_WORDS})\s*$", ""))
    return _or(n, own)


def _is_artist(segment: Column, forms: Column) -> Column:
    """Is a segment an artist's name? forms: compact names without what says channel."""
    hit = _let(compact(segment), lambda seg: F.when(F.length(seg) >= 2, F.exists(forms, lambda a: (F.length(a) >= 3) & (F.contains(seg, a) | F.contains(a, seg)))))
    return F.coalesce(hit, F.lit(False))


def _halves(c: Column) -> Column:
    return F.split(c, r"\s+[-–—]\s+", 2)


def clean_video_title(title: Column, artists: Column) -> Column:
    """The song's title in a video's title. artists: array of names.

    Parts between pipes that are noise or name only the artist go; of "a - b" the side that is not the artist
    stays.
    """
    full = F.coalesce(title, F.lit(""))
    parts = F.filter(F.transform(F.split(full, "[|｜]"), lambda x: _strip(x, QUOTES)), lambda x: x != "")
    noisy = lambda x: F.rlike(x, F.lit(_U + rf"\b(?:{VIDEO_WORDS})\b"))
    keep = _let(parts, lambda p: _let(F.filter(p, lambda x: ~noisy(x)), lambda loud: F.when(F.size(loud) > 0, loud).otherwise(F.slice(p, 1, 1))))
    named = lambda names: F.struct(F.transform(names, lambda a: compact(a)).alias("whole"), F.transform(names, lambda a: compact(clean_channel_name(a))).alias("forms"))

    def sides(x: Column, n: Column, told: Callable[[Column, Column, Column], Column]) -> Column:
        """`told` of the halves of x (halves, whether the left one is an artist, the right one)."""
        return _let(_halves(x), lambda two: _let(F.struct(_is_artist(two[0], n["forms"]).alias("l"), _is_artist(F.get(two, F.lit(1)), n["forms"]).alias("r")), lambda is_: told(two, is_["l"], is_["r"])))

    def song(x: Column, n: Column) -> Column:
        mixed = sides(x, n, lambda two, left, right: (F.size(two) == 2) & (left != right))
        return ~F.array_contains(n["whole"], compact(x)) & (mixed | ~_is_artist(x, n["forms"]))

    def side(x: Column, n: Column) -> Column:
        return sides(x, n, lambda two, left, right: F.when((F.size(two) == 2) & left & ~right, F.get(two, F.lit(1))).when((F.size(two) == 2) & right & ~left, two[0]).otherwise(x))

    def chosen(n: Column, kept: Column) -> Column:
        return _let(F.filter(kept, lambda x: song(x, n)), lambda some: F.coalesce(F.get(F.when(F.size(some) > 0, some).otherwise(kept), F.lit(0)), full))

    own = _let(split_artist_list(artists), named)
    return clean_title(_strip(_let(own, lambda n: _let(keep, lambda kept: _let(chosen(n, kept), lambda x: side(x, n)))), QUOTES))


def track_key(title: Column, artists: Column) -> Column:
    """title__artist as slugs; artists: array of names, of which the first counts."""
    first = F.get(split_artist_list(artists), F.lit(0))
    return F.concat(_or(slug(clean_title(title)), F.lit("unknown")), F.lit("__"), _or(slug(F.coalesce(first, F.lit("unknown"))), F.lit("unknown")))


def parse_count(c: Column) -> Column:
    """The whole number that a counter shows: a unit scales it, without one its separators go; 0 if no digits lead."""
    t = F.upper(F.trim(F.replace(c, F.lit(" "), F.lit(" "))))
    found = r"^([\d.,]+)\s*(K|M|B|N|TR|T)?"
    number, unit = F.regexp_extract(t, found, 1), F.regexp_extract(t, found, 2)
    times = F.lit(None).cast("double")
    for u, x in COUNT_UNITS.items():
        times = F.when(unit == u, F.lit(x)).otherwise(times)
    scaled = F.floor(F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * times).cast("long")
    plain = F.regexp_replace(number, "[.,]", "").try_cast("long")
    return F.coalesce(F.when(unit != "", scaled).otherwise(plain), F.lit(0).cast("long"))


# Buckets of genres and the words that lead to them, first match wins, and patterns of list names.
GENRE_RULES = [
    {"words": ("trinh", "tien chien"), "bucket": "Nhạc Trịnh/Tiền Chiến"},
    {"words": ("tru tinh", "bolero", "nhac vang"), "bucket": "Nhạc Trữ Tình"},
    {"words": ("cai luong", "que huong", "dan ca", "cach mang"), "bucket": "Quê Hương/Cải Lương"},
    {"words": ("au my", "us uk"), "bucket": "US-UK", "only_without_accents": True, "only_without_viet": True},
    {"words": ("han quoc", "k pop", "kpop", "nhat ban", "j pop", "hoa ngu", "c pop", "chau a"), "bucket": "K-Pop/Châu Á", "only_without_accents": True},
    {"words": ("rap", "hip hop"), "bucket": "US-UK", "domestic_bucket": "Rap Việt"},
    {"words": ("edm", "remix", "dance", "electronic", "house", "trance"), "bucket": "US-UK", "domestic_bucket": "EDM/Remix"},
    {"words": ("indie", "rock", "alternative"), "bucket": "US-UK", "domestic_bucket": "Indie/Rock Việt"},
    {"words": ("v pop", "nhac tre", "viet nam", "nhac phim", "vietnamese"), "bucket": "V-Pop"},
    {"words": ("pop", "r b", "soul", "singer"), "bucket": "US-UK", "domestic_bucket": "V-Pop"},
]
DOMESTIC_WORDS = ("viet", "v pop", "nhac tre")
LIST_TOP, LIST_PRAISE, LIST_SONGS = r"^top\s*\d+\s*", r"\s*(hay nhất|việt nam hay nhất)$", r"^bài hát\s+"
# End of fixed values.


def genre_bucket(genres: Column, title: Column, artists: Column) -> Column:
    """A common bucket for an array of genre names, with the title and artists as hints of origin."""
    joined = F.array_join(F.transform(F.filter(genres, lambda g: g.isNotNull() & (g != "")), lambda g: norm_text(g)), " | ")
    accents = has_diacritics(title) | F.coalesce(F.exists(split_artist_list(artists), lambda a: has_diacritics(a)), F.lit(False))

    def has(text: Column, *words: str) -> Column:
        out = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(text, F.lit(w))
        return out

    def first(text: Column, marked: Column, domestic: Column) -> Column:
        out = F.when(domestic, F.lit("V-Pop")).otherwise(F.lit("Khác"))
        for rule in reversed(GENRE_RULES):
            bucket, applies = F.lit(rule["bucket"]), has(text, *rule["words"])
            if "domestic_bucket" in rule:
                bucket = F.when(domestic, F.lit(rule["domestic_bucket"])).otherwise(bucket)
            if rule.get("only_without_accents"):
                applies = applies & ~marked
            if rule.get("only_without_viet"):
                applies = applies & ~has(text, "viet")
            out = F.when(applies, bucket).otherwise(out)
        return out

    told = F.struct(F.coalesce(joined, F.lit("")).alias("text"), accents.alias("marked"))
    return _let(told, lambda t: _let(t["marked"] | has(t["text"], *DOMESTIC_WORDS), lambda domestic: first(t["text"], t["marked"], domestic)))


def genre_hint(c: Column) -> Column:
    """The genre in a list's name: without a leading 'top N' and praise at the end."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), _U + LIST_TOP, "")
    t = F.regexp_replace(t, _U + LIST_PRAISE, "")
    return _strip(F.regexp_replace(t, _U + LIST_SONGS, ""))


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str, str]]:
    """(mark, letters, composed letters) for each combining mark that composes with Latin letters, by combining class.

    Twice: a letter takes two marks at most, and marks of one class may come in either order.
    """
    pairs: dict[str, dict[str, str]] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.decomposition(chr(code)).split()
        if len(d) == 2 and not d[0].startswith("<"):
            letter, mark = (chr(int(x, 16)) for x in d)
            if unicodedata.normalize("NFC", letter + mark) == chr(code):
                pairs.setdefault(mark, {})[letter] = chr(code)
    order = sorted(pairs, key=lambda m: (unicodedata.combining(m), m))
    return [(m, "".join(pairs[m]), "".join(pairs[m].values())) for m in order] * 2


def nfc(c: Column) -> Column:
    """Latin letters and the marks behind them as composed letters; text without marks is left alone."""
    field = lambda name, v: F.lit(v).alias(name)
    marks = F.array(*[F.struct(field("mark", m), field("letters", x), field("composed", y)) for m, x, y in _compositions()])

    def compose(text: Column, m: Column) -> Column:
        """The parts between one mark, joined again: by nothing where the letter before composes with it."""
        parts = F.call_function("split", text, m["mark"], F.lit(-1))

        def part(p: Column, i: Column) -> Column:
            last = F.right(p, F.lit(1))
            other = F.call_function("translate", last, m["letters"], m["composed"])
            held = F.concat(F.left(p, F.length(p) - 1), other)
            return F.when(i == F.size(parts) - 1, p).when(other != last, held).otherwise(F.concat(p, m["mark"]))

        return F.when(F.contains(text, m["mark"]), F.array_join(F.transform(parts, part), "")).otherwise(text)

    return F.when(c.rlike(r"\p{Mn}"), F.aggregate(marks, c, compose)).otherwise(c)


def light_text(c: Column) -> Column:
    """Lower case with composed accents; tone marks on one place; punctuation becomes single spaces."""
    t = F.lower(nfc(F.coalesce(c, F.lit(""))))
    for a, b in TONE_PAIRS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return _strip(F.regexp_replace(t, r"(?U)[^\w]+", " "))


def search_query(title: Column, artists: Column, words: int = 6, names: int = 2) -> Column:
    """A search query: the first words of the title and of the first artist that are not in it."""
    t = F.slice(F.split(_strip(clean_title(title)), r"\s+"), 1, words)
    first = F.slice(F.split(_strip(F.coalesce(F.get(split_artist_list(artists), F.lit(0)), F.lit(""))), r"\s+"), 1, names)
    low = F.transform(t, lambda x: F.lower(x))
    return _strip(F.concat_ws(" ", F.array_join(t, " "), F.array_join(F.filter(first, lambda a: ~F.array_contains(low, F.lower(a))), " ")))
