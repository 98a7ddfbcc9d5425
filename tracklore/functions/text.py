"""Name cleaning as column expressions; everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns whose exact form decides which names are equal -----------------

FEATURED_PATTERNS = [
    r"\(feat\.?\s+(.*?)\)",
    r"\(featuring\s+(.*?)\)",
    r"\(with\s+(.*?)\)",
    r"\[ft\.?\s+(.*?)\]",
    r"\[featuring\s+(.*?)\]",
    r"featuring\s+(.+)$",
    r"feat\.?\s+(.+)$",
]
COLLABORATION_SEPARATOR = r"\s+&\s+|(?i)\s+and\s+|(?i)\s+x\s+|(?i)\s+vs\.?\s+"
ALBUM_SUFFIXES = [
    r"\s*\(.*?deluxe.*?\)",
    r"\s*\(.*?remaster.*?\)",
    r"\s*\(.*?reissue.*?\)",
    r"\s*\(.*?anniversary.*?\)",
    r"\s*\(.*?expanded.*?\)",
    r"\s*\(.*?special.*?edition.*?\)",
    r"\s*\(.*?collector.*?\)",
    r"\s*\(.*?limited.*?edition.*?\)",
    r"\s*\(.*?super.*?deluxe.*?\)",
    r"\s*\[.*?uk.*?\]",
    r"\s*\[.*?us.*?\]",
    r"\s*\[.*?japan.*?\]",
    r"\s*\[.*?bonus.*?\]",
    r"\s*-\s*Single$",
    r"\s*\(EP\)$",
]
TRACK_SUFFIXES = [
    r"\s*\(.*?radio.*?edit.*?\)",
    r"\s*\(.*?album.*?version.*?\)",
    r"\s*\(.*?single.*?version.*?\)",
    r"\s*\(.*?original.*?mix.*?\)",
    r"\s*\(.*?instrumental.*?\)",
    r"\s*\(.*?acoustic.*?\)",
    r"\s*\(.*?demo.*?\)",
    r"\s*\(.*?bonus.*?track.*?\)",
    r"\s*-\s*\d{4}\s*Remaster(ed)?$",
    r"\s*-\s*Remaster(ed)?$",
]
LIVE_PATTERN = r"(?i)\blive"

# --- cleaning ----------------------------------------------------------------------------


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


BLANKS = " \t\n\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)



def strip(value: Column | str) -> Column:
    return F.btrim(_col(value), F.lit(BLANKS))


def squeeze(value: Column | str) -> Column:
    """Whitespace runs to one blank, trimmed; blank becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(_col(value), r"\s+", " ")), F.lit(""))


def clean_artist(value: Column | str) -> Column:
    unified = F.replace(squeeze(value), F.lit("Feat."), F.lit("feat."))
    return F.replace(unified, F.lit("Featuring"), F.lit("feat."))


def title_case(value: Column | str) -> Column:
    """Capitalise after every non-letter, not only after blanks."""
    runs = F.regexp_extract_all(_col(value), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def fold_capitals(value: Column | str) -> Column:
    """ALL CAPS longer than two characters becomes Title Case."""
    value = _col(value)
    shouting = (value == F.upper(value)) & (value != F.lower(value)) & (F.length(value) > 2)
    return F.when(shouting, title_case(F.lower(value))).otherwise(value)


def split_collaboration(value: Column | str) -> Column:
    parts = F.transform(F.split(_col(value), COLLABORATION_SEPARATOR), strip)
    return F.filter(parts, lambda part: part != "")


def artist_parts(raw: Column | str, override: Column | None = None) -> Column:
    """Individual artists behind one credited name; an override wins when present."""
    parts = F.coalesce(split_collaboration(fold_capitals(clean_artist(raw))), F.array().cast("array<string>"))
    return parts if override is None else F.coalesce(override, parts)


def _strip_all(value: Column, patterns: list[str]) -> Column:
    return reduce(lambda acc, pattern: strip(F.regexp_replace(acc, "(?i)" + pattern, "")), patterns, value)


def split_featured(title: Column | str) -> Column:
    """struct(clean_title, featured, is_live) of a track title."""
    title = F.coalesce(_col(title), F.lit(""))
    rest, names = title, []
    for pattern in FEATURED_PATTERNS:
        flagged = "(?i)" + pattern
        names.append(F.when(rest.rlike(flagged), split_collaboration(F.regexp_extract(rest, flagged, 1))))
        rest = strip(F.regexp_replace(rest, flagged, ""))
    empty = F.array().cast("array<string>")
    rest = strip(F.regexp_replace(rest, r"\(\s*\)", ""))
    rest = strip(F.regexp_replace(rest, r"\[\s*\]", ""))
    return F.struct(
        rest.alias("clean_title"),
        F.concat(*[F.coalesce(found, empty) for found in names]).alias("featured"),
        title.rlike(LIVE_PATTERN).alias("is_live"),
    )


def canonical_album(title: Column | str, override: Column | None = None) -> Column:
    cleaned = fold_capitals(_strip_all(F.coalesce(_col(title), F.lit("")), ALBUM_SUFFIXES))
    return cleaned if override is None else F.coalesce(override, cleaned)


def canonical_track(title: Column | str, override: Column | None = None) -> Column:
    cleaned = fold_capitals(_strip_all(split_featured(title)["clean_title"], TRACK_SUFFIXES))
    return cleaned if override is None else F.coalesce(override, cleaned)


# --- slugs -------------------------------------------------------------------------------


def _latin_folding() -> tuple[str, str]:
    """Accented Latin letters with a one-letter ASCII base, by Unicode decomposition."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0].isalpha():
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


# Letters without a Unicode decomposition.
EXTRA_FOLDING = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th"}
EXTRA_SINGLE = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "ı": "i", "Ð": "D", "ð": "d"}
LATIN_SOURCE, LATIN_TARGET = _latin_folding()

# Common Latin spellings of Cyrillic and Greek letters (capitals follow from them), and of kana syllables.
CYRILLIC = dict(zip("абвгдезийклмнопрстуфхыэ", "abvgdeziiklmnoprstufkye")) | {
    "й": "i", "х": "kh", "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "ъ": "", "ь": "",
    "є": "ie", "і": "i", "ї": "i", "ґ": "g", "ў": "u", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz",
}
GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυφω", "abgdeziiklmnxoprsstyfo")) | {"η": "i", "θ": "th", "χ": "ch", "ψ": "ps"}
KANA_ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも",
    "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ",
}
KANA = {"や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "n", "ゔ": "vu"}
IRREGULAR_KANA = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu"}


def _kana() -> dict[str, str]:
    """Hiragana and katakana syllables; the syllable before a small ya, yu, yo or vowel loses its own vowel to it."""
    single = {c: row + vowel for row, letters in KANA_ROWS.items() for c, vowel in zip(letters, "aiueo")} | KANA | IRREGULAR_KANA
    table = {}
    for c, sound in single.items():
        if sound.endswith("i") and len(sound) > 1:
            for small, glide in zip("ゃゅょ", ("a", "u", "o")):
                table[c + small] = sound[:-1] + ("" if sound in ("shi", "chi", "ji") else "y") + glide
        for small, vowel in zip("ぁぃぅぇぉ", "aiueo"):
            if sound in ("fu", "vu", "te", "de", "u", "shi", "chi", "ji", "tsu"):
                table[c + small] = {"u": "w"}.get(sound, sound.rstrip("aiueo")) + vowel
    table |= single | dict(zip("ぁぃぅぇぉゃゅょゎ", ("a", "i", "u", "e", "o", "ya", "yu", "yo", "wa")))
    return table | {"".join(chr(ord(c) + 0x60) for c in kana): sound for kana, sound in table.items()}


SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ"
TOKEN = rf"(?s)[ぁ-ヺ][{SMALL_KANA}]?|."


def _spellings() -> Column:
    """The tables as one map, shallow however many letters it has."""
    letters = CYRILLIC | GREEK
    letters |= {c.upper(): sound.capitalize() for c, sound in letters.items() if c.upper() != c and len(c.upper()) == 1}
    table = letters | _kana()
    return F.map_from_arrays(F.split(F.lit(" ".join(table)), " "), F.split(F.lit(" ".join(table.values())), " "))


def transliterate(value: Column | str) -> Column:
    """Cyrillic, Greek and kana in Latin letters, letter by letter; a small tsu doubles what follows, a bar is left out."""
    def spelled(text: Column) -> Column:
        bare = F.regexp_replace(F.translate(text, *_accented_greek()), "ー", "")
        return let(_spellings(), lambda table: F.array_join(F.transform(
            F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0)),
            lambda t: F.coalesce(
                F.try_element_at(table, t),
                # Two syllables that make no sound together.
                F.concat(F.try_element_at(table, F.substring(t, 1, 1)), F.try_element_at(table, F.substring(t, 2, 1))), t)), ""))

    def latin(text: Column) -> Column:
        doubled = F.regexp_replace(F.regexp_replace(spelled(text), "[っッ]([a-z])", "$1$1"), "[っッ]", "")
        return F.when(text.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsHiragana}\p{IsKatakana}]"), doubled).otherwise(text)

    return let(_col(value), latin)


def _accented_greek() -> tuple[str, str]:
    """Accented Greek letters and their bare forms, by Unicode decomposition."""
    pairs = [(chr(code), unicodedata.normalize("NFD", chr(code))[0]) for code in [*range(0x386, 0x3CF), *range(0x1F00, 0x2000)]]
    pairs = [(c, base) for c, base in pairs if c != base and "Α" <= base <= "ω"]
    return "".join(c for c, _b in pairs), "".join(b for _c, b in pairs)




def ascii_fold(value: Column | str) -> Column:
    folded = F.translate(
        _col(value), LATIN_SOURCE + "".join(EXTRA_SINGLE), LATIN_TARGET + "".join(EXTRA_SINGLE.values())
    )
    for letter, replacement in EXTRA_FOLDING.items():
        folded = F.replace(folded, F.lit(letter), F.lit(replacement))
    return F.regexp_replace(folded, r"\p{M}+", "")


def slug(value: Column | str) -> Column:
    """Lower-case ASCII words joined by '-'; thousands separators vanish."""
    plain = F.regexp_replace(F.lower(ascii_fold(transliterate(value))), r"(?<=\d),(?=\d)", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))


def entity_slug(value: Column | str) -> Column:
    """Slug as a grouping key. Names without ASCII letters keep their own text, so they stay apart."""
    return F.coalesce(F.nullif(slug(value), F.lit("")), F.lower(strip(value)))


def matching_form(value: Column | str) -> Column:
    return strip(F.lower(ascii_fold(value)))
