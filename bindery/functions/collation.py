"""Collation of Japanese labels: kana weights, long vowels and sort keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the hiragana from U+3041 to U+3093, in code point order.
KANA_WEIGHTS = [
    4, 5, 7, 8, 11, 12, 13, 14, 16, 17, 19, 20, 22, 23, 24, 26, 27, 29, 30, 32, 33, 35, 36, 37, 38,
    40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63,
    66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89,
    91, 92, 93, 94, 95, 96, 97, 98, 99, 100,
]
SPACE_WEIGHT, ALPHANUMERIC_WEIGHT, LITERAL = 3, 2, 0x10000
# Hiragana by the vowel they end in; ん has none.
VOWELS = {
    "a": "ぁあかがさざただなはばぱまゃやらゎわゕ",
    "i": "ぃいきぎしじちぢにひびぴみりゐ",
    "u": "ぅうくぐすずっつづぬふぶぷむゅゆるゔ",
    "e": "ぇえけげせぜてでねへべぺめれゑゖ",
    "o": "ぉおこごそぞとどのほぼぽもょよろを",
}
# The sign that a prolonged mark becomes after each vowel, and marks without weight.
PROLONGED = "ー"
LONG = {"a": "ゕ", "i": "ゖ", "u": "゗", "e": "゘", "o": "ゟ"}
IGNORED = "ー・ヽヾゝゞ"
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_AS_HIRAGANA = "".join(chr(ord(c) - 0x60) for c in _KATAKANA)
_LIKE = {"ゔ": "う", "ゕ": "か", "ゖ": "け"}


def hiragana(x: Column) -> Column:
    """Katakana as the hiragana of the same sound."""
    return F.translate(x, _KATAKANA, _AS_HIRAGANA)


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def long_vowels(label: Column) -> Column:
    """Each prolonged mark becomes the sign of the vowel before it, also after another mark; one
    without a vowel before it stays. The vowel is handed on from character to character."""
    vowel = _map({c: v for v, cs in VOWELS.items() for c in cs})
    sign = _map(LONG)
    zero = F.struct(F.lit(None).cast("string").alias("vowel"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        mark = c == PROLONGED
        return F.struct(F.when(mark, s.vowel).otherwise(F.try_element_at(vowel, hiragana(c))).alias("vowel"), F.concat(s.out, F.when(mark & s.vowel.isNotNull(), F.try_element_at(sign, s.vowel)).otherwise(c)).alias("out"))

    return F.aggregate(F.split(label, ""), zero, step, lambda s: s.out)


def kana_key(label: Column) -> Column:
    """Weights of a label's characters: kana of both scripts alike, marks left out, other characters after all by code point."""
    table = {chr(0x3041 + k): w for k, w in enumerate(KANA_WEIGHTS)}
    weights = _map(table | {k: table[v] for k, v in _LIKE.items()})
    chars = F.filter(F.split(label, ""), lambda c: (c != "") & ~c.isin(list(IGNORED)))
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(weights, hiragana(c)), F.when(c == " ", SPACE_WEIGHT).when(c.rlike("^[A-Za-z0-9]$"), ALPHANUMERIC_WEIGHT), F.ascii(c) + LITERAL))
