"""Unicode compatibility folding (NFKC) as Columns.

The tables are made from the character data of Python's ``unicodedata`` when they are first asked for. Plain ASCII takes no
part, characters that fold to one character go through ``translate``, and only texts that hold a multi-character fold or a
mark are taken apart, ordered and put together again.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where Hangul syllables and their parts begin, and how many vowels and finals there are.
_SYLLABLE, _LEAD, _VOWEL, _FINAL, _VOWELS, _FINALS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28
_ENTRY, _VALUE = "\u0001", "\u0002"
_CLASS = 0x100


def _char_class(points: list[int]) -> str:
    """A regular expression class; neighbours are written as ranges."""
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{p:X}}}")
            start = None
    return "[" + "".join(out) + "]"


@lru_cache
def _tables() -> dict:
    single, parts, pairs, marks, joins = {}, {}, {}, {}, set()
    for p in range(0x80, sys.maxunicode + 1):
        c = chr(p)
        if 0xD800 <= p < 0xE000 or _SYLLABLE <= p < _SYLLABLE + 11172:
            continue
        if cc := unicodedata.combining(c):
            marks[p] = cc
        folded, taken = unicodedata.normalize("NFKC", c), unicodedata.normalize("NFKD", c)
        if len(folded) == 1 and folded != c:
            single[c] = folded
        if taken != c:
            parts[c] = taken
        two = unicodedata.decomposition(c)
        if two and not two.startswith("<") and " " in two and unicodedata.normalize("NFC", c) == c:
            pair = "".join(chr(int(x, 16)) for x in two.split())
            pairs[pair] = c
            joins.add(ord(pair[1]))
    many = {ord(c) for c in parts if len(unicodedata.normalize("NFKC", c)) > 1}
    jamo = {*range(_VOWEL, _VOWEL + _VOWELS), *range(_FINAL + 1, _FINAL + _FINALS)}
    busy = {*marks, *joins, *many, *jamo}
    return {"from": "".join(single), "to": "".join(single.values()), "parts": parts, "pairs": pairs, "marks": marks, "busy": "".join(map(chr, sorted(busy))), "mark": _char_class(sorted(marks))}


def _map(entries: dict) -> Column:
    return F.str_to_map(F.lit(_ENTRY.join(k + _VALUE + v for k, v in entries.items())), F.lit(_ENTRY), F.lit(_VALUE))


def _composed(s: Column) -> Column:
    """Canonical composition of ``s``, taken apart, marks put in order."""
    t = _tables()
    parts, pairs = _map(t["parts"]), _map(t["pairs"])
    points = "".join(map(chr, t["marks"])), "".join(chr(_CLASS + cc) for cc in t["marks"].values())
    cc = lambda ch: F.when(ch.rlike(t["mark"]), F.ascii(F.translate(ch, *points)) - _CLASS).otherwise(F.lit(0))
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)(.)"))
    apart = F.array_join(F.transform(chars(s), lambda ch: F.coalesce(F.try_element_at(parts, ch), ch)), "")
    clusters = F.regexp_extract_all(apart, F.lit(f"(?s)(^{t['mark']}+|.{t['mark']}*)"))
    ordered = F.flatten(F.transform(clusters, lambda c: F.array_sort(F.transform(chars(c), lambda ch, i: F.struct(cc(ch).alias("cc"), i.alias("i"), ch.alias("ch"))))))
    none = F.lit("")

    def joined(a: Column, b: Column) -> Column:
        x, y = F.ascii(a), F.ascii(b)
        lead, vowel, final = x - _LEAD, y - _VOWEL, y - _FINAL
        syllable = F.when(lead.between(0, 18) & vowel.between(0, _VOWELS - 1), _SYLLABLE + (lead * _VOWELS + vowel) * _FINALS)
        syllable = syllable.when(x.between(_SYLLABLE, _SYLLABLE + 11171) & ((x - _SYLLABLE) % _FINALS == 0) & final.between(1, _FINALS - 1), x + final)
        return F.coalesce(F.try_element_at(pairs, F.concat(a, b)), F.decode(F.unhex(F.hex(syllable)), "UTF-16BE"))

    def step(state: Column, x: Column) -> Column:
        free = (state["marks"] == "") | (state["last"] < x["cc"])
        one = F.when(free & (state["base"] != ""), joined(state["base"], x["ch"]))
        row = lambda done, base, marks, last: F.struct(done.alias("done"), base.alias("base"), marks.alias("marks"), last.alias("last"))
        taken = row(state["done"], one, state["marks"], state["last"])
        starts = row(F.concat(state["done"], state["base"], state["marks"]), x["ch"], none, F.lit(0))
        follows = row(state["done"], state["base"], F.concat(state["marks"], x["ch"]), x["cc"])
        return F.when(one.isNotNull(), taken).when(x["cc"] == 0, starts).otherwise(follows)

    begin = F.struct(none.alias("done"), none.alias("base"), none.alias("marks"), F.lit(0).alias("last"))
    return F.aggregate(ordered, begin, step, lambda a: F.concat(a["done"], a["base"], a["marks"]))


def nfkc(c: Column) -> Column:
    """``c`` in Unicode's normal form NFKC; null stays null. Tables follow the Unicode version of the driver's Python."""
    t = _tables()
    one = F.translate(c, t["from"], t["to"])
    plain = F.translate(one, t["busy"], "") == one
    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(plain, one).otherwise(_composed(c))
