"""One form for text that looks the same: a code-point kernel over whole Arrow buffers.

A batch of strings is copied to one numpy array of code points. Lookup-table gathers and expansion offsets
take apart canonical and look-neutral compatibility forms, drop signs without a look, turn every blank
into a space and every look-alike letter into the one that stands for its class; combining marks are put in canonical order and
composed in vector passes; blanks at the ends of rows are cut. No string call per row.

Kept apart on purpose: letter case, visible accents, raised and lowered signs, circled and squared signs,
fractions, and letters that are merely similar (0 and O, 1 and l, rn and m).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborloom.session import ship_code, written

#: Classes of letters and signs that print alike, under one that stands for them. Cyrillic, Greek, Armenian, Cherokee, Coptic, Lisu, IPA.
CLASSES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐⲂ", "C": "СᏟᏣꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІӀΙꓲⲒ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗⲔ", "L": "Ꮮꓡ", "M": "МΜᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅᏚꓢ", "T": "ТΤᎢꓔⲦ",
    "U": "ꓴ", "V": "Ꮩꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫⲬ", "Y": "ҮΥꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "сⲥ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛ",
    "s": "ѕ", "u": "սυ", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "Γ": "ГⲄ", "Λ": "Ⲗ", "Π": "ПⲠ", "Φ": "ФⲪ", "Θ": "Ѳ", "Ψ": "Ѱ", "κ": "кⲕᴋ", "ψ": "ѱ", "ω": "ѡⲱ", "α": "ɑ", "ε": "ɛ", "ı": "ι",
    "в": "ʙ", "г": "ᴦ", "м": "ᴍ", "н": "ʜ", "п": "ᴨ", "т": "ᴛ",
    "Æ": "Ӕ", "æ": "ӕ", "Ə": "Ә", "ə": "ә", "Ɵ": "Ө", "ɵ": "ө", "Ʒ": "Ӡ", "ʒ": "ӡ", "Đ": "ÐƉ", "-": "‐", "’": "ʼ",
}
LOOK_ALIKES = {c: stands for stands, cs in CLASSES.items() for c in cs}

#: Compatibility forms whose look is that of what they stand for, leaving aside width and typeface.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: The long s has a look of its own.
OWN_LOOK = {"ſ"}
#: Format signs that do print: Arabic, Syriac and Kaithi number and abbreviation marks.
PRINTED_FORMATS = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Signs without a look outside the format category: grapheme joiner, Hangul fillers, Khmer inherent vowels, Mongolian and other variation selectors.
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
BLANKS = {0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0x2028, 0x2029, 0x2800}
_RANGES = ((0, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
_DEEP = 64
#: Bytes of text that one step of the kernel handles; it needs some tens of bytes for each.
STEP = 4_000_000


def look(ch: str) -> str:
    """The characters a character prints as, taken apart; reference rule for the tables."""
    out = ""
    for c in unicodedata.normalize("NFD", ch):
        cp, kind = ord(c), unicodedata.category(c)
        if kind == "Zs" or cp in BLANKS:
            out += " "
        elif cp in UNSEEN or kind == "Cc" or (kind == "Cf" and cp not in PRINTED_FORMATS):
            pass
        else:
            tag, *parts = unicodedata.decomposition(c).split() or [""]
            if tag in SAME_LOOK and c not in OWN_LOOK and parts[0] != "0020":
                out += "".join(look(chr(int(p, 16))) for p in parts)
            else:
                out += LOOK_ALIKES.get(c, c)
    return out


def canonical_string(text: str) -> str:
    """The form of one text, character by character: the plain statement of what the kernel computes."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(map(look, text)))).strip(" ")


class Tables(NamedTuple):
    single: np.ndarray  # code point a code point becomes, if one
    length: np.ndarray  # how many it becomes
    offset: np.ndarray  # where in pool, if several
    pool: np.ndarray
    ccc: np.ndarray  # combining classes
    pairs: np.ndarray  # sorted first << 21 | second of composable pairs
    composed: np.ndarray
    second: np.ndarray  # whether a starter can be the second of a pair


@lru_cache(1)
def tables() -> Tables:
    """Built once per process from the interpreter's character data by the rule ``look``."""
    n = 0x110000
    single, length = np.arange(n, dtype=np.int32), np.ones(n, np.uint8)
    offset, ccc, second = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.zeros(n, bool)
    pool, pairs = [], {}
    for a, b in _RANGES:
        for cp in range(a, b):
            if 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            if k := unicodedata.combining(c):
                ccc[cp] = k
            if (out := look(c)) != c:
                length[cp] = len(out)
                if len(out) == 1:
                    single[cp] = ord(out)
                elif out:
                    offset[cp] = len(pool)
                    pool.extend(map(ord, out))
            d = unicodedata.decomposition(c)
            if d and d[0] != "<" and len(parts := d.split()) == 2 and unicodedata.normalize("NFC", c) == c:
                x, y = (int(p, 16) for p in parts)
                pairs[x << 21 | y] = cp
                if not unicodedata.combining(chr(y)):
                    second[y] = True
    keys = np.array(sorted(pairs), np.int64)
    return Tables(single, length, offset, np.array(pool, np.int32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), second)


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings and where each string starts (one more entry than strings)."""
    strings = strings.cast(pa.large_string())
    bounds = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return points, before[bounds - bounds[0]]


def strings_of(points: np.ndarray, starts: np.ndarray, valid: np.ndarray | None) -> pa.Array:
    """The reverse of ``code_points``."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=before[1:])
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(before[starts].tobytes()), pa.py_buffer(data), mask)


def _expand(points: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    length = t.length[points].astype(np.int64)
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(length, out=before[1:])
    out = np.empty(before[-1], np.int32)
    one = length == 1
    out[before[:-1][one]] = t.single[points[one]]
    many = np.flatnonzero(length > 1)
    k = 0
    while len(many):
        out[before[many] + k] = t.pool[t.offset[points[many]] + k]
        k += 1
        many = many[length[many] > k]
    return out, before[starts]


def _drop(points: np.ndarray, starts: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(~gone, out=before[1:])
    return points[~gone], before[starts]


def _found(keys: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(t.pairs, keys), len(t.pairs) - 1)
    return t.pairs[at] == keys, t.composed[at]


def _compose_marks(points: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Put marks in canonical order and compose them with the starter they follow, one mark per cluster a pass."""
    ccc = t.ccc[points].astype(np.int64)
    if not ccc.any():
        return points, starts
    head = ccc == 0
    head[starts[:-1][starts[:-1] < len(points)]] = True
    cluster = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    if ((ccc[1:] < ccc[:-1]) & ~head[1:]).any():
        points = points[np.lexsort((ccc, cluster))]
        ccc = t.ccc[points].astype(np.int64)
    points = points.copy()
    rank = np.arange(len(points)) - first[cluster]
    marks = np.flatnonzero(rank > 0)
    order = marks[np.argsort(rank[marks], kind="stable")]
    edges = np.searchsorted(rank[order], np.arange(1, min(int(rank.max()), _DEEP) + 2))
    gone, last = np.zeros(len(points), bool), np.zeros(len(first), np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = order[a:b]
        c = cluster[at]
        s = first[c]
        hit, made = _found(points[s].astype(np.int64) << 21 | points[at], t)
        hit &= (last[c] < ccc[at]) & (ccc[s] == 0)
        points[s[hit]] = made[hit]
        gone[at[hit]] = True
        last[c[~hit]] = ccc[at[~hit]]
    # Beyond _DEEP marks on one letter: the rest of each such cluster in one plain pass.
    for at in order[edges[-1] :][np.argsort(order[edges[-1] :], kind="stable")]:
        c, s = cluster[at], first[cluster[at]]
        hit, made = _found(np.array([int(points[s]) << 21 | int(points[at])]), t)
        if hit[0] and last[c] < ccc[at] and ccc[s] == 0:
            points[s], gone[at] = made[0], True
        else:
            last[c] = ccc[at]
    return _drop(points, starts, gone)


def _compose_starters(points: np.ndarray, starts: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Compose a starter with the starter right after it: Hangul by arithmetic, a few vowel signs by table."""
    while len(points) > 1:
        a, b = points[:-1].astype(np.int64), points[1:].astype(np.int64)
        inside = np.ones(len(b), bool)
        cut = starts[1:-1]
        inside[cut[(cut > 0) & (cut < len(points))] - 1] = False
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        hit = t.second[points[1:]]
        made = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28, np.where(lvt, a + b - 0x11A7, 0))
        if hit.any():
            at = np.flatnonzero(hit)
            ok, new = _found(a[at] << 21 | b[at], t)
            made[at[ok]] = new[ok]
        hit = (made > 0) & inside
        hit[1:] &= ~hit[:-1]  # of overlapping pairs the first; a later pass takes the rest
        if not hit.any():
            break
        points = points.copy()
        at = np.flatnonzero(hit)
        points[at] = made[at]
        gone = np.zeros(len(points), bool)
        gone[at + 1] = True
        points, starts = _drop(points, starts, gone)
    return points, starts


def _trim(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.flatnonzero(points != 0x20)
    lo = np.searchsorted(seen, starts[:-1])
    hi = np.searchsorted(seen, starts[1:])
    seen = np.append(seen, 0)
    filled = hi > lo
    a = np.where(filled, seen[np.minimum(lo, len(seen) - 1)], starts[:-1])
    b = np.where(filled, seen[hi - 1] + 1, starts[:-1])
    edge = np.zeros(len(points) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return _drop(points, starts, np.cumsum(edge)[:-1] == 0)


def canonical_points(points: np.ndarray, starts: np.ndarray, trim: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The kernel on code points; ``starts`` bounds the rows."""
    t = tables()
    points, starts = _expand(points, starts, t)
    points, starts = _compose_marks(points, starts, t)
    points, starts = _compose_starters(points, starts, t)
    return _trim(points, starts) if trim else (points, starts)


def _steps(strings: pa.Array) -> Iterator[pa.Array]:
    """Slices of about STEP bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(strings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, a = np.append(0, np.cumsum(sizes)), 0
    while a < len(strings):
        b = max(a + 1, int(np.searchsorted(before, before[a] + STEP, side="right")) - 1)
        yield strings.slice(a, b - a)
        a = b


def canonical_array(strings: pa.Array) -> pa.Array:
    """Canonical forms of an Arrow string array; null stays null."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    out = []
    for part in _steps(strings):
        points, starts = code_points(part)
        valid = None if part.null_count == 0 else part.is_valid().to_numpy(zero_copy_only=False)
        out.append(strings_of(*canonical_points(points, starts), valid).cast(pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def with_canonical(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``, the canonical form of the string ``column``.

    Defined results: null stays null, an empty text and one of blanks and unseen signs only become empty; the form
    of a form is itself; texts of any length are treated whole; further columns pass through.
    """
    ship_code(df.sparkSession)
    return df.withColumn(out, F.arrow_udf(canonical_array, "string")(F.col(column)))


def look_alike_classes(words: DataFrame) -> DataFrame:
    """``(id, word, canonical, class_id)`` of the distinct non-empty words of ``words(id, word)``.

    class_id is the smallest id of the words of the same look. Rows with a null id or a null or empty word
    are in no class; repeated rows count once; a word under several ids has several rows.
    """
    rows = words.where("id is not null and word is not null and word <> ''").select(F.col("id").cast("int"), "word").distinct()
    forms = with_canonical(rows, "word", "canonical")
    least = forms.groupBy("canonical").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    return forms.join(least, "canonical").select("id", "word", "canonical", "class_id", "n")


def look_alike_pairs(words: DataFrame) -> DataFrame:
    """``(id1, id2)``, id1 < id2: the pairs of ids whose words look the same (the result asked for is all pairs)."""
    rows = words.where("id is not null and word is not null and word <> ''").select(F.col("id").cast("int"), "word").distinct()
    forms = written(with_canonical(rows, "word", "canonical").select("id", "canonical").distinct(), "looks")
    left, right = forms.withColumnRenamed("id", "id1"), forms.withColumnRenamed("id", "id2")
    return left.join(right, "canonical").where("id1 < id2").select("id1", "id2").distinct()
