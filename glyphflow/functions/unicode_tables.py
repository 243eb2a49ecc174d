"""Unicode property names and ranges, and the sets of code points they stand for."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

Ranges = tuple[tuple[int, int], ...]

# General categories by their long names.
CATEGORIES = {
    "Letter": "L", "Cased_Letter": "LC", "Lowercase_Letter": "Ll", "Modifier_Letter": "Lm", "Other_Letter": "Lo",
    "Titlecase_Letter": "Lt", "Uppercase_Letter": "Lu", "Mark": "M", "Spacing_Mark": "Mc", "Enclosing_Mark": "Me",
    "Nonspacing_Mark": "Mn", "Number": "N", "Decimal_Number": "Nd", "Letter_Number": "Nl", "Other_Number": "No",
    "Punctuation": "P", "Connector_Punctuation": "Pc", "Dash_Punctuation": "Pd", "Close_Punctuation": "Pe",
    "Final_Punctuation": "Pf", "Initial_Punctuation": "Pi", "Other_Punctuation": "Po", "Open_Punctuation": "Ps",
    "Symbol": "S", "Currency_Symbol": "Sc", "Modifier_Symbol": "Sk", "Math_Symbol": "Sm", "Other_Symbol": "So",
    "Separator": "Z", "Line_Separator": "Zl", "Paragraph_Separator": "Zp", "Space_Separator": "Zs", "Other": "C",
    "Control": "Cc", "Format": "Cf", "Unassigned": "Cn", "Private_Use": "Co", "Surrogate": "Cs",
}

# Blocks with their first and last code points.
BLOCKS = {
    "Basic_Latin": (0x0000, 0x007F), "Latin_1_Supplement": (0x0080, 0x00FF), "Latin_Extended_A": (0x0100, 0x017F),
    "Latin_Extended_B": (0x0180, 0x024F), "IPA_Extensions": (0x0250, 0x02AF),
    "Spacing_Modifier_Letters": (0x02B0, 0x02FF), "Combining_Diacritical_Marks": (0x0300, 0x036F),
    "Greek_and_Coptic": (0x0370, 0x03FF), "Cyrillic": (0x0400, 0x04FF), "Cyrillic_Supplement": (0x0500, 0x052F),
    "Armenian": (0x0530, 0x058F), "Hebrew": (0x0590, 0x05FF), "Arabic": (0x0600, 0x06FF), "Syriac": (0x0700, 0x074F),
    "Arabic_Supplement": (0x0750, 0x077F), "Thaana": (0x0780, 0x07BF), "NKo": (0x07C0, 0x07FF),
    "Devanagari": (0x0900, 0x097F), "Bengali": (0x0980, 0x09FF), "Gurmukhi": (0x0A00, 0x0A7F),
    "Gujarati": (0x0A80, 0x0AFF), "Oriya": (0x0B00, 0x0B7F), "Tamil": (0x0B80, 0x0BFF), "Telugu": (0x0C00, 0x0C7F),
    "Kannada": (0x0C80, 0x0CFF), "Malayalam": (0x0D00, 0x0D7F), "Sinhala": (0x0D80, 0x0DFF), "Thai": (0x0E00, 0x0E7F),
    "Lao": (0x0E80, 0x0EFF), "Tibetan": (0x0F00, 0x0FFF), "Myanmar": (0x1000, 0x109F), "Georgian": (0x10A0, 0x10FF),
    "Hangul_Jamo": (0x1100, 0x11FF), "Ethiopic": (0x1200, 0x137F), "Cherokee": (0x13A0, 0x13FF),
    "Unified_Canadian_Aboriginal_Syllabics": (0x1400, 0x167F), "Ogham": (0x1680, 0x169F), "Runic": (0x16A0, 0x16FF),
    "Tagalog": (0x1700, 0x171F), "Khmer": (0x1780, 0x17FF), "Mongolian": (0x1800, 0x18AF),
    "Latin_Extended_Additional": (0x1E00, 0x1EFF), "Greek_Extended": (0x1F00, 0x1FFF),
    "General_Punctuation": (0x2000, 0x206F), "Superscripts_and_Subscripts": (0x2070, 0x209F),
    "Currency_Symbols": (0x20A0, 0x20CF), "Combining_Diacritical_Marks_for_Symbols": (0x20D0, 0x20FF),
    "Letterlike_Symbols": (0x2100, 0x214F), "Number_Forms": (0x2150, 0x218F), "Arrows": (0x2190, 0x21FF),
    "Mathematical_Operators": (0x2200, 0x22FF), "Miscellaneous_Technical": (0x2300, 0x23FF),
    "Control_Pictures": (0x2400, 0x243F), "Optical_Character_Recognition": (0x2440, 0x245F),
    "Enclosed_Alphanumerics": (0x2460, 0x24FF), "Box_Drawing": (0x2500, 0x257F), "Block_Elements": (0x2580, 0x259F),
    "Geometric_Shapes": (0x25A0, 0x25FF), "Miscellaneous_Symbols": (0x2600, 0x26FF), "Dingbats": (0x2700, 0x27BF),
    "Miscellaneous_Mathematical_Symbols_A": (0x27C0, 0x27EF), "Supplemental_Arrows_A": (0x27F0, 0x27FF),
    "Braille_Patterns": (0x2800, 0x28FF), "Supplemental_Arrows_B": (0x2900, 0x297F),
    "Miscellaneous_Mathematical_Symbols_B": (0x2980, 0x29FF), "Supplemental_Mathematical_Operators": (0x2A00, 0x2AFF),
    "Miscellaneous_Symbols_and_Arrows": (0x2B00, 0x2BFF), "Supplemental_Punctuation": (0x2E00, 0x2E7F),
    "CJK_Radicals_Supplement": (0x2E80, 0x2EFF), "Kangxi_Radicals": (0x2F00, 0x2FDF),
    "CJK_Symbols_and_Punctuation": (0x3000, 0x303F), "Hiragana": (0x3040, 0x309F), "Katakana": (0x30A0, 0x30FF),
    "Bopomofo": (0x3100, 0x312F), "Hangul_Compatibility_Jamo": (0x3130, 0x318F), "Kanbun": (0x3190, 0x319F),
    "CJK_Strokes": (0x31C0, 0x31EF), "Katakana_Phonetic_Extensions": (0x31F0, 0x31FF),
    "Enclosed_CJK_Letters_and_Months": (0x3200, 0x32FF), "CJK_Compatibility": (0x3300, 0x33FF),
    "CJK_Unified_Ideographs_Extension_A": (0x3400, 0x4DBF), "Yijing_Hexagram_Symbols": (0x4DC0, 0x4DFF),
    "CJK_Unified_Ideographs": (0x4E00, 0x9FFF), "Yi_Syllables": (0xA000, 0xA48F), "Hangul_Syllables": (0xAC00, 0xD7AF),
    "Private_Use_Area": (0xE000, 0xF8FF), "CJK_Compatibility_Ideographs": (0xF900, 0xFAFF),
    "Alphabetic_Presentation_Forms": (0xFB00, 0xFB4F), "Arabic_Presentation_Forms_A": (0xFB50, 0xFDFF),
    "Variation_Selectors": (0xFE00, 0xFE0F), "Combining_Half_Marks": (0xFE20, 0xFE2F),
    "CJK_Compatibility_Forms": (0xFE30, 0xFE4F), "Small_Form_Variants": (0xFE50, 0xFE6F),
    "Arabic_Presentation_Forms_B": (0xFE70, 0xFEFF), "Halfwidth_and_Fullwidth_Forms": (0xFF00, 0xFFEF),
    "Specials": (0xFFF0, 0xFFFF), "Linear_B_Syllabary": (0x10000, 0x1007F), "Aegean_Numbers": (0x10100, 0x1013F),
    "Ancient_Greek_Numbers": (0x10140, 0x1018F), "Old_Italic": (0x10300, 0x1032F), "Gothic": (0x10330, 0x1034F),
    "Deseret": (0x10400, 0x1044F), "Byzantine_Musical_Symbols": (0x1D000, 0x1D0FF),
    "Musical_Symbols": (0x1D100, 0x1D1FF), "Mathematical_Alphanumeric_Symbols": (0x1D400, 0x1D7FF),
    "Emoticons": (0x1F600, 0x1F64F), "Transport_and_Map_Symbols": (0x1F680, 0x1F6FF),
    "Supplemental_Symbols_and_Pictographs": (0x1F900, 0x1F9FF), "Symbols_and_Pictographs_Extended_A": (0x1FA70, 0x1FAFF),
    "CJK_Unified_Ideographs_Extension_B": (0x20000, 0x2A6DF),
}

# Scripts with their primary ranges (first, last, first, last ...).
SCRIPTS = {
    "Latin": (0x41, 0x5A, 0x61, 0x7A, 0xAA, 0xAA, 0xBA, 0xBA, 0xC0, 0xD6, 0xD8, 0xF6, 0xF8, 0x2B8, 0x1E00, 0x1EFF),
    "Greek": (0x370, 0x373, 0x375, 0x377, 0x37A, 0x37D, 0x386, 0x386, 0x388, 0x38A, 0x38C, 0x38C, 0x38E, 0x3A1, 0x3A3, 0x3E1, 0x3F0, 0x3FF, 0x1F00, 0x1FFF),
    "Cyrillic": (0x400, 0x52F, 0x1C80, 0x1C88, 0x2DE0, 0x2DFF, 0xA640, 0xA69F),
    "Hebrew": (0x591, 0x5C7, 0x5D0, 0x5EA, 0x5EF, 0x5F4, 0xFB1D, 0xFB4F),
    "Arabic": (0x600, 0x604, 0x606, 0x60B, 0x60D, 0x61A, 0x61E, 0x61E, 0x620, 0x63F, 0x641, 0x64A, 0x656, 0x66F, 0x671, 0x6DC, 0x6DE, 0x6FF, 0x750, 0x77F, 0xFB50, 0xFDFF, 0xFE70, 0xFEFC),
    "Armenian": (0x531, 0x556, 0x559, 0x58A, 0x58D, 0x58F, 0xFB13, 0xFB17), "Georgian": (0x10A0, 0x10C5, 0x10D0, 0x10FF, 0x2D00, 0x2D2D),
    "Devanagari": (0x900, 0x97F, 0xA8E0, 0xA8FF), "Bengali": (0x980, 0x9FE), "Gurmukhi": (0xA01, 0xA76),
    "Gujarati": (0xA81, 0xAFF), "Oriya": (0xB01, 0xB77), "Tamil": (0xB82, 0xBFA), "Telugu": (0xC00, 0xC7F),
    "Kannada": (0xC80, 0xCF2), "Malayalam": (0xD00, 0xD7F), "Sinhala": (0xD81, 0xDF4), "Thai": (0xE01, 0xE5B),
    "Lao": (0xE81, 0xEDF), "Tibetan": (0xF00, 0xFDA), "Myanmar": (0x1000, 0x109F), "Khmer": (0x1780, 0x17F9),
    "Mongolian": (0x1800, 0x18AA), "Ethiopic": (0x1200, 0x139F, 0x2D80, 0x2DDE), "Cherokee": (0x13A0, 0x13FD),
    "Syriac": (0x700, 0x74A), "Thaana": (0x780, 0x7B1),
    "Han": (0x2E80, 0x2E99, 0x3005, 0x3005, 0x3007, 0x3007, 0x3400, 0x4DBF, 0x4E00, 0x9FFF, 0xF900, 0xFAFF, 0x20000, 0x2FA1F),
    "Hiragana": (0x3041, 0x309E, 0x309D, 0x309F), "Katakana": (0x30A1, 0x30FF, 0x31F0, 0x31FF, 0xFF66, 0xFF9D),
    "Hangul": (0x1100, 0x11FF, 0x3131, 0x318E, 0xA960, 0xA97F, 0xAC00, 0xD7A3), "Bopomofo": (0x3105, 0x312F, 0x31A0, 0x31BA),
    "Braille": (0x2800, 0x28FF), "Coptic": (0x3E2, 0x3EF, 0x2C80, 0x2CFF), "Deseret": (0x10400, 0x1044F),
    "Gothic": (0x10330, 0x1034A), "Old_Italic": (0x10300, 0x1031F), "Ogham": (0x1681, 0x169A), "Runic": (0x16A0, 0x16F0),
    "Yi": (0xA000, 0xA4C6), "Inherited": (0x300, 0x36F, 0x1AB0, 0x1AFF, 0x1DC0, 0x1DFF, 0xFE00, 0xFE0F),
    "Vai": (0xA500, 0xA62B), "Cham": (0xAA00, 0xAA5F), "Batak": (0x1BC0, 0x1BFF), "Balinese": (0x1B00, 0x1B7C),
    "Sundanese": (0x1B80, 0x1BBF), "Lepcha": (0x1C00, 0x1C4F), "Ol_Chiki": (0x1C50, 0x1C7F), "Tai_Tham": (0x1A20, 0x1AAF),
    "Tai_Viet": (0xAA80, 0xAADF), "New_Tai_Lue": (0x1980, 0x19DF), "Tai_Le": (0x1950, 0x1974),
    "Meetei_Mayek": (0xAAE0, 0xAAF6, 0xABC0, 0xABFF), "Kayah_Li": (0xA900, 0xA92F), "Rejang": (0xA930, 0xA95F),
    "Javanese": (0xA980, 0xA9DF), "Saurashtra": (0xA880, 0xA8D9), "Nko": (0x7C0, 0x7FA), "Tifinagh": (0x2D30, 0x2D7F),
    "Glagolitic": (0x2C00, 0x2C5F), "Tirhuta": (0x11480, 0x114DF), "SignWriting": (0x1D800, 0x1DA8B),
}

# Binary properties as categories and code points; a name without either is known but matches nothing.
BINARY = {
    "Alphabetic": "L", "ASCII": ((0x00, 0x7F),), "ASCII_Hex_Digit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)),
    "Bidi_Control": ((0x61C, 0x61C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)), "Bidi_Mirrored": (),
    "Case_Ignorable": (), "Cased": "LC", "Changes_When_Casefolded": (), "Changes_When_Casemapped": "LC",
    "Changes_When_Lowercased": "Lu", "Changes_When_Titlecased": "Lu", "Changes_When_Uppercased": "Ll",
    "Dash": ("Pd", (0x2212, 0x2212)),
    "Default_Ignorable_Code_Point": ((0xAD, 0xAD), (0x200B, 0x200F), (0x2060, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB)),
    "Deprecated": ((0x17A3, 0x17A4), (0x206A, 0x206B)), "Diacritic": ("Mn", "Mc"),
    "Emoji": ((0x2600, 0x27BF), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF)),
    "Emoji_Component": ((0x200D, 0x200D), (0x20E3, 0x20E3), (0xFE0F, 0xFE0F), (0x1F1E6, 0x1F1FF), (0x1F3FB, 0x1F3FF)),
    "Emoji_Modifier": ((0x1F3FB, 0x1F3FF),),
    "Emoji_Modifier_Base": ((0x261D, 0x261D), (0x270A, 0x270D), (0x1F385, 0x1F385), (0x1F3C3, 0x1F3C4), (0x1F3CA, 0x1F3CB), (0x1F442, 0x1F443), (0x1F446, 0x1F450), (0x1F466, 0x1F469), (0x1F645, 0x1F647)),
    "Emoji_Presentation": ((0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF)),
    "Extended_Pictographic": ((0x2600, 0x27BF), (0x1F000, 0x1FAFF)), "Extender": ((0x5F, 0x5F), (0xB7, 0x10FFFF)),
    "Grapheme_Base": ("L", "M", "N", "P", "S", "Zs", "Co"), "Grapheme_Extend": ("Mn", "Me"),
    "Hex_Digit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)), "Hyphen": ((0x2D, 0x2D), (0xAD, 0xAD), (0x2010, 0x2011)),
    "ID_Continue": ("L", "Nd", (0x5F, 0x5F)), "ID_Start": ("L", (0x5F, 0x5F)),
    "Ideographic": ((0x3006, 0x3007), (0x3021, 0x3029), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)),
    "IDS_Binary_Operator": (), "IDS_Trinary_Operator": (), "Join_Control": ((0x200C, 0x200D),),
    "Logical_Order_Exception": (), "Lowercase": "Ll", "Math": ("Sm", (0x2200, 0x22FF), (0x2A00, 0x2AFF), (0x1D400, 0x1D7FF)),
    "Noncharacter_Code_Point": ((0xFDD0, 0xFDEF), *((p * 0x10000 + 0xFFFE, p * 0x10000 + 0xFFFF) for p in range(17))),
    "Pattern_Syntax": ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "Pattern_White_Space": ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0x200E, 0x200F), (0x2028, 0x2029)),
    "Quotation_Mark": ("Pi", "Pf", (0x22, 0x22), (0x27, 0x27), (0x2018, 0x2019), (0x201C, 0x201D)),
    "Radical": ((0x2E80, 0x2EF3), (0x2F00, 0x2FD5)), "Regional_Indicator": ((0x1F1E6, 0x1F1FF),),
    "Sentence_Terminal": ((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F), (0x2026, 0x2026), (0x203C, 0x203C), (0x2047, 0x2049), (0x3002, 0x3002), (0xFF01, 0xFF01), (0xFF0E, 0xFF0E), (0xFF1F, 0xFF1F)),
    "Soft_Dotted": ((0x69, 0x6A), (0x12F, 0x12F), (0x249, 0x249), (0x268, 0x268), (0x29D, 0x29D), (0x2B2, 0x2B2), (0x1D96, 0x1D96), (0x1DA4, 0x1DA4), (0x1DA8, 0x1DA8), (0x1DB2, 0x1DB2), (0x2096, 0x2097)),
    "Terminal_Punctuation": ((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F), (0x203C, 0x203C), (0x3001, 0x3002)),
    "Unified_Ideograph": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)), "Uppercase": "Lu",
    "Variation_Selector": ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF)),
    "White_Space": ("Z", (0x09, 0x0D), (0x85, 0x85)), "XID_Continue": ("L", "Nd", (0x5F, 0x5F)), "XID_Start": ("L", (0x5F, 0x5F)),
}

LAST = sys.maxunicode


def lookup_key(name: str) -> str:
    return "".join(c for c in name.strip() if c not in "_- ").lower()


@lru_cache(maxsize=1)
def _names() -> dict[str, tuple[str, str]]:
    """Lookup key -> (canonical name, kind); where kinds share a key, the later kind's name stands."""
    found = {lookup_key(short): (short, "category") for short in CATEGORIES.values()}
    for kind, table in (("binary", BINARY), ("script", SCRIPTS), ("block", BLOCKS)):
        found |= {lookup_key(name): (name, kind) for name in table}
    return found | {lookup_key(long): (short, "category") for long, short in CATEGORIES.items()}


def normalize_name(name: str | None, also: tuple[str, ...] = ()) -> tuple[str, str] | None:
    """(canonical name, kind) of a property name, or None.

    Case, ``_``, ``-`` and spaces don't count and ``Is``/``In`` may stand before. ``also`` names further scripts or
    blocks that are valid but have no ranges here, such as java_names().
    """
    if not name or not name.strip():
        return None
    known = _names()
    extra = {lookup_key(x): (x, "named") for x in also}
    key = lookup_key(name)
    for k in (key, key[2:] if key[:2] in ("is", "in") and len(key) > 2 else key):
        if k in known or k in extra:
            return known.get(k) or extra[k]
    return None


def java_names(spark) -> tuple[str, ...]:
    """Names of all scripts that the JVM knows, as property names."""
    return tuple("_".join(w.capitalize() for w in str(s.name()).split("_")) for s in spark._jvm.java.lang.Character.UnicodeScript.values())


def merged(ranges) -> Ranges:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


def inverted(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in ranges:
        if at < a:
            out.append((at, a - 1))
        at = b + 1
    return (*out, (at, LAST)) if at <= LAST else tuple(out)


@lru_cache(maxsize=1)
def _category_ranges() -> dict[str, Ranges]:
    found: dict[str, list[list[int]]] = {}
    for cp in range(LAST + 1):
        own = found.setdefault(unicodedata.category(chr(cp)), [])
        if own and own[-1][1] == cp - 1:
            own[-1][1] = cp
        else:
            own.append([cp, cp])
    return {k: tuple((a, b) for a, b in v) for k, v in found.items()}


@lru_cache(maxsize=512)
def category_ranges(name: str) -> Ranges:
    parts = {"LC": ("Lu", "Ll", "Lt")}.get(name) or [c for c in _category_ranges() if c == name or (len(name) == 1 and c[0] == name)]
    return merged(r for c in parts for r in _category_ranges().get(c, ()))


@lru_cache(maxsize=512)
def property_ranges(name: str) -> Ranges | None:
    """The code points of a property; None for an unknown name. A block's name goes before a script's."""
    found = normalize_name(name)
    if found is None:
        return None
    canonical, kind = found
    if kind == "category":
        return category_ranges(canonical)
    if canonical in BLOCKS:
        return (BLOCKS[canonical],)
    if canonical in SCRIPTS:
        flat = SCRIPTS[canonical]
        return merged(zip(flat[::2], flat[1::2], strict=True))
    spec = BINARY.get(canonical, ())
    parts = (spec,) if isinstance(spec, str) else spec
    return merged(r for p in parts for r in (category_ranges(p) if isinstance(p, str) else (p,)))


def matches_property(code_point: int, name: str) -> bool:
    ranges = property_ranges(name) if 0 <= code_point <= LAST else None
    return any(a <= code_point <= b for a, b in ranges or ())
