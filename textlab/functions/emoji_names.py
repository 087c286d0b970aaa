"""Default emoji dictionary: short names derived from the Unicode database.

A name is the lower-cased character name with underscores. The table below holds
common emoji whose published short name differs. Any other dictionary can be passed
to the text functions instead.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Code points with the Unicode property Emoji (without ASCII and flags).
EMOJI_RANGES = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 "
    "25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 "
    "2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B "
    "267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE "
    "26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 "
    "2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 "
    "2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 "
    "303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 "
    "1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B "
    "1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 "
    "1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC "
    "1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F "
    "1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC "
    "1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 "
    "1FA90-1FABD 1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8 1FAF0-1FAF8"
)

# Published short names which are not the character name.
SHORT_NAMES = {
    "❤": "red_heart", "😁": "beaming_face_with_smiling_eyes", "😆": "grinning_squinting_face",
    "😅": "grinning_face_with_sweat", "😄": "grinning_face_with_smiling_eyes",
    "😃": "grinning_face_with_big_eyes", "🤣": "rolling_on_the_floor_laughing",
    "😍": "smiling_face_with_heart-eyes", "😘": "face_blowing_a_kiss",
    "😋": "face_savoring_food", "😜": "winking_face_with_tongue",
    "😝": "squinting_face_with_tongue", "😛": "face_with_tongue", "😭": "loudly_crying_face",
    "😢": "crying_face", "😱": "face_screaming_in_fear", "😡": "enraged_face",
    "😠": "angry_face", "😤": "face_with_steam_from_nose", "😩": "weary_face",
    "😫": "tired_face", "😪": "sleepy_face", "😥": "sad_but_relieved_face",
    "😰": "anxious_face_with_sweat", "😓": "downcast_face_with_sweat",
    "😖": "confounded_face", "😣": "persevering_face", "😞": "disappointed_face",
    "😔": "pensive_face", "😌": "relieved_face", "😲": "astonished_face",
    "😵": "face_with_crossed-out_eyes", "😷": "face_with_medical_mask",
    "😇": "smiling_face_with_halo", "😈": "smiling_face_with_horns",
    "👿": "angry_face_with_horns", "☺": "smiling_face", "☹": "frowning_face",
    "🙁": "slightly_frowning_face", "🙂": "slightly_smiling_face", "🙃": "upside-down_face",
    "🙄": "face_with_rolling_eyes", "🤔": "thinking_face", "🤗": "smiling_face_with_open_hands",
    "🤷": "person_shrugging", "🤦": "person_facepalming", "🙏": "folded_hands",
    "🙌": "raising_hands", "👏": "clapping_hands", "👍": "thumbs_up", "👎": "thumbs_down",
    "👌": "OK_hand", "👊": "oncoming_fist", "✊": "raised_fist", "✌": "victory_hand",
    "👋": "waving_hand", "💪": "flexed_biceps", "👉": "backhand_index_pointing_right",
    "👈": "backhand_index_pointing_left", "👆": "backhand_index_pointing_up",
    "👇": "backhand_index_pointing_down", "☝": "index_pointing_up", "💩": "pile_of_poo",
    "💯": "hundred_points", "🔥": "fire", "✨": "sparkles", "⭐": "star", "🎉": "party_popper",
    "🎂": "birthday_cake", "🎁": "wrapped_gift", "🎄": "Christmas_tree", "🎅": "Santa_Claus",
    "☀": "sun", "❄": "snowflake", "☕": "hot_beverage", "🍺": "beer_mug",
    "🍻": "clinking_beer_mugs", "🍷": "wine_glass", "🍕": "pizza", "🍔": "hamburger",
    "💀": "skull", "☠": "skull_and_crossbones", "👀": "eyes", "💔": "broken_heart",
    "💕": "two_hearts", "💖": "sparkling_heart", "💗": "growing_heart", "💓": "beating_heart",
    "💘": "heart_with_arrow", "💙": "blue_heart", "💚": "green_heart", "💛": "yellow_heart",
    "💜": "purple_heart", "🖤": "black_heart", "♥": "heart_suit", "✔": "check_mark",
    "✅": "check_mark_button", "❌": "cross_mark", "❗": "red_exclamation_mark",
    "❓": "red_question_mark", "‼": "double_exclamation_mark", "⚽": "soccer_ball",
    "🏈": "american_football", "🎶": "musical_notes", "📷": "camera", "📱": "mobile_phone",
    "🐶": "dog_face", "🐱": "cat_face", "🙈": "see-no-evil_monkey", "🙉": "hear-no-evil_monkey",
    "🙊": "speak-no-evil_monkey", "💁": "person_tipping_hand", "🙋": "person_raising_hand",
    "🙅": "person_gesturing_NO", "🙆": "person_gesturing_OK", "😀": "grinning_face",
    "©": "copyright", "®": "registered", "™": "trade_mark",
}

# Skin tones, and the bases in this dictionary that take them.
SKIN_TONES = {
    "🏻": "light", "🏼": "medium-light", "🏽": "medium", "🏾": "medium-dark", "🏿": "dark",
}
TONED = "👍👎👌👊✊✌👋💪👉👈👆👇☝🙏🙌👏🤷🤦💁🙋🙅🙆🎅"


def _base_name(ch: str) -> str | None:
    if ch in SHORT_NAMES:
        return SHORT_NAMES[ch]
    name = unicodedata.name(ch, "")
    return name.lower().replace(" ", "_") or None


@lru_cache(maxsize=1)
def _names() -> tuple[tuple[str, str], ...]:
    out: dict[str, str] = {}
    for r in EMOJI_RANGES.split():
        lo, _, hi = r.partition("-")
        for cp in range(int(lo, 16), int(hi or lo, 16) + 1):
            name = _base_name(chr(cp))
            if name:
                out[chr(cp)] = name
                out[chr(cp) + "\N{VARIATION SELECTOR-16}"] = name
    for base in TONED:
        for tone, word in SKIN_TONES.items():
            out[base + tone] = f"{out[base]}_{word}_skin_tone"
    for key in "0123456789#*":
        out[f"{key}\N{VARIATION SELECTOR-16}\N{COMBINING ENCLOSING KEYCAP}"] = f"keycap_{key}"
    return tuple(out.items())


def default_emoji_names() -> dict[str, str]:
    """A fresh copy of the default ``emoji -> name`` dictionary."""
    return dict(_names())
