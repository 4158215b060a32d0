"""Names of emoji: the longest sequence at a place becomes its published short name between colons."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Published short names of single emoji that aren't their character's name, by code point.
NAMES = """
00A9 copyright, 00AE registered, 2122 trade mark, 2194 left-right arrow, 2195 up-down arrow, 2196 up-left arrow
2197 up-right arrow, 2198 down-right arrow, 2199 down-left arrow, 21A9 right arrow curving left
21AA left arrow curving right, 2600 sun, 2611 check box with check, 261D index pointing up, 2639 frowning face
263A smiling face, 267B recycling symbol, 2695 medical symbol, 26A0 warning, 26A1 high voltage
26C8 cloud with lightning and rain, 2705 check mark button, 2714 check mark, 2733 eight-spoked asterisk
2734 eight-pointed star, 274E cross mark button, 2753 red question mark, 2754 white question mark
2755 white exclamation mark, 2757 red exclamation mark, 2763 heart exclamation, 2764 red heart, 27A1 right arrow
2934 right arrow curving up, 2935 right arrow curving down, 2B05 left arrow, 2B06 up arrow, 2B07 down arrow, 2B50 star
2B55 hollow red circle, 1F311 new moon, 1F312 waxing crescent moon, 1F313 first quarter moon, 1F314 waxing gibbous moon
1F315 full moon, 1F316 waning gibbous moon, 1F317 last quarter moon, 1F318 waning crescent moon, 1F31A new moon face
1F31B first quarter moon face, 1F31C last quarter moon face, 1F31D full moon face, 1F324 sun behind small cloud
1F325 sun behind large cloud, 1F326 sun behind rain cloud, 1F32A tornado, 1F33E sheaf of rice, 1F355 pizza
1F381 wrapped gift, 1F385 Santa Claus, 1F387 sparkler, 1F3A3 fishing pole, 1F3BD running shirt, 1F3BE tennis, 1F3BF skis
1F3C0 basketball, 1F3C3 person running, 1F3D2 ice hockey, 1F3D3 ping pong, 1F3F3 white flag, 1F3F4 black flag
1F3F8 badminton, 1F411 ewe, 1F42A camel, 1F42B two-hump camel, 1F439 hamster, 1F43A wolf, 1F43B bear, 1F43C panda
1F446 backhand index pointing up, 1F447 backhand index pointing down, 1F448 backhand index pointing left
1F449 backhand index pointing right, 1F44A oncoming fist, 1F44B waving hand, 1F44C OK hand, 1F44D thumbs up
1F44E thumbs down, 1F44F clapping hands, 1F450 open hands, 1F46F people with bunny ears, 1F470 person with veil
1F471 person: blond hair, 1F472 person with skullcap, 1F473 person wearing turban, 1F474 old man, 1F475 old woman
1F479 ogre, 1F47A goblin, 1F47D alien, 1F47F angry face with horns, 1F481 person tipping hand, 1F482 guard
1F483 woman dancing, 1F486 person getting massage, 1F487 person getting haircut, 1F4A4 ZZZ, 1F4A5 collision
1F4A6 sweat droplets, 1F4A8 dashing away, 1F4AB dizzy, 1F4AF hundred points, 1F4E2 loudspeaker, 1F4E3 megaphone
1F503 clockwise vertical arrows, 1F504 counterclockwise arrows button, 1F519 BACK arrow, 1F51A END arrow
1F51B ON! arrow, 1F51C SOON arrow, 1F51D TOP arrow, 1F54A dove, 1F575 detective, 1F590 hand with fingers splayed
1F595 middle finger, 1F596 vulcan salute, 1F601 beaming face with smiling eyes, 1F603 grinning face with big eyes
1F604 grinning face with smiling eyes, 1F605 grinning face with sweat, 1F606 grinning squinting face
1F60B face savoring food, 1F60D smiling face with heart-eyes, 1F613 downcast face with sweat, 1F618 face blowing a kiss
1F61B face with tongue, 1F61C winking face with tongue, 1F61D squinting face with tongue, 1F621 enraged face
1F624 face with steam from nose, 1F625 sad but relieved face, 1F630 anxious face with sweat
1F635 face with crossed-out eyes, 1F638 grinning cat with smiling eyes, 1F639 cat with tears of joy, 1F63A grinning cat
1F63B smiling cat with heart-eyes, 1F63C cat with wry smile, 1F63D kissing cat, 1F63E pouting cat, 1F63F crying cat
1F640 weary cat, 1F645 person gesturing NO, 1F646 person gesturing OK, 1F647 person bowing, 1F64B person raising hand
1F64C raising hands, 1F64E person pouting, 1F64F folded hands, 1F6A9 triangular flag, 1F6AB prohibited
1F6B6 person walking, 1F6C0 person taking bath, 1F916 robot, 1F917 smiling face with open hands, 1F91E crossed fingers
1F91F love-you gesture, 1F920 cowboy hat face, 1F926 person facepalming, 1F928 face with raised eyebrow
1F929 star-struck, 1F92A zany face, 1F92B shushing face, 1F92C face with symbols on mouth
1F92D face with hand over mouth, 1F92E face vomiting, 1F92F exploding head, 1F935 person in tuxedo, 1F936 Mrs. Claus
1F937 person shrugging, 1F95D kiwi fruit, 1F981 lion, 1F984 unicorn, 1F98A fox, 1F992 giraffe, 1F993 zebra, 1F9D1 person
1F9D3 older person, 1F9D4 person: beard, 1F9D5 woman with headscarf
"""
# The five skin tones from U+1F3FB on, and the flags that are spelled with tags.
TONES = ["light", "medium-light", "medium", "medium-dark", "dark"]
TAGGED = {"gbeng": "England", "gbsct": "Scotland", "gbwls": "Wales"}

_VARIANT, _JOINER, _KEYCAP, _TONE, _REGION = "\ufe0f", "\u200d", "\u20e3", 0x1F3FB, 0x1F1E6
_SIGNS = {"\u2640": "woman", "\u2642": "man"}
#: The longest form first: tagged flags, flags of two letters, keycaps, joined and toned sequences, single ones.
_PATTERN = regex.compile(
    r"\U0001F3F4[\U000E0061-\U000E007A]+\U000E007F|[\U0001F1E6-\U0001F1FF]{2}|[0-9#*]\ufe0f?\u20e3"
    r"|[\p{Extended_Pictographic}\U0001F3FB-\U0001F3FF]\ufe0f?[\U0001F3FB-\U0001F3FF]?(?:\u200d\p{Extended_Pictographic}\ufe0f?[\U0001F3FB-\U0001F3FF]?)*"
)
_TAKES_TONE = regex.compile(r"\p{Emoji_Modifier_Base}")
_CLOCK = re.compile(r"clock face (\w+)(?: oclock|(-thirty))")
#: A text without a character from here on, nor one of these, has no emoji.
_ANY = regex.compile(r"[\p{Extended_Pictographic}\U0001F1E6-\U0001F1FF\U0001F3FB-\U0001F3FF\u20e3]")


def named(table: str = NAMES) -> dict[str, str]:
    """Character to short name."""
    return {chr(int(code, 16)): name for code, name in (x.strip().split(" ", 1) for x in re.split("[,\n]", table) if x.strip())}


def published(lines: list[str]) -> dict[str, str]:
    """Sequence (without variation selectors) to short name, from lines of the published list of emoji
    for tests: code points ; status # emoji version name."""
    found = {}
    for line in lines:
        if m := re.match(r"([0-9A-F ]+?)\s*;\s*[a-z-]+\s*# \S+ E[0-9.]+ (.*)", line):
            found["".join(chr(int(c, 16)) for c in m[1].split()).replace(_VARIANT, "")] = m[2].removeprefix("flag: ")
    return found


def regions(spark: SparkSession) -> dict[str, str]:
    """Two letters to the region's English name, from the JVM's locale data."""
    locale = spark._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}


def token(name: str) -> str:
    return ":" + re.sub("[,:“”]", "", name).replace(" ", "_") + ":"


def namer(known: Mapping[str, str], flags: Mapping[str, str]):
    """A function text -> text with names. ``known`` has names of sequences and single emoji; others are
    put together by rule: flags, keycaps, tones, a person as woman or man, else a character's own name."""

    def single(c: str) -> str | None:
        if c in known:
            return known[c]
        if 0 <= (tone := ord(c) - _TONE) < len(TONES):
            return f"{TONES[tone]} skin tone"
        name = unicodedata.name(c, "").lower()
        return _CLOCK.sub(lambda m: m[1] + (m[2] or " o’clock"), name) or None

    def sequence(s: str) -> str | None:
        bare = s.replace(_VARIANT, "")
        if bare in known:
            return known[bare]
        if bare[0] == "\U0001F3F4" and len(bare) > 1 and ord(bare[1]) > 0xE0000:
            return TAGGED.get("".join(chr(ord(c) - 0xE0000) for c in bare[1:-1]))
        if ord(bare[0]) - _REGION in range(26) and len(bare) == 2:
            return flags.get("".join(chr(ord("A") + ord(c) - _REGION) for c in bare))
        if bare[-1] == _KEYCAP:
            return f"keycap {bare[0]}"
        if len(bare) == 1:
            return single(bare)
        if len(bare) == 2 and 0 <= ord(bare[1]) - _TONE < len(TONES) and _TAKES_TONE.match(bare) and (base := single(bare[0])):
            return f"{base} {single(bare[1])}" if ":" not in base else base.replace(":", f" {single(bare[1])}", 1)
        head, _, sign = bare.rpartition(_JOINER)
        if sign in _SIGNS and _JOINER not in head and (base := sequence(head)):
            who = _SIGNS[sign]
            if base.startswith("people "):
                return {"woman": "women", "man": "men"}[who] + base.removeprefix("people")
            return f"{who} {base.removeprefix('person ')}"
        return None

    def replace(m) -> str:
        s = m[0]
        if name := sequence(s):
            return token(name)
        out, i = [], 0  # no name as a whole: the longest parts that have one
        while i < len(s):
            for j in range(len(s), i, -1):
                if s[i] not in (_JOINER, _VARIANT) and s[j - 1] != _JOINER and (j - i < len(s)) and (name := sequence(s[i:j])):
                    out.append(token(name))
                    i = j
                    break
            else:
                out.append(s[i])
                i += 1
        return "".join(out)

    return lambda text: _PATTERN.sub(replace, text) if _ANY.search(text) else text


def emoji_names(text: Column, known: Mapping[str, str] | None = None, flags: Mapping[str, str] | None = None) -> Column:
    """``text`` with names for emoji. ``known`` is ``NAMES`` by default; ``published`` reads all names from the
    published list. Null stays null, and a null costs nothing: pass one where a text has no emoji."""
    known, flags = dict(known or named()), dict(flags or {})

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        name = namer(known, flags)
        return texts.map(lambda t: None if t is None else name(t))

    return run(text)
