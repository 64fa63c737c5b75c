"""Script profiles: the units whose coverage is measured, and the characters that make text valid."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values of the Bengali profile -------------------------------------------------------
BN_VOWELS = "অ আ ই ঈ উ ঊ ঋ এ ঐ ও ঔ".split()
BN_CONSONANTS = "ক খ গ ঘ ঙ চ ছ জ ঝ ঞ ট ঠ ড ঢ ণ ত থ দ ধ ন প ফ ব ভ ম য র ল শ ষ স হ ড় ঢ় য়".split()
BN_MATRAS = "া ি ী ু ূ ৃ ে ৈ ো ৌ".split()
BN_SPECIAL = "ং ঃ ঁ ্ ৎ".split()
BN_CONJUNCTS = (
    "ক্ত ক্ষ ক্র ক্ল গ্র ঙ্ক ঙ্গ চ্ছ জ্ঞ ঞ্চ ঞ্জ ট্ট ণ্ড ণ্ট ন্ত ন্দ ন্ধ ন্ন প্ত প্র ব্দ ব্র ভ্র ম্ব ম্প ল্ক ল্প ল্ল শ্চ শ্র ষ্ট ষ্ঠ "
    "স্ক স্ত স্থ স্ন স্প স্ম স্র হ্ন হ্ম হ্য হ্র র্ক র্ত র্থ র্ন র্ম র্য র্স ত্র দ্র ন্ত্র স্ত্র ষ্ট্র"
).split()
BN_DIGITS = "০১২৩৪৫৬৭৮৯"
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    name: str
    units: dict[str, list[str]] = field(hash=False)
    #: Inside of a regex class: the script's own characters, and what else a valid text may hold.
    letters: str = ""
    others: str = " ।,!?'\"\\-():;\\n"
    terminators: str = "।.?!"
    #: What a run of full stops becomes.
    stop: str = "।"

    def labelled(self) -> list[str]:
        """category:unit in inventory order."""
        return [f"{c}:{u}" for c, us in self.units.items() for u in us]


BENGALI = Profile(
    "bengali",
    {"vowel": BN_VOWELS, "consonant": BN_CONSONANTS, "matra": BN_MATRAS, "special": BN_SPECIAL, "conjunct": BN_CONJUNCTS},
    letters="\\u0980-\\u09ff",
)
LATIN = Profile(
    "latin",
    {
        "vowel": list("aeiou"),
        "consonant": list("bcdfghjklmnpqrstvwxyz"),
        "special": list("éèêçñäöüß"),
        "conjunct": "th sh ch ph wh ng nt nd st tr pr br cr sch str tion".split(),
    },
    letters="A-Za-z\\u00c0-\\u024f",
    stop=".",
)
PROFILES = {p.name: p for p in (BENGALI, LATIN)}
