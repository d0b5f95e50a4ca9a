"""Registry of sentence detectors, and their compilation for two regex dialects.

A pattern is written once, with ``<w>`` for the characters of a word (within a class), ``<W>`` for
one of them, ``<s>`` for a blank and ``<b>`` for a word boundary. Dialect ``python`` reads them as
Unicode, ``re2`` as ASCII and without line mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, flags and patterns of the detectors.
DETECTORS = {
    "Passive Voice": ("i", "<b>(?:am|is|are|was|were|be|been|being)<s>+(?:<W>+ed|done|made|sent|read|built|kept|held|set|put|run|written|shown|given|taken|found|got|gotten|seen|known|thrown|drawn)<b>"),
    "Semicolon Used": ("", ";"),
    "Contraction Used": ("i", "<b><W>+['’](?:t|re|ve|ll|d|s|m)<b>"),
    "Nominalization": ("i", "<b>(?:perform(?:s|ed)? an?|conduct(?:s|ed)? an?|provide(?:s|d)? a|carry out|carries out|make use of|makes use of)<b>"),
    "Marketing Adjective": (
        "i",
        "<b>(?:seamless|seamlessly|robust|powerful|cutting-edge|effortless|effortlessly|world-class|next-generation|revolutionary|blazing|lightning-fast|elegant|turnkey|state-of-the-art|game-changing|battle-tested|enterprise-grade|supercharge|unlock|unleash)<b>",
    ),
    "Phrasal Verb": (
        "i",
        "<b>(?:spin up|spin down|reach out|dive into|dives into|diving into|kick off|kicks off|roll out|rolls out|tear down|ramp up|circle back|drill down|spun up|reaching out)<b>",
    ),
    "Banned Synonym": (
        "i",
        "<b>(?:begin|begins|commence|commences|initiate|initiates|originate|utilize|utilizes|utilizing|leverage|leverages|leveraging|facilitate|facilitates|ensure|ensures|ensuring|obtain|obtains|acquire|acquires|demonstrate|demonstrates|additionally|furthermore|moreover|utilization|aforementioned|henceforth|therein|whilst|amongst|numerous|myriad|plethora|prior to|subsequent to)<b>",
    ),
    "Modal Hedge": ("i", "<b>(?:it'?s? (?:is )?important to note|it should be noted|it is worth noting|please note that|as mentioned|as noted above)<b>"),
    "-ing Main Verb": ("i", "<b>(?:am|is|are|was|were)<s>+<W>+ing<b>"),
    "Stacked Auxiliaries": ("i", "<b>(?:may help to|may be able to|might be able to|can help to|could potentially|may possibly)<b>"),
    "Missing Article": (
        "m",
        "^<s>*(?:Turn|Remove|Install|Open|Close|Press|Push|Pull|Lift|Lower|Insert|Connect|Disconnect|Set|Check|Make|Adjust|Apply|Move|Rotate|Slide|Tighten|Loosen|Replace|Clean|Fill|Drain)<s>+[a-z]",
    ),
    "Em-Dash Overuse": ("", "—"),
    "Three+ Nouns in a Row": ("i", "<b><W>+<s>+<W>+<s>+<W>+<s>+<W>+<b>"),
    "Historical Analogy Stacking": ("", "<b>[A-Z][<w>&' -]{1,40}<s>+(?:did not|didn'?t)<s>+(?:build|invent|create|start|make)<b>"),
    "Content Duplication": ("m", "^.{0,10}$"),
}
#: Detectors of the gate: all but those that are judged by document there.
GATE = [n for n in DETECTORS if n not in ("Historical Analogy Stacking", "Content Duplication")]

_ASCII_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def java_pattern(name: str, dialect: str = "re2") -> str:
    """The pattern of a detector as Java regex text."""
    flags, p = DETECTORS[name]
    if dialect == "python":
        head = "d" + ("i" if "i" in flags else "") + ("m" if "m" in flags else "") + "U"
        return f"(?{head})" + p.replace("<w>", "\\w").replace("<W>", "\\w").replace("<s>", "[\\s\\x1c-\\x1f]").replace("<b>", "\\b")
    head = "d" + ("iu" if "i" in flags else "")
    p = p.replace("$", "\\z") if p.endswith("$") else p
    return f"(?{head})" + p.replace("<w>", "0-9A-Za-z_").replace("<W>", "[0-9A-Za-z_]").replace("<s>", "[\\t\\n\\f\\r ]").replace("<b>", _ASCII_EDGE)


def re2_pattern(name: str) -> str:
    """The same pattern as RE2 text, for SQL engines built on it."""
    flags, p = DETECTORS[name]
    return ("(?i)" if "i" in flags else "") + p.replace("<w>", "0-9A-Za-z_").replace("<W>", "[0-9A-Za-z_]").replace("<s>", "[\\t\\n\\f\\r ]").replace("<b>", "\\b")


def register_detector(name: str, pattern: str, flags: str = "") -> None:
    """Add a detector of one's own (in the notation above)."""
    DETECTORS[name] = (flags, pattern)


def hits(text: Column, name: str, dialect: str = "re2") -> Column:
    if name in ("Semicolon Used", "Em-Dash Overuse"):
        return text.contains(DETECTORS[name][1])
    return text.rlike(java_pattern(name, dialect))


def first_match(text: Column, name: str, dialect: str = "re2", size: int = 60) -> Column:
    return F.substring(F.regexp_extract(text, java_pattern(name, dialect), 0), 1, size)
