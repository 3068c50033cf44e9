"""Activity codes of time-log lines, by keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords and the code of the first group that a text has one of.  A star ends a prefix, an underscore is any word.
KEYWORDS = [
    ("fishing, overshot, jarring", 19),
    ("kick, well control, shut in, shutin, flow check, flowcheck, sidpp, sicp", 27),
    ("ream, reaming, reamed, back ream*, backream*", 3),
    ("wait on cement, waiting on cement, woc", 13),
    ("bop test*, test bop*, test the bop*, testing bop*, testing the bop*", 15),
    ("run casing*, run _ casing*, running casing*, running _ casing*, casing run*", 12),
    ("pooh, rih, trip, tripping, wiper trip*", 6),
    ("wireline*, logging, log run*, logs run*", 11),
    ("drill, drilled, drilling", 2),
    ("circulat*", 5),
]
LOSSES = "losses, loss of returns, loss of circulation, lcm, lost circulation*"
#: Losses are circulation if a text says so, else lost time.
CIRCULATION, LOST_TIME = 5, 24


def _any(keywords: str) -> str:
    """A pattern of whole words and phrases; blanks in phrases may be hyphens."""
    one = lambda k: re.sub(r"\s+", "[- ]", k.strip().rstrip("*")).replace("_", r"\S+") + ("" if k.strip().endswith("*") else r"\b")
    return r"(?i)\b(?:" + "|".join(map(one, keywords.split(","))) + ")"


def code(text: Column) -> Column:
    """The code of a line, null without a keyword."""
    out = F.when(text.rlike(_any(LOSSES)), F.when(text.rlike("(?i)circulat"), CIRCULATION).otherwise(LOST_TIME))
    for keywords, number in KEYWORDS:
        out = out.when(text.rlike(_any(keywords)), number)
    return out
