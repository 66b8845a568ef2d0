"""Masking of secrets and home folders in text that leaves the engine."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a name secret, characters beside blanks that end a value, schemes that may stand before one, and the mask.
SECRET_WORDS = ("token", "password", "passwd", "secret", "api_key", "access_key", "private_key", "authorization", "credential", "passphrase")
VALUE_ENDS = "\"',;)]}"
SCHEMES = ("bearer", "basic", "token")
MASK = "***"

#: Extra secrets shorter than this are left: they would mask ordinary text.
SHORTEST = 4


def _class(*ranges: str, but: str = "") -> str:
    return "[" + ("^" if but else "") + "".join(ranges) + "".join(re.escape(c) for c in but) + "]"


def _words() -> str:
    """The secret words, their parts joined by a dash, an underscore or nothing."""
    return "(?:" + "|".join(w.replace("_", "[_-]?") for w in SECRET_WORDS) + ")"


def rules(start: str) -> list[tuple[str, str]]:
    """(pattern, what replaces it) in order; ``start`` is what must stand before a name, as the regex dialect says it."""
    value = _class(r"\s", but=VALUE_ENDS)
    part = _class(r"\w", r"\.", r"\-") + "*"
    name = part + _words() + part
    scheme = "(?:(?:" + "|".join(SCHEMES) + r")\s+)?"
    assigned = rf"(?i)({start}{name}[\"']?\s*\]?\s*[=:]\s*{scheme}[\"']?){value}+"
    flag = rf"(?i)(--?[\w-]*{_words()}[\w-]*\s+[\"']?){value}+"
    opaque = r"[A-Za-z0-9_\-]{10,}"
    return [
        (assigned, r"\1" + MASK),
        (flag, r"\1" + MASK),
        (r"(?i)(bearer\s+)[A-Za-z0-9._\-]{16,}", r"\1" + MASK),
        (rf"\beyJ{opaque}\.{opaque}\.{opaque}\b", MASK),
        (r"(?i)(password\s+)\S+", r"\1" + MASK),
        (r"(https?://)[^/\s:@]+:[^/\s@]+@", rf"\1{MASK}:{MASK}@"),
    ]


def trigger() -> str:
    """A text without any of this has nothing that the rules replace."""
    return f"(?i){_words()}|bearer|eyj|://"


def masked(text: Column, secrets: Sequence[str] = (), homes: Sequence[str] = ()) -> Column:
    """``text`` without secrets.

    Known ``secrets`` go wherever they stand; then what follows a secret
    name by ``=`` or ``:``, a flag of such a name, or ``password`` in a
    credentials file; bearer tokens, web tokens and credentials in URLs; home
    folders become ``~``.  Names, quotes and schemes stay.
    """
    out = text
    for s in sorted((s for s in secrets if len(s) >= SHORTEST), key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit(MASK))
    cleaned = out
    for pattern, by in rules(r"(?<![\w.])"):
        cleaned = F.regexp_replace(cleaned, pattern, by.replace("\\1", "$1"))
    out = F.when(out.rlike(trigger()), cleaned).otherwise(out)
    for home in sorted(homes, key=len, reverse=True):
        out = F.replace(out, F.lit(home), F.lit("~"))
    return out


def secret_name(name: Column) -> Column:
    """Whether a setting or variable is called like a secret."""
    return name.rlike(f"(?i){_words()}|(?:^|[_-])keys?(?:$|[_-])")
