"""Words of a text, as the evaluation passages are compared by."""

from __future__ import annotations

import html
import re

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|\[/?(?:quote|b|i|u|s|url|img|code|size|color|font|list|center|left|right|spoiler|email|youtube|\*)(?:=[^\[\]]*)?\]", re.I | re.S)
#: Zero-width characters and the soft hyphen (fixed values).
_UNSEEN = re.compile("[­​‌‍⁠﻿]")
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 after decoding entities once, tags to spaces, unseen characters dropped, lower case. None has none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(_UNSEEN.sub("", text).lower())
