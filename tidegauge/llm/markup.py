"""Page markup that nests, taken out in one pass whatever its depth."""

from __future__ import annotations

import regex

_INNER = regex.compile(r"\{\{[^{}]*\}\}")
_BRACES = regex.compile(r"\{\{|\}\}")


def without_templates(text: str) -> str:
    """text with every matched {{...}} replaced by a space, however deep it nests; braces without a partner stay."""
    if "{{" not in text:
        return text
    # Most templates don't nest, or once; the full pass takes what is left.
    text = _INNER.sub(" ", _INNER.sub(" ", text))
    if "{{" not in text:
        return text
    open_at: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in _BRACES.finditer(text):
        if m.group() == "{{":
            open_at.append(m.start())
        elif open_at:
            start = open_at.pop()
            # A pair swallows the pairs within it.
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    if not spans:
        return text
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return " ".join([*out, text[at:]])
