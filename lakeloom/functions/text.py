"""Text helpers shared by the Spark plans and their DuckDB oracles.

Python's ``str.strip``/``str.split``/``str.splitlines`` use Unicode whitespace
and line-boundary sets; the JVM regex ``\\s`` is ASCII only.  The sets are
spelled out once here and rendered for each regex dialect.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Code points Python treats as whitespace (str.isspace), as ranges.
WHITESPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                     (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                     (0x3000, 0x3000)]
# Single-character line boundaries of str.splitlines ("\r\n" is one boundary too).
LINE_BREAKS = [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]


def _java_cp(c: int) -> str:
    return f"\\x{{{c:X}}}"


def _re2_cp(c: int) -> str:
    return f"\\x{{{c:X}}}"


def ws_class(dialect: str = "java") -> str:
    cp = _java_cp if dialect == "java" else _re2_cp
    return "[" + "".join(cp(a) if a == b else f"{cp(a)}-{cp(b)}" for a, b in WHITESPACE_RANGES) + "]"


def line_break_pattern(dialect: str = "java") -> str:
    cp = _java_cp if dialect == "java" else _re2_cp
    return "\\r\\n|[" + "".join(cp(c) for c in LINE_BREAKS) + "]"


def whitespace_chars() -> str:
    """All characters of ``WHITESPACE_RANGES``, for ``trim(BOTH chars FROM s)``."""
    return "".join(chr(c) for a, b in WHITESPACE_RANGES for c in range(a, b + 1))


def strip_pattern(dialect: str = "java") -> str:
    w = ws_class(dialect)
    return f"^{w}+|{w}+$"


# ---------------------------------------------------------------- HTML

_NON_TEXT_TAGS = {"script", "style", "template"}


class _TextNodes(HTMLParser):
    """Collect text nodes in document order, skipping script/style/template
    content, comments and declarations (what a browser would not show)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _NON_TEXT_TAGS:
            self._skip += 1

    def handle_endtag(self, tag):
        if tag in _NON_TEXT_TAGS and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        if not self._skip:
            self.nodes.append(data)


def html_text_nodes(html: str) -> list[str]:
    p = _TextNodes()
    p.feed(html)
    p.close()
    return p.nodes


def html_to_text(html: str | None, separator: str = "\n", strip: bool = True) -> str | None:
    """X1 (``strip=True``): stripped non-empty text nodes joined by ``separator``;
    X2 (``strip=False``, separator ``""``): raw concatenation."""
    if html is None:
        return None
    nodes = html_text_nodes(html)
    if strip:
        return separator.join(s.strip() for s in nodes if s.strip())
    return separator.join(nodes)
