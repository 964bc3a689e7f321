"""Language records. A new language is a new record; no operator changes.

Patterns are Java regular expressions as Spark's regexp functions read them:
``d`` makes the newline the only line end, ``m`` anchors ``^`` at each line and
``U`` gives ``\\w``, ``\\s`` and ``\\b`` their Unicode meaning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FLAGS = "(?dmU)"

# Comments and string literals. Repeats are possessive, so that a long literal
# is consumed by a loop and not by recursion. Branch rules begin with the first
# characters of their words, which rejects most positions at once.
_LINE_COMMENT = r"//[^\n]*+\n?"
_BLOCK_COMMENT = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
_DOUBLE = r'"(?:[^"\\]|\\(?s:.)|\\\z)*+(?:"|\z)'
_SINGLE = r"'(?:[^'\\]|\\(?s:.)|\\\z)*+(?:'|\z)"
_TEMPLATE = r"`(?:[^`\\]|\\(?s:.)|\\\z)*+(?:`|\z)"
_RAW = r"`[^`]*+(?:`|\z)"
_HASH_COMMENT = r"#[^\n]*+\n?"
_TRIPLE = (
    r'"""(?:[^"\\]|\\(?s:.)|\\\z|"(?!""))*+(?:"""|\z)'
    r"|'''(?:[^'\\]|\\(?s:.)|\\\z|'(?!''))*+(?:'''|\z)"
)
_PY_DOUBLE = r'"(?:[^"\\\n]|\\(?s:.)|\\\z)*+(?:"|\z|(?=\n))'
_PY_SINGLE = r"'(?:[^'\\\n]|\\(?s:.)|\\\z)*+(?:'|\z|(?=\n))"


# Upper score of each rank; above the last comes F.
RANK_BANDS = ((5, "A"), (10, "B"), (20, "C"), (30, "D"))


@dataclass(frozen=True)
class LanguageSpec:
    language: str
    extensions: tuple[str, ...]
    # Signature with its name groups marked NAME, and the same with INDENT.
    signature: str
    literals: tuple[str, ...]
    quotes: str
    branch_rules: tuple[tuple[str, int], ...]
    body: str = "brace"  # or "indent"
    # A signature-like line that must not start a function (keyword blocks).
    decoy: str | None = None
    # End of text closes an open body; otherwise the function is dropped.
    keep_unclosed: bool = True
    # The first brace is found by lexing, and a ";" before it means no body.
    lexed_head: bool = False
    nested: bool = True
    # Match arms count as branches.
    match_arms: bool = False
    # A function's result lists the functions inside it as well.
    lists_inner: bool = False
    name_groups: int = field(default=1)
    # Upper score of each rank, lines counted behind a function where all start
    # at the file's first line, and the scanner that serves the language.
    rank_bands: tuple[tuple[int, str], ...] = RANK_BANDS
    lines_behind: int = 0
    security_tool: str | None = None

    @property
    def plain_signature(self) -> str:
        return self.signature.replace("NAME", r"\w+").replace("INDENT", r"[ \t]*")

    @property
    def named_signature(self) -> str:
        return self.signature.replace("NAME", r"(\w+)").replace("INDENT", r"[ \t]*")

    @property
    def literal(self) -> str:
        """A comment or string, behind a look at its first character."""
        return f"(?=[{self.literal_starts}])(?:{'|'.join(self.literals)})"

    @property
    def literal_starts(self) -> str:
        return self.quotes + ("#" if self.body == "indent" else "/")


# Words that the loose method form would take for a name.
JS_RESERVED = (
    "if", "for", "while", "switch", "catch", "return", "function", "do", "else", "try",
    "finally", "throw", "typeof", "new", "in", "of", "with", "yield", "await", "async",
    "const", "let", "var", "class", "extends", "import", "export", "default", "case", "break",
    "continue", "this", "super", "void", "delete", "instanceof",
)
_RESERVED = "(?:" + "|".join(JS_RESERVED) + r")\b"

# File extensions, and signature forms per language.
PYTHON = LanguageSpec(
    language="python",
    extensions=(".py",),
    signature=r"^INDENT(?:async\s+)?def\s+NAME\s*\(.*?\).*?:",
    literals=(_HASH_COMMENT, _TRIPLE, _PY_DOUBLE, _PY_SINGLE),
    quotes="\"'",
    branch_rules=(
        (r"(?=[aefiow])\b(?:if|elif|for|while|except|assert|and|or)\b", 1),
        (r"^[ \t]*case\s[^\n=]*:", 1),
    ),
    body="indent",
    rank_bands=(*RANK_BANDS, (40, "E")),
    lines_behind=1,
    security_tool="bandit",
)
JAVASCRIPT = LanguageSpec(
    language="javascript",
    extensions=(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"),
    signature=(
        r"^INDENT(?:"
        r"(?:async\s+)?function\s*\*?\s*(?!" + _RESERVED + r")NAME\s*\([^)]*\)"
        r"|(?:const|let|var)\s+(?!" + _RESERVED + r")NAME\s*=\s*(?:async\s+)?"
        r"(?:\([^)]*\)\s*=>|\w+\s*=>|function\s*\*?\s*\w*\s*\([^)]*\))"
        r"|(?:async\s+)?(?!" + _RESERVED + r")NAME\s*\([^)]*\)\s*\{"
        r")"
    ),
    decoy=r"^[ \t]*(?:async\s+)?" + _RESERVED + r"\s*\([^)]*\)\s*\{",
    literals=(_LINE_COMMENT, _BLOCK_COMMENT, _DOUBLE, _SINGLE, _TEMPLATE),
    quotes="\"'`",
    branch_rules=(
        (r"(?=[cfiw&|?])(?:\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|(?<!\?)\?(?![?.:,)=]))", 1),
    ),
    nested=False,
    name_groups=3,
    security_tool="eslint_security",
)
RUST = LanguageSpec(
    language="rust",
    extensions=(".rs",),
    signature=(
        r"^INDENT(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe)\s+)*"
        r"fn\s+NAME\s*(?:<[^>]*>)?\s*\("
    ),
    literals=(_LINE_COMMENT, _BLOCK_COMMENT, _DOUBLE),
    quotes='"',
    branch_rules=((r"(?=[filw&|])(?:\b(?:if|while|for|loop)\b|&&|\|\|)", 1),),
    keep_unclosed=False,
    lexed_head=True,
    match_arms=True,
    lists_inner=True,
    security_tool="clippy",
)
GO = LanguageSpec(
    language="go",
    extensions=(".go",),
    signature=r"^func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?NAME\s*\(",
    literals=(_LINE_COMMENT, _BLOCK_COMMENT, _DOUBLE, _RAW),
    quotes='"`',
    branch_rules=((r"(?=[cfi&|])(?:\b(?:if|for|case)\b|&&|\|\|)", 1),),
    security_tool="gosec",
)

# Registration order decides which extension wins.
LANGUAGES: tuple[LanguageSpec, ...] = (PYTHON, JAVASCRIPT, RUST, GO)
