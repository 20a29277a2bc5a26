"""Column expressions (JVM-side, codegen-friendly) used by the operators."""

from chatloom.functions.text import bind, fill, py_repr, tokens, ustrip
from chatloom.functions.messages import (
    assistant_chars,
    canonical_text,
    first_content,
    normalize_role,
    render_chat,
)

__all__ = [
    "assistant_chars",
    "bind",
    "canonical_text",
    "fill",
    "first_content",
    "normalize_role",
    "py_repr",
    "render_chat",
    "tokens",
    "ustrip",
]
