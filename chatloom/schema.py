"""Types shared by every operator, plus the fixed values the semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

# A sample row: ``ord`` is the position key that every order-dependent rule uses
# (keep-first dedup, tail split, first-N quota, auto ids).
SAMPLE = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("messages", MESSAGES),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Characters Python's str.strip()/str.split() treat as whitespace, as one regex
# class that Java regex and RE2 read the same way.
WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same set for Java regex: with the (?U) flag, \s is Unicode White_Space, which equals
# str.isspace() except for \x1c-\x1f. Patterns using it must start with (?U).
WS_CLASS_JAVA = r"[\s\x1c-\x1f]"

VALID_ROLES = ("system", "user", "assistant")

# Role aliases applied by repair / strict validation (after lower + strip).
REPAIR_ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant"}

# Role table for conversations records (`from` lower-cased; unknown kept as written).
SHAREGPT_ROLE_MAP = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "system": "system",
}

# Chat rendering used for training text.
CHAT_TURN_OPEN = "<|im_start|>"
CHAT_TURN_CLOSE = "<|im_end|>"

# Separators of the canonical dedup text.
CANON_MSG_SEP = "\x00"
CANON_ROLE_SEP = "\x01"

# Texts of warnings and errors. Users match on them in logs, so they must stay as they are.
MESSAGE_TEXT = {
    "empty_content": "Removed message with empty content (role={role})",
    "stripped_whitespace": "Stripped whitespace from message content (role={role})",
    "unknown_role": "Removed message with unknown role {role} (normalized: {norm})",
    "normalized_role": "Normalized role {role} -> {norm}",
    "no_messages": "Dropped sample: no messages remaining after cleanup.",
    "no_user": "Dropped sample: no 'user' turn after repair.",
    "no_assistant": "Dropped sample: no 'assistant' turn after repair.",
    "first_not_user": "Dropped sample: first non-system turn is {role}, expected 'user'.",
    "consecutive_roles": "Dropped sample: consecutive {role} turns at positions {i},{j}.",
    "sample_warning": "Sample {n}: {detail}",
    "strict_missing_user": "Sample {n}: missing 'user' turn.",
    "strict_missing_assistant": "Sample {n}: missing 'assistant' turn.",
    "strict_no_messages": "Sample {n}: has no messages.",
    "strict_empty_content": "Sample {n}, message {j}: empty content.",
    "strict_unknown_role": "Sample {n}, message {j}: unknown role {role}.",
    "low_score": "Sample {n}: dropped, quality score {score}/{scale} < {least}",
    "mixed_format": ("Mixed dataset format: some records use 'conversations', others use 'messages'. "
                     "All records must use the same format."),
    "empty_dataset": "Dataset is empty after dedup, quality gate, and validation.",
}

DEFAULT_SIMILARITY = 0.85
DEFAULT_MIN_ASSISTANT_CHARS = 50
DEFAULT_NUM_PERM = 128
CHUNK_CHARS = 3000
CHARS_PER_TOKEN = 3.8
PRICE_PER_1K_TOKENS = 0.0001
STALL_LIMIT = 5
