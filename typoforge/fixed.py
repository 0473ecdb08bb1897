"""Word lists, tables, constants and formats that results depend on.

Everything here is data that other tools read or write in the same form; nothing is logic.
"""

from __future__ import annotations

import builtins
import keyword

# Keys next to each other on a QWERTY keyboard.
KEYBOARD = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv",
    "h": "gyujnb", "i": "ujko", "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm",
    "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz", "t": "rfgy", "u": "yhji",
    "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}

# Comment words that stay as they are.
COMMENT_SKIP = (
    "todo", "fixme", "note", "hack", "xxx", "bug", "warning", "attention",
    "yes", "no", "true", "false", "none", "is", "in", "or", "and", "not",
    "if", "else", "elif", "for", "while", "with", "as", "from", "import",
    "def", "class", "return", "pass", "break", "continue", "try", "except",
    "finally", "raise", "yield", "the", "a", "an", "this", "that", "it",
)

# Names that are never changed, besides anything of the form __x__.
RESERVED = tuple(sorted({*keyword.kwlist, *keyword.softkwlist, *dir(builtins), "self", "cls", "__init__", "__name__", "__main__", "__file__", "__doc__"}))
KEYWORDS = tuple(keyword.kwlist)

# The edit tags' alphabet, position limit and wire forms; the first three indexes.
EDIT_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
MAX_POSITION = 30
KEEP, DELETE, UNKNOWN = "$KEEP", "$DELETE", "$UNK"
SPECIAL_TAGS = (KEEP, DELETE, UNKNOWN)
SWAP, DEL, INS, SUB, CASE, REPLACE = "$SWAP_", "$DEL_", "$INS_", "$SUB_", "$CASE_", "$REPLACE_"
IGNORED_LABEL = -100

# Sizes of the splits of the known sources.
SPLIT_SIZES = {
    "demo": {"train": 8},
    "mbpp": {"train": 500, "validation": 90, "test": 374},
    "magicoder": {"train": 23284, "validation": 5000, "test": 10000},
    "codealpaca": {"train": 1336, "validation": 300, "test": 1000},
    "github_python": {"test": 3000},
}
GITHUB_SEED = 2026
GITHUB_CAP = 3000
GITHUB_MIN_CHARS = 20

# Prompt formats of the language-model fixers, and the markers cut from their output.
LM_PREFIX = "Fix grammar and typos in this Python code:\n"
LM_SUFFIX = "\n\nCorrected code:\n"
LM_MARKERS = r"<\|fim_(?:prefix|middle|suffix|pad)\|>|<\|repo_name\|>|<\|file_sep\|>"
BASELINE_MODELS = ("SpellCheck", "Typos")
METRICS = (
    "total_samples", "exact_match_rate", "identifier_precision", "identifier_recall", "identifier_f1",
    "avg_normalized_edit_distance", "clean_samples_total", "clean_false_positive_count",
    "clean_false_positive_rate", "total_time_seconds", "avg_time_per_sample_seconds", "avg_time_per_kb_seconds",
)
