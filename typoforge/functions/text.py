"""Texts as Column expressions: targets, prompts, masking, clean-up, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import LM_MARKERS, LM_PREFIX, LM_SUFFIX


def target(fixed: Column, code: Column) -> Column:
    """fixed, or code where fixed is null or empty."""
    return F.coalesce(F.nullif(fixed, F.lit("")), code)


def mask_names(code: Column, corrupted: Column, mask: str) -> Column:
    """code with each corrupted name replaced by the mask, one after another, wherever the text occurs."""
    return F.aggregate(F.filter(corrupted, lambda c: F.coalesce(c != "", F.lit(False))), code, lambda acc, c: F.replace(acc, c, F.lit(mask)))


def lm_prompt(code: Column) -> Column:
    return F.concat(F.lit(LM_PREFIX), code, F.lit(LM_SUFFIX))


def chat_prompt(code: Column, names: Column, template: str) -> Column:
    """A template with {code} (stripped) and {names} (sorted, as JSON)."""
    strip = F.regexp_replace(F.regexp_replace(code, r"^\s+", ""), r"\s+$", "")
    return F.replace(F.replace(F.lit(template), F.lit("{names}"), F.to_json(F.array_sort(names))), F.lit("{code}"), strip)


def clean_output(text: Column) -> Column:
    """Generated text without leaked markers and without the white space from its last line feed on."""
    return F.regexp_replace(F.regexp_replace(text, LM_MARKERS, ""), r"\n\s*\z", "")


def python_blocks(text: Column) -> Column:
    """The fenced Python blocks of a text, joined by a blank line; null if there are none."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```python\s*\n(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, "\n\n"))


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """The factor of a linear warm-up followed by a cosine decay to 0."""
    up = step.cast("double") / F.lit(float(max(1, warmup)))
    done = (step - warmup).cast("double") / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, up).otherwise(F.greatest(F.lit(0.0), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(3.141592653589793) * done))))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds before a retry: base doubled each time up to a limit, within a quarter by jitter in -1..1, 0.1 at least."""
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return F.greatest(F.lit(0.1), delay * (1 + F.lit(0.25) * (jitter if jitter is not None else F.lit(0.0))))


def padded(ids: Column, length: Column, pad: Column) -> Column:
    """An array cut or filled up on the right to a length."""
    return F.concat(F.slice(ids, F.lit(1), length), F.array_repeat(pad, F.greatest(length - F.size(ids), F.lit(0))))


def byte_size(n: Column) -> Column:
    """Bytes as B, KB or MB, with one decimal from KB on."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024 * 1024)), F.lit(" MB")))
    )


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def argmax(values: Column) -> Column:
    """The first position (from 0) of the largest value; null of an empty array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def stamp() -> Column:
    """The time of the query as text, for run records."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
