"""Audit prompts for offline inference: one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PROMPT_HEAD = (
    "Act as an application security reviewer. Report every security weakness in the "
)
PROMPT_FORMAT = """ source that follows, whatever its severity: injection, authentication,
cryptography, secrets, configuration and pitfalls of the language itself.

Write one block per weakness, in exactly this form and with nothing in between:

---
SEVERITY: CRITICAL|HIGH|MEDIUM|LOW
TYPE: <name of the weakness>
LINE: <line number or N/A>
DESCRIPTION: <one sentence>
IMPACT: <one sentence>
FIX: <concrete remedy or short snippet>
---

If there is nothing to report, write only: NO_VULNERABILITIES

Source:
```
"""
PROMPT_TAIL = "\n```\n"


def build_prompts(files: DataFrame) -> DataFrame:
    """Prompt text per row of (file_hash, language, text); the whole text is included."""
    return files.select(
        "file_hash",
        F.concat(F.lit(PROMPT_HEAD), F.col("language"), F.lit(PROMPT_FORMAT), F.col("text"),
                 F.lit(PROMPT_TAIL)).alias("prompt"))
