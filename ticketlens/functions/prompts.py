"""Reply-prompt rendering (P15) and reply clean-up.

Only the prompt projection is built; calling a language model is a
per-row network client and is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.text import strip_ws

# The reference's prompt texts.
USER_PROMPT_LINES = [
    "Ticket Category : ",
    "Priority        : ",
    "Customer Tone   : ",
    "Subject         : ",
    "Description     : ",
]
USER_PROMPT_TAIL = "\n\nWrite a suggested reply for the support agent to send to this customer."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def user_prompt(category, priority, sentiment, subject, description) -> Column:
    """The user prompt, one line per field."""
    parts = []
    for i, (head, c) in enumerate(zip(USER_PROMPT_LINES,
                                      [category, priority, sentiment, subject, description])):
        if i:
            parts.append(F.lit("\n"))
        parts.append(F.lit(head))
        parts.append(_col(c).cast("string"))
    parts.append(F.lit(USER_PROMPT_TAIL))
    return F.concat(*parts)


def clean_reply(c) -> Column:
    """Strip surrounding whitespace of a generated reply."""
    return strip_ws(c)
