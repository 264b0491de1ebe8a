"""Second opinion for documents the model is unsure about."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed

# Answers a batch of prompts; called on executors, so it must be picklable.
Responder = Callable[[list[str]], list[str | None]]

# Order in which an answer is searched for labels.
ANSWER_ORDER = (*fixed.LABELS, fixed.UNKNOWN)


PROMPT_HEAD = f"Which kind of document is this? Answer with one of: {', '.join(ANSWER_ORDER)}.\n\n"
PROMPT_TAIL = "\n\nYour answer, one word:"


def prompt(text: Column) -> Column:
    """The question for one document, with the start of its text."""
    return F.concat(
        F.lit(PROMPT_HEAD), F.substring(text, 1, fixed.PROMPT_CHARS), F.lit(PROMPT_TAIL)
    )


def parse_answer(answer: Column, labels: Sequence[str] = ANSWER_ORDER) -> Column:
    """First label, in list order, that the answer contains in any case; Unknown otherwise."""
    chain = F
    for label in labels:
        chain = chain.when(F.contains(F.lower(answer), F.lit(label.lower())), F.lit(label))
    return chain.otherwise(F.lit(fixed.UNKNOWN))


def ask(prompts: Column, responder: Responder | None) -> Column:
    """Answers to the non-null prompts; null when there is no responder or it fails.

    Callers blank the prompt of every row that needs no answer, so the responder sees only the
    uncertain documents of each Arrow batch.
    """
    if responder is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(questions: pd.Series) -> pd.Series:
        def answer(batch: list[str]) -> list[str | None]:
            try:
                return list(responder(batch))
            except Exception:
                # One bad document must not cost the rest of its batch their answers.
                return [None] if len(batch) == 1 else [answer([one])[0] for one in batch]

        answers = pd.Series([None] * len(questions), index=questions.index, dtype=object)
        asked = questions.notna()
        if asked.any():
            answers[asked] = answer(list(questions[asked]))
        return answers

    return run(prompts)
