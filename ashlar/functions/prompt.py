"""Answer assembly around a model: message lists, intent directives, signed image maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the answer should look like, for the intents that ask for a form of their own.
DIRECTIVES = {
    "procedure": "Answer as numbered steps in the order of the context.",
    "diagnostic": "List likely causes first, then a check for each.",
    "safety": "State the immediate action first, then the background.",
    "wiring": "Name connectors and colours exactly as in the context.",
    "warranty": "Give conditions and intervals as they are written.",
}


def directive(intent: Column) -> Column:
    """The directive of an intent, empty for others."""
    table = F.create_map(*[F.lit(x) for kv in DIRECTIVES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, intent), F.lit(""))


def chat_messages(system: Column, history: Column, context: Column, question: Column) -> Column:
    """Role and content structs: system, the history's pairs in order, then context and question as one user turn."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    pairs = F.flatten(F.transform(history, lambda h: F.array(turn("user", h.question), turn("assistant", h.answer))))
    return F.concat(F.array(turn("system", system)), pairs, F.array(turn("user", F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nQUESTION: "), question))))


def signed(images: Column, signer: Callable[[Column], Column]) -> Column:
    """A map of image addresses with every value signed by a plug-in."""
    return F.transform_values(images, lambda _, url: signer(url))
