"""A weighted finite-state grammar of hostile clauses.

Six small transducers read the same word classes: one remembers a negation
for a few words, one a verb of reporting, one a person that is spoken of, one
a person that something is done to, one a stated intent, and one a harm that
is intended and waits a few words for its target.  ``compose`` builds their
product.  A match leaves as a clause kind, with the weight of its word.

A clause ends at a sentence mark or a blank line, not where a line is wrapped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+|[.!?;:]|\n[^\S\n]*\n")
_NOT = re.compile("n['’]t$")

OTHER, TARGET, NEGATION, REPORT, INTENT, HARM, INSULT, BREAK, OBJECT = range(9)
#: Words of each class in the four languages.
WORDS = {
    TARGET: "you your he she they this these du dein ihr sie er tu vous il elle ils ella usted ustedes ellos",
    OBJECT: "him her them dich te toi",
    NEGATION: "not never without nobody cannot isnt arent dont doesnt wont nicht kein keine niemals ohne pas jamais sans nunca jamás sin",
    REPORT: "said says say quoted quotes reported reports wrote claimed called sagte sagt schrieb berichtet dit disait écrit rapporte dijo dice escribió",
    INTENT: "will ll shall gonna going must werde werden wird vais va allons voy vamos",
    HARM: "kill hurt destroy beat shoot burn murder töten verletzen zerstören schlagen tuer blesser détruire frapper matar herir destruir golpear",
}
CLASS_OF = {word: kind for kind, words in WORDS.items() for word in words.split()}

INSULTED, INSULTED_TARGET, THREAT, DENIED, REPORTED = range(5)
KINDS = 5
#: Words for which a negation holds.
REACH = 3


def _negation(state: int, kind: int) -> int:
    return REACH if kind == NEGATION else 0 if kind == BREAK else max(0, state - 1)


def _until_break(*opens: int):
    return lambda state, kind: 1 if kind in opens else 0 if kind == BREAK else state


def _intended(state: tuple[int, int], kind: int) -> tuple[int, int]:
    """Whether an intent was stated, and for how many words a harm it goes with looks for its target."""
    intent, waits = state
    if kind == BREAK:
        return 0, 0
    if kind == HARM and intent:
        return 1, REACH + 1
    return (1 if kind == INTENT else intent), (0 if kind in (TARGET, OBJECT) else max(0, waits - 1))


#: The transducers and their first states.
PARTS = ((_negation, 0), (_until_break(REPORT), 0), (_until_break(TARGET, OBJECT), 0), (_until_break(OBJECT), 0), (_intended, (0, 0)))


def _clause(state: tuple, kind: int) -> int | None:
    negated, reported, target, aimed, (intent, waits) = state
    if kind == HARM and intent and (negated or reported or aimed) or kind in (TARGET, OBJECT) and waits:
        return DENIED if negated else REPORTED if reported else THREAT
    if kind != INSULT:
        return None
    return DENIED if negated else REPORTED if reported else INSULTED_TARGET if target else INSULTED


def compose() -> tuple[list[list[int]], list[list[int | None]]]:
    """Next state and clause kind, by state and word class; state 0 is the start."""
    start = tuple(first for _, first in PARTS)
    number, todo = {start: 0}, [start]
    steps, clauses = [], []
    for state in todo:
        row = []
        for kind in range(9):
            after = tuple(part(s, kind) for (part, _), s in zip(PARTS, state))
            # a harm that has been told of in full does not wait for its target as well
            if kind == HARM and _clause(state, kind) is not None:
                after = (*after[:-1], (after[-1][0], 0))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        steps.append(row)
        clauses.append([_clause(state, kind) for kind in range(9)])
    return steps, clauses


STEPS, CLAUSES = compose()
SHORTEST, LONGEST = 3, 8


def entries(word: str) -> Iterable[str]:
    """Lexicon entries that match a word: its beginnings, and the word with an end mark."""
    yield word + "$"
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]


class Grammar:
    """Matches texts with a learnt lexicon of insults (entry -> weight)."""

    TABLE = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.table: dict[str, tuple[int, float]] = {}

    def _look_up(self, word: str) -> tuple[int, float]:
        if len(self.table) > self.TABLE:
            self.table.clear()
        weight = max((w for e in entries(word) if (w := self.lexicon.get(e))), default=0.0)
        kind = INSULT if weight else NEGATION if _NOT.search(word) else CLASS_OF.get(word, BREAK if not word.isalpha() else OTHER)
        got = self.table[word] = (kind, weight)
        return got

    def clauses(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """(kind, weight) of the matched clauses, and the number of words."""
        found, state, last = [], 0, -1
        words = TOKEN.findall(text.lower())
        known = self.table.get
        for at, word in enumerate(words):
            got = known(word) or self._look_up(word)
            kind = got[0]
            if kind == OTHER:
                continue
            for _ in range(min(REACH + 1, at - last - 1)):
                state = STEPS[state][OTHER]
            last = at
            clause = CLAUSES[state][kind]
            if clause is not None:
                found.append((clause, got[1]))
            state = STEPS[state][kind]
        return found, len(words)
