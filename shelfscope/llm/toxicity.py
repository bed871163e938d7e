"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: abuse, threat, target, negation, report, other. Four small transducers rewrite the symbols of a
clause one after the other: negation and reported speech mark what stands in their scope, a target marks abuse or threat
near it, before or after. They are composed into one machine, a table of (state, symbol). What leaves it are matched
patterns such as ``abuse, targeted, negated``; a match weighs as much as its word and its pattern together, in log odds. A
text is as likely toxic as at least one of its matches is meant.

Weights are counted on labelled texts: families of near copies count once, the lexicon of abuse consists of the words
that labels tie to toxic texts beyond chance, and a few fixed words carry prior counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import hinted, require, stage, texts

OTHER, ABUSE, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATED, REPORTED, TARGETED = 1, 2, 4
# Words after a negation that it reaches, and words between a target and what it is the target of.
NEGATION_SCOPE, TARGET_GAP = 3, 4

# Words of each class in English, German, French and Spanish.
CLASS_WORDS = {
    ABUSE: "idiot moron stupid loser scum trash pathetic worthless disgusting dumb fool dummkopf trottel abschaum imbécile crétin ordure idiota imbécil estúpido basura",
    THREAT: "kill hurt destroy punish smash strangle töten umbringen vernichten verprügeln tuer frapper détruire étrangler matar golpear destruir ahorcar",
    TARGET: "you your yours he she him her they them du dich dir dein deine euch ihr ihn tu toi te ton vous votre il elle ils tú ti usted ustedes ella ellos",
    NEGATION: "not never no don isn aren wasn nicht kein keine keinen nie niemals pas jamais aucun aucune nunca ni tampoco",
    REPORT: "said says told wrote called quoted claimed sagte schrieb nannte zitierte behauptete dit disait écrivait appelait dijo escribió llamó según",
}
# Log odds, before any label is seen, that a match is meant; and how many labelled families they are worth.
PRIOR_ODDS = {ABUSE: 1.0, THREAT: -1.5}
PRIOR_SHIFT = {NEGATED: -2.5, REPORTED: -1.5, TARGETED: 1.0}
PRIOR_FAMILIES = 4
# A word joins the lexicon if labels depend on it beyond this likelihood ratio (G squared), towards toxic by these log odds.
LEAST_RATIO, LEAST_ODDS = 25.0, 0.5
SHINGLE = 5

CLAUSE = re.compile(r"[^.!?;:|\n]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# A symbol of a transducer is (class, marks); a step gives the next state and the symbols that leave.
Symbol = tuple[int, int]
State = Hashable
Step = Callable[[State, Symbol], tuple[State, tuple[Symbol, ...]]]


@dataclass(frozen=True)
class Transducer:
    """``step`` reads a symbol in a state, ``end`` gives what leaves at the end of a clause."""

    start: State
    step: Step
    end: Callable[[State], tuple[Symbol, ...]] = lambda state: ()


def _scope(opener: int, mark: int, reach: int | None) -> Transducer:
    """Marks abuse and threats within ``reach`` words after an opener, or to the end of the clause. State: words left."""

    def step(state, symbol):
        kind, marks = symbol
        if kind == opener:
            return reach or 1, (symbol,)
        left = state if reach is None else max(0, state - 1)
        return left, ((kind, marks | mark) if state and kind in (ABUSE, THREAT) else symbol,)

    return Transducer(0, step)


def _targeted() -> Transducer:
    """Marks abuse and threats that have a target within the gap before or after them; others leave once the gap is over.

    State: words until an earlier target is out of reach, the symbol that waits for a later one, and the words it waits.
    """

    def step(state, symbol):
        near, held, left = state
        kind, marks = symbol
        if kind == TARGET:
            return (TARGET_GAP + 1, None, 0), () if held is None else ((held[0], held[1] | TARGETED),)
        near_after, out = max(0, near - 1), ()
        if held is not None and (kind in (ABUSE, THREAT) or left == 0):
            out, held = (held,), None
        if kind in (ABUSE, THREAT):
            if not near:
                return (near_after, symbol, TARGET_GAP), out
            out += ((kind, marks | TARGETED),)
        return (near_after, held, 0 if held is None else left - 1), out

    return Transducer((0, None, 0), step, lambda state: () if state[1] is None else (state[1],))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what leaves ``first`` to ``second``; a state is a pair of theirs."""

    def feed(state, symbols):
        out: tuple[Symbol, ...] = ()
        for symbol in symbols:
            state, more = second.step(state, symbol)
            out += more
        return state, out

    def step(state, symbol):
        one, between = first.step(state[0], symbol)
        two, out = feed(state[1], between)
        return (one, two), out

    def end(state):
        two, out = feed(state[1], first.end(state[0]))
        return out + second.end(two)

    return Transducer((first.start, second.start), step, end)


@dataclass(frozen=True)
class Machine:
    """A composed transducer as tables over numbered states: the next state and the patterns that leave."""

    following: list[list[int]]
    leaving: list[list[tuple[int, ...]]]
    ending: list[tuple[int, ...]]


@cache
def grammar() -> Machine:
    """Negation, then reported speech, then targets; a pattern is its class times 8 plus its marks."""
    whole = compose(_scope(NEGATION, NEGATED, NEGATION_SCOPE), compose(_scope(REPORT, REPORTED, None), _targeted()))
    patterns = lambda symbols: tuple(kind * 8 + marks for kind, marks in symbols if kind in (ABUSE, THREAT))
    number, queue, machine = {whole.start: 0}, [whole.start], Machine([], [], [])
    for state in queue:
        row, out = [], []
        for kind in range(6):
            after, symbols = whole.step(state, (kind, 0))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row.append(number[after])
            out.append(patterns(symbols))
        machine.following.append(row), machine.leaving.append(out), machine.ending.append(patterns(whole.end(state)))
    return machine


PATTERNS = [kind * 8 + marks for kind in (ABUSE, THREAT) for marks in range(8)]


def prior_odds(pattern: int) -> float:
    return PRIOR_ODDS[pattern // 8] + sum(shift for mark, shift in PRIOR_SHIFT.items() if pattern & mark)


@dataclass(frozen=True)
class Lexicon:
    """Classes of words, and log odds of the words of abuse and threat."""

    classes: dict[str, int]
    odds: dict[str, float]


def matches(text: str, lexicon: Lexicon) -> Iterator[tuple[str, int]]:
    """The word and the pattern of each match of the grammar in a text."""
    machine, kinds, triggers = grammar(), lexicon.classes, lexicon.odds.keys()
    settled = max(NEGATION_SCOPE, TARGET_GAP) + 2
    for clause in CLAUSE.finditer(text.lower()):
        words = WORD.findall(clause[0])
        if triggers.isdisjoint(words):
            continue
        state, last, waiting = 0, -1, []
        for at, word in enumerate(words):
            kind = kinds.get(word, OTHER)
            if kind == OTHER:
                continue
            # After so many other words nothing changes any more.
            for symbol in [OTHER] * min(at - last - 1, settled) + [kind]:
                if symbol in (ABUSE, THREAT):
                    waiting.append(word)
                for pattern in machine.leaving[state][symbol]:
                    yield waiting.pop(0), pattern
                state = machine.following[state][symbol]
            last = at
        for symbol in [OTHER] * min(len(words) - last - 1, settled):
            for pattern in machine.leaving[state][symbol]:
                yield waiting.pop(0), pattern
            state = machine.following[state][symbol]
        for pattern in machine.ending[state]:
            yield waiting.pop(0), pattern


@dataclass(frozen=True)
class Model:
    """A lexicon, a shift in log odds for each pattern, and how often texts without a match are toxic."""

    lexicon: Lexicon
    shifts: dict[int, float]
    unmatched: float

    def score(self, text: str) -> float:
        """Probability that the text is toxic: one minus that none of its matches is meant."""
        clean = 1 - self.unmatched
        for word, pattern in matches(text, self.lexicon):
            clean /= 1 + math.exp(self.lexicon.odds[word] + self.shifts[pattern])
        return 1 - clean


def fixed_classes() -> dict[str, int]:
    return {word: kind for kind, words in CLASS_WORDS.items() for word in words.split()}


def family(words: list[str]) -> int:
    """Smallest hash of runs of five words: nearly always the same for near copies."""
    runs = (" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))
    return min(xxhash.xxh3_64_intdigest(run) >> 1 for run in runs)


def trains(identifier: Column) -> Column:
    """Whether labels of an id may be learned from: a fifth of the ids is held out."""
    return F.crc32(identifier.cast("string").cast("binary")) % 5 != 0


def ratio(toxic: int, with_word: int, all_toxic: int, all_: int) -> float:
    """G squared of a two by two table: families with the word or without, toxic or not."""
    table = ((toxic, with_word, all_toxic), (with_word - toxic, with_word, all_ - all_toxic), (all_toxic - toxic, all_ - with_word, all_toxic), (all_ - with_word - all_toxic + toxic, all_ - with_word, all_ - all_toxic))
    return 2 * sum(seen * math.log(seen * all_ / (row * column)) for seen, row, column in table if seen)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """A model from labelled texts outside the held-out fifth.

    About ``fit_rows`` labelled ids are taken, chosen by a hash of the id where there are more; so the lexicon and all counts
    that reach the driver have a bounded size. An id with several labels is toxic if one of them says so; null labels are none.
    Without labelled texts the fixed words and prior odds decide.
    """
    require(labels, [id_column, "toxic"])
    usable = labels.filter(F.col(id_column).isNotNull() & F.col("toxic").isNotNull()).filter(trains(F.col(id_column)))
    known = stage(usable.groupBy(F.col(id_column).alias("__id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), "labelled")
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 20)) < (fit_rows << 20) // n)
    sample = stage(texts(docs, id_column, text_column).join(hinted(known, 32), "__id").select("__text", "toxic"), "toxicity-fit")

    def word_rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words, families, toxic = [], [], []
            for text, label in zip(batch.column("__text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = WORD.findall(text.lower())
                one, different = family(found), [*dict.fromkeys(found), ""]
                words += different
                families += [one] * len(different)
                toxic += [label] * len(different)
            yield pa.record_batch({"item": pa.array(words, pa.string()), "family": pa.array(families, pa.int64()), "toxic": pa.array(toxic, pa.int32())})

    def counted(rows: DataFrame) -> DataFrame:
        """Families that have an item, and toxic ones among them."""
        return rows.groupBy("item", "family").agg(F.max("toxic").alias("toxic")).groupBy("item").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))

    fixed = fixed_classes()
    triggers = [w for w, kind in fixed.items() if kind in (ABUSE, THREAT)]
    counts = counted(sample.mapInArrow(word_rows, "item string, family long, toxic int"))
    # A word that is pure in fewer toxic families cannot reach the least ratio; all words of the sample are the bound of what comes back.
    seen = {r["item"]: (r["toxic"], r["n"]) for r in counts.filter((F.col("toxic") >= 4) | F.col("item").isin("", *triggers)).collect()}
    all_toxic, all_ = seen.pop("", (0, 0))
    odds = {}
    for word, (toxic, n) in seen.items():
        if word not in fixed and toxic * all_ > n * all_toxic and ratio(toxic, n, all_toxic, all_) >= LEAST_RATIO and (value := math.log((toxic + 0.5) / (n - toxic + 0.5))) >= LEAST_ODDS:
            odds[word] = value
    for word in triggers:
        toxic, n = seen.get(word, (0, 0))
        meant = 2 / (1 + math.exp(-PRIOR_ODDS[fixed[word]]))
        odds[word] = math.log((toxic + meant) / (n - toxic + 2 - meant))
    lexicon = Lexicon({**{w: ABUSE for w in odds}, **fixed}, odds)

    def pattern_rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            items, families, toxic = [], [], []
            for text, label in zip(batch.column("__text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = sorted({pattern for _, pattern in matches(text, lexicon)}) or [0]
                items += found
                families += [family(WORD.findall(text.lower()))] * len(found)
                toxic += [label] * len(found)
            yield pa.record_batch({"item": pa.array(items, pa.int32()), "family": pa.array(families, pa.int64()), "toxic": pa.array(toxic, pa.int32())})

    patterns = {r["item"]: (r["toxic"], r["n"]) for r in counted(sample.mapInArrow(pattern_rows, "item int, family long, toxic int")).collect()}
    meant = {}
    for pattern in PATTERNS:
        toxic, n = patterns.get(pattern, (0, 0))
        prior = PRIOR_FAMILIES / (1 + math.exp(-prior_odds(pattern)))
        meant[pattern] = math.log((toxic + prior) / (n - toxic + PRIOR_FAMILIES - prior))
    toxic, n = patterns.get(0, (0, 0))
    return Model(lexicon, {p: meant[p] - meant[ABUSE * 8] for p in PATTERNS}, min(0.49, (toxic + 0.1) / (n + 10)))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``__id``, ``held_out``, ``score`` and ``predicted``.

    The score depends on the text alone. Null texts are empty texts and, like all texts without a match, score what texts
    without a match did among the labelled ones. Rows without an id are not held out and never learned from. Repeated
    rows each get their row; an empty table gives none; other columns are not read.
    """
    model = fit(docs, labels, fit_rows, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            scores = [model.score(t) for t in batch.column("__text").to_pylist()]
            yield pa.record_batch({"__id": batch.column("__id"), "score": pa.array(scores, pa.float64())})

    rows = texts(docs, id_column, text_column)
    kind = rows.schema["__id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"__id {kind}, score double")
    held_out = F.coalesce(~trains(F.col("__id")), F.lit(False))
    return scored.select("__id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
