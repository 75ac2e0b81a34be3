"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause as classes of words:

- insult: an insult counts as part of a phrase, before or after a determiner, a copula or another
  linking word, with three other words between at most; likewise after a target or a verb of
  report; or if a target follows it in its clause;
- threat: an agent or a modal verb, then a verb of harm, then a target; or a verb of harm with a
  target right after it;
- target: a target in the clause raises the weight of what is matched;
- negation: lowers the weight of what follows it in the clause; a second one lifts it;
- reported speech: lowers the weight of what follows it in its clause, or to the end of the quotation.

The first two are non-deterministic: an insult or a verb of harm may be taken into the match, at
its weight, or passed over, and a path that took one and doesn't complete its pattern isn't
accepted. All five are composed into one machine; a clause weighs what its heaviest accepted path
weighs. So isolated words, insults too, have no weight. Insults, whose words and word stems are
learned with their weights, are the only class that is not closed. A text's score is a logistic
function of its matched clauses.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tasks import column, slices
from gleaner.session import materialise

#: Closed classes of words in four languages.
TARGETS = frozenset("you your yours yourself yourselves u ur he she they him her them his their du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros él ella ellos".split())
LINKS = frozenset(
    """a an the this that these those such what is are am was were be been being of and or but as like in on at for with by to from it
    ein eine einen einem einer der die das den dem des dieser diese dieses ist sind bist war waren und oder aber wie als von zu mit auf für
    un une le la les du de ce cet cette ces est sont était et ou mais comme à dans pour avec sur par que
    una el los las lo del este esta estos estas es son eres era y o pero como en para con por""".split()
)
NEGATIONS = frozenset("not no never none neither nor cannot can't don't doesn't didn't isn't aren't wasn't weren't won't nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás ni tampoco".split())
REPORTS = frozenset("said says say told tells wrote writes called calls quoted reported alleged according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split())
AGENTS = frozenset("i i'll we we'll someone somebody will gonna shall should must let's ich wir jemand werde werden sollte sollten muss je j'vais nous quelqu'un vais allons devrait yo nosotros alguien voy vamos debería".split())
HARMS = frozenset("kill hurt destroy murder burn shoot stab strangle hang töten umbringen schlagen verprügeln tuer frapper détruire brûler matar golpear destruir quemar".split())

END, QUOTE, OTHER, TARGET, LINK, NEGATION, REPORT, AGENT, HARM, INSULT = SYMBOLS = range(10)
CLASSES = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (AGENT, AGENTS), (HARM, HARMS), (LINK, LINKS))
#: Other words that may stand between the opening of a phrase and its insult.
GAP = 3

#: Labelled texts of each class that the grammar is fitted on; the bounds of the sample.
TOXIC_ROWS, CLEAN_ROWS = 6000, 12000
#: Entries of the lexicon, stem lengths, least toxic texts with an entry, least odds ratio.
LEXICON, STEMS, SUPPORT, ODDS = 4000, (4, 5, 6, 7), 8, 6.0


# The machine


@dataclass(frozen=True)
class Transducer:
    """States are 0, 1, ...; a clause begins and ends in 0, to which ``END`` leads from a final state.

    ``moves`` has for (state, symbol) the next states, each with whether the symbol is taken into
    the match; without an entry the state stays. A state with no next state ends the path.
    """

    states: int
    moves: dict[tuple[int, int], tuple[tuple[int, bool], ...]]


def insult_transducer(gap: int = GAP) -> Transducer:
    """States: 0 closed; 1 to ``gap`` + 1 open, with fewer words to go; from ``gap`` + 2 on waiting for
    a target, all but the first of them for a linking word too."""
    fresh, late = gap + 1, gap + 2
    waits = late + gap + 1
    moves: dict = {(0, INSULT): ((0, False), (waits, True))}
    for state in range(waits + 1):
        if state >= late:
            moves[state, INSULT] = ((waits, True),)
            moves[state, END] = ()
            moves[state, TARGET] = ((fresh, False),)
            if state > late:
                moves[state, LINK] = ((fresh, False),)
        else:
            for opener in (LINK, TARGET, REPORT):
                moves[state, opener] = ((fresh, False),)
            if state:
                moves[state, INSULT] = ((fresh, True),)
                moves[state, END] = ((0, False),)
        if state not in (0, late):
            for word in (OTHER, NEGATION, AGENT, HARM, *((REPORT,) if state > late else ())):
                moves[state, word] = ((state - 1, False),)
    return Transducer(waits + 1, moves)


def threat_transducer() -> Transducer:
    """States: 0, 1 after an agent, 2 after agent and harm, 3 after a harm alone."""
    moves: dict = {(0, AGENT): ((1, False),), (0, HARM): ((0, False), (3, True)), (1, HARM): ((1, False), (2, True)), (1, END): ((0, False),)}
    moves |= {(2, HARM): ((2, True),), (2, TARGET): ((1, False),), (2, END): ()}
    moves |= {(3, symbol): () for symbol in SYMBOLS if symbol not in (TARGET, QUOTE)} | {(3, TARGET): ((0, False),)}
    return Transducer(4, moves)


def _plain(moves: dict[tuple[int, int], int]) -> dict:
    return {k: ((v, False),) for k, v in moves.items()}


#: Insult, threat, target, negation, reported speech.
PARTS = (
    insult_transducer(),
    threat_transducer(),
    Transducer(2, _plain({(0, TARGET): 1, (1, END): 0})),
    Transducer(2, _plain({(0, NEGATION): 1, (1, NEGATION): 0, (1, END): 0})),
    Transducer(3, _plain({(0, REPORT): 1, (1, END): 0, (1, QUOTE): 2, (2, QUOTE): 0})),
)


@dataclass(frozen=True)
class Weights:
    """What a clause's parts do to the weight of its match, and the weight of a verb of harm."""

    targeted: float = 1.5
    negated: float = 0.3
    reported: float = 0.6
    harm: float = 2.0


def compose(parts: tuple[Transducer, ...] = PARTS) -> tuple[list[tuple[int, ...]], list[list[tuple[tuple[int, bool], ...]]]]:
    """The product machine: its states as tuples, and for each state and symbol the next states,
    each with whether the symbol is taken."""
    states = list(itertools.product(*(range(p.states) for p in parts)))
    number = {s: k for k, s in enumerate(states)}

    def moves(state: tuple[int, ...], symbol: int) -> tuple[tuple[int, bool], ...]:
        every = itertools.product(*(p.moves.get((x, symbol), ((x, False),)) for p, x in zip(parts, state)))
        return tuple((number[tuple(x for x, _ in path)], any(taken for _, taken in path)) for path in every)

    return states, [[moves(state, symbol) for symbol in SYMBOLS] for state in states]


STATES, TABLE = compose()


def clause_weights(symbols: Iterator[tuple[int, float]], weights: Weights = Weights()) -> list[float]:
    """Weights of the matched clauses of a stream of (symbol, weight): of each clause, that of its
    heaviest accepted path."""
    factor = [(weights.negated if s[3] else 1.0) * (weights.reported if s[4] else 1.0) for s in STATES]
    raised = [weights.targeted if s[2] else 1.0 for s in STATES]
    now, out, matched = {0: 0.0}, [], False

    def close() -> dict[int, float]:
        ends = {to: 0.0 for state in now for to, _ in TABLE[state][END]}
        best = max((w * raised[state] for state, w in now.items() if TABLE[state][END]), default=0.0)
        if best:
            out.append(best)
        return ends

    for symbol, weight in symbols:
        if symbol == END:
            now, matched = close(), False
            continue
        matched |= symbol >= HARM
        if not matched and len(now) == 1:
            (state,) = now
            ((to, _),) = TABLE[state][symbol]
            now = {to: 0.0}
            continue
        after: dict[int, float] = {}
        for state, w in now.items():
            for to, taken in TABLE[state][symbol]:
                got = w + weight * factor[state] if taken else w
                if got >= after.get(to, 0.0):
                    after[to] = got
        now = after
    close()
    return out


# Words


_EDGE = "\"'“”„«»‘’()[]{}<>*_#&%$|~.,;:!?…-"
_QUOTES = frozenset("\"“”„«»")
_STOPS = frozenset(".!?;…")


STOP = (END, 0.0)


@dataclass
class Reader:
    """Turns words between white space into symbols, by the closed classes and a lexicon."""

    lexicon: dict[str, float]
    weights: Weights = field(default_factory=Weights)
    known: dict[str, tuple[tuple, bool]] = field(default_factory=dict)
    bound: int = 300_000

    def symbols(self, word: str) -> tuple[tuple[int, float], ...]:
        core = word.strip(_EDGE)
        out = []
        if not _QUOTES.isdisjoint(word[: len(word) - len(word.lstrip(_EDGE))]):
            out.append((QUOTE, 0.0))
        if core:
            kind = next((symbol for symbol, members in CLASSES if core in members), None)
            insult = 0.0 if kind is not None else max((self.lexicon.get(f, 0.0) for f in entries(core)), default=0.0)
            out.append((INSULT, insult) if insult else (OTHER if kind is None else kind, self.weights.harm if kind == HARM else 0.0))
        tail = word[len(word.rstrip(_EDGE)) :] if core else word
        if not _QUOTES.isdisjoint(tail):
            out.append((QUOTE, 0.0))
        if not _STOPS.isdisjoint(tail):
            out.append(STOP)
        return tuple(out)

    def read(self, words: list[str]) -> tuple[list[tuple[tuple[int, float], ...]], bool]:
        """The symbols of each word, and whether an insult or a verb of harm is among them.

        A stop after the first word of a clause is emphasis and doesn't end it.
        """
        known, out, found, length = self.known, [], False, 0
        for w in words:
            got = known.get(w)
            if got is None:
                symbols = self.symbols(w)
                got = symbols, any(x[0] >= HARM for x in symbols)
                if len(known) < self.bound:
                    known[w] = got
            symbols = got[0]
            found |= got[1]
            length += 1
            if symbols and symbols[-1] == STOP:
                if length == 1:
                    symbols = symbols[:-1]
                else:
                    length = 0
            out.append(symbols)
        return out, found

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """``(log of the clauses' weight, of the heaviest clause's, of the weight for 100 words, matched clauses' log)``."""
        words = (text or "").lower().split()
        symbols, found = self.read(words)
        clauses = clause_weights(itertools.chain.from_iterable(symbols), self.weights) if found else []
        total = sum(clauses)
        return math.log1p(total), math.log1p(max(clauses, default=0.0)), math.log1p(100 * total / max(1, len(words))), math.log1p(len(clauses))


def entries(core: str) -> list[str]:
    """What a word can be found by: itself, and its stems, marked by a final asterisk."""
    return [core, *[core[:k] + "*" for k in STEMS if len(core) > k]] if len(core) > 2 else []


@dataclass
class Grammar:
    """A fitted grammar: the lexicon, and the logistic function of the clause features."""

    lexicon: dict[str, float]
    coefficients: list[float]
    weights: Weights = field(default_factory=Weights)


# Fitting


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression, the constant first, by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    c = np.zeros(x.shape[1])
    pull = np.eye(x.shape[1]) * ridge
    pull[0, 0] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ c)
        c += step
        if np.abs(step).max() < 1e-8:
            break
    return c


def _count(texts: list[str | None], allowed: set[str] | None) -> Counter:
    """In how many texts each lexicon entry occurs."""
    out: Counter = Counter()
    for text in texts:
        found = set()
        for w in {x.strip(_EDGE) for x in set((text or "").lower().split())}:
            found.update(entries(w))
        out.update(found if allowed is None else found & allowed)
    return out


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, weights: Weights = Weights()) -> Grammar:
    """Fit the grammar on ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    At most ``toxic_rows`` and ``clean_rows`` labelled ids, picked by a hash of the id, are used, and
    only their texts are read more than once. Labels that are null, or other than 0 and 1, are
    left out. Counts of words are made by Spark; only the lexicon, bounded by ``LEXICON``, and four
    numbers for each text of the sample come to the driver. One half of the sample (by another
    hash) gives the lexicon and the other half the coefficients, so that entries which fit only the
    texts they came from earn no weight. Without toxic labels every score is the same.
    """
    spark = docs.sparkSession

    def picked(toxic: int, rows: int) -> DataFrame:
        own = labels.where(F.col("toxic") == toxic).select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).dropna().distinct()
        return own.orderBy(F.xxhash64("l_id"), "l_id").limit(rows)

    ids = materialise(picked(1, toxic_rows).unionByName(picked(0, clean_rows)), "labelled")
    sample = docs.select(F.col("doc_id").alias("s_id"), F.col("text").alias("text")).join(F.broadcast(ids), F.col("s_id") == F.col("l_id")).select("s_id", "text", "toxic")
    sample = materialise(sample.withColumn("half", F.pmod(F.xxhash64("s_id", F.lit("half")), F.lit(2)).cast("int")), "sample")
    sizes = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get((1, 0), 0), sizes.get((0, 0), 0)

    def counted(toxic: int, allowed: set[str] | None) -> dict[str, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                found = _count(part.column(0).to_pylist(), allowed)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])

        own = sample.where((F.col("toxic") == toxic) & (F.col("half") == 0)).select("text")
        sums = own.mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
        if allowed is None:  # the most frequent, more than the lexicon will need
            sums = sums.where(F.col("n") >= SUPPORT).orderBy(F.col("n").desc(), "entry").limit(20 * LEXICON)
        return {r["entry"]: r["n"] for r in sums.collect()}

    toxic = counted(1, None) if n_toxic else {}
    clean = counted(0, set(toxic)) if toxic else {}
    odds = {e: (n + 0.5) / (n_toxic + 1) / ((clean.get(e, 0) + 0.5) / (n_clean + 1)) for e, n in toxic.items()}
    best = sorted((e for e, o in odds.items() if o >= ODDS), key=lambda e: (-math.log(odds[e]) * math.sqrt(toxic[e]), e))[:LEXICON]
    lexicon = {e: math.log(odds[e]) for e in best}
    shared = spark.sparkContext.broadcast(lexicon)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, weights)
        for part in slices(batches):
            found = np.array([reader.features(t) for t in part.column(0).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)] + [part.column(1), part.column(2)], [*"abcd", "toxic", "half"])

    rows = sample.select("text", "toxic", "half").mapInArrow(describe, "a double, b double, c double, d double, toxic int, half int").collect()
    if not rows or not n_toxic:
        return Grammar({}, [-2.0, 0.0, 0.0, 0.0, 0.0], weights)
    x = np.array([list(r)[:4] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    fresh = np.array([r["half"] for r in rows]) == 1
    fresh = fresh if len(set(y[fresh])) == 2 else np.ones(len(y), bool)
    return Grammar(lexicon, logistic(x[fresh], y[fresh]).tolist(), weights)


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, clauses`` of every row: the probability of toxicity, and the number of
    matched clauses. A null or empty text scores what a text without matches does. Whole texts are
    read; other columns aren't. Repeated rows score alike. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        reader = Reader(grammar.lexicon, grammar.weights)
        for part in slices(batches):
            found = [reader.features(t) for t in part.column(1).to_pylist()]
            z = np.array([[1.0, *f] for f in found]) @ np.array(grammar.coefficients)
            clauses = np.rint(np.expm1([f[3] for f in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), pa.array(clauses)], ["doc_id", "score", "clauses"])

    wanted = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, score double, clauses long")
