"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause token by token:

* LEXICON: a word to its symbol: insult level (words and stems with weights learned from labels,
  quantised), threat level, target, negation, reported speech, or other;
* NEGATION: marks insults and threats within `SPAN` tokens after a negation;
* REPORT: remembers whether the clause has a verb of reported speech, before or after what it reports;
* INSULT: weighs each insult by its level, a marked one by a share, and once a clause adds the pull of
  a target that stands with an insult, on either side;
* THREAT: weighs a threat word that has a target in its clause, on either side, whether or not the
  lexicon has the word; without a target it weighs nothing.

The last four are composed (`compose`) into one deterministic machine whose arcs carry vectors of
weights (insult, threat, targeted insult, negated), which add along a path; its final states tell
reported clauses. The machine runs over whole clauses, of whatever length, all clauses of a chunk in
step; clauses without an insult or a threat weigh nothing and aren't run. A clause ends at a sentence
mark that no letter or digit follows, or at a line's end.

The score is a logistic function, fitted on the training fold, of the heaviest clause, the number of
matched clauses, their total, their density, and the totals of threats, targeted insults, negated and
reported matches. The levels' weights, those of threats and that of a target are learned from labels;
the last two are drawn to `PRIOR` and `PULL` where few documents have the pattern.

Learns from about `SAMPLE` labelled rows outside the held-out fold (bounded, uniform); the lexicon
holds `LEXICON` entries at most.

Defined cases: a null or empty text matches nothing and gets the score of that. Rows that repeat are
returned each; labels without a document or an id and null labels teach nothing; with no labelled row
every score is 0. Other columns are ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textvec as tv
from .models import SAMPLE, held_out, logistic, sample, sigmoid, weighed

LEXICON = 5_000
#: Letters of a stem.
STEMS = (4, 5, 6)
#: Tokens after a negation that it reaches.
SPAN = 3
#: Levels of insults and of threats.
INSULTS, THREATS = 8, 3
#: Share of its weight that a negated match and a reported clause keep.
NEGATED, REPORTED = 0.5, 0.7
#: Log odds of a threat word with a target, and of an insult with one besides the insult's own, before
#: any document is seen, and the documents that they count for.
PRIOR, PULL, WORTH = 2.0, 0.3, 5

#: Closed word classes of the grammar (fixed values), in the languages of the corpus.
NEGATION = "not no never without isn't aren't wasn't don't doesn't nicht kein keine nie ohne ne pas jamais sans nunca sin".split()
REPORT = "said says say wrote writes quoted called claimed sagte sagt schrieb dit écrit dijo dice escribió".split()
TARGET = "you your you're he she they him her them du dich ihr sie tu toi vous il elle ils usted tú ellos".split()
THREAT = "kill hurt beat destroy die burn shoot töten sterben tuer mourir matar morir".split()

#: ASCII signs that part words; apostrophes, hyphens and underscores don't.
_PARTS = ".,;:!?\"()[]{}#*$%&|<>~`"
_SPLIT = re.compile(r"[\x20\x09-\x0D.,;:!?\"()\[\]{}#*$%&|<>~`\u2018\u201c\u201d\u201e\u2026\u2013\u2014\xa1\xbf\xab\xbb]+")
_END = re.compile("[.!?;](?![A-Za-z0-9\u0080-\U0010ffff])|\n")
#: Capitals that fold: ASCII and Latin-1.
_FOLD = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7}

#: A token of the grammar: kind ("", "target", "negation", "report"), insult level, threat level, negated.
Symbol = tuple[str, int, int, bool]
OTHER: Symbol = ("", 0, 0, False)
WEIGHTS = ("insult", "threat", "targeted", "negated")
NOTHING = (0.0, 0.0, 0.0, 0.0)


def _negated(s: Symbol) -> Symbol:
    return (s[0], s[1], s[2], True) if s[1] or s[2] else s


@dataclass
class Transducer:
    """Deterministic: (state, symbol) to (state, symbol written, weights). State 0 is the start."""

    arcs: dict[tuple[int, Symbol], tuple[int, Symbol, tuple[float, ...]]]
    #: What each state is made of; its meaning where a path ends there.
    states: list

    @classmethod
    def build(cls, start, symbols: list[Symbol], step: Callable) -> "Transducer":
        """The reachable part of the machine that step(state, symbol) describes."""
        number, states, arcs = {start: 0}, [start], {}
        for state in states:  # grows while it runs
            for x in symbols:
                to, out, w = step(state, x)
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                arcs[number[state], x] = number[to], out, w
        return cls(arcs, states)

    def symbols(self) -> list[Symbol]:
        return list(dict.fromkeys(out for _, out, _ in self.arcs.values()))

    def read(self, tokens: list[Symbol]) -> tuple[list[Symbol], np.ndarray, int]:
        """(what is written, weights, last state)."""
        at, out, total = 0, [], np.zeros(len(WEIGHTS))
        for x in tokens:
            at, y, w = self.arcs[at, x]
            out.append(y)
            total += w
        return out, total, at


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that reads what a reads and writes what b writes of what a writes; weights add."""
    inputs = list(dict.fromkeys(x for _, x in a.arcs))

    def step(state, x):
        p, y, w = a.arcs[state[0], x]
        q, z, v = b.arcs[state[1], y]
        return (p, q), z, tuple(i + j for i, j in zip(w, v))

    c = Transducer.build((0, 0), inputs, step)
    c.states = [(a.states[p], b.states[q]) for p, q in c.states]
    return c


def negation(symbols: list[Symbol], span: int = SPAN) -> Transducer:
    """State: tokens that a negation still reaches."""
    return Transducer.build(0, symbols, lambda left, x: (span, x, NOTHING) if x[0] == "negation" else (max(0, left - 1), _negated(x) if left else x, NOTHING))


def report(symbols: list[Symbol]) -> Transducer:
    """State: whether a verb of reported speech was read."""
    return Transducer.build(False, symbols, lambda seen, x: (seen or x[0] == "report", x, NOTHING))


def insult(symbols: list[Symbol], level: list[float], pull: float) -> Transducer:
    """State: target read, insult read, pull counted. level: weight of each insult level, 0 for none."""

    def step(state, x):
        target, seen, pulled = state
        w = [0.0] * 4
        target = target or x[0] == "target"
        if x[1] and x[3]:
            w[3] = NEGATED * level[x[1]]
        elif x[1]:
            w[0], seen = level[x[1]], True
        if target and seen and not pulled:
            w[2], pulled = pull, True
        return (target, seen, pulled), x, tuple(w)

    return Transducer.build((False, False, False), symbols, step)


def threat(symbols: list[Symbol], level: list[float]) -> Transducer:
    """State: target read, heaviest threat that waits for one as (level, negated)."""

    def weight(t: int, negated: bool) -> tuple[float, ...]:
        return (0.0, 0.0, 0.0, NEGATED * level[t]) if negated else (0.0, level[t], 0.0, 0.0)

    def step(state, x):
        target, waits = state
        if x[0] == "target":
            return (True, (0, False)), x, weight(*waits) if waits[0] else NOTHING
        if not x[2]:
            return state, x, NOTHING
        if target:
            return state, x, weight(x[2], x[3])
        return (False, max(waits, (x[2], x[3]), key=lambda t: sum(weight(*t)))), x, NOTHING

    return Transducer.build((False, (0, False)), symbols, step)


def _levels(weights: dict[str, float], n: int) -> tuple[dict[str, int], list[float]]:
    """A level of 1 to n for each word by its weight, and the mean weight of each level (0 for none)."""
    if not weights:
        return {}, [0.0] * (n + 1)
    w = np.array(list(weights.values()))
    step = max((w.max() - w.min()) / n, 1e-9)
    at = np.minimum(n, 1 + ((w - w.min()) / step).astype(int))
    mean = [0.0] + [float(w[at == k].mean()) if (at == k).any() else 0.0 for k in range(1, n + 1)]
    return dict(zip(weights, at.tolist())), mean


@dataclass
class Grammar:
    words: dict[str, float]
    stems: dict[str, float]
    model: np.ndarray
    #: Weight of each threat word with a target in its clause.
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREAT, PRIOR))
    #: Weight of a target in an insult's clause.
    pull: float = PULL

    def __post_init__(self):
        entries = self.words | {f"{k}*": v for k, v in self.stems.items()}
        self.insult, insults = _levels(entries, INSULTS)
        self.threat, threats = _levels({k: v for k, v in self.threats.items() if v > 0}, THREATS)
        read: dict[str, Symbol] = {}
        for kind, words in (("target", TARGET), ("negation", NEGATION), ("report", REPORT)):
            read |= {w: (kind, 0, 0, False) for w in words}
        for w in [*self.words, *self.threat]:
            read[w] = (read.get(w, OTHER)[0], self.insult.get(w, 0), self.threat.get(w, 0), False)
        stems = {k: ("", self.insult[f"{k}*"], 0, False) for k in self.stems}
        self.symbols = list(dict.fromkeys([OTHER, *read.values(), *stems.values()]))
        # the levels that a machine reads after NEGATION has marked them
        n = negation(self.symbols)
        self.parts = (n, report(n.symbols()), insult(n.symbols(), insults, self.pull), threat(n.symbols(), threats))
        machine = self.parts[0]
        for part in self.parts[1:]:
            machine = compose(machine, part)
        self.next = np.zeros((len(machine.states), len(self.symbols)), np.int32)
        self.weight = np.zeros((*self.next.shape, len(WEIGHTS)))
        for (state, x), (to, _, w) in machine.arcs.items():
            self.next[state, self.symbols.index(x)] = to
            self.weight[state, self.symbols.index(x)] = w
        self.reported = np.array([state[0][0][1] for state in machine.states])  # (((negation, report), insult), threat)
        self.starts = np.array([bool(x[1] or x[2]) for x in self.symbols])
        # LEXICON: hashes of words and of stems to symbols
        number = {x: i for i, x in enumerate(self.symbols)}
        self.read = read
        self.lexicon = _table({w: number[x] for w, x in read.items()})
        self.stem_lexicon = {k: _table({w: number[x] for w, x in stems.items() if len(w.encode()) == k}) for k in {len(w.encode()) for w in stems}}

    def symbol(self, word: str) -> Symbol:
        """What LEXICON writes for a word; the heaviest of its stems where the word itself isn't there."""
        level = [self.insult[f"{word[:k]}*"] for k in STEMS if len(word) > k and word[:k] in self.stems]
        return self.read.get(word) or (("", max(level), 0, False) if level else OTHER)


def _table(entries: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, symbol numbers)."""
    if not entries:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    (c,) = tv.chunks(pa.array(list(entries)), 1 << 30)
    h = tv.Words(c).hashes()
    order = np.argsort(h)
    return h[order], np.array(list(entries.values()), np.int64)[order]


def _found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Symbol numbers of hashes; 0 (other) where the table lacks them."""
    keys, number = table
    if not len(keys) or not len(h):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, number[at], 0)


_SIGN = np.zeros(256, bool)
_SIGN[[ord(x) for x in _PARTS]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in ".!?;"]] = True
_WORDY = np.zeros(256, bool)
_WORDY[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = True


def _split(c: tv.Chunk) -> tuple[tv.Words, np.ndarray]:
    """The chunk's words without signs around them, and the clause of each, numbered through the chunk."""
    b = c.bytes
    after = np.concatenate([b[1:], np.zeros(min(1, len(b)), np.uint8)])
    wordy = _WORDY[after]
    last = c.off[1:] - 1
    wordy[last[last >= 0]] = False  # no text goes on in the next one
    ends = np.cumsum((_MARK[b] & ~wordy) | (b == 10))
    blank = b.copy()
    blank[_SIGN[b]] = 32
    # signs of two and three bytes: inverted marks and angle quotes, dashes and curly quotes
    two = np.flatnonzero((b[:-1] == 0xC2) & np.isin(b[1:], (0xA1, 0xAB, 0xBB, 0xBF))) if len(b) > 1 else np.zeros(0, int)
    three = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x80) & np.isin(b[2:], (0x93, 0x94, 0x98, 0x9C, 0x9D, 0x9E, 0xA6))) if len(b) > 2 else np.zeros(0, int)
    if len(b) > 1:
        blank[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)] += 0x20  # Latin-1 capitals
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            blank[at + k] = 32
    d = tv.Chunk.__new__(tv.Chunk)
    d.lo, d.hi, d.n, d.off, d.bytes = c.lo, c.hi, c.n, c.off, blank
    w = tv.Words(d)
    if not len(w.start):
        return w, np.zeros(0, np.int64)
    mark, doc = ends[w.start], w.doc()
    return w, np.concatenate([[0], np.cumsum((mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1]))])


def _symbols(g: Grammar, w: tv.Words) -> np.ndarray:
    """LEXICON over all words of a chunk."""
    sym = _found(g.lexicon, w.hashes())
    b, size = w.chunk.bytes, w.end - w.start
    level = np.array([x[1] for x in g.symbols])
    known = sym > 0
    for k, table in g.stem_lexicon.items():
        i = np.flatnonzero((size > k) & ~known)
        if i.size:
            v = tv._BYTE[True][b[w.start[i][:, None] + np.arange(k)]] * tv._POWER[:k]
            got = _found(table, tv.mix(v.sum(1, dtype=np.uint64), 17))
            sym[i] = np.where(level[got] > level[sym[i]], got, sym[i])
    return sym


def clauses(g: Grammar, c: tv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, weights, reported) of each clause of the chunk that has an insult or a threat, and
    the words of each document."""
    w, clause = _split(c)
    words = w.count()
    none = np.zeros(0, np.int64), np.zeros((0, len(WEIGHTS))), np.zeros(0, bool), words
    if not len(clause):
        return none
    sym = _symbols(g, w)
    run = np.zeros(clause[-1] + 1, bool)
    run[clause[g.starts[sym]]] = True
    at = np.flatnonzero(run[clause])
    if not at.size:
        return none
    # others further than SPAN behind the clause's last symbol change no state
    place = np.arange(len(at))
    head = np.concatenate([[True], clause[at][1:] != clause[at][:-1]])
    told = sym[at] > 0
    last = np.maximum.accumulate(np.where(told, place, -1))
    first = np.maximum.accumulate(np.where(head, place, 0))
    keep = told | ((last >= first) & (place - last <= SPAN))
    at = at[keep]
    begin = np.flatnonzero(np.concatenate([[True], clause[at][1:] != clause[at][:-1]]))
    length = np.diff(begin, append=len(at))
    order = np.argsort(-length, kind="stable")
    begin, length, tape = begin[order], length[order], sym[at]
    state, total = np.zeros(len(begin), np.int64), np.zeros((len(begin), len(WEIGHTS)))
    alive = np.searchsorted(-length, -np.arange(length[0]), side="left")
    for t in range(int(length[0])):
        n = alive[t]
        x = tape[begin[:n] + t]
        total[:n] += g.weight[state[:n], x]
        state[:n] = g.next[state[:n], x]
    doc = np.searchsorted(w.first, at[begin], side="right") - 1
    back = np.argsort(order, kind="stable")
    return doc[back], total[back], g.reported[state][back], words


FEATURES = 8


def features(g: Grammar, texts: pa.Array) -> np.ndarray:
    """Heaviest clause, logs of the number, total weight and density of matched clauses, and of the
    totals of threats, targeted insults, negated and reported matches; a row for each text."""
    out = np.zeros((len(texts), FEATURES))
    for c in tv.chunks(texts):
        doc, total, reported, words = clauses(g, c)
        weight = total.sum(1) * np.where(reported, REPORTED, 1.0)
        hit = weight > 0
        doc, total, reported, weight = doc[hit], total[hit], reported[hit], weight[hit]
        add = lambda x: np.bincount(doc, x, c.n)  # noqa: B023, E731
        heaviest = np.zeros(c.n)
        np.maximum.at(heaviest, doc, weight)
        n = add(np.ones(len(doc)))
        direct = ~reported
        rows = (heaviest, np.log1p(n), np.log1p(add(weight)), np.log1p(100 * n / np.maximum(words, 1)), *(np.log1p(add(total[:, k] * direct)) for k in (1, 2, 3)), np.log1p(add(weight * reported)))
        out[c.lo : c.hi] = np.column_stack(rows)
    return out


def _forms(text: str | None) -> set[str]:
    """A text's words, and the stems of its longer words as "stem*"."""
    words = set(_SPLIT.split((text or "").translate(_FOLD)))
    words |= {f"{x[:k]}*" for x in words for k in STEMS if len(x) > k}
    words.discard("")
    return words


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, toxic) once for each document."""
    for batch in batches:
        forms, toxic = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = _forms(text)
            forms += own
            toxic += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(toxic, pa.int64())], names=["form", "toxic"])


def _patterns(g: Grammar):
    """(pattern, toxic) once for each document: threat words that meet a target in a clause, and
    whether its insults meet one ("insult+", else "insult")."""
    threats, targets = frozenset(THREAT), frozenset(TARGET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for clause in _END.split((text or "").translate(_FOLD)):
                    words = set(_SPLIT.split(clause))
                    targeted = not words.isdisjoint(targets)
                    if targeted:
                        own |= words & threats
                    if "insult+" not in own and any(w not in threats and g.symbol(w)[1] for w in words):
                        own.add("insult+" if targeted else "insult")
                if "insult+" in own:
                    own.discard("insult")
                found += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int64())], names=["form", "toxic"])

    return run


def _learned(g: Grammar, rows: DataFrame, base: float) -> tuple[dict[str, float], float]:
    """Weights of the threat words with a target, and of a target besides an insult; none below 0."""
    seen = rows.mapInArrow(_patterns(g), "form string, toxic long").groupBy("form").agg(F.sum("toxic"), F.count(F.lit(1))).collect()
    count = {form: (t, n) for form, t, n in seen}

    def odds(form: str) -> tuple[float, int]:
        t, n = count.get(form, (0, 0))
        p = (t + base) / (n + 1)
        return float(np.log(p / (1 - p)) - np.log(base / (1 - base))), n

    drawn = lambda w, n, prior: max(0.0, (n * w + WORTH * prior) / (n + WORTH))
    threats = {t: drawn(*odds(t), PRIOR) for t in THREAT}
    (a, n), (b, m) = odds("insult+"), odds("insult")
    return threats, drawn(a - b, min(n, m), PULL)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Grammar | None:
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    # at most about `most` ids, and of the rows that have them as many: one id can be that of many rows
    rows = stored(sample(d.join(F.broadcast(sample(known, most)), "doc_id"), most).select("text", "toxic"), "toxicity-sample")
    n, bad = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not bad or bad == n:
        return None
    counts = rows.mapInArrow(_words, "form string, toxic long").groupBy("form").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    # a form whose documents are toxic far above the base rate; smoothed
    share = (F.col("t") + bad / n) / (F.col("n") + 1)
    odds = F.log(share / (1 - share + 1e-3)) - F.log(F.lit(bad / n) / (1 - bad / n))
    good = counts.where(F.col("t") >= 3).withColumn("w", odds).where(F.col("w") > 2.0)
    top = good.orderBy(F.desc(F.col("w") * F.log("t")), "form").limit(LEXICON).toPandas()
    entries = dict(zip(top["form"], top["w"]))
    stems = {k[:-1]: v for k, v in entries.items() if k.endswith("*")}
    words = {k: v for k, v in entries.items() if not k.endswith("*")}
    threats, pull = _learned(Grammar(words, stems, np.zeros(FEATURES + 1)), rows, bad / n)
    g = Grammar(words, stems, np.zeros(FEATURES + 1), threats, pull)
    # features of the same rows, on the executors
    t = rows.mapInArrow(_featured(g), "f array<double>, toxic long").toPandas()
    g.model = logistic(np.array(t["f"].tolist()), t["toxic"].to_numpy(np.float64), steps=600)
    return g


def _featured(g: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features(g, batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(f.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    return run


def _scored(g: Grammar | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = features(g, batch.column(2)) if g else np.zeros((batch.num_rows, FEATURES))
            score = sigmoid(weighed(np.column_stack([f, np.ones(len(f))]), g.model)) if g else np.zeros(len(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.3).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, grammar: Grammar | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; a row for each row."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_scored(grammar), "doc_id long, held_out boolean, score double, predicted int")
