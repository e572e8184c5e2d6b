"""Toxicity: a learned lexicon, matched with misspellings, weighed by the words around each hit.

Fit, on at most TRAIN_ROWS labelled texts that are not held out (chosen by a hash of doc_id): whole
words and word beginnings that toxic texts use far more often than others make the lexicon. Its trie,
crossed with Levenshtein automata for its longer words, becomes one table-driven automaton; a whole word
under a beginning stays an entry, as the beginning itself is not matched with misspellings. Words of a
text run through it side by side in numpy. A hit counts less inside quotation marks near a reporting
word than as plain abuse. Misspellings that training saw get their own weight. The sum is calibrated
by a logistic curve. Only the text enters a score.

Defined cases: a null or empty text scores as one without hits; very long texts are scored whole; with no
usable labels every score is 0; a null doc_id is not held out and teaches nothing; a doc_id labelled twice counts
as toxic if one of its labels is; repeated rows are scored each; of terms that match alike the longest beginning
or the nearest, then the first word counts; other columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import releasing, text_slices, texts_of

#: Labelled texts that the fit looks at, at most.
TRAIN_ROWS = 24_000
#: Lexicon entries in one automaton; more of them make more automata.
ENTRIES = 400
PREFIX = range(4, 11)
FUZZY_1, FUZZY_2 = 5, 9  # letters from which a whole word is matched with one, with two edits
THRESHOLD = 0.7
#: Weight of a misspelling that training has not seen, as a share of its word's.
UNSEEN = 0.6
#: Share of toxic texts among those with a term, below which it is no entry.
LEAST_SHARE = 0.55
MOST_EVIDENCE = 30.0
QUOTED, WINDOW = 0.25, 80
_REPORTING = re.compile(r"\b(?:said|says|say|quote|quoted|wrote|writes|called|reads|word|term|dit|sagte|dijo)\b")
#: Marks that open a quotation stand before a word and after none, those that close one the other way round.
_OPENS = re.compile(r"(?:^|(?<=[\s(\[{>—–-]))[\"'“”«»„‘](?=\S)")
_CLOSES = re.compile(r"(?<=\S)[\"'”“»«’](?=$|[\s.,;:!?)\]}<—–-])")
_WORD = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457@$", "oieastas")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _folded(text: str) -> str:
    """Lower case; digits and signs that stand for letters inside words become those."""
    text = text.lower()
    return text if text.isalpha() else re.sub(r"(?<=[a-z])[013457@$](?=[a-z])", lambda m: m[0].translate(_LEET), text)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and word beginning: in how many toxic and other texts of the batch it stands."""
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall(_folded(text.decode())))
            found = {f"={w}" for w in words}
            for w in words:
                found.update(w[:k] for k in PREFIX if k <= len(w))
            (toxic if label else other).update(found)
        keys = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())], ["term", "toxic", "other"])


def _llr(a: float, b: float, na: float, nb: float) -> float:
    return math.log((a + 0.5) / (na + 1)) - math.log((b + 0.5) / (nb + 1))


@dataclass
class Lexicon:
    """Terms with their weights; a term with = before it is a whole word. variants: weights of misspellings."""

    weights: dict[str, float]
    variants: dict[str, float] = field(default_factory=dict)
    #: Of the evidence, of the logarithm of the words, and alone.
    curve: tuple[float, float, float] = (1.0, 0.0, -4.0)

    def keys(self) -> tuple[tuple[str, ...], ...]:
        """The terms of each automaton."""
        terms = sorted(self.weights)
        return tuple(tuple(terms[k : k + ENTRIES]) for k in range(0, len(terms), ENTRIES))


class Automaton:
    """The lexicon's trie crossed with its Levenshtein automata, made deterministic.

    A state is a set of (place in the trie, edits so far); reading a letter moves each along the trie,
    or spends an edit on a changed, added or left-out letter. Beginnings stay matched once read.
    """

    def __init__(self, terms: tuple[str, ...]):
        self.terms = terms
        child: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.begins: dict[int, int] = {}
        allowed: list[int] = [0]
        for i, term in enumerate(terms):
            node, word = 0, term.lstrip("=")
            most = 0 if term[0] != "=" or not word.isalpha() else 2 if len(word) >= FUZZY_2 else 1 if len(word) >= FUZZY_1 else 0
            allowed[0] = max(allowed[0], most)
            for c in word:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    allowed.append(0)
                node = child[node][c]
                allowed[node] = max(allowed[node], most)
            (self.whole if term[0] == "=" else self.begins)[node] = i
        self.child, self.allowed = child, allowed
        self.most = {i: (2 if len(t) > FUZZY_2 else 1 if len(t) > FUZZY_1 else 0) if t[0] == "=" else 0 for i, t in enumerate(terms)}
        alphabet = sorted({c for t in terms for c in t.lstrip("=")})
        self.letter = {c: k + 1 for k, c in enumerate(alphabet)}  # 0: any other
        start = self._close({(0, 0)})
        states, todo, table = {start: 1}, [start], [[0] * (len(alphabet) + 1), None]
        while todo:
            s = todo.pop()
            row = []
            for c in [None, *alphabet]:
                to = self._close(self._read(s, c))
                if not to:
                    row.append(0)
                    continue
                if to not in states:
                    states[to] = len(table)
                    table.append(None)
                    todo.append(to)
                row.append(states[to])
            table[states[s]] = row
        self.table = np.array(table, np.int32)
        self.hit = np.full(len(table), -1, np.int32)
        self.fuzzy = np.zeros(len(table), bool)
        for s, k in states.items():
            exact = [i for n, e in s if e == 0 and (i := self.whole.get(n)) is not None]
            begun = [-n - 1 for n, _ in s if n < 0]
            near = [(e, i) for n, e in s if n >= 0 and e > 0 and (i := self.whole.get(n)) is not None and e <= self.most[i]]
            if exact or begun:
                self.hit[k] = (exact or sorted(begun, key=lambda i: -len(terms[i])))[0]
            elif near:
                self.hit[k], self.fuzzy[k] = min(near)[1], True

    def _read(self, s: frozenset, c: str | None) -> set:
        out = set()
        for n, e in s:
            if n < 0:
                out.add((n, 0))
                continue
            if c is not None and c in self.child[n]:
                out.add((self.child[n][c], e))
            if e < self.allowed[n]:
                out.add((n, e + 1))  # an added letter
                out.update((to, e + 1) for x, to in self.child[n].items() if x != c and e < self.allowed[to])
        return out

    def _close(self, s: set) -> frozenset:
        todo, best = list(s), {}
        while todo:
            n, e = todo.pop()
            if best.get(n, 9) <= e:
                continue
            best[n] = e
            if n >= 0:
                if e == 0 and n in self.begins:
                    todo.append((-self.begins[n] - 1, 0))
                if e < self.allowed[n]:
                    todo += [(to, e + 1) for to in self.child[n].values() if e < self.allowed[to]]  # a left-out letter
        return frozenset(best.items())

    def hits(self, text: str) -> tuple[list[tuple[int, int, str, bool]], np.ndarray]:
        """(start, end, term, misspelled) of the words that match, and where words start; text is folded."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters = _classes(self.terms)[codes]
        inside = letters != 255
        edge = np.diff(inside, prepend=False, append=False)
        places = np.flatnonzero(edge)
        start, end = places[::2], places[1::2]
        state = np.ones(len(start), np.int32)
        alive, k = np.arange(len(start)), 0
        final = np.zeros(len(start), np.int32)
        while len(alive):
            over = end[alive] - start[alive] == k
            final[alive[over]] = state[alive[over]]
            alive = alive[~over]
            state[alive] = self.table[state[alive], letters[start[alive] + k]]
            alive = alive[state[alive] > 0]
            k += 1
        got = np.flatnonzero(self.hit[final] >= 0)
        return [(int(start[i]), int(end[i]), self.terms[self.hit[final[i]]], bool(self.fuzzy[final[i]])) for i in got], start


@lru_cache(1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


@lru_cache(64)
def _automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton(terms)


@lru_cache(64)
def _classes(terms: tuple[str, ...]) -> np.ndarray:
    """For each code point: 255 outside words, the letter's number in the lexicon, or 0."""
    out = np.where(_alnum(), 0, 255).astype(np.uint8)
    for c, k in _automaton(terms).letter.items():
        out[ord(c)] = k
    return out


def _context(text: str, start: int, end: int) -> float:
    """Less than 1 for a hit that is quoted: after a mark that opens and before one that closes, with a reporting word nearby."""
    first, last = max(0, start - WINDOW), min(len(text), end + WINDOW)
    if not _REPORTING.search(text[first:start] + " " + text[end:last]):
        return 1.0

    def places(marks: re.Pattern, a: int, b: int) -> list[int]:
        return [m.start() for m in marks.finditer(text, a, min(b + 1, len(text))) if m.start() < b]

    opened, shut = max(places(_OPENS, first, start), default=-1), max(places(_CLOSES, first, start), default=-1)
    closes, opens = min(places(_CLOSES, end, last), default=len(text)), min(places(_OPENS, end, last), default=len(text))
    return QUOTED if opened > shut and closes < len(text) and closes <= opens else 1.0


def document_hits(automata: list[Automaton], texts: list[bytes]) -> tuple[list[dict[str, float]], np.ndarray]:
    """For each text, what it hits (a term, or ~ and a misspelled word) and how often, quotations counting less; and its words.

    A word that several automata know is the hit of the first that knows it as written, else of the first that does.
    """
    folded = [_folded(t.decode()) for t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in folded)])
    out: list[dict[str, float]] = [defaultdict(float) for _ in texts]
    whole = "\n".join(folded)
    found: dict[int, tuple[int, int, str, bool]] = {}
    for automaton in automata:
        hits, words = automaton.hits(whole)
        for hit in hits:
            if hit[0] not in found or found[hit[0]][3] and not hit[3]:
                found[hit[0]] = hit
    for a, b, term, fuzzy in found.values():
        row = int(np.searchsorted(starts, a, "right")) - 1
        key = f"~{whole[a:b]}~{term}" if fuzzy else term
        out[row][key] += _context(folded[row], a - int(starts[row]), b - int(starts[row]))
    return out, np.diff(np.searchsorted(words, starts))


def _evidence(lexicon: Lexicon, hits: dict[str, float]) -> float:
    total = 0.0
    for key, n in hits.items():
        if key[0] == "~":
            _, word, term = key.split("~")
            w = lexicon.variants.get(word, UNSEEN * lexicon.weights[term])
        else:
            w = lexicon.weights[key]
        total += w * min(n, 1.0) * (1 + 0.5 * math.log(max(n, 1.0)))
    return total


def _train_hits(batches: Iterator[pa.RecordBatch], keys: tuple[tuple[str, ...], ...]) -> Iterator[pa.RecordBatch]:
    automata = [_automaton(terms) for terms in keys]
    for batch in releasing(batches):
        for a, b, texts in text_slices(batch.column("text")):
            found, words = document_hits(automata, texts)
            yield pa.RecordBatch.from_arrays([batch.column("toxic")[a:b], pa.array(words, pa.int64()), pa.array([list(h) for h in found], pa.list_(pa.string())), pa.array([list(h.values()) for h in found], pa.list_(pa.float64()))], ["toxic", "words", "hits", "times"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon and its weights from labelled texts that are not held out.

    Collects a row for each of at most ``rows`` texts, and the terms that at least a hundredth of the toxic ones
    among them have: so as many as ``rows`` allows. A doc_id with several rows counts once, by its least text.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    there = usable.count()
    if there > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(0.97 * rows / there * 1_000_003))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(usable), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    na, nb = sizes.get(1, 0), sizes.get(0, 0)
    if not na or not nb:
        return Lexicon({})
    counted = train.mapInArrow(_features, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    least = max(4, na // 100)
    # Lower end of the share of toxic texts among those with the term, against chance (Wilson).
    n, z = F.col("a") + F.col("b"), 1.96
    share = F.col("a") / n
    lower = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    kept = counted.where((F.col("a") >= least) & (lower >= max(LEAST_SHARE, 2 * na / (na + nb))))
    seen = {r["term"]: (r["a"], r["b"]) for r in kept.collect()}
    weights: dict[str, float] = {}
    begins: set[str] = set()
    words = {t: c for t, c in seen.items() if t[0] == "="}
    for t in sorted((t for t in seen if t[0] != "="), key=len):
        own = max((c[0] for w, c in words.items() if w.startswith(f"={t}")), default=0)
        if any(t[:k] in begins for k in range(1, len(t))) or own >= 0.8 * seen[t][0]:
            continue  # a shorter one covers it, or it stands for a single word
        begins.add(t)
        weights[t] = _llr(*seen[t], na, nb)
    under: dict[str, float] = {}
    for w in words:
        covered = any(w[1 : k + 1] in begins for k in range(1, len(w)))
        (under if covered else weights)[w] = _llr(*words[w], na, nb)
    lexicon = Lexicon(weights | under)
    if not weights:
        return lexicon
    found = [(r["toxic"], r["words"], dict(zip(r["hits"], r["times"], strict=True))) for r in train.mapInArrow(partial(_train_hits, keys=lexicon.keys()), "toxic int, words long, hits array<string>, times array<double>").collect()]
    seen_in: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for label, _, hits in found:
        for word in {k.split("~")[1] for k in hits if k[0] == "~"}:
            seen_in[word][label] += 1
    lexicon.variants = {w: _llr(a, b, na, nb) for w, (b, a) in seen_in.items()}
    rows_x = np.array([_row(lexicon, h, n) for _, n, h in found])
    lexicon.curve = _calibrate(rows_x, np.array([y for y, *_ in found], float))
    return lexicon


def _row(lexicon: Lexicon, hits: dict[str, float], words: int) -> tuple[float, float, float]:
    return min(_evidence(lexicon, hits), MOST_EVIDENCE), math.log1p(words), 1.0


def _calibrate(rows: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A logistic curve by Newton's method with halved steps, and a slight pull to none."""
    pull = np.array([1e-3, 1e-3, 1e-6])

    def loss(w: np.ndarray) -> float:
        z = rows @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * w * w).sum() / 2)

    w = np.array([0.0, 0.0, float(np.log(y.mean() / (1 - y.mean())))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - y) + pull * w
        step = np.linalg.solve((rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + np.diag(pull), slope)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automata = [_automaton(terms) for terms in lexicon.keys()]
    for batch in releasing(batches):
        for a, b, texts in text_slices(batch.column("text")):
            found, words = document_hits(automata, texts)
            rows = np.array([_row(lexicon, h, int(n)) for h, n in zip(found, words, strict=True)])
            score = 1 / (1 + np.exp(-np.clip(rows @ np.array(lexicon.curve), -30, 30)))
            shown = [sorted(k.split("~")[1] if k[0] == "~" else k.lstrip("=") for k in h) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(score, pa.float64()), pa.array(shown, pa.list_(pa.string()))], ["doc_id", "score", "hits"])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and the words or beginnings that were hit, for every text; no shuffle."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if not lexicon.weights:
        return texts.select("doc_id", F.lit(0.0).alias("score"), F.expr("cast(array() as array<string>)").alias("hits"))
    return texts.mapInArrow(partial(_scored, lexicon=lexicon), "doc_id long, score double, hits array<string>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fit, then score: doc_id, held_out, score, predicted, hits."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
