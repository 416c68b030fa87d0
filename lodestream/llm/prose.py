"""Per-document text statistics, and telling prose from lists, tables and junk line by line.

Every line (long ones in pieces) becomes a vector of small discrete features. A hidden Markov model with the states
prose, list, table and junk labels the lines of a document: a feature speaks for a state as often as the state's lines
show it, and neighbouring lines tend to share their state. The shares of the labels, by non-blank characters, describe
the document.

Training needs no labels: rules of high precision name the state of the plain cases, and first states, transitions and
feature values are counted from these, over all documents. So are the letter pairs that tell words from letter runs.
Both are partial sums per task, added up in a shuffle of at most a few thousand distinct cells. Features are computed
once per document and written; labelling reads them back and is by the model alone: no rule overrules it.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.scratch import written

STATES = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: Words of a piece of a long line; characters where a line has no blanks.
PIECE_WORDS, PIECE_CHARS = 30, 240
#: Documents whose features are computed together, and their characters, of which one document may have more.
BATCH_DOCS, BATCH_CHARS = 500, 2_000_000
#: Words back at which a repeated triple is junk by itself; triples in a row at one distance that make a copy.
NEAR, COPY = 12, 30

# Words that make clauses (pronouns, auxiliaries, conjunctions, negations, question words).
CLAUSE_WORDS = frozenset(
    """
    i you he she it we they me us them who which that this there what when while where why how if because since although
    though but and so than then as is are was were be been being am has have had do does did not no never nobody will would
    can could should may might must ever even just very too also still already only both our your their his her my its
    whoever whatever whichever someone anyone everyone once until unless whether
    nadie alguien qué quién cuál niemand jemand nichts etwas sobald obwohl personne quelqu quoi dès lorsque nessuno qualcuno ninguém alguém niemand iemand
    que se no es son era fue está están estaba estaban hay ha han había pero porque aunque cuando como donde si ya me nos te su sus mi muy más también sin sino quien esto eso ella ellos yo nosotros todo nada nunca hemos ser tiene
    ich du er sie es wir ihr man mir mich uns sich ihm ihnen dass ist sind war waren hat haben hatte wird werden wurde kann
    muss sollte nicht kein keine aber denn doch weil wenn als ob wie auch noch schon sehr nur mehr hier dort und oder so wo was
    je tu il elle nous vous ils elles on me te se ce cela ça c est sont était ont avait ne pas plus jamais mais et ou où si
    qui quand comme parce car très aussi lui leur tout rien être sans même
    io lui lei noi loro mi ci si che non è sono era ho hanno ma perché quando come anche molto più questo
    eu ele ela nós eles não são foi estava tem mas porque quando também muito mais isto isso
    ik je hij zij wij het niet geen maar omdat als wanneer ook nog heel wat dit dat zijn was heeft hebben
    """.split()
)
# Articles and prepositions, which lists of things also use.
LINK_WORDS = frozenset(
    """
    the a an of in on at to for from with by about near into over after before
    el la los las un una unos unas de del al a en con por para desde hasta y o
    der die das den dem des ein eine einen einem einer im in am an auf aus bei mit nach seit von vor zu zum zur für
    le la les un une des du de au aux à dans par pour sur avec chez d l lo das
    il lo gli uno di da nel con su per o os um uma do no na ao em het een van op te
    """.split()
)

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_STOP = re.compile(r"[.!?…。！？]+[\"'»”)]*[\s\W]*$")
_UNIT = re.compile(r"[\n.;!?…。！？,|\t•·]+|\s[-–—/]\s|\s{2,}")
_MARK = re.compile(r"^\s*(?:[-–—•·*+>]\s|\[.?\]|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|#\w|[☐☑✓✔→▪◦‣●○])")
_FIELDS = re.compile(r"\t|\||\s{2,}|;|</t[dh]>|,\s*(?=-?[\d.]+\s*(?:,|$))")
_KEY = re.compile(r"^\s*[\"'{]?[\w .-]{1,24}[\"']?\s*[:=]\s*\S+")
_TAG = re.compile(r"<[^<>]{1,200}>|&\w{1,8};|https?://\S+|www\.\S+")
_CELL = re.compile(r"</?t[dhr]\b|\{\{|\}\}|\\hline|\"\s*:\s*[\"\d\[{]", re.I)
_LOG = re.compile(r"\b\d{1,2}:\d{2}:\d{2}\b|\b(?:ERR|ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\b|\b0x[0-9a-f]+\b|\w+=\w+|\b[\w.]+\(\w*\.?\w*:\d+\)|\bat [\w.$]+\(")
# Characters that end sentences, other punctuation, characters between units, and ranges of code points of
# scripts whose words the lists do not have.
_STOPS, _MARKS, _CUTS = ".!?…。！？", ".,!?;:'’\"()…-", "\n.;!?…。！？,|\t•·"
_SCRIPTS = ((0x0370, 0x1DFF), (0x2C00, 0xA71F), (0xA800, 0xAAFF), (0xABC0, 0xFAFF), (0xFB13, 0xFDFF), (0xFE70, 0xFEFF), (0xFF66, 0xFFDC))
_LATIN = re.compile(r"^[a-zà-ÿœßāăąćčďęěğıłńňőřśşšťůűźżž]+$")


def pieces_of(text: str) -> list[tuple[str, int]]:
    """Non-blank lines in order, long ones cut at blanks, each with the number of its line."""
    out = []
    for number, line in enumerate(text.splitlines()):
        if not line.strip():
            continue
        if len(line) <= PIECE_CHARS:
            out.append((line, number))
            continue
        if "  " not in line and "\t" not in line:
            tokens = line.split()
            ends = list(accumulate(len(t) + 1 for t in tokens))  # where the next token begins
            first = base = 0
            while first < len(tokens):
                k = min(first + PIECE_WORDS, max(first + 1, bisect_right(ends, base + PIECE_CHARS + 1, first)))
                out.append((" ".join(tokens[first:k]), number))
                first, base = k, ends[k - 1]
            continue
        spans = [m.span() for m in _TOKEN.finditer(line)]
        ends = [e for _, e in spans]
        first = 0
        while first < len(spans):
            begin = spans[first][0]
            k = min(first + PIECE_WORDS, max(first + 1, bisect_right(ends, begin + PIECE_CHARS, first)))
            out.append((line[begin : ends[k - 1]], number))
            first = k
    return out


class Letters:
    """Which letter pairs words are made of; tells made-up letter runs from words of any language it has seen."""

    #: Mean log2 probability of a letter pair below which a word is strange; words of fewer letters never are.
    FLOOR, LEAST = -5.6, 4

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.known = table.tolist(), {}

    @staticmethod
    def pairs(texts: Sequence[str]) -> np.ndarray:
        """How often each of 28 x 28 pairs occurs in whole texts: no letter (0), a-z, other letters (27)."""
        points = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where((points >= 97) & (points <= 122), points - 96, np.where(points < 192, 0, 27)).astype(np.int64)
        return np.bincount(codes[:-1] * 28 + codes[1:], minlength=28 * 28)

    @classmethod
    def counted(cls, pairs: np.ndarray) -> Letters:
        """Log2 probabilities of the next letter, add-one smoothed."""
        n = 1.0 + pairs.reshape(28, 28)
        return cls(np.log2(n / n.sum(axis=1, keepdims=True)))

    @staticmethod
    def _codes(word: str) -> list[int]:
        return [0, *(ord(c) - 96 if "a" <= c <= "z" else 27 for c in word), 0]

    def strange(self, word: str) -> bool:
        """Far too long, or (Latin letters only) of unlikely letter pairs."""
        if len(word) > 30:
            return True
        if len(word) < self.LEAST or not _LATIN.match(word):
            return False
        codes = self._codes(word)
        return sum(self.table[a][b] for a, b in zip(codes, codes[1:], strict=False)) / (len(codes) - 1) < self.FLOOR

    def kind(self, word: str) -> int:
        """1 for a clause word, plus 2 for a link word, plus 4 for a strange one; remembered for common words."""
        found = (word in CLAUSE_WORDS) + 2 * (word in LINK_WORDS) + 4 * self.strange(word)
        if len(self.known) < 200_000:
            self.known[word] = found
        return found


_LETTER, _DIGIT, _POINT, _SPACE, _CUT, _FOREIGN, _STOPPED = (1 << k for k in range(7))


def _flags_of(c: str) -> int:
    """Letters are what words are made of: word characters that are no decimal digit."""
    k = ord(c)
    return (
        _LETTER * (c.isalnum() and not c.isdecimal()) | _DIGIT * c.isdecimal() | _POINT * (c in _MARKS) | _SPACE * c.isspace() | _CUT * (c in _CUTS)
        | _FOREIGN * any(lo <= k <= hi for lo, hi in _SCRIPTS) | _STOPPED * (c in _STOPS)
    )


@functools.lru_cache(maxsize=1)
def _flag_table() -> np.ndarray:
    return np.array([_flags_of(chr(k)) for k in range(1 << 16)], np.uint8)


def _flags(points: np.ndarray) -> np.ndarray:
    """The flags of every code point; those beyond 65,535 are looked at one by one, each once."""
    out = _flag_table()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        kinds, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_flags_of(chr(k)) for k in kinds.tolist()], np.uint8)[at]
    return out


def _repeated(words: Sequence[str] | np.ndarray, doc: np.ndarray | None = None) -> list[bool]:
    """For each word that begins a triple of its document: whether the triple came up at most ``NEAR`` words before, or
    is in the fourth or a later copy of a longer passage: among ``COPY`` triples or more in a row that all came up the
    same distance before.

    Phrases repeated over and over come back at once, dumped blocks of any length as a whole; a sentence that someone
    writes again and again, between others, does neither. Words may be given by numbers; ``doc`` gives each word's
    document, ascending (default: all are of one).
    """
    codes = pd.factorize(words if isinstance(words, np.ndarray) else np.array(words, object))[0].astype(np.int64)
    doc = np.zeros(len(codes), np.int64) if doc is None else doc
    at = np.flatnonzero(doc[2:] == doc[:-2])
    if not len(at):
        return []
    pair = pd.factorize(codes[:-1] * len(codes) + codes[1:])[0]
    triple = pd.factorize(pair[at] * len(codes) + codes[at + 2])[0]
    doc = doc[at]
    order = np.lexsort((at, triple, doc))
    a, d = triple[order], doc[order]
    begins = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]
    lag, earlier, place = np.zeros(len(at), np.int64), np.empty(len(at), np.int64), np.arange(len(at))
    lag[order[1:]] = np.where(begins[1:], 0, at[order[1:]] - at[order[:-1]])
    earlier[order] = place - np.maximum.accumulate(np.where(begins, place, 0))
    edge = np.flatnonzero(np.r_[True, (lag[1:] != lag[:-1]) | (doc[1:] != doc[:-1])])
    run = np.repeat(np.diff(np.r_[edge, len(lag)]), np.diff(np.r_[edge, len(lag)]))
    return (((lag > 0) & (lag <= NEAR)) | ((lag > NEAR) & (run >= COPY) & (earlier >= 3))).tolist()


#: Number of values of each feature, in the order of ``features``.
SIZES = (5, 5, 5, 4, 4, 4, 2, 2, 4, 4, 5, 3, 3, 2, 3, 4, 16, 16, 160)
#: Features that rest on the word lists or on blanks between words; unknown (-1) in scripts the lists have no word of.
LISTED = (0, 1, 2, 10, 16, 17, 18)


def _measured(parts: list[str], doc: np.ndarray, letters: Letters) -> dict[str, np.ndarray]:
    """Raw measures of all pieces of a batch at once, by name. ``doc``: the number of each piece's document, ascending.

    What characters tell is counted over the batch's text as one array; patterns are tried only on pieces that have the
    characters they need.
    """
    bare = [p.strip() for p in parts]
    text = "\n".join(bare)
    low = text.lower()
    if len(low) != len(text):  # some characters have longer small forms; places must stay
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(p) for p in bare])
    first = np.cumsum(size + 1) - size - 1
    flags = _flags(points)
    n = len(bare)
    count = lambda mask: np.add.reduceat(mask, first, dtype=np.int64)
    has = lambda chars: count(np.isin(points, [ord(c) for c in chars])) > 0
    letter, digit, space = flags & _LETTER > 0, flags & _DIGIT > 0, flags & _SPACE > 0
    solid, digits = count(~space), count(digit)

    # tokens that are codes: too long for a word, or digits with letters of both cases; letter runs in them are no words
    gaps = np.r_[True, space, True]
    begin, end = np.flatnonzero(gaps[:-1] & ~gaps[1:]), np.flatnonzero(~gaps[:-1] & gaps[1:])
    long = end - begin > 12
    begin, end = begin[long], end[long]
    coded, mixed = np.zeros(len(points), bool), np.zeros(n, np.int64)
    if len(begin):
        each = lambda mask: np.add.reduceat(np.r_[mask, False], np.ravel(np.column_stack([begin, end])), dtype=np.int64)[::2] > 0
        code = ((end - begin > 40) & ~each(flags & _FOREIGN > 0)) | (each(digit) & each((points >= 97) & (points <= 122)) & each((points >= 65) & (points <= 90)))
        for x, y in zip(begin[code].tolist(), end[code].tolist(), strict=True):
            coded[x:y] = True
        mixed = count(coded)

    in_word = letter & ~coded
    edges = np.r_[False, in_word, False]
    begin, end = np.flatnonzero(~edges[:-1] & edges[1:]), np.flatnonzero(edges[:-1] & ~edges[1:])
    of = np.searchsorted(first, begin, side="right") - 1
    numbers, different = pd.factorize(np.array([low[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], object))
    kind = np.array([letters.known[w] if w in letters.known else letters.kind(w) for w in different], np.int64)[numbers] if len(begin) else np.zeros(0, np.int64)
    tally = lambda weight: np.bincount(of, weights=weight, minlength=n)
    words = tally(np.ones(len(of)))
    clause, link = tally((kind == 1) | (kind == 3)), tally((kind == 2) | (kind == 3))
    odd, alphabetic = tally((kind >= 4) * (end - begin)), tally(end - begin)

    again = np.zeros(len(of), bool)
    mine = doc[of]
    again[np.flatnonzero(mine[2:] == mine[:-2])] = _repeated(numbers, mine)

    # units: stretches with a letter between punctuation, dashes and gaps
    dash = np.isin(points, [ord(c) for c in "-–—/"])
    cut = flags & _CUT > 0
    cut |= dash & np.r_[False, space[:-1]] & np.r_[space[1:], False]
    cut |= space & np.r_[space[1:], False]
    at = np.flatnonzero(letter)
    stretch = np.cumsum(cut)[at]
    units = np.bincount(np.searchsorted(first, at[np.r_[True, stretch[1:] != stretch[:-1]]] if len(at) else at, side="right") - 1, minlength=n)

    def found(pattern: re.Pattern, where: np.ndarray, measure: Callable[[list], int] = len) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for k in np.flatnonzero(where).tolist():
            out[k] = measure(pattern.findall(bare[k]))
        return out

    fields = found(_FIELDS, has("\t|;<") | (count(space & np.r_[space[1:], False]) > 0) | (has(",") & (digits > 0)))
    same = np.r_[False, (fields[1:] == fields[:-1]) & (doc[1:] == doc[:-1])]
    tags = found(_TAG, has("<&:") | np.array(["w." in p for p in bare]), lambda m: sum(map(len, m)))
    stops, pair = count(flags & _STOPPED > 0) > 0, has(":=")
    mark = np.array([bool(_MARK.match(p)) for p in parts])
    ended = np.array([s and bool(_STOP.search(p[-16:])) for s, p in zip(stops.tolist(), bare, strict=True)])
    key = np.array([x and bool(_KEY.match(p)) for x, p in zip((pair & (words <= 6) & (clause == 0)).tolist(), parts, strict=True)])
    hashes = np.array([sum(t.count("#") for t in p.split() if t[0] == "#") if x else 0 for x, p in zip(has("#").tolist(), bare, strict=True)])
    share = lambda v: np.divide(v, words, out=np.zeros(n), where=words > 0)
    return {
        "words": words, "clauses": clause, "clause": share(clause), "link": share(link), "per_unit": np.divide(words - link, units, out=np.zeros(n), where=units > 0), "digits": digits / solid, "other": (solid - alphabetic - digits - count(flags & _POINT > 0)) / solid,
        "odd": np.maximum(odd, mixed) / solid, "repeat": share(tally(again)), "fields": fields, "alike": (fields >= 1) & (same | np.r_[same[1:], False]), "key": key, "logs": found(_LOG, (digits > 0) | has("=(")), "tags": tags / solid, "cells": found(_CELL, has('<{"\\')),
        "mark": mark, "hash": hashes, "end": ended, "units": units, "letters": alphabetic / solid, "solid": solid, "foreign": 2 * count(flags & _FOREIGN > 0) > alphabetic,
    }


def features_of(texts: Sequence[str], letters: Letters) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(features of all pieces, end to end; their raw measures; the number of pieces of each text)."""
    cut = [[p for p, _ in pieces_of(t)] for t in texts]
    lengths = np.array([len(c) for c in cut], np.int64)
    parts = [p for c in cut for p in c]
    if not parts:
        return np.zeros((0, len(SIZES)), np.int64), {}, lengths
    r = _measured(parts, np.repeat(np.arange(len(cut)), lengths), letters)
    level = lambda bounds, name: np.searchsorted(bounds, r[name], side="left")
    shape, odd, repeat, end = level((1.5, 2.2, 3.2, 5.0), "per_unit"), level((0.0, 0.1, 0.4), "odd"), level((0.3, 0.5, 0.7), "repeat"), r["end"].astype(np.int64)
    # what oddness, repeats, the shape of the units and the end tell depends on the clause and link words
    talk = np.select([r["clause"] >= 0.15, r["clauses"] > 0, r["link"] >= 0.1], [3, 2, 1], 0)
    x = np.column_stack([
        level((0.0, 0.07, 0.15, 0.25), "clause"), np.searchsorted((0.0, 0.12, 0.25, 0.4), r["clause"] + r["link"], side="left"), shape, level((0.0, 0.08, 0.3), "digits"), level((0.0, 0.04, 0.2), "other"),
        np.minimum(3, r["fields"]), end, r["mark"], repeat, odd, level((0, 3, 7, 15), "words"), np.select([r["alike"] & (r["fields"] >= 2), r["alike"]], [2, 1], 0), np.minimum(2, r["logs"]), r["key"], np.select([r["cells"] > 0, r["tags"] > 0.2], [2, 1], 0),
        level((0.2, 0.4, 0.7), "letters"), talk * 4 + odd, talk * 4 + repeat, ((talk * 5 + shape) * 4 + level((1, 3, 7), "units")) * 2 + end,
    ]).astype(np.int64)
    x[np.ix_(r["foreign"], LISTED)] = -1
    return x, r, lengths


def features(text: str, letters: Letters) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(features of the pieces, their non-blank characters, raw measures) of one text; empty for a blank one."""
    x, r, _ = features_of([text], letters)
    return x, r["solid"].astype(float) if r else np.zeros(0), [{k: v[j] for k, v in r.items()} for j in range(len(x))]


def plain_case(r: dict) -> np.ndarray:
    """State of pieces whose kind is plain, else -1; ``r``: raw measures by name, of one piece or of many."""
    prose = (r["repeat"] < 0.3) & (r["digits"] < 0.15) & (r["odd"] < 0.1) & r["end"]
    cases = [
        (r["cells"] >= 2, TABLE),
        ((r["logs"] >= 2) & (r["clause"] < 0.1), JUNK),
        ((r["repeat"] > 0.7) & (r["words"] >= 6), JUNK),
        ((r["odd"] > 0.4) | ((r["letters"] < 0.2) & np.logical_not(r["alike"])), JUNK),
        (r["tags"] > 0.5, JUNK),
        (r["key"] | (r["alike"] & (r["fields"] >= 2) & (r["clause"] < 0.08)), TABLE),
        (r["hash"] >= 2, LIST),
        ((r["clause"] >= 0.15) & (r["words"] >= 8) & (r["repeat"] < 0.5) & (r["per_unit"] >= 2.5) & (r["digits"] < 0.15), PROSE),
        # without sentences of few clause words the model would count them to the junk, for want of any like them
        (prose & (r["clause"] > 0) & (r["clause"] + r["link"] >= 0.25) & (r["words"] >= 6) & (r["per_unit"] >= 2.5), PROSE),
        (prose & (r["link"] >= 0.25) & (r["words"] >= 8) & (r["units"] <= 2), PROSE),
        ((r["clause"] == 0) & (r["words"] >= 2) & (r["per_unit"] <= 3.0) & (r["digits"] < 0.25) & (r["mark"] | (r["units"] >= 4)), LIST),
        ((r["clause"] == 0) & (r["words"] >= 10) & (r["units"] <= 2) & (r["link"] < 0.1), JUNK),
    ]
    return np.select([c for c, _ in cases], [v for _, v in cases], -1)


#: Cells of the counts: first states, transitions, and state by value of each feature, one after another.
_STARTS = np.cumsum([0, 4, 16, *(4 * size for size in SIZES)])


def cells(x: np.ndarray, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts by cell from the features and states (-1: unknown, skipped) of documents of the given lengths, end to end."""
    out = np.zeros(_STARTS[-1], np.int64)
    begins = np.zeros(len(s), bool)
    begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    known = s >= 0
    out[:4] = np.bincount(s[begins & known], minlength=4)
    both = known[1:] & known[:-1] & ~begins[1:]
    out[4:20] = np.bincount(s[:-1][both] * 4 + s[1:][both], minlength=16)
    for j, size in enumerate(SIZES):
        seen = known & (x[:, j] >= 0)
        out[_STARTS[j + 2] : _STARTS[j + 3]] = np.bincount(s[seen] * size + x[seen, j], minlength=4 * size)
    return out


class LineModel:
    """Log probabilities of first states, transitions and feature values."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: list[np.ndarray], letters: Letters) -> None:
        self.first, self.move, self.emit, self.letters = first, move, emit, letters

    @classmethod
    def counted(cls, counts: np.ndarray, letters: Letters) -> LineModel:
        """From counts by cell, add-one smoothed, with a bias to staying in a state."""
        norm = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
        emit = [norm(1.0 + counts[_STARTS[j + 2] : _STARTS[j + 3]].reshape(4, size)) for j, size in enumerate(SIZES)]
        return cls(norm(1.0 + counts[:4]), norm(1.0 + 4 * np.eye(4) + counts[4:20].reshape(4, 4)), emit, letters)

    def label(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Most probable states (Viterbi) of the pieces of documents of the given lengths, end to end (default: one
        document); ties go to the earlier state. All documents advance together, one piece a step."""
        lengths = np.array([len(x)]) if lengths is None else lengths
        if not len(x):
            return np.zeros(0, np.int64)
        # features overlap in what they tell, so their joint evidence is tempered
        score = sum(np.where(x[:, j] >= 0, e[:, x[:, j]], 0.0) for j, e in enumerate(self.emit)).T * 0.6
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        longest_first = lengths[order]
        start, longest_first = start[longest_first > 0], longest_first[longest_first > 0]
        alive = np.searchsorted(-longest_first, -np.arange(longest_first[0]), side="left")  # documents that have a piece t
        back = np.zeros(score.shape, np.int8)
        best = self.first + score[start]
        for t in range(1, longest_first[0]):
            n = alive[t]
            ways = best[:n, :, None] + self.move
            back[start[:n] + t] = ways.argmax(axis=1)
            best[:n] = ways.max(axis=1) + score[start[:n] + t]
        out = np.empty(len(x), np.int64)
        at = best.argmax(axis=1)
        for t in range(longest_first[0] - 1, -1, -1):
            n = alive[t]
            out[start[:n] + t] = at[:n]
            at[:n] = back[start[:n] + t, at[:n]]
        return out


def train(texts: list[str]) -> LineModel:
    """A model from unlabelled texts on the driver, by the same counts as :func:`train_on`; for small samples."""
    letters = Letters.counted(Letters.pairs(texts))
    x, r, lengths = features_of(texts, letters)
    return LineModel.counted(cells(x, plain_case(r), lengths) if len(x) else np.zeros(_STARTS[-1], np.int64), letters)


CELLS = "cell int, n long"


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Counts by cell over all tasks; at most ``size`` rows reach the driver."""
    out = np.zeros(size, np.int64)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _cell_rows(total: np.ndarray) -> pd.DataFrame:
    some = np.flatnonzero(total)
    return pd.DataFrame({"cell": some.astype(np.int32), "n": total[some]})


def letters_of(docs: DataFrame) -> Letters:
    """The letter-pair table over the texts of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(28 * 28, np.int64)
        for pdf in batches:
            total += Letters.pairs(pdf["text"].tolist())
        yield _cell_rows(total)

    return Letters.counted(_summed(docs.filter(F.col("text").isNotNull()).select("text").mapInPandas(run, CELLS), 28 * 28))


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of documents within both bounds of a batch, or of a single larger document."""
    first = held = 0
    for k, size in enumerate(sizes):
        if k > first and (k - first >= BATCH_DOCS or held + size > BATCH_CHARS):
            yield first, k
            first, held = k, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


FEATURED = "doc_id long, pieces int, x binary, weight binary, state binary"


def featured(docs: DataFrame, letters: Letters) -> DataFrame:
    """Features, non-blank characters and plain states of every document's pieces, packed as bytes, written.

    Null and blank texts have 0 pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo, hi in _batches([len(t or "") for t in whole["text"]]):
                pdf = whole.iloc[lo:hi]
                x, r, lengths = features_of([t or "" for t in pdf["text"]], letters)
                packed = (x + 1).astype(np.uint8), *((r["solid"].astype(np.int32), plain_case(r).astype(np.int8)) if r else (np.zeros(0, np.int32), np.zeros(0, np.int8)))
                ends = np.cumsum(lengths)
                pieces = {name: [v[x:y].tobytes() for x, y in zip(ends - lengths, ends, strict=True)] for name, v in zip(("x", "weight", "state"), packed, strict=True)}
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "pieces": lengths.astype(np.int32), **pieces})

    return written(docs.select("doc_id", "text").mapInPandas(run, FEATURED))


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, states, lengths) of a batch of packed documents, end to end."""
    x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(-1, len(SIZES)).astype(np.int64) - 1
    return x, np.frombuffer(b"".join(pdf["weight"]), np.int32).astype(float), np.frombuffer(b"".join(pdf["state"]), np.int8).astype(np.int64), pdf["pieces"].to_numpy().astype(np.int64)


def counted(packed: DataFrame, letters: Letters) -> LineModel:
    """The model of all documents' plain cases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_STARTS[-1], np.int64)
        for pdf in batches:
            x, _, s, lengths = _unpacked(pdf)
            total += cells(x, s, lengths)
        yield _cell_rows(total)

    return LineModel.counted(_summed(packed.filter("pieces > 0").mapInPandas(run, CELLS), _STARTS[-1]), letters)


def train_on(docs: DataFrame) -> LineModel:
    """The model of ``docs`` (doc_id, text)."""
    letters = letters_of(docs)
    return counted(featured(docs, letters), letters)


def shares(text: str | None, model: LineModel) -> tuple[float, float, float, float] | None:
    """Shares of the states by non-blank characters; null for a text without any."""
    if not text:
        return None
    x, weight, _ = features(text, model.letters)
    if not len(x):
        return None
    s = model.label(x)
    total = weight.sum()
    return tuple(float(weight[s == k].sum() / total) for k in range(4))


LABELLED = "doc_id long, prose double, list double, table double, junk double"


def label_packed(packed: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, prose, list, table, junk of packed documents: shares of non-blank characters; nulls without pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, weight, _, lengths = _unpacked(pdf)
            cell = np.repeat(np.arange(len(pdf)), lengths) * 4 + model.label(x, lengths)
            sums = np.bincount(cell, weights=weight, minlength=4 * len(pdf)).reshape(-1, 4)
            with np.errstate(invalid="ignore"):
                found = sums / sums.sum(axis=1, keepdims=True)
            out = pd.DataFrame(found, columns=list(STATES))  # NaN, which Arrow takes for null, without pieces
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return packed.mapInPandas(run, LABELLED)


def label_shares(docs: DataFrame, model: LineModel) -> DataFrame:
    """The shares of documents (doc_id, text) under a model trained before."""
    return label_packed(featured(docs, model.letters), model)


def label_documents(docs: DataFrame) -> DataFrame:
    """The shares of documents (doc_id, text) under the model of themselves; features are computed once."""
    letters = letters_of(docs)
    packed = featured(docs, letters)
    return label_packed(packed, counted(packed, letters))


def statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Plain statistics per document, in built-in expressions.

    words (separated by white space), mean_word_length (characters; null without words), symbol_ratio (characters that
    are neither letters, digits nor white space, of all non-blank ones), lines (non-blank), punctuated_lines (share
    ending in . ! ? or …), common_words (share of words, lower case and stripped of punctuation, in ``common`` for the
    document's language; any language's where its own is unknown). Blank and null texts have 0 words and lines, and
    null ratios.
    """
    from lodestream.operators.skew import broadcast_if_small

    lists = common.select(F.lower("lang").alias("_lang"), F.lower("word").alias("w")).filter(F.col("w").isNotNull())
    known = lists.groupBy("_lang").agg(F.collect_set("w").alias("_own"))
    anyone = lists.agg(F.collect_set("w").alias("_any"))
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"\n"), lambda x: F.btrim(x) != "")
    bare = F.regexp_replace(text, r"\s", "")
    base = docs.select("doc_id", F.lower("lang").alias("_lang"), words.alias("_w"), lines.alias("_l"), F.length(bare).alias("_c"), F.length(F.regexp_replace(bare, r"[\p{L}\p{N}]", "")).alias("_s"))
    joined = base.join(broadcast_if_small(known, 1_000), "_lang", "left").join(broadcast_if_small(anyone, 1_000))
    own = F.coalesce("_own", "_any")
    plain = F.transform("_w", lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    n, rows = F.size("_w"), F.size("_l")
    return joined.select(
        "doc_id",
        n.alias("words"),
        F.when(n > 0, F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w)) / n).alias("mean_word_length"),
        F.when(F.col("_c") > 0, F.col("_s") / F.col("_c")).alias("symbol_ratio"),
        rows.alias("lines"),
        F.when(rows > 0, F.size(F.filter("_l", lambda x: F.rtrim(x).rlike("[.!?…]$"))) / rows).alias("punctuated_lines"),
        F.when(n > 0, F.size(F.filter(plain, lambda w: F.array_contains(own, w))) / n).alias("common_words"),
    )


