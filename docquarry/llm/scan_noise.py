"""Problem 4: noise in text read from scanned pages.

One averaged perceptron makes every decision.  Its places are found by plain patterns; what happens there it decides
from features of the word, the line and the page:

* characters: replace (also two for one, and one for two) or keep, wherever a misreading may stand;
* spaced-out characters: delete the space, or keep it between two words;
* line ends: join the parted word, or keep the hyphen that is its own;
* lines and spans that may be a running title or a page number: remove or keep, from their place on the page, the
  shape, the neighbours, and how the line returns in its file.

It is fitted on all clean texts of the table, with damage of all these kinds planted in them; without weights it
changes nothing.
"""

from __future__ import annotations

import math
import random
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.name_links import slip
from docquarry.llm.print_forms import canonical
from docquarry.storage import materialize

# Frequent misreadings, true form -> what is read.
MISREAD_LATIN = [
    ("e", "c"), ("i", "l"), ("l", "1"), ("d", "cl"), ("u", "ii"), ("g", "q"), ("h", "b"), ("m", "rn"), ("w", "vv"),
    ("S", "5"), ("5", "S"), ("O", "0"), ("0", "O"), ("1", "l"), ("B", "8"), ("8", "B"),
]
MISREAD_HAN = dict(
    zip("木曰捡己植卒斯夭摸椐素仔敖庶曾问牧折刑汀太人土未千侯冶戊", "本日检已值率期天模据索存数应增间收析型订大入士末干候治戌")
)
TERMINAL = ".。!?;:,、"
MANY = 5  # places from which misread characters are reported
TITLE_TIMES = 3
EPOCHS = 3

_SEP = "\x1f"
_CACHED = 400_000
_READS = {t: [r for true, r in MISREAD_LATIN if true == t] for t, _ in MISREAD_LATIN}
_TRUES = {r: sorted(t for t, read in MISREAD_LATIN if read == r) for _, r in MISREAD_LATIN}
_PAIRED = re.compile("[" + "".join({*MISREAD_HAN, *MISREAD_HAN.values()}) + "]")
_PAIRED_RUN = re.compile(f"{_PAIRED.pattern}(?:.?{_PAIRED.pattern})*")
_READ_HAN = {t: r for r, t in MISREAD_HAN.items()}
_WORD = re.compile("[A-Za-zÀ-ɏ0-9]+")
_HAN = re.compile("[一-鿿]")
_ODD_HAN = re.compile("[" + "".join(MISREAD_HAN) + "]")
_SPACED = re.compile("(?:(?<=^)|(?<=[^A-Za-z0-9]))(?:[^\\s] {1,3}){4,}[^\\s](?![^\\s])|(?:[一-鿿,。、;] ){3,}[一-鿿,。、;]", re.M)
_BREAK = "(?:[ \t]*\r?\n[ \t]*|[ \t]+)"
_HYPHEN = re.compile(f"([A-Za-zÀ-ɏ0-9]*[A-Za-zÀ-ɏ])([-‐¬\xad]){_BREAK}([A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9]*)")
_COMPOUND = re.compile("(?<![A-Za-zÀ-ɏ-])([A-Za-zÀ-ɏ]+)-([A-Za-zÀ-ɏ]+)(?![A-Za-zÀ-ɏ-])")
# forms of a page number: first character, rest
_NUMBERS = [
    ("[-—–·•]", " ?[0-9]{1,4} ?[-—–·•]"), ("\\[", " ?[0-9]{1,4} ?\\]"), ("第", " ?[0-9]{1,4} ?页(?:[ ,/]*共 ?[0-9]{1,4} ?页)?"),
    ("[Pp]", "age [0-9]{1,4}(?: (?:of|/) [0-9]{1,4})?"), ("[Pp]", "\\. ?[0-9]{1,4}"), ("[0-9]", "[0-9]{0,3} / [0-9]{1,4}"),
    ("[0-9]", "[0-9]{0,3} ?\\|"), ("\\|", " ?[0-9]{1,4}"),
]
_NUMBER = "|".join(first + rest for first, rest in _NUMBERS)
_NUMBER_LINE = re.compile(f"^[ \t]*(?:{_NUMBER})[ \t]*$", re.M)
_NUMBER_END = re.compile(f"[ \t]*(?:{_NUMBER})$")
_NUMBER_ENDS = frozenset("-—–·•]页|0123456789")
# the first character leads, so that a search looks at such characters only: after a blank or at the start of the text
_NUMBER_AMID = re.compile("[-—–·•\\[第Pp0-9|](?<![^ \t].)(?:" + "|".join(f"(?<={first}){rest}" for first, rest in _NUMBERS) + ")(?=[ \t]|$)")
_BARE_LINE = re.compile("^[ \t]*[0-9]{1,4}[ \t]*$")
_STAMP = "(?: {2,}[^ \n]{2,6})?"
_SHY_MARK = re.compile("\xad(?=[ \t]*\r?\n|[ \t]+[a-z])")
_HYPHEN_HINT = re.compile("[-‐¬\xad][ \t\r\n]")
_SPACED_HINT = re.compile(" [^ ] {1,3}[^ ] ")
# a break leads, so that a search looks at blanks only
_WRAP = "(?:(?<=\n)|(?<=[ \t])[ \t]*\n)[ \t]*"
_HAN_WRAP = re.compile(f"[ \t\n](?<=[一-鿿,。;:、0-9][ \t\n]){_WRAP}(?=[一-鿿0-9,。;])")
_WORD_WRAP = re.compile(f"[ \t\n](?<=[^\n.。!?:#][ \t\n]){_WRAP}(?=[a-zà-ɏ0-9(])")
_BLANKS = re.compile("[ \t]+")
_DIGIT = re.compile("[0-9]")
_STAMPED = re.compile(" {2,}[^ \n]{2,8}$")
_STAMP_END = re.compile(" {2,}[^ ]{1,8}$")
_TITLE_END = re.compile(f"{_STAMP}(?: [0-9]{{1,3}}(?= |$))?(?=\\s|$)")
_FOLDS = re.compile("[^\0-´¶-įĲ-ž\u2010-\u205e\u3000-\u9fff]")  # beside these, one letter may have several small forms
_NOT_HAN = re.compile("[^一-鿿]{2,}")
_WIDE = re.compile(" {2,}")
_PART = re.compile("\\S+")
_LETTERS_2 = re.compile("[A-Za-z]{2,}")
_LETTERS_5 = re.compile("[A-Za-zÀ-ɏ]{5,}")
_NAMES = re.compile("[A-Z一-鿿](?:(?<=[A-Z])[a-z]{3,} [A-Z][a-z]{3,}|(?<=[一-鿿])[一-鿿]{3})")
_SENTENCE_END = re.compile("([.。])")
_FIGURES = re.compile("[0-9. ,%]+")
_SUSPENDED = {"and", "or", "to", "und", "nor"}
# Forms of printed page numbers, for planting.
PLANTED_NUMBERS = ("- {} -", "— {} —", "· {} ·", "[{}]", "第{}页", "第 {} 页", "第{}页 共{}页", "Page {}", "Page {} of {}", "P.{}", "p. {}", "{} / {}", "{} |", "| {}")
PLANTED_TITLES = ("Annual Report {}", "Technical Manual {}", "Case Notes {}", "{}年年度报告", "{}年技术手册", "{}年会议纪要")
_QUOTES = "《\"'(["


class _GramLogs(dict):
    """Log likelihood of the last character of a triple, by the counts of an editor."""

    def __init__(self, grams: dict[str, int]) -> None:
        self.grams = grams

    def __missing__(self, gram: str) -> float:
        log = math.log((self.grams.get(gram, 0) + 0.05) / (self.grams.get(gram[:2], 0) + 5))
        if len(self) < _CACHED:
            self[gram] = log
        return log


_LEVELS = [0, *(min(4, int(math.log2(n + 1) / 2 + 0.99)) for n in range(1, 66))]


@dataclass
class Editor:
    """Averaged-perceptron weights, and the counts of the clean texts that its features read."""

    weights: dict[str, float] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    compounds: dict[str, int] = field(default_factory=dict)
    lefts: set[str] = field(default_factory=set)
    rights: set[str] = field(default_factory=set)
    total: int = 1
    word_cache: dict[str, tuple[str, int]] = field(default_factory=dict)
    kept: set[str] = field(default_factory=set)  # words of word_cache that stay as they are
    gram_logs: _GramLogs | None = None
    site_scores: dict[tuple, float] = field(default_factory=dict)
    han_cache: dict[str, bool] = field(default_factory=dict)
    join_cache: dict[str, bool] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"word_cache": {}, "kept": set(), "gram_logs": None, "site_scores": {}, "han_cache": {}, "join_cache": {}}

    # features -----------------------------------------------------------------------------------------------------
    def _level(self, n: int) -> int:
        return _LEVELS[n] if n < 66 else 4

    def _spelling(self, word: str) -> float:
        s = f"^{word}$"
        logs = self.gram_logs
        if logs is None or logs.grams is not self.grams:
            logs = self.gram_logs = _GramLogs(self.grams)
        got = [logs[s[i : i + 3]] for i in range(len(s) - 2)]
        return sum(got) / max(len(got), 1)

    def latin_sites(self, word: str) -> list[tuple[int, str, str]]:
        """(place, read, true) of every misreading that ``word`` may hold."""
        out = []
        for i, c in enumerate(word):
            for read in (c, word[i : i + 2]) if i + 1 < len(word) else (c,):
                if read in _TRUES:
                    out += [(i, read, true) for true in _TRUES[read]]
        return out

    def latin_features(self, word: str, sites: list[tuple[int, str, str]]) -> list[tuple[str, ...]]:
        return [_site_told(*x) for x in self._site_facts(word, sites)]

    def _site_facts(self, word: str, sites: list[tuple[int, str, str]]) -> list[tuple]:
        """What the features of each misreading are made of."""
        if not sites:
            return []
        low = word.lower()
        known = self._level(self.words.get(low, 0))
        best, used = 0, 0
        if not known and sites and len(sites) <= 7:
            count = self.words.get
            for fixed, picked in _fixes(word, sites):
                n = count(fixed.lower(), 0)
                if n > best or (n and n == best and picked.bit_count() < used.bit_count()):
                    best, used = n, picked
        now = self._spelling(low)
        digits = sum(map(str.isdigit, word)) * 2 >= len(word)
        title, whole = word[:1].isupper(), self._level(best)
        count = self.words.get
        out = []
        for k, (i, read, true) in enumerate(sites):
            end = i + len(read)
            fixed = (word[:i] + true + word[end:]).lower()
            gain = max(-6, min(6, round(2 * (self._spelling(fixed) - now))))
            before, after = word[i - 1 : i] or "^", word[end : end + 1] or "$"
            shape = before.isdigit() or after.isdigit()
            out.append((read, true, known, whole, used >> k & 1, self._level(count(fixed, 0)), gain, before, after, shape, digits, title))
        return out

    def _site_score(self, facts: tuple) -> float:
        got = self.site_scores.get(facts)
        if got is None:
            got = self.score(_site_told(*facts))
            if len(self.site_scores) < _CACHED:
                self.site_scores[facts] = got
        return got

    def han_features(self, around: str) -> list[str]:
        """Features of the character amid the five of ``around``."""
        x, y = around[2], MISREAD_HAN[around[2]]
        g = self.grams.get

        def ratio(a: str, b: str, c: str = "", d: str = "") -> int:
            return max(-6, min(6, round(math.log2((g(a + y + b, 0) + g(c + y + d, 0) + 0.3) / (g(a + x + b, 0) + g(c + x + d, 0) + 0.3)))))

        p2, p1, _x, n1, n2 = around
        two, left, right, mid = ratio(p1, "", "", n1), ratio(p2 + p1, ""), ratio("", n1 + n2), ratio(p1, n1)
        return ["hbias", f"h{x}", f"two{two}", f"left{left}", f"right{right}", f"mid{mid}", f"h{x} two{two}", f"lr{left > 0}{right > 0}"]

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features)

    # edits --------------------------------------------------------------------------------------------------------
    def word(self, word: str) -> tuple[str, int]:
        """``word`` repaired, and how many misreadings that took."""
        got = self.word_cache.get(word)
        if got is None:
            sites = self.latin_sites(word)
            chosen = []
            if sites and len(word) > 1:
                rated = [(self._site_score(f), s) for f, s in zip(self._site_facts(word, sites), sites)]
                end = -1
                for score, s in sorted(rated, key=lambda x: (x[1][0], -x[0])):
                    if score > 0 and s[0] >= end:
                        chosen.append(s)
                        end = s[0] + len(s[1])
            got = (_apply(word, chosen) or word, len(chosen))
            if len(self.word_cache) < _CACHED:
                self.word_cache[word] = got
                if not chosen:
                    self.kept.add(word)
        return got

    def han(self, around: str) -> bool:
        """Whether the middle one of five characters is misread."""
        got = self.han_cache.get(around)
        if got is None:
            got = self.score(self.han_features(around)) > 0
            if len(self.han_cache) < _CACHED:
                self.han_cache[around] = got
        return got

    def break_features(self, left: str, mark: str, right: str) -> tuple[str, ...]:
        """Features of a hyphen at a line end: what the words, their compounds and their repaired forms tell, in this order."""
        a, b = left.lower(), right.lower()
        known = f"{a in self.words:d}{b in self.words:d}"
        whole, own = self.words.get(a + b, 0), self.compounds.get(f"{a}-{b}", 0)
        if mark in "¬\xad":
            told = "mark"
        elif b in _SUSPENDED:
            told = "suspended"
        elif own or whole:
            told = f"form{whole > own:d}"
        else:
            a, b = self.word(left)[0].lower(), self.word(right)[0].lower()
            whole, own = self.words.get(a + b, 0), self.compounds.get(f"{a}-{b}", 0)
            told = f"repaired{whole > own:d}" if own or whole else "part" if b in self.rights or (a in self.lefts and b in self.words) else "none"
        return _break_told(told, known, f"{min(len(a), 4)}{min(len(b), 4)}", f"{left[:1].isupper():d}{right[:1].isupper():d}")

    def parted(self, left: str, mark: str, right: str) -> bool:
        """Whether a hyphen at a line end parts a word, rather than being the word's own."""
        key = f"{left}{mark}{right}"
        got = self.join_cache.get(key)
        if got is None:
            got = self.score(self.break_features(left, mark, right)) > 0
            if len(self.join_cache) < _CACHED:
                self.join_cache[key] = got
        return got

    def segments(self, letters: str) -> list[tuple[int, int]]:
        """The likeliest words (start, end) that make up a run of letters; a run of unknown letters is one word."""
        n = len(letters)
        low = letters.lower()
        words, log, total = self.words, math.log, self.total
        values, froms, known = [0.0] + [-1e9] * n, [0] * (n + 1), [True] + [False] * n
        for j in range(1, n + 1):
            most, at, told = values[j], 0, False
            for i in range(max(0, j - 24), j):
                count = words.get(low[i:j], 0) if j - i > 1 else 0
                value = values[i] + (log(count / total) if count else _UNKNOWN[j - i])
                if value > most:
                    most, at, told = value, i, count > 0
            values[j], froms[j], known[j] = most, at, told
        out, j = [], n
        while j:
            out.append((froms[j], j, known[j]))
            j = froms[j]
        merged: list[tuple[int, int, bool]] = []
        for x in reversed(out):
            if merged and not merged[-1][2] and not x[2]:
                merged[-1] = (merged[-1][0], x[1], False)
            else:
                merged.append(x)
        return [(i, j) for i, j, _ in merged]

    def gap_features(self, run: str) -> list[tuple[str, ...]]:
        """Features of every gap in a spaced-out run of characters."""
        chars = run.split()
        kinds = [_char_kind(c) for c in chars]
        out: list[tuple[str, ...]] = []
        at = 0
        for piece in _WIDE.split(run) if "  " in run else (run,):
            letters = piece.replace(" ", "")
            words = [(0, len(letters))] if _HAN.search(letters) else self.segments(letters)
            length = min(5, len(letters) // 3)
            for i, j in words:
                known, word = self._level(self.words.get(letters[i:j].lower(), 0)), min(4, j - i)
                for k in range(i, j):
                    if k or at:
                        out.append(_gap_told(kinds[at + k - 1] + kinds[at + k], 1 if k else 2, k == i and k > 0, known, length, word))
            at += len(letters)
        return out if len(out) == len(chars) - 1 else []

    def unspaced(self, run: str) -> tuple[str, int]:
        """A spaced-out run without the spaces inside its words, and how many were deleted."""
        rated = [self.score(f) > 0 for f in self.gap_features(run)]
        chars = run.split()
        if len(rated) != len(chars) - 1 or not any(rated):
            return run, 0
        return chars[0] + "".join(("" if cut else " ") + c for c, cut in zip(chars[1:], rated)), sum(rated)


_UNKNOWN = [-14.0 - 6.0 * k for k in range(25)]  # of a run of so many unknown letters


@lru_cache(maxsize=65536)
def _char_kind(c: str) -> str:
    return "h" if _HAN.match(c) else "d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "m"


@lru_cache(maxsize=65536)
def _site_told(read: str, true: str, known: int, whole: int, used: int, fixed: int, gain: int, before: str, after: str, shape: bool, digits: bool, title: bool) -> tuple[str, ...]:
    pair = f"{read}>{true}"
    return (
        "bias", pair, f"known{known}", f"known{known} {pair}", f"whole{whole}{used}", f"fixed{fixed} known{known}", f"gain{gain}", f"gain{gain} {pair}",
        f"{pair} {before}", f"{pair} {after}", f"{pair} {'d' if shape else 'a'}{digits}", f"{pair} {before}{after}", f"title{title} known{known}",
    )


@lru_cache(maxsize=65536)
def _gap_told(kinds: str, size: int, between: bool, known: int, length: int, word: int) -> tuple[str, ...]:
    told = f"{kinds} gap{size}{between:d}"
    return ("sbias", f"s{told}", f"s{told} known{known}", f"s{kinds} run{length}", f"s{told} word{word}")


@lru_cache(maxsize=65536)
def _break_told(told: str, known: str, size: str, case: str) -> tuple[str, ...]:
    return ("jbias", f"j{told}", f"j{told} {known}", f"j{told} size{size}", f"j{told} case{case}")


def _fixes(word: str, sites: list[tuple[int, str, str]]) -> list[tuple[str, int]]:
    """``word`` with every choice of misreadings undone that do not overlap, and the choice by bits; later sites change first."""
    begun = [("", 0, 0)]
    for k, (i, read, true) in enumerate(sites):
        grown = []
        for x in begun:
            grown.append(x)
            done, end, picked = x
            if i >= end:
                grown.append((done + word[end:i] + true, i + len(read), picked | 1 << k))
        begun = grown
    return [(done + word[end:], picked) for done, end, picked in begun]


def _apply(word: str, sites: list[tuple[int, str, str]]) -> str:
    """``word`` with the misreadings at ``sites`` undone; empty where they overlap."""
    out, end = [], 0
    for i, read, true in sites:
        if i < end:
            return ""
        out += [word[end:i], true]
        end = i + len(read)
    return "".join(out) + word[end:]


def _damage(word: str, rng: random.Random, rate: float) -> tuple[str, list[tuple[int, str, str]]]:
    """``word`` with random misreadings, and their (place, read, true)."""
    out, done, i, at = [], [], 0, 0
    while i < len(word):
        c = word[i]
        options = _READS.get(c)
        if options and rng.random() < rate:
            read = rng.choice(options)
            done.append((at, read, c))
        else:
            read = c
        out.append(read)
        at += len(read)
        i += 1
    return "".join(out), done


def _clean(texts: list[str | None]) -> list[str]:
    """Printed forms of the texts without hyphens at line ends or page numbers; the others are not clean."""
    return [s for s in (canonical(t or "") for t in texts) if _is_clean(s)]


def _is_clean(s: str) -> bool:
    if not s or (_HYPHEN_HINT.search(s) and _HYPHEN.search(s)):
        return False
    return not (_NUMBER_LINE.search(s) if "\n" in s else _NUMBER_LINE.match(s)) and not _NUMBER_AMID.search(s)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        forms = [canonical(t) for t in texts]
        # soft hyphens before a break and not signs are marks of parted words, so they outlive the printed form
        marked = [canonical(_SHY_MARK.sub("¬", t)) if "\xad" in t else None for t in texts]
        cols = [b.column(0), b.column(1), pa.array(forms, pa.string()), pa.array(marked, pa.string()), pa.array(map(_is_clean, forms), pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["row_id", "index_key", "text", "marked", "clean"])


def printed_pages(chunks: DataFrame) -> DataFrame:
    """(row_id, index_key, text, marked, clean) of non-null texts, written once: the printed form, the one with marks of parted words where there may be any, and whether it is clean."""
    rows = chunks.where(F.col("text").isNotNull())
    rows = rows.select(*(F.col(c).cast(kind) if c in chunks.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("row_id", "bigint"), ("index_key", "string"), ("text", "string"))))
    return materialize(rows.mapInArrow(_printed, "row_id bigint, index_key string, text string, marked string, clean boolean"), "printed-pages")


def _tallied(clean: list[str]) -> Counter[tuple[str, str]]:
    """Times of the words, compounds, and pairs and triples of characters (kind, item) of clean texts.

    Of the pairs and triples in texts with Han, those with a Han character are read only where it may be misread or
    what is read for it; the others are not counted.
    """
    words: Counter[str] = Counter()
    compounds: Counter[str] = Counter()
    around: Counter[str] = Counter()  # stretches about characters that may be misread
    others: Counter[str] = Counter()  # stretches without Han
    for s in clean:
        words.update(_WORD.findall(s))
        if "-" in s:
            compounds.update(f"{a}-{b}".lower() for a, b in _COMPOUND.findall(s))
        if _HAN.search(s):
            run = "".join(s.split())
            others.update(_NOT_HAN.findall(run))
            around.update([run[max(0, m.start() - 2) : m.end() + 2] for m in _PAIRED_RUN.finditer(run)])
    grams: Counter[str] = Counter()
    for k in (2, 3):
        for x, n in others.items():
            for i in range(len(x) - k + 1):
                grams[x[i : i + k]] += n
        for x, n in around.items():
            for i in range(len(x) - k + 1):
                if _PAIRED.search(x, i, i + k):
                    grams[x[i : i + k]] += n
    return Counter({(kind, x): n for kind, of in (("word", words), ("compound", compounds), ("gram", grams)) for x, n in of.items()})


def _dictionary(counts: Iterable[tuple[str, str, int]]) -> tuple[Editor, dict[str, int]]:
    """An editor with the dictionary of (kind, item, times) but no weights, and the words without noise."""
    ed = Editor()
    by: dict[str, Counter[str]] = {"word": Counter(), "compound": Counter(), "gram": Counter()}
    for kind, item, n in counts:
        by[kind][item] = n
    words, grams = by["word"], by["gram"]
    low: Counter[str] = Counter()
    for w, n in words.items():
        low[w.lower()] += n
    # a rare word that is a misreading of a frequent one is noise left in the texts, not a word
    noisy = set()
    for w, n in low.items():
        sites = [x for x in ed.latin_sites(w) if x[2].islower()]
        if sites and len(sites) <= 7 and not w.isdigit():
            if max((low.get(f, 0) for f, _ in _fixes(w, sites) if f != w), default=0) >= 8 * n:
                noisy.add(w)
    low = Counter({w: n for w, n in low.items() if w not in noisy and not (re.search("[0-9]", w) and n < 8)})
    for w, n in low.items():
        if not w.isdigit():
            s = f"^{w}$"
            for k in (2, 3):
                for i in range(len(s) - k + 1):
                    grams[s[i : i + k]] += min(n, 20)
    ed.words = {w: n for w, n in low.items() if n >= 2 and not w.isdigit()}
    ed.grams = {g: n for g, n in grams.items() if n >= 2}
    ed.compounds = {c: n for c, n in by["compound"].items() if n >= 2}
    for c in ed.compounds:
        a, b = c.split("-")
        ed.lefts.add(a)
        ed.rights.add(b)
    return ed, {w: n for w, n in words.items() if w.lower() in low}


def _word_cases(ed: Editor, words: dict[str, int], seed: int) -> Iterator[tuple[list[str], int]]:
    """Words with planted misreadings, frequent ones up to six times."""
    for w, n in sorted(words.items()):
        rng = random.Random(f"{seed} {w}")
        known: dict[tuple[str, bool], tuple[list, list]] = {}
        for _ in range(min(n, 6)):
            seen, done = _damage(w, rng, rng.choice((0.0, 0.0, 0.1, 0.25)))
            hide = rng.random() < 0.15  # some words must look unknown
            if (seen, hide) not in known:
                sites = ed.latin_sites(seen)
                hidden = {w.lower(): ed.words.pop(w.lower(), None)} if hide else {}
                known[seen, hide] = sites, ed.latin_features(seen, sites)
                ed.words.update({k: v for k, v in hidden.items() if v})
            sites, features = known[seen, hide]
            true = set(done)
            yield from [(f, 1 if s in true else -1) for f, s in zip(features, sites)]


def _han_cases(s: str, seed: int) -> list[tuple[str, int]]:
    """The characters of a clean text that may be misread, and planted misreadings, each amid its five characters."""
    cases: list[tuple[str, int]] = []
    if not _HAN.search(s):
        return cases
    rng = random.Random(f"{seed} {s}")
    run = "  " + "".join(s.split()) + "  "
    for m in _PAIRED.finditer(run):
        i, c = m.start(), m[0]
        if c in MISREAD_HAN:
            cases += [(run[i - 2 : i + 3], -1)] * 2
        elif rng.random() < 0.08:
            cases.append((run[i - 2 : i] + _READ_HAN[c] + run[i + 1 : i + 3], 1))
    return cases


def _text_cases(ed: Editor, s: str, seed: int) -> list[tuple[Sequence[str], int]]:
    """Cases of the breaks, gaps and lines of one clean text; its damage follows from the text, wherever it is read."""
    rng = random.Random(f"{seed} {s}")
    return _break_cases(ed, [s], rng) + _gap_cases(ed, [s], rng) + _page_cases([s], rng)


def _planted(ed: Editor, clean: list[str], seed: int, chars: bool) -> Counter[tuple[str, int]]:
    """Times of the cases (features, y) of clean texts: of Han characters, or of breaks, gaps and lines."""
    if not chars:
        return _keyed(case for s in clean for case in _text_cases(ed, s, seed))
    out: Counter[tuple[str, int]] = Counter()
    for (around, y), n in Counter(case for s in clean for case in _han_cases(s, seed)).items():
        out[_SEP.join(ed.han_features(around)), y] += n
    return out


def _fit(counts: Iterable[tuple[str, str, int]], tally: Callable[[Editor, bool], dict[tuple[str, int], int]], seed: int) -> Editor:
    """Fit on the counts of all clean texts; ``tally`` gives the times of each case (features, y) of all of them.

    A case that occurs n times is shown 1 + log2(n) times an epoch, since one sentence pattern may fill a table.
    """
    rng = random.Random(seed)
    ed, words = _dictionary(counts)
    for chars in (True, False):  # joins, gaps and lines read the repaired words, so they are fitted after the misreadings
        times = Counter(tally(ed, chars))
        if chars:
            times.update(_keyed(_word_cases(ed, words, seed)))
        cases = [case for (f, y), n in sorted(times.items()) for case in [([sys.intern(x) for x in f.split(_SEP)], y)] * n.bit_length()]
        del times
        ed.word_cache.clear()
        ed.kept.clear()
        ed.site_scores.clear()
        ed.weights |= _averaged(cases, rng)
    return ed


def _keyed(cases: Iterable[tuple[Sequence[str], int]]) -> Counter[tuple[str, int]]:
    times = Counter((tuple(f), y) for f, y in cases)
    return Counter({(_SEP.join(f), y): n for (f, y), n in times.items()})


def fit_editor(texts: list[str], seed: int = 4) -> Editor:
    """Fit on all of the texts that are clean."""
    clean = _clean(texts)

    def tally(ed: Editor, chars: bool) -> Counter[tuple[str, int]]:
        return _planted(ed, clean, seed, chars)

    return _fit(((kind, item, n) for (kind, item), n in _tallied(clean).items()), tally, seed)


def fit_editor_of(chunks: DataFrame, seed: int = 4) -> Editor:
    """``fit_editor`` of all texts of a table."""
    return _fit_pages(printed_pages(chunks), seed)


def _fit_pages(pages: DataFrame, seed: int = 4) -> Editor:
    """``fit_editor`` of all clean texts of ``printed_pages``: they are counted, and planted with damage in two scans.

    Cases return to the driver by distinct features with their times; Han pairs and triples that stand once and
    figures that stand under eight times have no use and stay behind.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _tallied(b.column(0).to_pylist())
            cols = [pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(got.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "item", "n"])

    spark = pages.sparkSession
    texts = pages.where("clean").select("text")
    counts = texts.mapInArrow(count, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    once = (F.col("kind") == "gram") & (F.col("n") < 2) & F.col("item").rlike("[一-鿿]")
    figures = (F.col("kind") == "word") & (F.col("n") < 8) & F.col("item").rlike("^[0-9]+$")

    def tally(ed: Editor, chars: bool) -> dict[tuple[str, int], int]:
        shared = spark.sparkContext.broadcast(ed)

        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = _planted(shared.value, b.column(0).to_pylist(), seed, chars)
                cols = [pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.int64()), pa.array(got.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["features", "y", "n"])

        found = texts.mapInArrow(plant, "features string, y bigint, n bigint").groupBy("features", "y").agg(F.sum("n").alias("n"))
        cases = {(f, y): n for f, y, n in zip(*found.toArrow().to_pydict().values())}
        shared.destroy()
        return cases

    kept = counts.where(~once & ~figures & ~((F.col("kind") == "compound") & (F.col("n") < 2))).toArrow()
    return _fit((row for b in kept.to_batches(10_000) for row in zip(*b.to_pydict().values())), tally, seed)


def _averaged(cases: list[tuple[list[str], int]], rng: random.Random) -> dict[str, float]:
    """Averaged-perceptron weights of EPOCHS rounds over (features, +1 edit or -1 keep)."""
    sums: dict[str, float] = {}
    weights: dict[str, float] = {}
    step = 1
    for _ in range(EPOCHS):
        rng.shuffle(cases)
        for features, y in cases:
            if y * sum(weights.get(f, 0.0) for f in features) <= 0.5:
                for f in features:
                    weights[f] = weights.get(f, 0.0) + y
                    sums[f] = sums.get(f, 0.0) + y * step
            step += 1
    return {f: w - sums[f] / step for f, w in weights.items()}


def _break_cases(ed: Editor, clean: list[str], rng: random.Random) -> list[tuple[list[str], int]]:
    """Words of clean texts parted at a line end, and compounds that end a line at their own hyphen."""
    cases = []
    for s in clean:
        words = _LETTERS_5.findall(s)
        for w in rng.sample(words, min(4, len(words))):
            at = rng.randint(2, len(w) - 2)
            hidden = ed.words.pop(w.lower(), 0) if rng.random() < 0.2 else 0
            mark = "¬" if rng.random() < 0.2 else "-"
            cases.append((ed.break_features(w[:at], mark, w[at:]), 1))
            if hidden:
                ed.words[w.lower()] = hidden
        for a, b in _COMPOUND.findall(s)[:4] if "-" in s else ():
            own = f"{a}-{b}".lower()
            hidden = ed.compounds.pop(own, 0) if rng.random() < 0.2 else 0
            cases.append((ed.break_features(a, "-", b), -1))
            if hidden:
                ed.compounds[own] = hidden
        if words and rng.random() < 0.2:
            cases.append((ed.break_features(rng.choice(words), "-", rng.choice(sorted(_SUSPENDED))), -1))
    return cases


def _gap_cases(ed: Editor, clean: list[str], rng: random.Random) -> list[tuple[list[str], int]]:
    """Phrases of clean texts spaced out, the gaps between their words wider or not; and rows of single characters."""
    cases: list[tuple[list[str], int]] = []
    for s in clean:
        for m in _SPACED.finditer(s) if _SPACED_HINT.search(s) else ():
            cases += [(f, -1) for f in ed.gap_features(m[0])]
        words = _LETTERS_2.findall(s)
        if len(words) > 3:
            i = rng.randrange(len(words) - 3)
            phrase = words[i : i + rng.randint(1, 3)]
            if sum(map(len, phrase)) >= 5:
                wide = rng.random() < 0.7
                run = ("  " if wide else " ").join(" ".join(w) for w in phrase)
                inside = [k == 0 for w in phrase for k in range(len(w))][1:]
                cases += [(f, -1 if first else 1) for f, first in zip(ed.gap_features(run), inside)]
        flat = s if s.isprintable() and "  " not in s else f"{' ' if s[0].isspace() else ''}{' '.join(s.split())}{' ' if s[-1].isspace() else ''}"
        if len(flat) > 20:  # a stretch of any characters, its own spaces three wide
            i = rng.randrange(len(flat) - 16)
            stretch = flat[i : i + rng.randint(6, 16)].strip()
            apart = [" " in stretch[k - 1 : k + 1] for k in range(1, len(stretch)) if stretch[k] != " "]
            cases += [(f, -1 if space else 1) for f, space in zip(ed.gap_features(" ".join(stretch)), apart)]
        if rng.random() < 0.3:
            row = rng.choice([[chr(65 + k) for k in range(rng.randint(5, 9))], list("12345678"), rng.choices("ABCDEXYZ", k=7), rng.choices("0123456789", k=7), rng.choices("abcxyz", k=6), list("xyzxyz")])
            cases += [(f, -1) for f in ed.gap_features(" ".join(row))]
    return cases


def _page_cases(clean: list[str], rng: random.Random) -> list[tuple[list[str], int]]:
    """Clean texts with titles and page numbers planted at line ends and amid the text, and with what resembles them."""
    cases: list[tuple[list[str], int]] = []
    for s in clean:
        lines = [x for x in s.split("\n") if x.strip()][:12]
        if not lines:
            continue
        if len(lines) == 1:
            parts = _SENTENCE_END.split(lines[0], 4)
            lines = [a + b for a, b in zip(parts[:-1:2], parts[1::2])] + parts[-1:]
        names = _NAMES.findall(s) or ["Northern Works"]
        title = f"{rng.choice(names)} {rng.choice(PLANTED_TITLES).format(rng.randint(1990, 2029))}"
        if _HAN.search(title):
            title = title.replace(" ", "")
        number = rng.choice(PLANTED_NUMBERS).format(rng.randint(1, 400), rng.randint(100, 500))
        titles, endings = ([squeezed(title)], set()) if rng.random() < 0.6 else ([], {title_ending(title)})
        shown = title
        if titles and rng.random() < 0.3:
            shown = _damage(title, rng, 0.15)[0]
        at = rng.randint(0, len(lines))
        odd = rng.random()
        if odd < 0.4:  # what only resembles a title
            long = lines[-1][:200].rstrip(TERMINAL) if len(lines[-1]) > 70 else "as stated in full length and with all of its later amendments since then in the"
            shown = rng.choice([f"# {title}", f"《{title}》", f"{title}.", f"{long} {title}", f"{long} {title}"])
        planted = {at: "header" if odd >= 0.4 else ""}
        body = [*lines[:at], shown, *lines[at:]]
        if rng.random() < 0.6:
            to = rng.randint(0, len(body))
            bare = rng.random() < 0.2
            body.insert(to, str(rng.randint(1, 400)) if bare else number)
            planted = {k + (k >= to): v for k, v in planted.items()} | {to: "pageno"}
        if rng.random() < 0.2:  # a column of figures
            to = rng.randint(0, len(body))
            body[to:to] = [str(rng.randint(1, 999)) for _ in range(rng.randint(2, 5))]
            more = len(body) - len(lines) - len(planted)
            planted = {k + (more if k >= to else 0): v for k, v in planted.items()}
        for i, kind, features in line_sites(body, titles, endings):
            if kind != "both":
                cases.append((features, 1 if planted.get(i) == kind else -1))
        if shown[0] in "#《":
            cases += [(features, -1) for _, _, kind, features in span_sites("\n".join(body), titles) if kind == "header"]
        flat = " ".join(lines)
        parts = flat.split(" ")
        if len(parts) > 1:
            before = rng.choice(range(1, len(parts)))
            k = sum(map(len, parts[:before])) + before - 1
            inner, kind = (number, "pageno") if rng.random() < 0.5 or not titles else (title, "header")
            text = f"{flat[:k]} {inner}{flat[k:]}"
            for start, end, found, features in span_sites(text, titles):
                cases.append((features, 1 if found == kind and start <= k + 1 + len(inner) and end >= k + 1 else -1))
    return cases


# page furniture ---------------------------------------------------------------------------------------------------
def squeezed(line: str) -> str:
    """A line without case, spaces and trailing stamp, as titles are compared."""
    return "".join(_unstamped(line.strip()).split()).lower()


def _unstamped(line: str) -> str:
    return _STAMP_END.sub("", line) if "  " in line else line


def title_ending(line: str) -> str:
    """The end of a title with digits masked, common to the titles of one kind of document."""
    s = squeezed(line)
    return _DIGIT.sub("0", s[-9:] if _HAN.search(s) else s[-14:])


_YEAR = re.compile("[0-9]{4}")
_CLAUSE = re.compile("[,。;:、!?]")
_LONG_WORD = re.compile("[A-Za-zÀ-ɏ]{4,}")


def _headline(line: str) -> bool:
    """Whether a line without a year has the shape of a title: no clause marks in Han, mostly capitalised words else."""
    if _HAN.search(line):
        return len(line) <= 40 and not _CLAUSE.search(line)
    words = _LONG_WORD.findall(line)
    return bool(words) and 2 * sum(w[0].isupper() for w in words) >= len(words)


def title_lines(text: str) -> list[tuple[str, str]]:
    """(line, neighbours) of the lines that may be running titles."""
    lines = [x.strip() for x in text.split("\n")]
    out = []
    for i, x in enumerate(lines):
        bare = _unstamped(x)
        if 6 <= len(bare) <= 70 and bare[-1] not in TERMINAL and bare[0] not in "#*-•[|" and (_YEAR.search(bare) or _headline(bare)):
            before, after = (lines[i - 1] if i else ""), (lines[i + 1] if i + 1 < len(lines) else "")
            out.append((bare, f"{before[-12:]}|{after[:12]}"))
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if "\n" in s:
                out += [(key, squeezed(x), title_ending(x), around) for x, around in title_lines(s)]
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["index_key", "line", "ending", "around"])


@dataclass
class Found:
    """Kinds of noise of a text, and the text without it."""

    kinds: set[str]
    text: str


def _form_of(number: str) -> str:
    """The form of a page number: its characters without figures."""
    return re.sub("[0-9 ]+", "", number).lower() or "bare"


def line_sites(lines: list[str], titles: list[str], endings: set[str]) -> list[tuple[int, str, list[str]]]:
    """(line, kind, features) of the lines that may be a running title (header), a page number (pageno), or both."""
    tails = {e[-2:] for e in endings}
    longest = max(map(len, titles), default=0) + 2
    out: list[tuple[int, str, list[str]]] = []
    for i, x in enumerate(lines):
        bare = x.strip()
        if not bare:
            continue
        if titles or (tails and _DIGIT.sub("0", bare[-2:].lower()) in tails) or ("  " in bare and _STAMPED.search(bare)):
            core = "".join(_unstamped((_NUMBER_END.sub("", bare) if bare[-1] in _NUMBER_ENDS else bare).strip() or bare).split())
            told = ""
            if endings or len(core) <= longest:  # a longer line is no title of this file
                core = core.lower()
                told = "exact" if core in titles else "near" if len(core) > 8 and _is_title(core, titles) else "end" if endings and len(core) > 9 and title_ending(core) in endings else ""
            if told:
                place = "first" if i == 0 else "last" if i == len(lines) - 1 else "mid"
                shape = f"{bare[0] == '#':d}{bare[0] in _QUOTES:d}{bare[-1] in TERMINAL:d}{len(bare) > 70:d}"
                features = ["tbias", f"t{told}", f"t{told} {shape}", f"t{shape}", f"t{told} {place}"]
                both = _NUMBER_AMID.search(bare) and not core.endswith(bare[-3:].lower())
                out.append((i, "header", features))
                if both:
                    out.append((i, "both", features))
                continue
        if bare[-1] not in _NUMBER_ENDS:
            continue
        place = "first" if i == 0 else "last" if i == len(lines) - 1 else "mid"
        if _NUMBER_LINE.match(x):
            form = _form_of(bare)
            out.append((i, "pageno", ["nbias", f"n{form}", f"n {place}", "nline"]))
        elif len(x) < 12 and _BARE_LINE.match(x) and len(bare) <= 3 and len(lines) > 1:
            near = [lines[k].strip() for k in (i - 1, i + 1) if 0 <= k < len(lines)]
            figures = any(_FIGURES.fullmatch(y) for y in near)
            out.append((i, "pageno", ["nbias", "nbare", f"nbare figures{figures:d}", f"n {place}", "nline"]))
    return out


def span_sites(s: str, titles: list[str]) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of the spans amid a text that may be a running title or a page number."""
    out = []
    parts = s.split() if titles else []
    run_on = "".join(parts).lower()
    for t in titles:
        if t in run_on:
            for start, end in title_spans(s, parts, run_on, t):
                before = s[:start].rstrip()[-1:]
                out.append((start, end, "header", ["tbias", "tspan", f"tspan{before in _QUOTES and before != '':d}", f"tspan {before in TERMINAL:d}", f"tspan heading{before == '#':d}"]))
    for m in _NUMBER_AMID.finditer(s):
        form = _form_of(m[0])
        place = "first" if not s[: m.start()].strip() else "last" if not s[m.end() :].strip() else "mid"
        out.append((m.start(), m.end(), "pageno", ["nbias", f"n{form}", f"n {place}", "nspan"]))
    return out


def repair(text: str, titles: list[str], endings: set[str], ed: Editor) -> Found:
    """Find and undo the noise of one text; ``titles`` (squeezed) are its file's, ``endings`` those of any file."""
    # soft hyphens before a break and not signs are marks of parted words, so they outlive the printed form
    return repair_printed(canonical(_SHY_MARK.sub("¬", text) if "\xad" in text else text), titles, endings, ed)


def repair_printed(s: str, titles: list[str], endings: set[str], ed: Editor) -> Found:
    """``repair`` of a text in its printed form."""
    kinds: set[str] = set()
    lines = s.split("\n")
    gone = set()
    for i, kind, features in line_sites(lines, titles, endings):
        if ed.score(features) > 0:
            gone.add(i)
            kinds.add("pageno" if kind == "both" else kind)
    if gone:
        s = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    out, end = [], 0
    for start, stop, kind, features in sorted(span_sites(s, titles), key=lambda x: (x[0], -x[1])):
        if start >= end and ed.score(features) > 0:
            out += [s[end:start], " " if kind == "header" else ""]
            end = stop
            kinds.add(kind)
    s = "".join(out) + s[end:] if out else s

    def join(m: re.Match) -> str:
        if ed.parted(m[1], m[2], m[3]):
            kinds.add("hyphen")
            return m[1] + m[3]
        return f"{m[1]}-{m[3]}"

    if _HYPHEN_HINT.search(s):
        s = _HYPHEN.sub(join, s)
    edits = 0

    def unspace(m: re.Match) -> str:
        nonlocal edits
        run, n = ed.unspaced(m[0])
        edits += n
        return run

    if _SPACED_HINT.search(s):
        s = _SPACED.sub(unspace, s)

    def fix(m: re.Match) -> str:
        nonlocal edits
        word, n = ed.word(m[0])
        edits += n
        return word

    if any(ed.word(w)[1] for w in set(_WORD.findall(s)) - ed.kept):
        s = _WORD.sub(fix, s)
    if _ODD_HAN.search(s):
        run = "  " + s + "  "
        out = list(s)
        for m in _ODD_HAN.finditer(s):
            i = m.start()
            left, right = "".join(run[max(0, i - 3) : i + 2].split())[-2:], "".join(run[i + 3 : i + 8].split())[:2]
            if ed.han(left.rjust(2) + m[0] + right.ljust(2)):
                out[i] = MISREAD_HAN[m[0]]
                edits += 1
        s = "".join(out)
    if edits >= MANY:
        kinds.add("char")
    if "\n" in s:
        s = _WORD_WRAP.sub(" ", _HAN_WRAP.sub("", s))
    if "  " in s or "\t" in s:
        s = _BLANKS.sub(" ", s)
    return Found(kinds, s.strip())


def _is_title(core: str, titles: list[str]) -> bool:
    return any(abs(len(core) - len(t)) <= 2 and (slip(core, t) or _nearly(core, t)) for t in titles)


def _nearly(a: str, b: str) -> bool:
    """Whether two squeezed lines differ in at most a fifth of their places, misreadings undone."""
    for true, read in MISREAD_LATIN:
        if len(read) == 2:
            a, b = a.replace(read, true), b.replace(read, true)
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) * 5 <= len(a)


def title_spans(s: str, parts: list[str], run_on: str, title: str) -> list[tuple[int, int]]:
    """(start, end) of a title amid a text, at most one blank between its characters.

    ``parts`` are the pieces of the text between its blanks, ``run_on`` is all of them in small letters.
    """
    if _FOLDS.search(s):
        body = r"\s?".join(re.escape(c) for c in title)
        return [m.span() for m in re.finditer(f"(?:(?<=^)|(?<=\\s)){body}{_TITLE_END.pattern}", s, re.I)]
    starts = [0, *accumulate(map(len, parts))]
    out: list[tuple[int, int]] = []
    at = run_on.find(title)
    while at >= 0:
        k = bisect_left(starts, at)
        if starts[k] == at:
            places = islice(_PART.finditer(s), k, None)
            start, end = next(places).span()
            left = len(title) - (end - start)
            while left > 0:
                i, j = next(places).span()
                if i != end + 1:
                    break
                end, left = j, left - (j - i)
            if left <= 0 and (not out or start >= out[-1][1]) and (m := _TITLE_END.match(s, end + left)):
                out.append((start, m.end()))
        at = run_on.find(title, at + 1)
    return out


def running_titles(pages: DataFrame) -> DataFrame:
    """(index_key, line, ending, n) of ``printed_pages``: squeezed lines that return in one file between at least three different neighbours."""
    rows = pages.where(F.col("index_key").isNotNull() & F.col("text").contains("\n")).select("index_key", "text")
    lines = rows.mapInArrow(_lines, "index_key string, line string, ending string, around string")
    lines = lines.select("index_key", "line", "ending", F.xxhash64("around").alias("around"))
    times = lines.groupBy("index_key", "line").agg(F.count_distinct("around").alias("n"), F.min("ending").alias("ending"))
    return times.where(F.col("n") >= TITLE_TIMES).select("index_key", "line", "ending", "n")


def title_endings(titles: DataFrame) -> set[str]:
    """The endings of titles that a share of at least ENDING_SHARE of them have, so at most 1 / ENDING_SHARE endings."""
    known = titles.where("n >= 4").select("line", "ending").distinct()
    least = ENDING_SHARE * known.count()
    return {r["ending"] for r in known.groupBy("ending").count().where(F.col("count") >= least).collect()}


def _find(shared: Broadcast, endings: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [repair_printed(t, titles or [], endings, shared.value) for t, titles in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted(f.kinds) for f in got], pa.list_(pa.string())), pa.array([f.text for f in got], pa.string())],
                names=["row_id", "kinds", "repaired"],
            )

    return find


ENDING_SHARE = 0.001


def repaired_texts(chunks: DataFrame, editor: Editor | None = None) -> DataFrame:
    """(row_id, kinds, repaired): the kinds of noise of every non-null text, sorted, and the text without it.

    ``chunks``: row_id, index_key, text.  A null index_key is a file without running titles.  Titles (one row per file
    that has any, with all of its titles) join by file, by broadcast where Spark finds them small enough, else by a
    split sort-merge join; the usual endings of titles are sent along, so that a title alone in a copied passage is found.
    """
    pages = printed_pages(chunks)
    ed = editor or _fit_pages(pages)
    titles = materialize(running_titles(pages), "titles")
    per_file = titles.groupBy("index_key").agg(F.sort_array(F.collect_list(F.struct("n", "line")), asc=False)["line"].alias("titles"))
    rows = pages.select("row_id", "index_key", F.coalesce("marked", "text").alias("text"))
    endings = title_endings(titles)
    joined = rows.join(materialize(per_file, "file-titles"), "index_key", "left").select("row_id", "text", "titles")
    shared = chunks.sparkSession.sparkContext.broadcast(ed)  # its caches outlive a task of a worker
    return joined.mapInArrow(_find(shared, endings), "row_id bigint, kinds array<string>, repaired string")


def noise_kinds(chunks: DataFrame, editor: Editor | None = None) -> DataFrame:
    """(row_id, noise): one row for each kind of scan noise of each text."""
    return repaired_texts(chunks, editor).select("row_id", F.explode("kinds").alias("noise"))
