"""Problem 8: keyword-stuffed and link-list pages by the perplexity of word classes.

A text is read as a sequence of kinds of function words (of nine languages) and classes of content words: their shape,
whether they were just said before, and how many content words have passed since the last function word.  A trigram
model of these classes is fitted on the prose of the corpus and on ordinary prose; every stretch of a page whose
perplexity is abnormally high or low for its writing (letters or Han) counts as no prose.  A page with more than half
of its characters in such stretches is spam.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.print_forms import plain_marks
from docquarry.llm.prose import PROSE
from docquarry.storage import materialize

# Chinese function characters that are often parts of words, so they do not part content words.
PARTS_OF_WORDS = "用会向下上中内地能"
# Function words by kind (determiners, pronouns, conjunctions, prepositions, auxiliaries, adverbs) and language.
FUNCTION_WORDS = {
    "det": {
        "en": "a an the this that these those each every no all any some both another such other same most more less least",
        "de": "der die das den dem des ein eine einen einem einer eines kein keine dieser diese dieses jeder jede alle",
        "fr": "le la les l un une des du au aux ce cet cette ces chaque tout toute tous toutes aucun aucune",
        "es": "el la los las un una unos unas este esta estos estas ese esa cada todo toda todos todas ningún",
        "it": "il lo la i gli le un uno una questo questa ogni tutti tutte", "pt": "o os as um uma uns umas este esta cada todo toda todos",
        "nl": "de het een deze dit die dat elke alle geen", "zh": "一 每 各 该 此 这 那 另 本",
    },
    "pron": {
        "en": "it its he she they their them we our us you your my me i his her who whom whose which what one itself themselves",
        "de": "ich du er sie es wir ihr ihre ihren ihrem seine seinen sein sich man uns mich ihm ihnen was wer",
        "fr": "je tu il elle on nous vous ils elles se son sa ses leur leurs qui que qu dont y en", "es": "yo él ella ellos ellas nosotros se su sus le les lo me te nos que quien cual",
        "it": "io lui lei noi voi loro si suo sua suoi che chi cui ci", "pt": "eu ele ela eles elas nós se seu sua seus que quem", "nl": "ik hij zij ze wij we u hun haar zijn zich wie wat",
        "ru": "я он она оно они мы вы его её их это этот эта эти что который которая которые себя свой", "zh": "其 之 它 他 她 你 我 们 者 所",
    },
    "conj": {
        "en": "and or but nor so yet because although though if unless while when where than as once until whether however",
        "de": "und oder aber denn weil dass wenn als ob obwohl während sondern sowie damit", "fr": "et ou mais donc car si quand lorsque comme ni puisque", "es": "y e o u pero si porque cuando aunque como mientras ni sino",
        "it": "e ed o ma se perché quando anche come mentre", "pt": "e ou mas se porque quando embora como enquanto", "nl": "en of maar want omdat dat als toen terwijl",
        "ru": "и а но или если когда чтобы как потому хотя", "zh": "和 与 及 或 但 而 若 因 则 且 即 如 と",
    },
    "prep": {
        "en": "in on at by for from to into of with within without over under after before between during about against per through since near up down out off",
        "de": "in im ins an am auf aus bei beim mit nach von vom zu zum zur über unter für durch um vor seit gegen ohne bis zwischen",
        "fr": "de d à dans sur sous avec sans pour par entre chez vers depuis pendant après avant", "es": "de del a al en con por para sin sobre entre hasta desde hacia según tras durante",
        "it": "di del della dei delle a al alla da dal in nel nella con su per tra fra", "pt": "de do da dos das em no na nos nas com por para sem sobre entre até",
        "nl": "van in op te met voor aan door bij naar uit over tot onder", "ru": "в во на с со к ко по из от до за для о об при у без под между", "zh": "在 于 以 对 从 到 被 把 向 按 由 为 据 经 给 用 将 に で を から",
    },
    "aux": {
        "en": "is are was were be been being am has have had do does did will would shall should may might can could must",
        "de": "ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können muss müssen soll sollen bin",
        "fr": "est sont était étaient a ont avait avaient sera seront été être avoir peut peuvent doit", "es": "es son era eran fue fueron ha han había está están ser hay puede pueden debe",
        "it": "è sono era erano ha hanno aveva sarà essere può possono deve", "pt": "é são era eram foi foram tem têm está estão ser pode podem deve", "nl": "is was waren wordt worden heeft hebben had kan kunnen moet zal",
        "ru": "был была было были будет есть может", "zh": "是 有 会 能 应 须 可 要 让 使 需 已 未 が は",
    },
    "adv": {
        "en": "not very also then there here too just only still already even again never always often now well", "de": "nicht auch nur noch schon sehr so dann da hier immer wieder mehr", "fr": "ne pas plus aussi très bien encore déjà alors",
        "es": "no más también muy ya bien así entonces todavía", "it": "non più anche molto già così ancora", "pt": "não mais também muito já bem assim ainda", "nl": "niet ook nog wel dan er hier meer al",
        "ru": "не ни уже ещё также только очень так там", "zh": "了 也 都 就 再 又 还 不 很 更 最 当 着 过 上 下 中 内 后 前 时 も",
    },
    "part": {"zh": "的 等 得 地 の", "en": "s t"},
}
WINDOW = 24  # tokens of a stretch
STEPS = 4096  # steps of a stretch's value (a mean log-probability) by which values are counted for their median
LIMIT = 4.0  # standard deviations of prose that a stretch may be away
HALF = 0.5
LEAST_SPREAD = 0.12  # of the stretches' values; the texts of one table may be more alike than prose is
PROSE_WEIGHT = 100  # texts for which the ordinary prose (prose.py) counts once

_KIND = {w: kind for kind, by in FUNCTION_WORDS.items() for words in by.values() for w in words.split()}
_ZH_CHARS = "".join(sorted(w for w in _KIND if len(w) == 1 and ord(w) >= 0x2E80))
_TOKEN = re.compile(
    "https?://[^\\s一-鿿]+|www\\.[^\\s一-鿿]+|[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+){0,2}|[0-9]+(?:[.,][0-9]+)*"
    f"|[{_ZH_CHARS}]|[^\\W0-9A-Za-z_À-ɏ{_ZH_CHARS}]+"
    "|\n(?![A-Za-zÀ-ɏ一-鿿])|(?<=[.。!?;:])\n|[^\\s]"  # a line break inside a sentence is no token
)
_MARKS = ",.;:!?()。、\"'|>/#*-•·[]%&+=<—_\\"
_CONTENT = ["w", "x", "C1", "C2", "C4"]
_RUNS = 8  # content words since the last function word are told apart up to so many
_AGAIN = len(_CONTENT) * _RUNS
_FIXED = ["URL", "NUM", *[f"{c}{r}{again}" for again in ("", " again") for r in range(_RUNS) for c in _CONTENT], "NL", "MARK"]
_NAMES = _FIXED + [f"m{c}" for c in _MARKS] + [f"{kind} {script}" for kind in FUNCTION_WORDS for script in ("zh", "word")]
_ID = {n: i for i, n in enumerate(_NAMES)}
V = len(_NAMES)
NEAR = 20  # tokens within which a content word counts as said again
_START = _ID["NL"]
WEIGHT = 5.0  # of the shorter context in the interpolation
_FIRST, _LAST = _ID["w0"], _ID["C40"]


def _class_of(token: str) -> int:
    c = token[0]
    if c == "\n":
        return _ID["NL"]
    if token.startswith(("http://", "https://", "www.")):
        return _ID["URL"]
    if c in "0123456789":
        return _ID["NUM"]
    if c in _ZH_CHARS:
        return _ID[f"{_KIND[c]} zh"]
    if c.isalpha():
        if ord(c) >= 0x2E80:
            n = len(token)
            return _ID["C10" if n == 1 else "C20" if n < 4 else "C40"]
        low = token.lower()
        if low in _KIND:
            return _ID[f"{_KIND[low]} word"]
        return _ID["w0" if token.islower() or token.istitle() else "x0"]
    return _ID.get("m" + c, _ID["MARK"])


class _Classes(dict):
    def __missing__(self, token: str) -> int:
        k = _class_of(token)
        if len(self) < 500_000:
            self[token] = k
        return k


_CACHE = _Classes()
_IS_FUNCTION = np.array([n.endswith((" zh", " word")) for n in _NAMES])
_IS_ZH = np.array([n.endswith(" zh") or (n[0] == "C" and n[1:2].isdigit()) for n in _NAMES])
_IS_AGAIN = np.array([n.endswith(" again") for n in _NAMES])
_IS_LONG_RUN = np.array([n.split(" ")[0] in {f"{c}{r}" for c in _CONTENT for r in range(6, _RUNS)} for n in _NAMES])
_IS_BREAK = np.array([n in ("m|", "m>", "m/", "m#", "m*", "m•", "m·") for n in _NAMES])


def class_sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the tokens of all texts one after the other, their lengths in characters, tokens per text."""
    classes: list[int] = []
    sizes: list[int] = []
    counts = []
    class_of = _CACHE.__getitem__
    for text in texts:
        found = _TOKEN.findall(plain_marks(text or ""))
        mine = list(map(class_of, found))
        seen: dict[str, int] = {}
        run = 0
        for i, k in enumerate(mine):
            if _FIRST <= k <= _LAST:
                token = found[i]
                k += run * len(_CONTENT)
                mine[i] = k + _AGAIN if i - seen.get(token, -NEAR) < NEAR else k
                seen[token] = i
                run = min(run + 1, _RUNS - 1)
            elif _IS_FUNCTION[k] and found[i] not in PARTS_OF_WORDS:
                run = 0
        classes += mine
        sizes += map(len, found)
        counts.append(len(found))
    return np.array(classes, np.int64), np.array(sizes, np.int64), np.array(counts, np.int64)


@dataclass
class ProseModel:
    """Interpolated trigram model of classes, and the range of the stretches' values by writing (letters, Han)."""

    seen: np.ndarray  # numbers of the trigrams seen, sorted
    times: np.ndarray
    context: np.ndarray  # times of each bigram as context
    p2: np.ndarray  # smoothed bigram probabilities
    low: np.ndarray
    high: np.ndarray

    def stretches(
        self, classes: np.ndarray, sizes: np.ndarray, counts: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean log-probability, characters, language and text number of the stretches of the texts."""
        n = len(classes)
        if not n:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.r_[0, np.cumsum(counts)[:-1]]
        place = np.arange(n) - np.repeat(first, counts)
        one = np.where(place > 0, np.r_[0, classes[:-1]], _START)
        two = np.where(place > 1, np.r_[0, 0, classes[:-2]][:n], _START)
        pair = two * V + one
        number = pair * V + classes
        k = np.minimum(np.searchsorted(self.seen, number), max(len(self.seen) - 1, 0))
        c3 = np.where(self.seen[k] == number, self.times[k], 0.0) if len(self.seen) else np.zeros(n)
        lp = np.log((c3 + WEIGHT * self.p2[one * V + classes]) / (self.context[pair] + WEIGHT))
        at = np.flatnonzero((place % WINDOW == 0) & ((place == 0) | (np.repeat(counts, counts) - place >= WINDOW // 2)))
        many = np.diff(np.r_[at, n])
        zh = np.add.reduceat(_IS_ZH[classes].astype(np.int64), at) * 4 > many
        text = np.repeat(np.arange(len(counts)), counts)[at]
        return np.add.reduceat(lp, at) / many, np.add.reduceat(sizes, at), zh.astype(np.int64), text

    def spam_shares(self, texts: list[str | None]) -> np.ndarray:
        """Share of the characters of each text in stretches of abnormal perplexity; 0 without any token."""
        score, size, lang, text = self.stretches(*class_sequences(texts))
        odd = (score < self.low[lang]) | (score > self.high[lang])
        n = len(texts)
        return np.bincount(text, size * odd, n) / np.maximum(np.bincount(text, size, n), 1)


def _paragraphs(sentences: list[str]) -> list[str]:
    return [" ".join(sentences[i : i + 5]) for i in range(0, len(sentences), 5)]


def prose_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the tokens of the lines that may be prose, one after the other, and tokens per line.

    They hold function words, no link and few words said again or without a function word between.
    """
    lines = [line + "\n" for t in texts for line in (t or "").split("\n")]
    classes, _sizes, counts = class_sequences(lines)
    at = np.repeat(np.arange(len(lines)), counts)
    share = lambda flag: np.bincount(at, flag[classes], len(lines)) / np.maximum(counts, 1)
    is_url = np.arange(V) == _ID["URL"]
    good = (counts >= 12) & (share(is_url) == 0) & (share(_IS_BREAK) <= 0.05) & (share(_IS_FUNCTION) >= 0.15) & (share(_IS_LONG_RUN) == 0) & (share(_IS_AGAIN) <= 0.2)
    return classes[good[at]], counts[good]


def _fair(model: ProseModel | None, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of which half of the stretches or more are of the model's range; without a model all."""
    if model is None or not len(counts):
        return classes, counts
    score, _z, lang, text = model.stretches(classes, classes, counts)
    near = (score >= model.low[lang]) & (score <= model.high[lang])
    fair = np.bincount(text, near, len(counts)) / np.maximum(np.bincount(text, minlength=len(counts)), 1) >= 0.5
    return classes[np.repeat(fair, counts)], counts[fair]


def _trigrams(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trigrams of class sequences, sorted, and the times of each."""
    place = np.arange(len(classes)) - np.repeat(np.cumsum(counts) - counts, counts)
    one = np.where(place > 0, np.r_[0, classes[:-1]][: len(classes)], _START)
    two = np.where(place > 1, np.r_[0, 0, classes[:-2]][: len(classes)], _START)
    return np.unique((two * V + one) * V + classes, return_counts=True)


def _values(model: ProseModel, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values of stretches (steps of 1 / STEPS, two numbers a step for the two writings) and the times of each."""
    score, _z, lang, _text = model.stretches(classes, classes, counts)
    return np.unique(2 * np.round(score * STEPS).astype(np.int64) + lang, return_counts=True)


Tally = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _median(value: np.ndarray, times: np.ndarray) -> float:
    order = np.argsort(value, kind="stable")
    value, upto = value[order], np.cumsum(times[order])
    middle = [(upto[-1] - 1) // 2, upto[-1] // 2]
    return float(value[np.searchsorted(upto, middle, side="right")].mean())


def _fit(texts: int, tally: Callable[[ProseModel | None, Tally], tuple[np.ndarray, np.ndarray]]) -> ProseModel:
    """Fit on so many texts; ``tally`` sums what a function counts over all of their lines that a model finds fair.

    How far ordinary prose may be from the middle is measured on the half of it that a model has not seen.
    """
    copies = 1 + texts // PROSE_WEIGHT
    halves = [class_sequences(_paragraphs(PROSE[k::2])) for k in (0, 1)]
    known = [_trigrams(c, n) for c, _sizes, n in halves]
    model = None
    for _ in range(2):
        before = model
        own = tally(before, _trigrams)
        model = _counted([own, *known], [1, copies, copies])
        number, times = tally(before, lambda c, n, by=model: _values(by, c, n))
        unseen = [_counted([own, known[k]], [1, 2 * copies]).stretches(*halves[1 - k]) for k in (0, 1)]
        other, other_lang = (np.concatenate([u[i] for u in unseen]) for i in (0, 2))
        for g in (0, 1):
            of, far = number % 2 == g, other[other_lang == g]
            mine, often = (number[of] - g) / 2 / STEPS, times[of]
            enough = often.sum() >= 20
            mid = _median(mine, often) if enough else np.median(far)
            spread = max(1.4826 * _median(np.abs(mine - mid), often), LEAST_SPREAD) if enough else LEAST_SPREAD
            model.low[g] = min(mid - LIMIT * spread, far.min() - LEAST_SPREAD)
            model.high[g] = mid + LIMIT * spread
    return model


def fit_prose(texts: list[str]) -> ProseModel:
    """Fit on the prose of the texts, filtered by the first of two models, and on ordinary prose of several languages."""
    lines = prose_lines(texts)
    return _fit(len(texts), lambda model, count: count(*_fair(model, *lines)))


def fit_prose_of(documents: DataFrame) -> ProseModel:
    """``fit_prose`` of all texts of a table: the classes of their lines are written once and counted in four scans.

    What returns to the driver is bounded by the trigrams of classes and the steps of values, not by the texts.
    """
    texts = documents.where(F.col("text").isNotNull()).select("text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000).column(0).to_pylist()
                classes, counts = prose_lines(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int64()), *(pa.array([x], pa.binary()) for x in (classes.astype(np.uint8).tobytes(), counts.tobytes()))],
                    names=["texts", "classes", "counts"],
                )

    lines = materialize(texts.mapInArrow(write, "texts bigint, classes binary, counts binary"), "prose-lines")

    def tally(model: ProseModel | None, count: Tally) -> tuple[np.ndarray, np.ndarray]:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for one, many in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    number, times = count(*_fair(model, np.frombuffer(one, np.uint8).astype(np.int64), np.frombuffer(many, np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(times.astype(np.int64))], names=["number", "times"])

        found = lines.select("classes", "counts").mapInArrow(scan, "number bigint, times bigint").groupBy("number").agg(F.sum("times").alias("times"))
        got = found.toArrow()
        number, times = (got.column(k).to_numpy().astype(np.int64) for k in ("number", "times"))
        order = np.argsort(number)
        return number[order], times[order]

    return _fit(lines.agg(F.sum("texts")).first()[0] or 0, tally)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]], copies: list[int]) -> ProseModel:
    """The trigram model of the times of trigrams, those of each part counted so many times."""
    numbers = np.concatenate([number for number, _ in parts])
    times = np.concatenate([often * float(by) for (_, often), by in zip(parts, copies)])
    seen, which = np.unique(numbers, return_inverse=True)
    sums = np.bincount(which, times, len(seen))
    bi = np.bincount(seen % (V * V), sums, V * V).reshape(V, V)
    # logarithms, since one sentence pattern may fill a table
    total = np.log2(1 + sums)
    context = np.bincount(seen // V, total, V * V)
    bi = np.log2(1 + bi)
    uni = (bi.sum(0) + 0.5) / (bi.sum() + 0.5 * V)
    p2 = (bi + WEIGHT * uni) / (bi.sum(1, keepdims=True) + WEIGHT)
    return ProseModel(seen, total, context, p2.ravel(), np.full(2, -np.inf), np.full(2, np.inf))


def _score(model: ProseModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = model.spam_shares(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share, pa.float64())], names=["doc_id", "spam_share"])

    return score


def spam_shares(documents: DataFrame, model: ProseModel | None = None) -> DataFrame:
    """(doc_id, spam_share) of every document; null and empty texts have 0.

    The model is fitted on all texts and sent to the executors once; the scan with it has no shuffle.
    """
    model = model or fit_prose_of(documents)
    docs = documents.select(F.col("doc_id").cast("bigint"), "text")
    return docs.mapInArrow(_score(model), "doc_id bigint, spam_share double")


def spam_pages(documents: DataFrame, model: ProseModel | None = None) -> DataFrame:
    """(doc_id): documents with more than half of their characters in stretches that are no prose."""
    return spam_shares(documents, model).where(F.col("spam_share") > HALF).select("doc_id")
