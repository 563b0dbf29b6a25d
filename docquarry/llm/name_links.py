"""Problem 3: variant spellings of persons and organisations by noisy-channel attribution.

A label is read into what it can stand for: a person (surname and given name, initial or neither) or an organisation
(core name and line of business).  Readings that agree are one spelling; frequent full spellings are the candidate
canonical forms.  Every spelling is attached to the candidate of greatest posterior: the log of the candidate's
frequency plus the log likelihoods of the noise between them (a typing slip in core or qualifier, a missing or
shortened part).  Spellings attached to one canonical form name one entity; readings with another given name or
another line of business are other entities, however alike.

The lists of given names, legal forms and lines of business only add certainty.  A label that they do not explain is
read by its structure: two words as given name and surname in either order, as core and line of business (a final
word that many organisations of the table share, else the last one), one word or a short run of Han characters as a
bare name.  Whether such a reading is a person, an organisation or neither is voted by the types of all rows of its
cluster.  Candidates meet variants through the deletion neighbourhood of the core together with the qualifier, so no
pair of unrelated spellings is ever compared and a frequent surname is split by its given names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.components import connected_components
from docquarry.llm.print_forms import canonical
from docquarry.storage import materialize

LONG = 9  # letters from which a Latin core may hold two slips
SLIP = -3.5  # log likelihood of a typing slip
OTHER_CITY = -2.0
NO_LINE = -15.0  # for a candidate without a qualifier: any full spelling comes first
LEAST_LINES = 5  # organisations that share a final word before it counts as a line of business ...
LINE_SHARE = 0.0005  # ... and their least share, so that at most 3 / LINE_SHARE words are sent to the executors

# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny",
    "catherine": "cathy", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave",
    "deborah": "deb debbie", "dorothy": "dot dolly", "edward": "ed eddie", "eleanor": "nell nora",
    "elizabeth": "liz beth betty lizzie eliza", "frances": "fran", "francis": "frank", "frederick": "fred freddie",
    "gabriel": "gabe", "george": "georgie", "gerald": "gerry", "gregory": "greg", "harold": "harry hal", "helen": "nellie",
    "henry": "hank", "isabella": "bella izzy", "jacob": "jake", "james": "jim jimmy jamie", "jeffrey": "jeff",
    "jennifer": "jen jenny", "jessica": "jess jessie", "john": "johnny jack", "jonathan": "jon jonny", "joseph": "joe joey",
    "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie", "kenneth": "ken kenny", "lawrence": "larry",
    "leonard": "leo len lenny", "lillian": "lily", "louis": "lou", "margaret": "peggy maggie meg", "martin": "marty",
    "mary": "molly polly", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nathan nate",
    "nicholas": "nick nicky", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty trish", "patrick": "paddy",
    "peter": "pete", "philip": "phil", "quentin": "quin", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich",
    "robert": "bob bobby rob bert", "ronald": "ron ronnie", "rosemary": "rosie", "samuel": "sam sammy", "sarah": "sally",
    "stephen": "steve", "susanna": "sue susie susan", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim",
    "ursula": "ulla", "valerie": "val", "victoria": "vicky tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally",
    "william": "bill will billy", "yvonne": "evie", "zachary": "zach zack",
}
# Lines of business, with short forms that are no prefix; legal forms; titles.
LINES_EN = (
    "technologies laboratories holdings networks securities foundation logistics instruments materials analytics pharma dynamics "
    "systems solutions industries services partners capital energy consulting university institute"
).split()
SHORT_EN = {"labs": "laboratories", "lab": "laboratories", "fdn": "foundation", "tech": "technologies", "technology": "technologies",
            "pharmaceuticals": "pharma", "univ": "university", "netw": "networks", "mfg": "industries"}
LEGAL_EN = set("inc incorporated ltd limited co company corp corporation gmbh llc plc ag sa the".split())
TITLES_EN = set("dr mr mrs ms prof professor sir".split())
LINES_ZH = (
    "数据服务 智能装备 精密制造 生物医药 新能源 物流 网络 咨询 实业 科技 传媒 证券 银行 保险 基金 软件 电子 医疗 教育 贸易 控股 投资 地产 建设 能源 集团"
).split()
LEGAL_ZH = "股份有限公司 有限责任公司 有限公司 总公司 分公司 公司".split()
CITIES_ZH = (
    "北京 上海 广州 深圳 杭州 南京 武汉 成都 苏州 西安 天津 重庆 长沙 青岛 大连 厦门 宁波 无锡 合肥 郑州 济南 福州 昆明 沈阳 哈尔滨 长春 南昌 贵阳"
).split()
TITLES_ZH = "先生 女士 小姐 博士 教授 老师 总监 经理 主任 院长 医生".split()
PLAIN_HAN = dict(zip("數據務醫藥傳實業網絡證詢諮製裝備團責電軟險銀資貿國際", "数据务医药传实业网络证询咨制装备团责电软险银资贸国际"))
PERSON_TYPES = {"person", "per", "人物", "人名", "人物/person"}
ORG_TYPES = {"org", "organization", "company", "组织", "公司", "机构", "组织/机构"}

_GIVEN = {n: n for n in NICKNAMES} | {s: n for n, short in NICKNAMES.items() for s in short.split()}
_HAN = re.compile("[一-鿿]")
_CITY = re.compile(f"[(]({'|'.join(CITIES_ZH)})[)]")
_LEGAL_ZH = re.compile(f"(?:{'|'.join(LEGAL_ZH)})$")
_LINE_ZH_END = re.compile(f"(?:集团)?({'|'.join(LINES_ZH[:-1])})$")
_DOT = "[·•・.]"
_TITLE_ZH = re.compile(f"[ ]*(?:{'|'.join(TITLES_ZH)})$")

# kind, core, qualifier, level, city; kinds: P person, O organisation, B a bare name of either, J and K a person and an
# organisation by structure alone, which join others but are no candidates
Reading = tuple[str, str, str, int, str]


def slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours leads from ``a`` to ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


_SLIPS: dict[str, str] = {}
for _n in NICKNAMES:
    if len(_n) >= 6:
        for _i in range(len(_n)):
            _SLIPS.setdefault(_n[:_i] + _n[_i + 1 :], _n)


def given_name(word: str) -> str | None:
    """The full given name that ``word`` is, shortens or slips from; None for other words."""
    if word in _GIVEN:
        return _GIVEN[word]
    if len(word) < 5:
        return None
    for key in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)))):
        full = _SLIPS.get(key)
        if full and slip(full, word):
            return full
    return next((n for n in NICKNAMES if len(n) >= 6 and _two_slips(n, word)), None) if len(word) >= 9 else None


def _two_slips(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 2 and a[:2] == b[:2] and any(
        slip(a[:i] + a[i + 1 :], b) or slip(b[:i] + b[i + 1 :], a) for i in range(len(min(a, b, key=len)))
    )


def line_en(word: str, shortened: bool) -> str | None:
    """The English line of business that ``word`` is or shortens."""
    if word in LINES_EN:
        return word
    if word in SHORT_EN:
        return SHORT_EN[word]
    if shortened and len(word) >= 3:
        return next((n for n in LINES_EN if n.startswith(word)), None)
    return next((n for n in LINES_EN if len(word) >= 7 and slip(n, word)), None)


def _read_en(s: str, kind: str) -> list[Reading]:
    s = _TITLE_ZH.sub("", s).strip()
    s = re.sub("(?<=[a-z][a-z])(?=[A-Z][a-z])", " ", s)
    marked_comma = s.split(",")
    words = re.findall("[A-Za-zÀ-ɏ]+[.]?", s.replace("-", " "))
    low = [unicodedata.normalize("NFD", w.rstrip(".").lower()).encode("ascii", "ignore").decode() for w in words]
    dotted = [w.endswith(".") for w in words]
    keep = [(w, d) for w, d in zip(low, dotted) if w not in TITLES_EN]
    titled = len(keep) < len(low)
    lines = [(i, n) for i, (w, d) in enumerate(keep) if (n := line_en(w, d))]
    legal = [i for i, (w, _d) in enumerate(keep) if w in LEGAL_EN]
    if (lines or (legal and len(keep) > len(legal))) and not (kind == "P" and not lines):
        line = lines[-1] if lines else None
        words = [w for i, (w, _d) in enumerate(keep) if i not in legal and (line is None or i != line[0])]
        core = "".join(words)
        if core and not (len(words) > 1 and s.islower()):  # a term in small letters is no name
            return [("O", core, line[1] if line else "", 2 if line else 0, "")]
    full = [w for w, d in keep if len(w) > 1]
    initials = [w for w, d in keep if len(w) == 1]
    if len(marked_comma) == 2 and len(full) == 2:
        return [("P", full[0], given_name(full[1]) or full[1], 2, "")]
    if len(full) == 2:
        first, second = given_name(full[0]), given_name(full[1])
        if first:
            return [("P", full[1], first, 2, "")]
        if second:
            return [("P", full[0], second, 2, "")]
        return []
    if len(full) == 1:
        if initials:
            return [("P", full[0], initials[0], 1, "")] if len(full[0]) >= 4 else []
        if len(full[0]) >= 5:
            return [("P" if titled or kind == "title" else "B", full[0], "", 0, "")]
    return []


def _read_zh(s: str, kind: str) -> list[Reading]:
    s = "".join(PLAIN_HAN.get(c, c) for c in s).strip(" \"'“”‘’《》")
    titled = bool(_TITLE_ZH.search(s))
    person = _TITLE_ZH.sub("", s)
    found = _CITY.search(s)
    city = found[1] if found else ""
    body = _CITY.sub("", s)
    spaced = re.sub("(?<=[一-鿿]) (?=[一-鿿])", "", body)
    if body.count(" ") >= 2 or _LINE_ZH_END.search(_LEGAL_ZH.sub("", spaced)):
        body = spaced
    if not titled:
        parts = re.split(_DOT, body)
        if len(parts) == 2 and parts[0] in LINES_ZH:
            return [("O", parts[1], parts[0], 2, city)]
        legal = _LEGAL_ZH.search(body)
        rest = _LEGAL_ZH.sub("", body)
        rest = re.sub("集团$", "", rest)
        line = _LINE_ZH_END.search(rest)
        core = rest[: line.start()] if line else rest
        if not city:
            at = next((c for c in CITIES_ZH if core.startswith(c) and len(core) - len(c) >= 3), "")
            city, core = at, core[len(at) :]
        if (line or legal) and 2 <= len(core) <= 6 and not re.search(_DOT, core):
            return [("O", core, line[1] if line else "", 2 if line else 0, city)]
    parts = [p for p in re.split(f"{_DOT}| ", person) if p]
    comma = [p.strip() for p in person.split(",") if p.strip()]
    if len(comma) == 2:
        return [("P", comma[0], comma[1], 2 if len(comma[1]) > 1 else 1, "")]
    if len(parts) == 2:
        given, name = parts
        if len(name) <= 2 < len(given):
            given, name = name, given
        return [("P", name, given, 2 if len(given) > 1 else 1, "")] if len(name) >= 2 else []
    if len(parts) == 1 and 3 <= len(parts[0]) <= 5 and (titled or not re.search("[0-9A-Za-z]", parts[0])):
        out: list[Reading] = [("P" if titled else "B", parts[0], "", 0, "")]
        if len(parts[0]) == 5:
            out.append(("J", parts[0][2:], parts[0][:2], 2, ""))
        return out
    if len(parts) == 1 and 6 <= len(parts[0]) <= 8 and not re.search("[0-9A-Za-z]", parts[0]):
        return [("J", parts[0][2:], parts[0][:2], 2, "")]
    return []


def _type_of(type_: str | None) -> str:
    t = (type_ or "").strip().lower()
    return "P" if t in PERSON_TYPES else "O" if t in ORG_TYPES else "X" if t else ""


def _words(s: str) -> tuple[list[str], list[str], bool]:
    """Words and initials of a label in letters, without titles and legal forms, and whether a comma parts a surname."""
    s = re.sub("(?<=[a-z][a-z])(?=[A-Z][a-z])", " ", _TITLE_ZH.sub("", s))
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))
    parts = [[w for w in map(fold, re.findall(r"[^\W\d_]+", x)) if w not in TITLES_EN and w not in LEGAL_EN] for x in s.split(",")]
    full = [[w for w in x if len(w) > 1] for x in parts if x]
    comma = len(full) == 2 and len(full[0]) == 1 and len(full[1]) > 0
    words = full[1] + full[0] if comma else [w for x in full for w in x]
    return words, [w for x in parts for w in x if len(w) == 1], comma


def line_of(label: str) -> list[str]:
    """Final words or final Han characters of an organisation's label that may be its line of business."""
    s = re.sub(r"\s+", " ", canonical(label)).strip()
    if not s or re.search("[0-9]", s):
        return []
    if _HAN.search(s):
        body = re.sub("[ 集团]+$", "", _LEGAL_ZH.sub("", _CITY.sub("", s)))
        return [body[-k:] for k in (2, 3, 4) if len(body) - k >= 2]
    words, _initials, _comma = _words(s)
    return words[-1:] if len(words) > 1 else []


def _by_structure(s: str, kind: str, lines: frozenset[str]) -> list[Reading]:
    """Readings of a label that no list explains."""
    person, other = ("P" if kind == "P" else "J"), ("O" if kind == "O" else "K")
    if re.search("[0-9]", s):
        return []
    if _HAN.search(s):
        body = _CITY.sub("", _TITLE_ZH.sub("", "".join(PLAIN_HAN.get(c, c) for c in s)))
        body = re.sub("[ \"'“”‘’《》]", "", _LEGAL_ZH.sub("", body) if kind == "O" else body)
        if not re.fullmatch("[一-鿿]+", body) or not 2 <= len(body) <= 20:
            return []
        size = next((k for k in (4, 3, 2) if len(body) - k >= 2 and body[-k:] in lines), 0)
        if size and (kind == "O" or len(body) > 4):
            return [(other, body[:-size], body[-size:], 2, "")]
        return [("B", body, "", 0, "")] if len(body) <= 4 else [("O", body, "", 0, "")] if kind == "O" else []
    words, initials, comma = _words(s)
    if not words:
        return [("B", "".join(initials), "", 0, "")] if len(initials) > 1 else []
    if len(words) == 1:
        return [("P", words[0], initials[0], 1, "")] if initials and kind == "P" else [] if initials else [("B", words[0], "", 0, "")]
    out: list[Reading] = []
    if len(words) <= 4:
        given, name = words[0], words[-1]
        out.append((person, name, given, 2, ""))
        if not comma:
            out.append((person, given, name, 2, ""))
    at = next((i for i in reversed(range(len(words))) if words[i] in lines), len(words) - 1)
    out.append((other, "".join(words[:at] + words[at + 1 :]), words[at], 2, ""))
    return out


def readings(label: str | None, type_: str | None, lines: frozenset[str] = frozenset()) -> list[Reading]:
    """What a label can stand for.  Null, empty and digit-led labels have no reading.

    ``lines``: lines of business learned from the table (business_lines).  A label that the lists explain has one
    reading, a run of Han characters up to two; any other is read by its structure.
    """
    return [r for r, _weak in _readings(label, type_, lines)]


def _readings(label: str | None, type_: str | None, lines: frozenset[str]) -> list[tuple[Reading, bool]]:
    s = re.sub(r"\s+", " ", canonical(label or "")).strip()
    if not s or s[0].isdigit():
        return []
    kind = _type_of(type_)
    listed = "" if kind == "X" else kind
    if _HAN.search(_TITLE_ZH.sub("", s)):
        found = _read_zh(s, listed)
    else:
        found = _read_en(s, "title" if _TITLE_ZH.search(s) else listed)
    if found and all(r[0] == "O" and not r[3] for r in found):  # a legal form alone tells no line
        return [(r, False) for r in found] + [(r, True) for r in _by_structure(s, "O", lines) if r[0] == "O" and r[3]]
    if any(r[0] in "POB" for r in found):
        return [(r, False) for r in found]
    return [(r, False) for r in found] + [(r, True) for r in _by_structure(s, kind, lines)]


def keys_of(core: str) -> list[str]:
    """Keys under which near spellings meet: the core, and the core without one (long Latin cores: two) characters."""
    han = bool(_HAN.search(core))
    if len(core) < (4 if han else 6):
        return [core] + (["".join(sorted(core))] if han and len(core) in (2, 3) else [])
    one = {core[:i] + core[i + 1 :] for i in range(len(core))}
    two = {w[:i] + w[i + 1 :] for w in one for i in range(len(w))} if not han and len(core) >= LONG else set()
    return sorted({core} | one | two)


def slips_between(a: str, b: str) -> int:
    """Typing slips from ``a`` to ``b``: 0, 1, or 2 where both are long Latin cores; 9 for more."""
    if a == b:
        return 0
    if slip(a, b):
        return 1
    if min(len(a), len(b)) < LONG or abs(len(a) - len(b)) > 2 or _HAN.search(a + b):
        return 9
    above: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):  # optimal string alignment
        before, above, row = above, row, [i]
        for j, y in enumerate(b, 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
    return row[-1] if row[-1] <= 2 else 9


def meeting_keys(kind: str, core: str, qual: str, level: int) -> list[str]:
    """Keys under which spellings with a qualifier meet: near cores with one qualifier, near qualifiers with one core.

    Keys of an initial (i) are wanted by candidates, initials and readings J; see entity_links.
    """
    side = "P" if kind in "PJ" else "O"
    near = keys_of(core)
    keys = [f"q{side}{k}|{qual}" for k in near] if level == 2 else []
    if level == 2 and len(qual) >= 4 and not _HAN.search(qual):
        keys += [f"s{side}{core}|{k}" for k in {qual} | {qual[:i] + qual[i + 1 :] for i in range(1, len(qual))}]
    return keys + ([f"i{side}{k}|{qual[:1]}" for k in near] if side == "P" else [])


def qualifier_slips(a: str, b: str) -> int:
    """Slips between two given names or lines of business: 0, 1 where long enough and begun alike, 9 for others."""
    return 0 if a == b else 1 if a[:1] == b[:1] and max(len(a), len(b)) >= 5 and slip(a, b) else 9


def _read(lines: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, label, type_ in zip(*(c.to_pylist() for c in b.columns)):
                out += [(key, label, _type_of(type_), *r, weak) for r, weak in _readings(label, type_, lines)]
            cols = list(zip(*out)) or [[]] * 9
            kinds = [pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string(), pa.bool_()]
            names = ["node_key", "label", "typed", "kind", "core", "qual", "level", "city", "weak"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return read


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys_udf(core: pd.Series) -> pd.Series:
    return core.map(keys_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _meeting_udf(kind: pd.Series, core: pd.Series, qual: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([meeting_keys(*x) for x in zip(kind, core, qual, level)], dtype=object)


@F.pandas_udf(T.IntegerType())
def _slips_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([slips_between(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def _qualifier_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([qualifier_slips(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _line_udf(label: pd.Series) -> pd.Series:
    return label.map(line_of)


def business_lines(nodes: DataFrame) -> frozenset[str]:
    """Final words (Han labels: two to four final characters) that many organisations of the table share.

    Counted over the distinct labels of all rows typed as an organisation; the number of words is bounded by LINE_SHARE.
    """
    typed = F.lower(F.trim("type")).isin(sorted(ORG_TYPES))
    ends = nodes.where(typed & F.col("label").isNotNull()).select(F.lower("label").alias("label")).distinct()
    ends = materialize(ends.select("label", _line_udf("label").alias("ends")), "name-ends")
    least = max(LEAST_LINES, int(LINE_SHARE * ends.count()))
    counted = ends.select(F.explode("ends").alias("end")).groupBy("end").count().where(F.col("count") >= least)
    times = {r["end"]: r["count"] for r in counted.collect()}
    # of Han ends inside each other the longest counts that still is as usual
    inner = {e[i:] for e, n in times.items() if _HAN.search(e) for i in (1, 2) if len(e) - i >= 2 and 2 * n >= times.get(e[i:], 0)}
    return frozenset(times) - inner


def entity_links(nodes: DataFrame) -> DataFrame:
    """(node_key, label, entity) of the nodes that name a person or organisation; entity is a node key.

    ``nodes``: node_key, label, type.  Labels that are null, empty, dates, terms or concepts have no row; a bare name
    has one only where another spelling of it exists.  A cluster without any reading by the lists is kept where more of
    its rows are typed as its kind than otherwise.  Equal labels get equal readings, so a label that fills
    a third of the table is one spelling after one partial aggregate.  Ties go to the smaller node key.
    """
    wanted = nodes.where(F.col("label").isNotNull()).select(F.col("node_key").cast("bigint"), "label", "type")
    schema = "node_key bigint, label string, typed string, kind string, core string, qual string, level int, city string, weak boolean"
    spelling = ["kind", "core", "qual", "level"]
    read = wanted.mapInArrow(_read(business_lines(wanted)), schema)
    read = materialize(read.withColumn("sid", F.xxhash64(*spelling)), "name-readings")
    spelled = read.groupBy("sid", *spelling).agg(
        F.count("*").alias("n"), F.min("node_key").alias("id"), F.max(F.nullif("city", F.lit(""))).alias("city"), F.max("weak").alias("weak"), (F.min("label") != F.max("label")).alias("several")
    )
    spelled = materialize(spelled, "name-spellings")

    def ends(pairs: DataFrame, right: DataFrame) -> DataFrame:
        """The pairs (v_sid, sid) with the columns of both spellings."""
        left = spelled.select(*[F.col(c).alias(f"v_{c}") for c in ["sid", *spelling, "n", "id", "city", "weak"]])
        return pairs.join(left, "v_sid").join(right, "sid")

    # spellings with a qualifier
    keyed = spelled.where("level > 0").select(
        "sid", "kind", "level", F.explode(_meeting_udf("kind", "core", "qual", "level")).alias("key")
    )
    keyed = materialize(keyed.select("sid", "kind", "level", F.substring("key", 1, 1).alias("way"), F.xxhash64("key").alias("key")), "name-keys")
    left = keyed.where("way <> 'i' or level = 1 or kind = 'J'").select("key", F.col("sid").alias("v_sid"))
    right = keyed.where("kind in ('P', 'O')").select("key", "sid")
    pairs = left.join(right, "key").where("v_sid <> sid").select("v_sid", "sid").distinct()
    sided = spelled.where("level = 2").withColumn("side", F.translate("kind", "JK", "PO"))
    one_core, one_qual = (
        sided.groupBy("side", mine).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where("lo = hi").select("side", F.col(mine).alias(f"v_{mine}"), F.lit(True).alias(f"{mine}_once"))
        for mine, other in (("qual", "core"), ("core", "qual"))
    )
    met = (
        ends(pairs, spelled.drop("weak", "several"))
        .where("v_kind = kind or (v_kind = 'J' and kind = 'P') or (v_kind = 'K' and kind = 'O')")
        .withColumn("slips", _slips_udf("v_core", "core"))
        .withColumn("other", F.when(F.col("level") == F.col("v_level"), _qualifier_udf("v_qual", "qual")).otherwise(9))
        .where("slips < 9 and (other = 0 or (other = 1 and slips = 0) or (least(level, v_level) = 1 and (startswith(qual, v_qual) or startswith(v_qual, qual))))")
    )
    # a part that other names share is no slip
    met = met.withColumn("side", F.translate("v_kind", "JK", "PO")).join(one_core, ["side", "v_qual"], "left").join(one_qual, ["side", "v_core"], "left")
    met = met.where("(other <> 1 or qual_once) and (slips = 0 or not v_weak or core_once)")
    met = met.withColumn("slips", F.when(F.col("other") == 1, 1).otherwise(F.col("slips"))).drop("side", "qual_once", "core_once", "other")
    met = materialize(met, "name-met")
    # a true spelling is the centre of its slips: its support counts the rows of all spellings near it
    near = met.where("level = v_level and kind = v_kind").groupBy("sid").agg(F.sum(F.col("v_n") / (1 + F.col("slips"))).alias("near"))
    support = materialize(
        spelled.join(near, "sid", "left").withColumn("support", F.col("n") + F.coalesce("near", F.lit(0.0))).drop("near"), "name-support"
    )

    # bare names: of the full spellings of one core only the best supported can be chosen
    best = support.where("level > 0 and kind in ('P', 'O')").groupBy("kind", "core").agg(
        F.max_by("sid", F.struct("support", -F.col("id"), "qual", "level")).alias("sid")
    )
    bare = support.where("level = 0").select("sid", "kind", "core")
    left = bare.select(F.col("sid").alias("v_sid"), F.col("kind").alias("v_kind"), F.explode(_keys_udf("core")).alias("key"))
    right = best.select("sid", "kind", "core").unionByName(bare.where("kind in ('O', 'B')"))
    right = right.select("sid", "kind", F.explode(_keys_udf("core")).alias("key"))
    pairs = left.join(right, "key").where("v_sid <> sid and (v_kind = kind or (v_kind = 'B' and kind in ('P', 'O')))")
    bare_met = ends(pairs.select("v_sid", "sid").distinct(), support.drop("weak", "several")).withColumn("slips", _slips_udf("v_core", "core")).where("slips < 9")

    full_met = met.join(support.select("sid", "support"), "sid")
    met = full_met.unionByName(bare_met.select(*full_met.columns)).join(support.select(F.col("sid").alias("v_sid"), F.col("support").alias("v_support")), "v_sid")
    # upwards only: to a fuller reading, else to a better supported one, else to the older one
    above = "level > v_level or (level = v_level and (support > v_support or (support = v_support and id < v_id)))"
    met = met.where(f"(v_kind <> kind and v_kind in ('B', 'J', 'K')) or {above}")
    score = (
        F.log(F.col("support") + 0.5)
        + SLIP * F.col("slips")
        + F.when(F.col("v_city") != F.col("city"), OTHER_CITY).otherwise(0.0)
        + F.when(F.col("level") == 2, 0.0).when(F.col("level") == 1, -1.0).otherwise(F.when(F.col("v_kind") == F.col("kind"), -1.0).otherwise(NO_LINE))
        + F.when(F.col("kind") == "B", NO_LINE).otherwise(0.0)
    )
    best_first = F.struct(F.col("score"), -F.col("id"), "core", "qual")
    chosen = met.withColumn("score", score).groupBy("v_sid").agg(F.max_by("sid", best_first).alias("sid"))
    # the two orders of a name that no list explains are one spelling
    swapped = spelled.where("weak and kind = 'P' and level = 2").select(F.col("sid").alias("a"), F.xxhash64("kind", F.col("qual"), F.col("core"), "level").alias("b"))
    swapped = swapped.join(spelled.select(F.col("sid").alias("b")), "b", "left_semi").select("a", "b")
    links = materialize(chosen.select(F.col("v_sid").alias("a"), F.col("sid").alias("b")).unionByName(swapped), "name-links")
    comps = connected_components(links, "a", "b")
    attached = spelled.select("sid", "several").join(comps, F.col("sid") == F.col("node"), "left").select(
        "sid", F.coalesce("component", "sid").alias("cluster"), (F.col("component").isNotNull() | F.col("several")).alias("linked")
    )
    named = read.join(attached, "sid").where("kind in ('P', 'O') or linked").where("not (kind = 'O' and level = 0 and not linked)")
    named = materialize(named.select("node_key", "label", "typed", "kind", "level", "weak", "cluster", "linked"), "name-clusters")
    nodes_of = named.groupBy("cluster", "node_key").agg(
        F.first("typed").alias("typed"), F.max(F.expr("kind in ('P', 'O') and not weak")).alias("listed"), F.max(F.expr("kind = 'P'")).alias("p"), F.max(F.expr("kind = 'O'")).alias("o")
    )
    votes = nodes_of.groupBy("cluster").agg(
        F.max("listed").alias("listed"), F.max("p").alias("p"), F.max("o").alias("o"),
        *[F.count_if(F.col("typed") == t).alias(f"n{t}") for t in "POX"],
    )
    persons, orgs = "nP > nO + nX", "nO > nP + nX"
    kept = votes.where(f"listed or (p and {persons}) or (o and {orgs}) or (not p and not o and ({persons} or {orgs}))").select("cluster", "listed")
    named = named.join(kept, "cluster").groupBy("node_key", "label").agg(F.max_by("cluster", F.struct("linked", "listed", "level", "cluster")).alias("cluster"))
    entity = named.groupBy("cluster").agg(F.min("node_key").alias("entity"))
    return named.join(entity, "cluster").select("node_key", "label", "entity")


def entity_pairs(links: DataFrame) -> DataFrame:
    """(node_key_a, node_key_b): nodes of one entity whose labels are different strings, smaller key first."""
    kept = materialize(links, "entities")
    several = kept.groupBy("entity").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("entity")
    rows = kept.join(several, "entity", "left_semi")
    a = rows.select("entity", F.col("node_key").alias("node_key_a"), F.col("label").alias("label_a"))
    b = rows.select("entity", F.col("node_key").alias("node_key_b"), F.col("label").alias("label_b"))
    return a.join(b, "entity").where("node_key_a < node_key_b and label_a <> label_b").select("node_key_a", "node_key_b")
