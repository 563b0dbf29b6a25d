"""Operators for training data against brute force, on small tables with nulls, ties, repeats and odd columns."""

import itertools
import pickle
import random
import re
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.llm import components, leaks, mixing, name_links, near_copies, print_forms, queries, ranking, scan_noise, spam_pages


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1 -------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("аs noted", "as noted"), ("tο", "to"), ("mmΗg", "mmHg"), ("Ｄａｔａ１", "Data1"), ("ét", "ét"), ("lea­ving", "leaving"),
        ("a b", "a b"), ("ﬁle", "file"), ("⽉", "月"), ("金", "金"), ("，", ","), ("µm", "μm"), ("x​y", "xy"), ("a\r\nb", "a\nb"), ("‐", "-"),
        ("ᎪᏟ", "AᏟ"), ("Ꮲaper", "Paper"), ("ꓟꓳꓠ", "MON"), ("𝐃𝐚𝐭𝐚", "Data"), ("fıle", "file"), ("⻢", "马"), ("Ⲟⲣ", "Op"),
    ],
)
def test_look_alikes_get_one_form(a, b):
    assert print_forms.canonical(a) == print_forms.canonical(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("x²", "x2"), ("α", "a"), ("Новтрек", "Hobtpek"), ("l", "1"), ("数", "據"), ("a  b", "a b")])
def test_visible_differences_stay(a, b):
    assert print_forms.canonical(a) != print_forms.canonical(b)


def test_genuine_words_of_another_script_stay():
    assert print_forms.canonical("Ладимар") == "Ладимар"
    assert print_forms.canonical("Лaдимар") == "Ладимар"  # a Latin letter inside
    assert print_forms.canonical("ᏣᎳᎩ") == "ᏣᎳᎩ"
    for s in (None, "", "plain"):
        assert print_forms.canonical(s) == s


def test_look_alike_pairs(spark):
    rows = [("c", 1, "as"), ("c", 2, "аs"), ("c", 3, "as"), ("c", 4, None), ("c", 5, ""), ("c", 6, "​"), ("q", 1, "аs"), ("c", 7, "As")]
    got = print_forms.look_alike_pairs(table(spark, rows, "src string, key bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [("c", 1, 2), ("c", 2, 3), ("c", 5, 6)]
    assert print_forms.look_alike_pairs(table(spark, [], "src string, key bigint, text string")).count() == 0


# components ----------------------------------------------------------------------------------------------------------
def test_components_equal_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, i) for i in range(2001, 2050)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(table(spark, links, "a bigint, b bigint").repartition(5), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(table(spark, [], "a bigint, b bigint"), "a", "b").count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------
def trigrams(s):
    return {s[i : i + 3] for i in range(len(s) - 2)}


def test_copy_groups_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    rows = []
    for t in texts:
        for _ in range(rng.randint(1, 5)):
            w = t.split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rows += [rows[0]] * 30 + [None, "", "", "ab", "ab", rows[3].replace("a", "а")]
    rng.shuffle(rows)
    df = table(spark, list(enumerate(rows)), "row_id bigint, text string").withColumn("group", F.lit("clash")).withColumn("form", F.lit(1)).repartition(3)
    got = {r["row_id"]: r["group"] for r in near_copies.copy_groups(df).collect()}
    form = {i: print_forms.canonical(t) for i, t in enumerate(rows) if t is not None}
    parent = {i: i for i in form}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    grams = {i: trigrams(s) for i, s in form.items()}
    keys = sorted(form)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            both = grams[i] | grams[j]
            if form[i] == form[j] or (both and len(grams[i] & grams[j]) / len(both) >= 0.7):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in form}
    assert sum(got[i] == want[i] for i in want) / len(want) >= 0.98
    pairs = near_copies.copy_pairs(table(spark, [(i, g) for i, g in got.items()], "row_id bigint, group bigint"))
    sizes = pd.Series(list(got.values())).value_counts()
    assert pairs.count() == int((sizes * (sizes - 1) // 2).sum())


def test_empty_and_hot_family(spark):
    assert near_copies.copy_groups(table(spark, [], "row_id bigint, text string")).count() == 0
    base = "The field service team confirmed the quarterly audit trail of every other warehouse lease in that region"
    rows = [(i, f"{base} number {i} of the list") for i in range(150)] + [(1000 + i, f"entirely different words {i * 7919} stand here {i * 104729} alone {i}") for i in range(50)]
    got = near_copies.copy_groups(table(spark, rows, "row_id bigint, text string").repartition(3))
    assert got.where("row_id < 150").select("group").distinct().count() == 1


def test_similarity_is_exact():
    a, b = pd.Series(["abcdef", "", "xyz"]), pd.Series(["abcxef", "", "xyz"])
    want = [len(trigrams(x) & trigrams(y)) / max(1, len(trigrams(x) | trigrams(y))) for x, y in zip(a, b)]
    assert np.allclose(near_copies.trigram_similarity(a, b), want)


def form_rows(spark, rows):
    """Table of printed forms as signed_rows gives it, from (rep, fingerprints, sketch)."""
    rows = [(i, 9, bytearray(sig.tobytes()), bytearray(sketch.tobytes())) for i, sig, sketch in rows]
    return table(spark, rows, "rep bigint, n int, sig binary, sketch binary")


def test_exactly_the_fingerprints_within_the_radius_meet(spark):
    rng = np.random.default_rng(2)
    places = list(range(near_copies.PLACES))
    base = rng.integers(0, 1 << 40, near_copies.TABLES, dtype=np.uint64)
    no_bits = np.zeros(near_copies.SKETCH // 64, np.uint64)
    rows, apart = [(1, base, no_bits)], {}
    for k, out in enumerate([(), (0,), (9,), (0, 1), (3, 4), (0, 9), (5, 8), (4, 6), (0, 4, 7), (1, 2, 3), (7, 8, 9)]):
        sig = base ^ np.uint64(sum(7 << 4 * p for p in places))  # every place of the other tables differs
        sig[2] = base[2] ^ np.uint64(sum((k + 1) << 4 * p for p in out))
        rows.append((k + 2, sig, no_bits))
        apart[k + 2] = len(out)
    got = near_copies.ball_rows(form_rows(spark, rows), 0).where("run is null and a = 1").select("b").collect()
    assert {r[0] for r in got} == {k for k, n in apart.items() if n <= near_copies.OUT}


def test_meeting_probability_is_as_stated():
    rng = random.Random(34)
    pairs = [p for n in (45, 49) for p in changed_copies(rng, 500, 300, n)]
    sims = near_copies.trigram_similarity(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    a, b = (near_copies.fingerprints(near_copies.minima([p[i] for p in pairs])) for i in (0, 1))
    differ = a ^ b
    places = sum(((differ >> np.uint64(4 * p)) & np.uint64(15)) > 0 for p in range(near_copies.PLACES))
    p = sims + (1 - sims) / 16
    one = p**10 + 10 * p**9 * (1 - p) + 45 * p**8 * (1 - p) ** 2
    assert abs(((places <= near_copies.OUT).any(1)).mean() - (1 - (1 - one) ** near_copies.TABLES).mean()) < 0.03


def test_repeated_trigrams_count_once(spark):
    rows = [(1, "abc" * 60), (2, "abc" * 12), (3, "abd" * 12), (4, "abc"), (5, "ab"), (6, None)]
    got = {r["row_id"]: r["group"] for r in near_copies.copy_groups(table(spark, rows, "row_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def changed_copies(rng, n, size, changed, before=""):
    """(text, copy) pairs of random letters after ``before``, the copies with another ending."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = lambda k: "".join(rng.choices(letters, k=k))
    bases = [made(size) for _ in range(n)]
    return [(before + x, before + x[:-changed] + made(changed)) for x in bases]


def test_copies_that_share_a_template(spark):
    rng = random.Random(31)
    template = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=150))
    pairs = changed_copies(rng, 40, 150, 32, template)
    rows = [x for p in pairs for x in p] + [p[0] for p in changed_copies(rng, 160, 300, 1)]  # a third shares the template
    got = {r["row_id"]: r["group"] for r in near_copies.copy_groups(table(spark, list(enumerate(rows)), "row_id bigint, text string")).collect()}
    sims = near_copies.trigram_similarity(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    assert sims.min() > 0.75
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(40)) >= 37
    assert len(set(got.values())) >= 200


def test_copies_at_the_threshold(spark):
    rng = random.Random(32)
    pairs = [p for n in range(45, 53) for p in changed_copies(rng, 40, 300, n)]
    sims = near_copies.trigram_similarity(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    got = {r["row_id"]: r["group"] for r in near_copies.copy_groups(table(spark, list(enumerate(x for p in pairs for x in p)), "row_id bigint, text string")).collect()}
    near = np.flatnonzero((sims >= 0.7) & (sims < 0.74))
    assert len(near) >= 100
    assert np.mean([got[2 * i] == got[2 * i + 1] for i in near]) >= 0.97
    assert not any(got[2 * i] == got[2 * i + 1] for i in np.flatnonzero(sims < 0.7))


def test_members_of_open_runs_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(33)
    texts = [p[0] for p in changed_copies(rng, 60, 300, 1)]
    texts[40] = texts[5][:-20] + texts[40][:20]  # in another block than its copy
    sketch = near_copies.sketches(near_copies.minima(texts))
    most = near_copies.most_apart(0.7, near_copies.SLACK)
    who = np.arange(60)
    a, b, _run, member = near_copies._pairs_of_runs(np.zeros(60, np.uint64), who, sketch, most)
    assert (5, 40) not in set(zip(a.tolist(), b.tolist())) and member.tolist() == who.tolist()
    forms = form_rows(spark, [(i, np.zeros(near_copies.TABLES, np.uint64), x) for i, x in enumerate(sketch)])
    runs, links = table(spark, [(7, int(i)) for i in who], "run bigint, id bigint"), table(spark, [(0, 1)], "a bigint, b bigint")
    assert [tuple(r) for r in near_copies.rest_of_runs(runs, links, forms, most).collect()] == [(5, 40)]


def test_long_runs_of_unlike_texts_do_not_stay_open(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(36)
    texts = [p[0] for p in changed_copies(rng, 60, 300, 1)]
    texts[40] = texts[5][:-20] + texts[40][:20]  # in another block than its copy
    forms = form_rows(spark, [(i, np.zeros(near_copies.TABLES, np.uint64), x) for i, x in enumerate(near_copies.sketches(near_copies.minima(texts)))])
    met = near_copies.ball_rows(forms, near_copies.most_apart(0.7, near_copies.SLACK)).distinct()
    assert [tuple(r) for r in met.collect()] == [(5, 40, None)]  # compared in full, nothing left for a second round


def test_sketches_keep_texts_of_one_subject_apart():
    rng = random.Random(37)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = lambda n: "".join(rng.choices(letters, k=n))
    most = near_copies.most_apart(0.7, near_copies.SLACK)
    passed = []
    for common in (165, 255):  # of 300 letters, so similarities of 0.37 and 0.73
        pairs = [(x + made(300 - common), x + made(300 - common)) for x in (made(common) for _ in range(2000))]
        a, b = (near_copies.sketches(near_copies.minima([p[i] for p in pairs])) for i in (0, 1))
        passed.append((near_copies.sketch_distance(a, b) <= most).mean())
    assert passed[0] < 0.001 and passed[1] > 0.998


def test_hot_family_of_varied_copies_stays_linear(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 64)
    rng = random.Random(35)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    texts = [base[: (p := rng.randrange(290))] + "0123456789"[: rng.randint(2, 9)] + base[p:] for _ in range(400)] + [x for x, _ in changed_copies(rng, 100, 300, 1)]
    signed, forms = near_copies.signed_rows(table(spark, list(enumerate(texts)), "row_id bigint, text string").repartition(3))
    met = near_copies.ball_rows(forms, near_copies.most_apart(0.7, near_copies.SLACK))
    assert met.where("run is null").select("a", "b").distinct().count() < 400 * 20
    got = {r["row_id"]: r["group"] for r in near_copies.copy_groups(table(spark, list(enumerate(texts)), "row_id bigint, text string")).collect()}
    assert len({got[i] for i in range(400)}) == 1 and len(set(got.values())) == 101


# 3 -------------------------------------------------------------------------------------------------------------------
def test_entities(spark):
    rows = [
        (1, "Katherine Fallavermir", "PERSON"), (2, "K. Fallavermir", "PERSON"), (3, "Fallavermir, Kate", "person"), (4, "KATE FALLAVERMIR", None), (5, "Katherine Falavermir", "人物"),
        (6, "Victoria Fallavermir", "PERSON"), (7, "Beberrezir Laboratories Ltd", "ORG"), (8, "BeberrezirLabs", "ORG"), (9, "Labs Bebrerezir", "机构"), (10, "The Beberrezir Technologies Company", "ORG"),
        (11, "菁竺雁岚咨询股份有限公司", "ORG"), (12, "杭州菁竺雁岚咨询", "组织"), (13, "菁 竺 雁 岚咨询", None), (14, "菁竺雁岚物流", "ORG"), (15, "格瓦·埃辛扎尼", "PERSON"), (16, "埃辛扎尼，格瓦", "PERSON"),
        (17, "格·埃辛扎尼", "PERSON"), (18, "2015年", "CONCEPT"), (19, "kv cache", "PERSON"), (20, "KV Cache", "ORG"), (21, None, "ORG"), (22, "", None), (23, "Katherine Fallavermir", "ORG"), (24, "提示词模板流程", None),
    ]
    df = table(spark, rows, "node_key bigint, label string, type string").withColumn("core", F.lit("clash"))
    groups = {}
    for r in name_links.entity_links(df).collect():
        groups.setdefault(r["entity"], set()).add(r["node_key"])
    for want in ({1, 2, 3, 4, 5, 23}, {7, 8, 9}, {11, 12, 13}, {15, 16, 17}):
        assert want in groups.values()
    assert not {18, 19, 20, 21, 22, 24} & set().union(*groups.values())
    pairs = {tuple(r) for r in name_links.entity_pairs(name_links.entity_links(df)).collect()}
    assert (1, 2) in pairs and (1, 23) not in pairs and (1, 6) not in pairs
    assert name_links.entity_links(table(spark, [], "node_key bigint, label string, type string")).count() == 0


def entity_groups(spark, rows):
    groups = {}
    for r in name_links.entity_links(table(spark, rows, "node_key bigint, label string, type string")).collect():
        groups.setdefault(r["entity"], set()).add(r["node_key"])
    return groups.values()


def test_names_outside_all_lists(spark):
    pairs = [
        ("Anna Schmidt", "Anna Schmdt", "PERSON"), ("Priya Raman", "Raman, Priya", "person"), ("Hiroshi Tanaka", "Hirohsi Tanaka", "人物"), ("Wei Zhang", "Zhang Wei", "PER"),
        ("Toyota Motor", "Toyota Moter", "ORG"), ("Northwind Robotics", "Nortwind Robotics Ltd", "company"), ("World Health Organization", "World Helth Organization", "机构"),
        ("IBM", "I.B.M.", "ORG"), ("王伟", "王 伟先生", "PERSON"), ("世界卫生组织", "世界卫生組织", "组织"), ("Amélie Dupont", "Amelie Dupont", "PERSON"), ("Иван Петров", "Петров, Иван", "人物"),
        ("María de la Cruz", "María dela Cruz", "PERSON"), ("Olu Adeyemi", "O. Adeyemi", "PERSON"),
    ]
    rows = [(2 * i + k, p[k], p[2]) for i, p in enumerate(pairs) for k in (0, 1)]
    rows += [(100, "Anna Müller", "PERSON"), (101, "Toyota Finance", "ORG"), (102, "Wei Chang", "PERSON"), (103, "Hana Chang", "PERSON"), (104, "王芳", "PERSON")]
    rows += [(110 + i, "Graph Store", t) for i, t in enumerate(["CONCEPT", "TASK", "PERSON", "概念"])]
    groups = entity_groups(spark, rows)
    missing = [p for i, p in enumerate(pairs) if not any({2 * i, 2 * i + 1} <= g for g in groups)]
    assert not missing
    for g in groups:
        assert len({k // 2 for k in g}) == 1
    assert not {110, 111, 112, 113} & set().union(*groups)


def test_lines_of_business_are_learned(spark):
    rows = [(i, f"{core} Aerostatics", "ORG") for i, core in enumerate(["Hollin", "Barrow", "Tasker", "Quillon", "Merrin", "Osgood"])]
    rows += [(10 + i, f"{core}航天技术有限公司", "组织") for i, core in enumerate(["明川", "北辰", "远帆", "青岳", "长河", "云起"])]
    rows += [(20, "Aerostatics Hollin", "ORG"), (21, "明川航天技术", None), (22, "Hollin Foods", "ORG"), (23, "明川食品厂", "组织")]
    assert {"aerostatics", "航天技术"} <= name_links.business_lines(table(spark, rows, "node_key bigint, label string, type string"))
    groups = entity_groups(spark, rows)
    assert {0, 20} in groups and {10, 21} in groups


def test_hot_surname_keeps_namesakes_apart(spark):
    rng = random.Random(36)
    given = sorted({"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(600)})
    rows = [(i, f"{g.title()} Garrowby", "PERSON") for i, g in enumerate(given)] + [(5000, f"{given[7].title()} Garowby", "PERSON"), (5001, None, None)]
    rows += [(6000 + i, f"{g} {s}", "PERSON") for i, (g, s) in enumerate(itertools.product(["Martina", "Martine"], ["Garrowby", "Ostrander", "Pellworm"]))]
    groups = entity_groups(spark, rows)
    apart = len(groups)
    assert {7, 5000} in groups and apart > 0.9 * len(given)
    assert all({6000 + i} in groups for i in range(6))  # two given names that differ by a letter, each with several surnames


def test_slips():
    assert name_links.slip("abcd", "abdc") and name_links.slip("abcd", "abd") and not name_links.slip("abcd", "abcd") and not name_links.slip("abcd", "badc")
    assert name_links.slips_between("malnunbarvun", "mallnunbarvnu") == 2
    assert name_links.given_name("liz") == "elizabeth" and name_links.given_name("chrstopher") == "christopher" and name_links.given_name("warehouse") is None


# 4 -------------------------------------------------------------------------------------------------------------------
SENTENCES = [
    "The field service team confirmed the quarterly audit trail in {m} and kept {n} items open.", "Notice to the procurement team counts as received after {n} days, although the index had changed.",
    "When the reranker returns nothing, the records team falls back to the archived price list.", "Each run of the trade-off writes one re-labelled entity table to a file of {n} rows.",
    "本期管理层把资产负债率的波动归因于扫描件质量不一，后续将由数据治理组跟进，期限{n}日。", "需要说明的是，报告期内营业收入大幅变化，公司对培训材料计提减值{n}万元。",
]


def prose(rng, n):
    return " ".join(rng.choice(SENTENCES).format(m=rng.choice(["May", "June"]), n=rng.randint(10, 399)) for _ in range(n))


def test_editor_repairs_and_leaves_clean_text(spark):
    rng = random.Random(7)
    ed = scan_noise.fit_editor([prose(rng, 6) for _ in range(400)])
    clean = "The field service team confirmed the quarterly audit trail in May and kept 114 items open."
    noisy = clean.replace("field", "fie1d").replace("team", "tearn").replace("confirmed", "confirmcd").replace("quarterly", "qiiarterly").replace("trail", "trai1")
    assert scan_noise.repair(noisy, [], set(), ed).text == clean
    assert scan_noise.repair(noisy, [], set(), ed).kinds == {"char"}
    assert scan_noise.repair(clean, [], set(), ed).kinds == set()
    parted = scan_noise.repair("the pro-\ncurement team counts", [], set(), ed)
    assert parted.kinds == {"hyphen"} and parted.text == "the procurement team counts"
    assert scan_noise.repair("the trade-\noff writes", [], set(), ed).kinds == set()
    assert scan_noise.repair("", [], set(), ed).text == ""
    page = "one line here\nSome Networks Annual Report 2020\n— 12 —\nmore text"
    assert scan_noise.repair(page, ["somenetworksannualreport2020"], set(), ed).kinds == {"header", "pageno"}
    assert scan_noise.repair("a\n2021\n2022\n2023", [], set(), ed).kinds == set()
    assert scan_noise.repair("text\n[图片：第10页，共3张]", [], set(), ed).kinds == set()
    assert scan_noise.repair("T h e   r e c o r d s   t e a m keeps it", [], set(), ed).text == "The records team keeps it"
    assert scan_noise.repair("the t e a m c o n f i r m e d it", [], set(), ed).text == "the team confirmed it"
    for rows in ("A B C D E F G", "1 2 3 4 5 6 7"):
        assert scan_noise.repair(rows, [], set(), ed).text == rows
    assert scan_noise.repair(f"# Some Networks Annual Report 2020\n{clean}", ["somenetworksannualreport2020"], set(), ed).kinds == set()
    blank = pickle.loads(pickle.dumps(ed))
    blank.weights = {}
    for text in (noisy, "the pro-\ncurement team counts", page, "T h e   r e c o r d s   t e a m keeps it"):
        assert scan_noise.repair(text, ["somenetworksannualreport2020"], set(), blank).kinds == set()


def test_decisions_on_planted_noise_held_out(spark):
    rng = random.Random(41)
    ed = scan_noise.fit_editor([prose(rng, 6) for _ in range(400)])
    held = [prose(rng, 5) for _ in range(150)]
    right = 0
    for k, s in enumerate(held):
        if k % 3 == 0:
            words = s.split(" ")
            at = next((i for i, w in enumerate(words) if i and len(w) > 5 and w.isalpha()), None)
            if at is None:
                right += 1
                continue
            words[at] = f"{words[at][:3]}-\n{words[at][3:]}"
            right += scan_noise.repair(" ".join(words), [], set(), ed).kinds == {"hyphen"}
        elif k % 3 == 1:
            right += scan_noise.repair(s.replace(". ", f".\n{rng.choice(scan_noise.PLANTED_NUMBERS).format(7, 90)}\n", 1), [], set(), ed).kinds == {"pageno"}
        else:
            right += scan_noise.repair(s, [], set(), ed).kinds == set()
    assert right >= 0.95 * len(held)


def test_editor_of_all_texts(spark):
    rng = random.Random(42)
    texts = [prose(rng, 1) for _ in range(8000)]  # more than any sample of old
    texts[11] += " The zanderflow valve."  # a word of two texts only
    texts[7000] += " The zanderflow valve."
    rows = table(spark, [*enumerate(texts), (9000, None)], "row_id bigint, text string").repartition(5)
    ed = scan_noise.fit_editor_of(rows)
    assert ed.words["zanderflow"] == 2
    assert ed.words["team"] == sum(t.count(" team ") for t in texts)
    want = scan_noise.fit_editor(texts)
    assert (ed.words, ed.grams, ed.compounds) == (want.words, want.grams, want.compounds)


def test_work_of_planting_is_bounded():
    rng = random.Random(43)
    texts = [prose(rng, 6) for _ in range(300)]
    scan_noise.fit_editor(texts[:20])
    calls = 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        scan_noise.fit_editor(texts)
    finally:
        sys.setprofile(None)
    assert calls < 1500 * len(texts)


def test_title_spans_equal_the_pattern():
    rng = random.Random(44)
    found = 0
    for k in range(20000):
        s = "".join(rng.choices(["a", "B", "b", "1", " ", " ", "\n", "é", "  cd", "日", "ſ" if k % 50 == 0 else "b"], k=rng.randint(1, 14)))
        t = "".join(rng.choices("ab1é", k=rng.randint(2, 3)))
        body = r"\s?".join(t)
        want = [m.span() for m in re.finditer(f"(?:(?<=^)|(?<=\\s)){body}(?: {{2,}}[^ \n]{{2,6}})?(?: [0-9]{{1,3}}(?= |$))?(?=\\s|$)", s, re.I)]
        run_on = "".join(s.split()).lower()
        if t in run_on:
            found += len(want)
            assert scan_noise.title_spans(s, s.split(), run_on, t) == want
    assert found > 100


def test_noise_of_a_file(spark):
    rng = random.Random(8)
    rows = [(i, "f", i, prose(rng, 2).replace(". ", ".\n") + f"\nSome Networks Annual Report 2020\n第 {i} 页\n" + prose(rng, 1)) for i in range(12)]
    rows += [(100 + i, "g", i, prose(rng, 3)) for i in range(30)] + [(200, "g", 99, None), (201, None, 1, "plain text"), (202, "g", 5, "")]
    rows += [(300 + i, "h", i, prose(rng, 1) + "\nField Handbook of the Northern Works\n" + prose(rng, 1)) for i in range(8)]
    titled = [f"{a} Works Quarterly Digest {b}" for a, b in zip("Alder Birch Cedar Dogwood Elm Fir".split(), range(2001, 2007))]
    rows += [(400 + 10 * k + i, "many", i, prose(rng, 1) + f"\n{t}\n" + prose(rng, 1)) for k, t in enumerate(titled) for i in range(5)]
    df = table(spark, rows, "row_id bigint, index_key string, pos int, text string").withColumn("titles", F.lit(1))
    got = {}
    for r in scan_noise.noise_kinds(df).collect():
        got.setdefault(r["row_id"], set()).add(r["noise"])
    assert all({"header", "pageno"} <= got.get(i, set()) for i in range(12)) and not [k for k in got if 100 <= k < 300]
    assert all("header" in got.get(300 + i, set()) for i in range(8))  # a title without a year
    assert all("header" in got.get(400 + 10 * k + i, set()) for k in range(6) for i in range(5))  # more titles than four


# 5 -------------------------------------------------------------------------------------------------------------------
def test_fused_ranking_equals_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for run in range(6):
        for c in range(12):
            rows.append((run, f"c{c}", rng.choice([None, rng.random(), 0.0]), rng.random() * 1000, None if run == 0 else rng.random(), rng.choice([1.0, 2.0]), c))
    rows += [rows[3], (0, None, 1.0, 1.0, 1.0, 1.0, 1), (None, "x", 1.0, 1.0, 1.0, 1.0, 1), (1, "c1", float("nan"), 1.0, 1.0, 1.0, 99)]
    df = table(spark, rows, "run_id bigint, chunk_id string, bm25_score double, vector_score double, rerank_score double, final_score double, logged_at int").withColumn("fused", F.lit(0))
    got = {(r["run_id"], r["chunk_id"]): r for r in ranking.fused_ranking(df).collect()}
    latest = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and ((r[0], r[1]) not in latest or r[6] >= latest[r[0], r[1]][6]):
            latest[r[0], r[1]] = r
    for run in range(6):
        mine = [r for k, r in latest.items() if k[0] == run]
        for r in mine:
            want = 0.0
            for i in (2, 3, 4, 5):
                value = lambda x, i=i: -1e18 if x[i] is None or x[i] != x[i] else x[i]
                want += 1 / (60 + 1 + sum(value(x) > value(r) for x in mine))
            assert abs(got[run, r[1]]["fused"] - want) < 1e-12
        assert sorted(got[k]["place"] for k in got if k[0] == run) == list(range(1, len(mine) + 1))


# 6 -------------------------------------------------------------------------------------------------------------------
def test_leaks(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    sentence = lambda: " ".join(rng.choices(words, k=14)) + "."
    items = [(i, " ".join(sentence() for _ in range(4))) for i in range(8)] + [(90, None), (91, ""), (92, "too short")]
    docs, want = [], set()
    for n in range(900):
        body = [sentence() for _ in range(8)]
        if n % 30 == 0:
            i = n // 30 % 8
            part = [s + "." for s in items[i][1].split(". ")][: 3 if n % 3 else 4]
            part = [p.rstrip(".") + "." for p in part]
            rng.shuffle(part)
            part[0] = part[0].upper().replace(" ", "\n", 2)
            w = part[1].split(" ")
            w[7] = "changed"
            part[1] = " ".join(w)
            body[3:3] = [part[0], sentence(), *part[1:]]
            want.add((n, i))
        elif n % 30 == 1:
            body[2:2] = [" ".join(items[n % 8][1].split(" ")[:9]) + "."]
        docs.append((n, " ".join(body)))
    docs += [(5000, None), (5001, ""), (5002, docs[0][1])]
    want.add((5002, 0))
    got = leaks.leaked_items(table(spark, docs, "doc_id bigint, text string").withColumn("items", F.lit(1)), table(spark, items, "item_id bigint, passage string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    none = table(spark, [], "doc_id bigint, text string")
    assert leaks.leaked_items(none, table(spark, items, "item_id bigint, passage string")).count() == 0
    assert leaks.leaked_items(table(spark, docs, "doc_id bigint, text string"), table(spark, [], "item_id bigint, passage string")).count() == 0


def test_shares_of_all_pairs_equal_those_of_each():
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(40)]
    index = leaks.ItemIndex.build(list(range(30)), [" ".join(rng.choice(words, rng.integers(2, 60))) for _ in range(30)])
    n = len(index.shingle)
    weight = rng.random(n) * (rng.random(n) < 0.8)
    held, doc, item = [], [], []
    for d in range(50):
        parts = [index.spans[i][x : x + rng.integers(1, 30)] for i in rng.integers(0, 30, 4) for x in [rng.integers(0, max(1, len(index.spans[i])))]]
        held.append(np.unique(np.concatenate([*parts, rng.integers(0, n, 20)])))
        item += range(30)
        doc += [d] * 30
    got = index.pieces(np.array(doc), np.array(item), np.repeat(np.arange(50), [len(x) for x in held]), np.concatenate(held))
    for w in (weight, np.ones(n)):
        assert np.allclose(got.shares(w), [leaks.covered(index.spans[i], held[d], w) for d, i in zip(doc, item)])
    assert 50 < (got.shares(weight) > 0).sum() < 1400


def test_documents_without_a_piece_are_not_judged():
    rng = random.Random(15)
    made = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    items = [made(30) for _ in range(5)]
    cut = items[0].split(" ")  # nine words of it: a window alike, no piece of ten tokens
    texts = [f"{made(20)} {items[1]} {made(20)}", f"{made(20)} {' '.join(cut[3:12])} {made(20)}"]
    index = leaks.ItemIndex.build(list(range(5)), items)
    rows = leaks.pa.RecordBatch.from_arrays([leaks.pa.array([7, 8]), leaks.pa.array(texts)], names=["doc_id", "text"])
    pairs = index.candidates(*leaks.windows_of(leaks.tokens_of(texts), stride=True))
    found = [(r["doc_id"], i) for b in leaks._scan(index)(iter([rows])) for r in b.to_pylist() if r["doc_id"] for i in r["items"]]
    assert found == [(7, 1)] and (0, 1) in set(zip(*pairs))


def test_widely_leaked_and_short_items(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    made = lambda n: " ".join(rng.choices(words, k=n))
    wide, short, han, phrase = made(20), made(8), "北境水文站去年夏季记录到最低水位", made(9)
    items = [(1, wide), (2, short), (3, han), (4, f"{made(30)} {phrase} {made(30)}")]
    docs = [(n, f"{made(40)} {wide if n % 8 < 3 else ''} {made(20)} {short if n % 200 == 1 else ''} {han if n % 300 == 2 else ''} {phrase if n % 5 == 4 else ''} {made(10)}") for n in range(2000)]
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(table(spark, docs, "doc_id bigint, text string").repartition(4), table(spark, items, "item_id bigint, passage string")).collect()}
    assert got == {(n, 1) for n in range(2000) if n % 8 < 3} | {(n, 2) for n in range(2000) if n % 200 == 1} | {(n, 3) for n in range(2000) if n % 300 == 2}


def test_blocks_of_items(spark, monkeypatch):
    rng = random.Random(14)
    made = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    items = [(i, made(30)) for i in range(12)]
    docs = [(i, f"{made(20)} {p} {made(20)}") for i, p in items] + [(100, made(60))]
    monkeypatch.setattr(leaks, "CHARS_PER_PASS", 500)
    got = leaks.leaked_items(table(spark, docs, "doc_id bigint, text string"), table(spark, items, "item_id bigint, passage string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(12)}


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    index = leaks.ItemIndex.build([1], ["some words"])
    order, edge = [], []
    for b in range(leaks.BLOCKS):
        v = (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
        o = np.argsort(v, kind="stable")
        order.append(o)
        edge.append(np.searchsorted(v[o], np.arange(65537, dtype=np.uint64)))
    index.prints, index.owner, index.order, index.edge = prints, np.arange(50, dtype=np.int32), order, edge
    asked = prints.copy()
    for k in range(50):
        for bit in rng.choice(64, leaks.RADIUS, replace=False):
            asked[k] ^= np.uint64(1) << np.uint64(bit)
    doc, item = index.candidates(asked, np.arange(50, dtype=np.int32))
    assert {(i, i) for i in range(50)} <= set(zip(doc.tolist(), item.tolist()))


# 7 -------------------------------------------------------------------------------------------------------------------
def fill(sizes, shares, caps, total):
    capped = {}
    while True:
        left = total - sum(capped.values())
        share = sum(v for k, v in shares.items() if k not in capped)
        new = {k: caps[k] * sizes[k] for k in shares if k not in capped and share and caps[k] * sizes[k] <= left * shares[k] / share}
        if not new:
            return {k: capped.get(k, left * shares[k] / share if share else 0.0) for k in shares}
        capped |= new


def test_mixture(spark):
    rng = random.Random(13)
    docs = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), rng.randint(1, 60)) for i in range(3000)] + [(9000, "z", 5), (9001, "b", 0)]
    weights = [("a", 0.3, 1), ("b", 0.45, 3), ("c", 0.2, 2), ("missing", 0.05, 2)]
    d = table(spark, docs, "doc_id bigint, source string, size bigint").withColumn("text", F.lit("x")).withColumn("bucket", F.lit(3)).repartition(3)
    w = table(spark, weights, "source string, target_share double, max_repeat int")
    selection, shares = mixing.mixture(d, w, F.col("size"))
    rows = {r["doc_id"]: r for r in selection.collect()}
    got = {r["source"]: r for r in shares.collect()}
    sizes = {s: sum(x[2] for x in docs if x[1] == s) for s in "abc"} | {"missing": 0}
    want = fill(sizes, {s: t for s, t, _ in weights}, {s: m for s, _, m in weights}, sum(x[2] for x in docs if x[1]))
    for s, _t, most in weights:
        mine = [r for r in rows.values() if r["source"] == s]
        assert all(1 <= r["repeats"] <= most for r in mine)
        assert abs(sum(r["tokens"] * r["repeats"] for r in mine) - want[s]) <= 60 and got[s]["tokens"] == sum(r["tokens"] * r["repeats"] for r in mine)
    assert abs(sum(r["reached_share"] for r in got.values()) - 1) < 1e-9
    again, _ = mixing.mixture(d.repartition(7), w, F.col("size"))
    assert {(r["doc_id"], r["repeats"]) for r in again.collect()} == {(k, r["repeats"]) for k, r in rows.items()}
    empty, shares = mixing.mixture(d.limit(0), w, F.col("size"))
    assert empty.count() == 0 and all(r["tokens"] == 0 for r in shares.collect())


def test_token_counter(spark):
    import tiktoken

    encode = mixing._encoder(mixing.VOCABULARY)
    assert isinstance(encode, tiktoken.Encoding)
    rows = table(spark, [(1, "hello 你好"), (2, None), (3, "")], "k int, text string")
    got = {r["k"]: r["n"] for r in rows.select("k", mixing.token_counter()(F.col("text")).alias("n")).collect()}
    assert got == {1: len(encode.encode_ordinary("hello 你好")), 2: 0, 3: 0}


# 8 -------------------------------------------------------------------------------------------------------------------
ORDINARY = [
    "Coffee was first grown in the highlands of Ethiopia, where, according to a well known legend, a goatherd noticed that his animals became lively after eating the red berries of a certain bush. Traders carried the beans across the Red Sea, and within a century coffee houses had opened in Cairo, Damascus and Istanbul. People met there to talk about politics and to listen to music, which worried the authorities more than once.",
    "I remember the summer we painted the boat. My father had bought it from a fisherman who wanted to retire, and it leaked so badly that we spent the first month just patching holes. Every evening my sister brought us sandwiches, and we ate them on the jetty while the sun went down behind the island. We never did win a race, but I would not have traded those weeks for anything.",
    "小时候，我家门前有一棵很大的槐树。每到五月，满树都是白色的花，整条街都能闻到香味。母亲会让我爬上树去摘一些花下来，和着面粉蒸成饭团。那种味道我一直记得，后来走过许多地方，却再也没有吃到过。前年回去的时候，那棵树已经不在了，原来的地方修了一条宽阔的马路。",
    "选择自行车的时候，首先要考虑自己的身高和用途。如果只是在城里骑，不需要太多的变速，车身轻一点会更方便。要是打算骑很远的路，就应该试一试车座是否舒服，因为坐久了才知道哪里不合适。另外，刹车一定要可靠，买之前最好自己骑一圈看看。",
    "Im Herbst gehen viele Familien in den Wald, um Pilze zu suchen. Man sollte aber nur solche Pilze mitnehmen, die man wirklich kennt, denn manche sind sehr giftig und sehen den essbaren zum Verwechseln ähnlich. Meine Großmutter hatte einen geheimen Platz, den sie niemandem verraten wollte, und wenn sie nach Hause kam, war ihr Korb immer voll.",
    "Mi abuela cultivaba tomates en el patio de su casa y los vendía a los vecinos por unas pocas monedas. Decía que el secreto estaba en regarlos muy temprano, antes de que saliera el sol, y en hablarles con cariño. Nosotros nos reíamos de ella, pero nunca he vuelto a probar unos tomates como aquellos.",
]
KEYWORDS = [
    " ".join(["garden tools mower blades hedge trimmer compost bins seed trays plant pots hose reel sprinkler lawn feed weed killer rake spade fork gloves"] * 3),
    ", ".join(["cheap flights, hotel deals, last minute offers, car rental, travel insurance, city breaks, family holidays, luxury cruises"] * 5),
    "；".join(["糖尿病 治疗 医院 价格 专家", "高血压 药物 品牌 批发 报价", "空调 维修 电话 上门 服务"] * 8),
    "\n".join(["函数调用"] * 60),
]


def test_spam(spark):
    rng = random.Random(17)
    good = [prose(rng, 8) for _ in range(300)]
    model = spam_pages.fit_prose(good)
    bad = [
        " ".join(rng.choice(["buy", "cheap", "best", "index", "unit", "cost"]) for _ in range(150)), "\n".join(f"* http://m.{rng.randint(1, 99)}a.example/p/{rng.randint(1, 999)}" for _ in range(30)),
        " > ".join(rng.choice(["首页", "新闻", "产品中心", "联系我们", "糖尿病"]) for _ in range(80)), "".join(rng.choice(["糖尿病官网", "糖尿病价格", "糖尿病教程"]) + rng.choice("。！，") for _ in range(60)),
    ]
    assert (model.spam_shares(bad) > spam_pages.HALF).all()
    assert (model.spam_shares(good) <= spam_pages.HALF).mean() > 0.99
    assert list(model.spam_shares([None, ""])) == [0, 0]
    assert (model.spam_shares(ORDINARY) < 0.3).all()
    assert (model.spam_shares(KEYWORDS) > 0.9).all()
    rows = table(spark, list(enumerate([*good, *bad, None])), "doc_id bigint, text string").withColumn("spam_share", F.lit(9))
    assert sorted(r["doc_id"] for r in spam_pages.spam_pages(rows).collect()) == [300, 301, 302, 303]
    assert spam_pages.spam_pages(table(spark, [], "doc_id bigint, text string")).count() == 0


def test_prose_model_of_all_documents(spark):
    rng = random.Random(18)
    texts = [f"{prose(rng, 6)}\n{rng.choice(ORDINARY)}" for _ in range(8000)]  # more than any sample of old
    want = spam_pages.fit_prose(texts)
    rows = table(spark, [*enumerate(texts), (9000, None)], "doc_id bigint, text string").repartition(7)
    got = spam_pages.fit_prose_of(rows)
    assert all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("seen", "times", "context", "p2", "low", "high"))
    lines = spam_pages.prose_lines(texts)
    seen, often = spam_pages._trigrams(*spam_pages._fair(want, *lines))
    assert len(lines[1]) >= 8000 and np.isin(seen, got.seen).all()
    assert (got.times[np.searchsorted(got.seen, seen)] >= np.log2(1 + often)).all()  # each trigram as often as in all texts


# whole queries -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["p5_found", "p5_ranking", "p7_grants_chars"])
def test_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("debug_info", "documents", "source_weights"):
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p1_found", "src key_a key_b"), ("p2_found", "row_id_a row_id_b"), ("p3_found", "node_key_a node_key_b"), ("p4_found", "row_id noise"), ("p6_found", "doc_id item_id"), ("p7_mix", "doc_id source tokens repeats"), ("p8_found", "doc_id")],
)
def test_found(spark, data, name, columns):
    got = queries.QUERIES[name](spark, data)
    assert got.columns == columns.split() and got.count() > 0
