import math
import random
import re
import sys
from collections import Counter

from pyspark.sql import functions as F

from scriptorium.operators import citations, judge, overlap

KEYS = ["pid"]


# ---------------------------------------------------------------- plain-Python versions
def py_units(text):
    """By positions: a unit begins at every stretch of text between markers
    that is more than one line break; markers and lone breaks stay with what
    is before them."""
    ends = [m.span() for m in re.finditer(r"\[\d+\]", text)]
    gaps = list(zip([0] + [e for _, e in ends], [s for s, _ in ends] + [len(text)]))
    begins = [a for a, b in gaps if text[a:b] not in ("", "\n")]
    cuts = sorted({0, len(text), *begins})
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def py_bleu(ref, cand, weights):
    r, c = ref.split(), cand.split()
    nums, dens = [], []
    for n in range(1, 5):
        cg = Counter(tuple(c[i:i + n]) for i in range(len(c) - n + 1))
        rg = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        nums.append(sum(min(v, rg[g]) for g, v in cg.items()))
        dens.append(max(1, sum(cg.values())))
    if nums[0] == 0:
        return 0.0
    bp = 1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c))
    ps = [nums[i] / dens[i] if nums[i] else sys.float_info.min for i in range(4)]
    return bp * math.exp(math.fsum(w * math.log(p) for w, p in zip(weights, ps)))


def py_meteor(ref, cand, alpha=0.9, beta=3, gamma=0.5):
    h = list(enumerate(w.lower() for w in cand.split()))
    r = list(enumerate(w.lower() for w in ref.split()))
    hl, rl = len(h), len(r)
    matches = []
    for i in range(len(h))[::-1]:
        for j in range(len(r))[::-1]:
            if h[i][1] == r[j][1]:
                matches.append((h[i][0], r[j][0]))
                h.pop(i)
                r.pop(j)
                break
    matches.sort()
    m = len(matches)
    if m == 0:
        return 0.0
    chunks = 1 + sum(1 for a, b in zip(matches, matches[1:]) if not (b[0] == a[0] + 1 and b[1] == a[1] + 1))
    p, rc = m / hl, m / rl
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    return (1 - gamma * (chunks / m) ** beta) * fmean


def one_lcs(a, b):
    """Words of the longest common subsequence found from the end: equal last
    words belong to it; else the last word of ``a`` is dropped where that loses
    less, otherwise the last word of ``b``."""
    from functools import cache

    @cache
    def size(i, j):
        if not i or not j:
            return 0
        return size(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(size(i - 1, j), size(i, j - 1))

    found, i, j = set(), len(a), len(b)
    while size(i, j):
        if a[i - 1] == b[j - 1]:
            found.add(a[i - 1])
            i, j = i - 1, j - 1
        elif size(i - 1, j) > size(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


def py_rouge_l(ref, cand):
    rs = [" ".join(s.split()) for s in ref.split(".") if len(s) > 0]
    cs = [" ".join(s.split()) for s in cand.split(".") if len(s) > 0]
    if not rs or not cs:
        return 0.0
    u = set().union(*[one_lcs(a.split(" "), b.split(" ")) for a in rs for b in cs])
    m = len({w for s in rs for w in s.split(" ")})
    n = len({w for s in cs for w in s.split(" ")})
    r, p = len(u) / m, len(u) / n
    return 2.0 * (r * p) / (r + p + 1e-8)


def lcs_len(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def random_text(rnd, n):
    vocab = ["a", "b", "c", "the", "cat", "Cat", "sat", ".", "dog"]
    return " ".join(rnd.choice(vocab) for _ in range(n))


# ---------------------------------------------------------------- tests
def test_split_units_random(spark):
    rnd = random.Random(11)
    alphabet = ["a", "b", " ", "\n", "[1]", "[23]", "[0]", ".", "[x]", "["]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    texts += ["[1]lead", "a[1][1]\nb[2]", "", "\n[3]"]
    df = spark.createDataFrame(list(enumerate(texts)), "pid long, text string")
    got = {}
    for r in citations.split_units(df, KEYS).collect():
        got.setdefault(r.pid, []).append((r.unit_pos, r.unit))
    for i, t in enumerate(texts):
        assert [u for _, u in sorted(got.get(i, []))] == py_units(t), repr(t)


def test_cited_ids_and_hypothesis(spark):
    df = spark.createDataFrame([("Sent.[1][1][0][99]",)], "u string")
    r = df.select(citations.cited_ids("u").alias("ids"), citations.hypothesis("u").alias("h")).first()
    assert r.ids == [0, 0, -1, 98] and r.h == "Sent."


def test_premises_out_of_range_and_negative(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0, "h"), (1, 0, 1, -1, "h"), (1, 0, 2, 7, "h")],
                                  "pid long, unit_pos long, cite_pos long, idx long, hypothesis string")
    refs = spark.createDataFrame([(1, 0, "p0"), (1, 1, "p1")], "pid long, ref_pos long, premise string")
    blank = {r.cite_pos: r.premise for r in citations.attach_premises(pairs, refs, KEYS).collect()}
    assert blank == {0: "p0", 1: " ", 2: " "}
    wrap = {r.cite_pos: r.premise for r in citations.attach_premises(pairs, refs, KEYS, True).collect()}
    assert wrap == {0: "p0", 1: "p1", 2: " "}


def test_support_labels_scores(spark):
    pairs = spark.createDataFrame([("the cat sat", "The cat"), ("x", "y z"), (" ", "")], "premise string, hypothesis string")
    got = [r.l for r in pairs.select(citations.lexical_support("premise", "hypothesis").alias("l")).collect()]
    assert got == ["1", "0", "0"]
    hooked = citations.score_pairs(pairs, lambda p, h: ["1" if len(a) > len(b) else "0" for a, b in zip(p, h)], batch=2)
    assert [r.label for r in hooked.collect()] == ["1", "0", "1"]
    units = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "pid long, unit_pos long")
    labels = spark.createDataFrame([(1, 0, 0, "1"), (1, 0, 1, "0"), (1, 1, 0, "0"), (1, 1, 1, "2")],
                                   "pid long, unit_pos long, cite_pos long, label string")
    ul = citations.unit_labels(units, labels, KEYS)
    lab = {(r.pid, r.unit_pos): r.labels for r in ul.collect()}
    assert lab == {(1, 0): ["1", "0"], (1, 1): ["0", "2"], (1, 2): [], (2, 0): []}
    arts = spark.createDataFrame([(1,), (2,), (3,)], "pid long")
    s = citations.citation_scores(ul, arts, KEYS).first()
    # article 1: precision (0.5 + 0.5 + 0) / 3, recall (1 + 0 + 0) / 3; articles 2, 3 add 0
    assert s.n_articles == 3
    assert s.citation_precision == round((1 / 3) / 3, 6)
    assert s.citation_recall == round((1 / 3) / 3, 6)


def _pairs(spark, rows):
    return spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(rows)], "pid long, ref string, cand string")


def test_bleu_meteor_rouge_random(spark):
    rnd = random.Random(5)
    rows = [(random_text(rnd, rnd.randint(0, 25)), random_text(rnd, rnd.randint(0, 25))) for _ in range(150)]
    rows += [("one", "one"), ("a b c", "x y"), ("a b c d e", "a b c d e")]
    p = _pairs(spark, rows)
    b = {r.pid: (r.bleu_1, r.bleu_4) for r in overlap.bleu(p, KEYS).collect()}
    m = {r.pid: r.meteor for r in overlap.meteor_exact(p, KEYS).collect()}
    rl = {r.pid: r.rouge_l for r in overlap.rouge_l(p, KEYS).collect()}
    for i, (ref, cand) in enumerate(rows):
        assert b[i][0] == round(py_bleu(ref, cand, (1, 0, 0, 0)), 6), (ref, cand)
        assert b[i][1] == round(py_bleu(ref, cand, (0.25,) * 4), 6), (ref, cand)
        assert m[i] == round(py_meteor(ref, cand), 6), (ref, cand)
        assert rl[i] == round(py_rouge_l(ref, cand), 6), (ref, cand)


def test_lcs_words_is_a_longest_common_subsequence():
    """Also where only every few rows are kept for the walk back."""
    rnd = random.Random(2)
    for _ in range(300):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 19))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 19))]
        words = overlap.lcs_words(a, overlap.word_bits(b), len(b))
        assert words == one_lcs(tuple(a), tuple(b)) == overlap.lcs_words(a, overlap.word_bits(b), len(b), row_bits=1)
        assert bool(words) == (lcs_len(a, b) > 0)


def test_union_of_lcs_skips_no_word():
    rnd = random.Random(3)
    for _ in range(100):
        side = [[[rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))] for _ in range(rnd.randint(1, 6))] for _ in range(2)]
        assert overlap.union_lcs(*side) == set().union(*[one_lcs(tuple(a), tuple(b)) for a in side[0] for b in side[1]])


def test_subsequences_that_are_whole_need_no_table(monkeypatch):
    """What two sentences share, where one side's is a subsequence of the other's, is found
    without the table; else the table is asked for the shared words alone."""
    widths = []
    table_of = overlap.lcs_words
    monkeypatch.setattr(overlap, "lcs_words", lambda r, b, n: widths.append(n) or table_of(r, b, n))
    ref = "a b c d e f g h".split()
    assert overlap.union_lcs([ref], [["b", "x", "d", "y", "h"]]) == {"b", "d", "h"} and not widths
    assert overlap.union_lcs([ref], [["h", "x", "y", "a", "b"]]) == {"a", "b"} | one_lcs(tuple(ref), ("h", "x", "y", "a", "b"))
    assert widths == [3]


def test_words_are_those_of_split():
    """Words of a batch are found by Arrow as Python finds them, over all white space."""
    every = "".join(chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    texts = [every, "", "  a\x1cb\x85 ", "a\0b c", "\u3000", None or "x"]
    w = overlap._Words(texts, texts[::-1])
    words = [t.split() for pair in zip(texts, texts[::-1]) for t in pair]
    assert [w.vocabulary[i] for i in w.code] == [x for t in words for x in t] and w.sizes.tolist() == [len(t) for t in words]


def test_candidates_lack_every_seventh_word(spark):
    from scriptorium.functions import text as T
    from scriptorium.plans import fixtures
    texts = [None, "", " ", "a", "a b c d e f g h", " \x1ca\u3000b c\u2028d\te f\xa0g h i j k l m n ", "a b c d e f g", "\u200b \ufeff x\0y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = F.array_join(F.filter(T.words("text"), lambda w, i: F.pmod(i, F.lit(7)) != 6), " ")
    assert all(r.a == r.b for r in df.select(plain.alias("a"), fixtures.without_sevenths("text").alias("b")).collect())


def test_one_pass_over_awkward_pairs(spark):
    """All metrics together equal each alone; nulls, blanks, one long text, NUL
    characters, repeated keys, many pairs to a batch of few characters."""
    rnd = random.Random(8)
    long = " ".join(rnd.choice(["a", "b", "c.", "dd", "e."]) for _ in range(4000))
    rows = [(None, "a b"), ("a b", None), (None, None), ("", ""), (" . . ", "."), ("a\0b c", "a\0c c"), (long, long[:3000]), ("x y z.", "x y z.")]
    rows += [(random_text(rnd, rnd.randint(0, 9)), random_text(rnd, rnd.randint(0, 9))) for _ in range(40)]
    df = spark.createDataFrame([(i // 2, r, c) for i, (r, c) in enumerate(rows)], "pid long, ref string, cand string").withColumn("bleu_1 ", F.lit(1))
    order = lambda d: sorted(tuple(r) for r in d.collect())
    every = order(overlap.overlap_scores(df, KEYS))
    assert len(every) == len(rows) and all(0 <= x <= 1 for r in every for x in r[1:])
    assert sorted(r[:3] for r in every) == order(overlap.bleu(df, KEYS))
    assert sorted((r[0], r[3]) for r in every) == order(overlap.meteor_exact(df, KEYS))
    assert sorted((r[0], r[4]) for r in every) == order(overlap.rouge_l(df, KEYS))
    for pid, b1, b4, m, _ in every:
        texts = [((r or ""), (c or "")) for i, (r, c) in enumerate(rows) if i // 2 == pid and len(r or "") < 1000]
        wanted = [(round(py_bleu(r, c, (1, 0, 0, 0)), 6), round(py_bleu(r, c, (0.25,) * 4), 6), round(py_meteor(r, c), 6)) for r, c in texts]
        assert (b1, b4, m) in wanted or pid == 3
    assert overlap.overlap_scores(df.limit(0), KEYS).count() == 0


def test_summary_and_missing(spark):
    gold = spark.createDataFrame([(1, "a b"), (2, "c d")], "pid long, text string")
    cand = spark.createDataFrame([(1, "a b")], "pid long, text string")
    pairs, missing = overlap.pair_texts(gold, cand, KEYS)
    assert [r.pid for r in missing.collect()] == [2]
    scores = overlap.bleu(pairs, KEYS).join(
        pairs.select("pid", overlap.candidate_length("cand").alias("length")), "pid")
    s = overlap.macro_summary(scores, ["bleu_1"]).first()
    assert (s.n_pairs, s.bleu_1, s.avg_length) == (1, 100.0, 2.0)


def test_text_union(spark):
    df = spark.createDataFrame([('{"text": ["a", "b"]}',), ('{"text": "c"}',), ('{}',)], "j string")
    got = [r.t for r in df.select(overlap.flatten_text(overlap.normalize_text_union("j")).alias("t")).collect()]
    assert got == ["a\nb", "c", ""]


def test_judge_parse_and_means(spark):
    df = spark.createDataFrame([("Fluency:4,Informativeness:5 Faithfulness:3",), ("4,9,3",), ("good",),
                                (None,), ("1 2 3 4",), ("99999999999999999999999 1 1",)], "reply string")
    got = [r.s for r in df.select(judge.parse_scores("reply").alias("s")).collect()]
    assert got == [[4, 5, 3], [4, 0, 3], [0, 0, 0], [0, 0, 0], [1, 2, 3], [0, 1, 1]]
    means = judge.score_means(df.select(judge.parse_scores("reply").alias("score"))).first()
    assert means.n == 6 and means.fluency == round(9 / 6, 6)
    p = spark.createDataFrame([("Ada", "text")], "k string, t string")
    prompt = p.select(judge.judge_prompt("k", "t").alias("p")).first().p
    assert prompt == "Keyword:Ada\n    Encyclopedia Text:text\n    Scores:"


def test_text_that_begins_with_a_marker(spark):
    rows = [('{"text": "[1] The city is old.[2]"}',), ('{"text": "[1]"}',), ('{"text": ["a"]}',), ('{"text": "[\\"a\\"]"}',)]
    df = spark.createDataFrame(rows, "j string")
    got = [r.t for r in df.select(overlap.flatten_text(overlap.normalize_text_union("j")).alias("t")).collect()]
    assert got == ["[1] The city is old.[2]", "[1]", "a", '["a"]']


def test_long_marker_is_outside_every_list(spark):
    units = spark.createDataFrame([(1, 0, "Old.[99999999999999999999][1]")], "pid long, unit_pos long, unit string")
    refs = spark.createDataFrame([(1, 0, "p0")], "pid long, ref_pos long, premise string")
    got = {r.cite_pos: r.premise for r in citations.attach_premises(citations.cite_pairs(units, KEYS), refs, KEYS).collect()}
    assert got == {0: " ", 1: "p0"}


def test_section_beyond_the_lists_is_dropped(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0, "h"), (2, 0, 0, 0, "h")], "pid long, unit_pos long, cite_pos long, idx long, hypothesis string")
    refs = spark.createDataFrame([(1, 0, "p0")], "pid long, ref_pos long, premise string")
    assert [r.pid for r in citations.attach_premises(pairs, refs, KEYS, only_listed=True).collect()] == [1]
    assert citations.attach_premises(pairs, refs, KEYS).count() == 2


def test_generated_records_in_any_form(spark):
    from scriptorium.operators import articles
    rows = [(1, '{"key": "K", "outline": ["a", "b"], "text": ["t1[1]", "t2[2][9]"], "retrieve": [["d1"], ["e1", "e2"], ["x"]]}'),
            (2, '{"text": "whole[1][0]\\nmore[2]", "retrieve": ["d1", "d2"]}'), (3, '{"text": "no list[1]"}'), (4, "{}"), (5, None),
            (6, "broken {"), (7, '{"text": [], "retrieve": []}'), (8, '{"text": ["a[1]"], "retrieve": []}'), (9, '{"text": "[one]", "retrieve": "d"}')]
    df = spark.createDataFrame(rows, "page_id long, json string")
    got = {r.page_id: r for r in articles.generated(df).collect()}
    assert (got[1].key, got[1].outline, got[1].text, got[1].per_section) == ("K", ["a", "b"], ["t1[1]", "t2[2][9]"], True)
    assert got[1].retrieve == [["d1"], ["e1", "e2"], ["x"]]
    assert (got[2].text, got[2].retrieve, got[2].per_section) == (["whole[1][0]\nmore[2]"], [["d1", "d2"]], False)
    assert all((got[i].text, got[i].retrieve) == ([], []) for i in (4, 5, 6)) and (got[9].text, got[9].retrieve) == (["[one]"], [["d"]])
    secs = articles.sections_of(articles.generated(df), ["page_id"])
    assert sorted((r.page_id, r.sec_pos, len(r.retrieve)) for r in secs.collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 2), (3, 0, 0), (9, 0, 1)]
    p = citations.cite_records(secs, ["page_id", "sec_pos"], refs="retrieve")
    assert sorted((r.page_id, r.sec_pos, r.unit_pos, r.cite_pos, r.idx, r.ref or "") for r in p.collect()) == [
        (1, 0, 0, 0, 0, "d1"), (1, 1, 0, 0, 1, "e2"), (1, 1, 0, 1, 8, ""), (2, 0, 0, 0, 0, "d1"), (2, 0, 0, 1, -1, ""), (2, 0, 1, 0, 1, "d2"), (3, 0, 0, 0, 0, "")]


def test_scores_of_records_equal_those_of_joined_tables(spark):
    """Texts without units, units without citations, ids outside the list."""
    rnd = random.Random(7)
    texts = ["", "\n", "plain", "[1]"] + ["".join(rnd.choice(["a b ", "[1]", "[2]", "[7]", "\n", ". "]) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, [f"a{i}", "b"]) for i, t in enumerate(texts)], "pid long, text string, refs array<string>")
    label = F.when(F.col("ref").isNull(), "0").when(F.pmod(F.col("pid") + F.col("unit_pos"), F.lit(3)) == 0, "0").otherwise("1")
    rows = citations.cite_records(df, KEYS, outer=True).withColumn("label", label)
    lists = citations.labels_per_unit(rows, KEYS)
    units = citations.split_units(df, KEYS)
    inner = citations.cite_records(df, KEYS).withColumn("label", label)
    wanted = citations.unit_labels(units, inner, KEYS)
    order = lambda d: sorted((r.pid, r.unit_pos, tuple(r.labels)) for r in d.collect())
    assert order(lists.filter("unit_pos IS NOT NULL")) == order(wanted)
    assert citations.scores_of_units(lists, KEYS).first() == citations.citation_scores(wanted, df, KEYS).first()


def test_responses_replace_texts_and_records_keep_documents(spark):
    from scriptorium.operators import articles
    inputs = spark.createDataFrame([(1, "old", "k"), (2, "old", None), (3, "old", "z")], "pid long, text string, key string")
    responses = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (9, "x")], "pid long, text string")
    out = articles.attach_responses(inputs, responses, KEYS)
    assert out.columns == inputs.columns and sorted(map(tuple, out.collect())) == [(1, "new", "k"), (2, "b", None)]
    secs = spark.createDataFrame([(1, 1, "B", "tb", ["d2"]), (1, 0, "A", "ta", [])], "pid long, sec_pos long, section string, text string, retrieve array<string>")
    r = articles.article_records(secs, KEYS).first()
    assert (r.outline, r.text, r.retrieve) == (["A", "B"], ["ta", "tb"], [[], ["d2"]])


def py_meteor_stages(ref, cand, forms, alpha=0.9, beta=3, gamma=0.5):
    """Stage by stage over what is left, from the end of both texts."""
    h, r = list(enumerate(cand.lower().split())), list(enumerate(ref.lower().split()))
    hl, rl, matches = len(h), len(r), []
    for form in forms:
        for i in range(len(h))[::-1]:
            for j in range(len(r))[::-1]:
                if form(h[i][1]) == form(r[j][1]):
                    matches.append((h[i][0], r[j][0]))
                    h.pop(i)
                    r.pop(j)
                    break
    matches.sort()
    m = len(matches)
    if not m:
        return 0.0
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(matches, matches[1:]))
    p, rc = m / hl, m / rl
    return (1 - gamma * (chunks / m) ** beta) * p * rc / (alpha * p + (1 - alpha) * rc)


def test_meteor_with_stems(spark):
    from scriptorium.functions.stem import stem
    rnd = random.Random(12)
    vocab = ["run", "Running", "runs", "cat", "cats", "Cat", "happy", "happily", "relational", "relate", "the", "The"]
    rows = [tuple(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12))) for _ in range(2)) for _ in range(120)]
    rows += [(None, "a"), ("cats", "cat"), ("runs", "running")]
    got = {r.pid: r.meteor for r in overlap.meteor(_pairs(spark, rows), KEYS).collect()}
    for i, (ref, cand) in enumerate(rows):
        assert got[i] == round(py_meteor_stages(ref or "", cand or "", (str, stem)), 6), (ref, cand)


def test_stems():
    """The algorithm's published examples."""
    from scriptorium.functions.stem import stem
    examples = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
    happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal
    decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form electrical electr
    goodness good revival reviv allowance allow airliner airlin adjustable adjust replacement replac adoption adopt activate activ
    effective effect probate probat rate rate cease ceas controll control roll roll is is""".split()
    assert [stem(w) for w in examples[::2]] == examples[1::2]
