"""Operators against brute force, exact round trips and held-out labels."""

import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import (cotraining, curriculum, dom_model, hilbert_shards, learned_partitions, norm_buckets, probminhash,
                             token_blocks, toxicity, unigram_pieces)
from scriptorium.llm.common import table
from scriptorium.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.01"


def groups_by_brute_force(texts, threshold=0.8):
    """Group number per text: all pairs that share a shingle, exactly."""
    sets = [Counter(zip(*[t.split()[i:] for i in range(5)])) or Counter([tuple(t.split())]) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def jp(v, w):
        every = set(v) | set(w)
        return sum(1 / sum(max(v[e] / v[d], w[e] / w[d]) for e in every) for d in set(v) & set(w))

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in seen[x]).items():
            # J <= shared / larger set holds for the numbers of distinct shingles of plain texts
            plain = max(s.values()) == 1 == max(sets[j].values())
            if find(i) != find(j) and (not plain or n >= threshold * max(len(s), len(sets[j]))) and n >= 2 or s == sets[j]:
                if jp(s, sets[j]) >= threshold - 1e-9:
                    parent[find(i)] = find(j)
        for x in s:
            seen[x].append(i)
    return [find(i) for i in range(len(texts))]


def test_near_duplicate_groups(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(5000)}"
    base = [word() for _ in range(150)]
    texts = [" ".join(base)] * 3
    for _ in range(60):  # near copies of one text with up to six changed words
        t = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 7)):
            t[k] = word()
        texts.append(" ".join(t))
    twice = [word() for _ in range(40)] * 4
    for _ in range(30):  # near copies of a text that repeats itself
        t = list(twice)
        for k in rng.integers(0, len(t), rng.integers(0, 6)):
            t[k] = word()
        texts.append(" ".join(t))
    chain = [word() for _ in range(100)]
    for _ in range(8):  # a chain: neighbours are alike, the ends are not
        texts.append(" ".join(chain))
        chain = list(chain)
        chain[int(rng.integers(100))] = word()
        chain[int(rng.integers(100))] = word()
    texts += [" ".join(word() for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = defaultdict(set)
    for i, g in enumerate(groups_by_brute_force(texts)):
        want[g].add(i)
    got = defaultdict(set)
    for r in probminhash.near_duplicates(df).collect():
        got[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(1)
    v = {i: float(rng.integers(1, 5)) for i in range(60)}
    w = {i: float(rng.integers(1, 5)) for i in range(10, 75)}
    every = set(v) | set(w)
    exact = sum(1 / sum(max(v.get(e, 0) / v[d], w.get(e, 0) / w[d]) for e in every) for d in set(v) & set(w))

    def arrays(x):
        keys = probminhash.mix64(np.array(sorted(x), dtype=np.uint64))
        order = np.argsort(keys)
        return keys[order], np.array([x[k] for k in sorted(x)])[order]

    (hv, wv), (hw, ww) = arrays(v), arrays(w)
    assert probminhash.similarity(hv, wv, hw, ww) == pytest.approx(exact)
    sig = probminhash.signatures(np.repeat([0, 1], [len(hv), len(hw)]), np.concatenate([hv, hw]), np.concatenate([wv, ww]), 2, 20_000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.015)


def test_recall(spark):
    rows = table(spark, SF, "embeddings")
    data = rows.toPandas()
    x = np.vstack(data.embedding.to_numpy()).astype(float)
    found = defaultdict(set)
    for r in learned_partitions.nearest_neighbours(rows, parts=8, query_every=10).collect():
        found[r.query_id].add(r.id)
    hits = total = 0
    for q in np.flatnonzero(data.vec_id.to_numpy() % 10 == 0):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = set(data.vec_id.to_numpy()[np.argsort(d, kind="stable")[:10]].tolist())
        hits, total = hits + len(near & found[data.vec_id[q]]), total + 10
    assert hits / total >= 0.9


def test_coordinate_and_length_pruning_lose_nothing():
    rng = np.random.default_rng(2)
    p = np.floor(rng.normal(size=(400, 8)) * rng.uniform(1, 300, (400, 1)))
    q = np.vstack([np.floor(rng.normal(size=(30, 8)) * 100), p[:10], np.zeros((1, 8))])
    ids, q_ids = np.arange(400), np.arange(1000, 1041)
    exact = (p @ q.T).astype(int)
    limit = np.sort(exact, axis=0)[-5].astype(float)  # the tightest limit that may be used
    got = defaultdict(list)
    for a, b, s in zip(*norm_buckets.search_bucket(ids, p, q, q_ids, limit, 5)):
        got[a].append((-s, b))
    for j in range(len(q)):
        assert sorted(got[1000 + j]) == sorted((-exact[i, j], i) for i in range(400))[:5]


@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 3), (3, 3), (4, 2)])
def test_curve_visits_neighbouring_cells(spark, dims, bits):
    cell = F.array(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1) for i in range(dims)])
    rows = sorted(spark.range(1 << dims * bits).select(hilbert_shards.hilbert_index(cell, dims, bits).alias("h"), cell.alias("c")).collect())
    assert [r.h for r in rows] == list(range(1 << dims * bits))
    assert {sum(abs(a - b) for a, b in zip(x.c, y.c)) for x, y in zip(rows, rows[1:])} == {1}


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1023, 1024, 5000):
        for high in (1, 2, 300, 50_257, 2 ** 32):
            x = rng.integers(0, high, n).astype(np.uint32)
            x[::50] = rng.integers(0, 2 ** 32, len(x[::50]))
            packed = token_blocks.pack_blocks(x)
            assert (token_blocks.unpack_blocks(packed["payload"], *(packed[c] for c in (
                "byte_start", "low", "width", "exceptions")), n) == x).all()


def test_pieces_against_the_library():
    """The library's unigram model with the same scores: edit the model file."""
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    pieces = unigram_pieces.Pieces(path)
    raw = bytearray(open(path, "rb").read())

    def varint(at):
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = n = 0
    while at < len(raw):
        tag, at = varint(at)
        size, at = varint(at)
        end, field = at + size, tag >> 3
        while field in (1, 2) and at < end:
            tag, at = varint(at)
            if field == 1 and tag >> 3 == 2:
                raw[at:at + 4] = struct.pack("<f", pieces.score[n])
            if field == 2 and tag == 3 << 3:
                raw[at] = 1  # unigram
            at = varint(at)[1] if tag & 7 == 0 else at + 4 if tag & 7 == 5 else at + 8 if tag & 7 == 1 else sum(varint(at))
        n += field == 1
        at = end
    library = sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))
    texts = ["Hello  world\n of pieces", "ἀρχή 日本 🦙", " lead", "the theatre of the absurd, again " * 30, "x" * 300]
    ids, bounds = pieces.encode(texts)
    assert pieces.decode(ids, bounds) == texts
    for i, t in enumerate(texts):
        own, other = ids[bounds[i]:bounds[i + 1]].tolist(), library.encode(t)
        assert own == other or pieces.score[own].sum() == pytest.approx(pieces.score[other].sum(), abs=1e-3)


def test_targets_against_resharing(spark):
    sizes = {"a": 10, "b": 4000, "c": 0, "d": 500, "e": 3, "f": 2500, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in curriculum.source_targets(df).collect()}
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        open_ = [k for k in names if k not in capped]
        share = {k: rest * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not over:
            break
        capped |= {k: 3 * sizes[k] for k in over}
    assert got == {k: pytest.approx(v) for k, v in (capped | share).items()}


def test_schedule_is_inverted(spark):
    share = [i / 40 for i in range(41)]
    for kind, knots in enumerate(curriculum.SCHEDULES):
        col = curriculum.when_demanded(F.col("s"), F.lit(kind))
        times = [r.t for r in spark.createDataFrame([(s,) for s in share], "s double").select(col.alias("t")).collect()]
        grid = np.linspace(0, 1, 20_001)
        weight = np.interp(grid, *zip(*knots))
        demand = np.append(0, np.cumsum((weight[1:] + weight[:-1]) / 2))
        assert np.allclose(np.interp(times, grid, demand / demand[-1]), share, atol=1e-4)


def test_labels_and_pages(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = cotraining.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert ((good.predicted == 1) != (good.quality == 1)).mean() < 0.05
    pages = table(spark, SF, "pages")
    for r in dom_model.extract_pages(pages, docs).join(pages.select("page_id", "html"), "page_id").collect():
        import html
        import re
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def plain_kneser_ney(texts_by_class):
    """Evidence of a word by a plain version of the toxicity models: texts are
    given by class (0 ordinary, 1 toxic)."""
    from collections import defaultdict
    starts = lambda w: ["^" + (w + "$")[:i] for i in range(1, min(len(w) + 1, toxicity.STEM) + 1)]
    n = [Counter(g for t in texts for w in set(t.split()) for g in starts(w)) for texts in texts_by_class]

    def discount(counts):
        one, two = (sum(v == k for v in counts.values()) for k in (1, 2))
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.75

    before = defaultdict(set)
    for g in set(n[0]) | set(n[1]):
        for k in range(1, len(g)):
            before[g[k:]].add(g[k - 1])
    shared = {s: len(x) for s, x in before.items()}
    low, symbols = discount(shared), sum(len(s) == 1 for s in shared) + 1

    def p_shared(s):
        same = [v for x, v in shared.items() if x[:-1] == s[:-1] and len(x) == len(s)]
        shorter = p_shared(s[1:]) if len(s) > 1 else 1 / symbols
        return max(shared[s] - low, 0) / sum(same) + low * len(same) / sum(same) * shorter

    def log_p(c, g, d):
        after = [v for x, v in n[c].items() if x[:-1] == g[:-1]]
        own = max(n[c][g] - d, 0) / sum(after) if after else 0
        left = d * len(after) / sum(after) if after else 1
        known = g in n[0] or g in n[1]
        return math.log(own + left * p_shared(g[1:])) if known else math.log(left)

    d = [discount(x) for x in n]
    return lambda w: sum(log_p(1, g, d[1]) - log_p(0, g, d[0]) for g in starts(w))


def test_toxicity_model_is_kneser_ney(spark, monkeypatch):
    """Counts, discounts, shared continuations and evidence of blocks equal the
    plain version, whatever the blocks."""
    rng = np.random.default_rng(6)
    letters = list("abcdeé")
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 8)))
    words = [word() for _ in range(150)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 30))) for _ in range(40)] + ["", "never seen zzz abz", "abcde"]
    toxic = {i for i in range(40) if i % 3 == 0}
    evidence = plain_kneser_ney([[t for i, t in enumerate(texts[:40]) if (i in toxic) == c] for c in (False, True)])
    got = []
    for pairs in (2_000_000, 50):
        monkeypatch.setattr(toxicity, "BLOCK_PAIRS", pairs)
        ids = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
        blocks = toxicity.in_blocks(ids)
        train = blocks.select("block", F.posexplode("rows").alias("idx", "row")).filter("row < 40")
        model = toxicity.fit(blocks, train.withColumn("grp", F.expr("cast(pmod(row, 3) > 0 as int)")))
        got.append({r.row: r.x for r in toxicity.described(blocks, model, ["a"]).collect()})
        assert len(got[-1]) == len(texts)
    for i, t in enumerate(texts):
        v = [evidence(w) for w in set(t.split())]
        top = sorted(np.maximum(v, 0), reverse=True)[:3]
        wanted = [np.mean(v), sum(top) / 3, top[0]] if v else [0, 0, 0]
        assert got[0][i] == pytest.approx(wanted, abs=1e-5) == got[1][i], t


def test_toxicity_spells_words_as_plain_python():
    """Words, their distinct pairs with texts and the strings that spell them equal a plain version, in every script."""
    texts = ["", " ", "a", "A b a", "Österreich ÖSTERREICH x²½ _a_", "tab\tfour five5\x85six\xa0seven\x1c", "ΣΑΣ ς İstanbul ǅ", "文字 𝒳yz 😀 ok ٣٤",
             "".join(map(chr, range(0x3000))), " ".join(map(chr, range(0x300))), "w" * 5000 + " w" * 50]
    for some in (texts, texts[:2], [], texts[:6]):
        codes, words, size = toxicity._words(some)
        plain = [list(dict.fromkeys(re.findall(r"\w+", t.lower()))) for t in some]
        assert words == list(dict.fromkeys(w for x in plain for w in x))
        ends = np.append(0, np.cumsum(size)).astype(int)
        assert [{words[c] for c in codes[a:b]} for a, b in zip(ends, ends[1:])] == [set(x) for x in plain]
        assert size.tolist() == [len(x) for x in plain]
        whole = [w + "$" for w in words]
        for spell, strings in ((toxicity.beginnings, [["^" + w[:i] for i in range(1, min(len(w), 4) + 1)] for w in whole]),
                               (toxicity.rests, [["~" + w[i - 3:i + 1] for i in range(4, len(w))] for w in whole])):
            word, code, distinct = toxicity._spelled(words, spell)
            flat = [g for x in strings for g in x]
            assert distinct == list(dict.fromkeys(flat)) and [distinct[i] for i in code] == flat
            assert word.tolist() == [i for i, x in enumerate(strings) for _ in x]


def test_toxicity_reads_words_to_their_ends(spark):
    """Words of both classes begin alike; their ends tell the class, wherever they stand."""
    rng = np.random.default_rng(3)
    common = [f"word{i:02d}" for i in range(40)]
    docs, marks = [], []
    for i in range(400):
        words = [*rng.choice(common, 30), *(f"{b}{'ulgo' if i % 4 == 0 else 'inne'}" for b in rng.choice(["stan", "bore", "mika"], 2))]
        docs.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs += [(1000, "word01 " * 50 + "stanulgo"), (1001, "word01 " * 50 + "staninne")]
    scored = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in scored.collect()}
    assert got[1000].predicted == 1 and got[1001].predicted == 0
    assert all(got[i].predicted == toxic for i, toxic in marks if got[i].held_out)


def test_toxicity_held_out(spark):
    """Only rows that took no part in learning."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = toxicity.toxicity_scores(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    clean, bad = held[held.toxic == 0], held[held.toxic == 1]
    assert clean.predicted.mean() < 0.03
    auc = np.mean([(b > clean.score).mean() + (b == clean.score).mean() / 2 for b in bad.score])
    assert auc > 0.85


@pytest.mark.parametrize("source,texts", [
    ('<article class="post hidden md:block"><p>one</p></article><p>two', ["one", "two"]),
    ('<div class="overflow hidden wide" data-style="display:none">one</div>', ["one"]),
    ('<p>see <a href="/v" title="the hidden valley">this valley</a> here', ["see this valley here"]),
    ('<p aria-hidden="true">one</p><p title=" hidden ">two</p><p style="color:red; overflow:hidden">three', ["one", "two", "three"]),
    ('<div hidden>x<div>y</div>z</div><div HIDDEN=""><p>x</div><p class="a"hidden>x</p><p>one', ["one"]),
    ('<p style="Display : NONE !important">x</p><p style="color:red;visibility:hidden">x</p><p>one', ["one"]),
    ('<p hidden>x<p>one<p hidden>x<div>two</div>three', ["one", "two", "three"]),
    ('<ul><li hidden>x <b>y<li>one<li hidden>x</ul>two', ["one", "two"]),
    ('<table><tr><td hidden>x<td>one<tr hidden><td>x<tr><td>two</table>', ["one", "two"]),
    ('<section><div hidden>x<p>y</section><p>one', ["one"]),
    ('<p>one <span hidden>x <span>y</span> z</span>two <i hidden>x</p><p>three', ["one two", "three"]),
    ('<div>one <span hidden>x<div>y</div><br>z</span>two</div>', ["one two"]),
    ('<p>one <span hidden>x<p>two', ["one", "two"])])
def test_only_hidden_elements_are_dropped(source, texts):
    page = dom_model.Page(source)
    assert page.texts == texts
    assert len(page.parent) == len(page.depth) == len(page.element) == len(page.block)
    assert all(page.depth[i] == page.depth[p] + 1 for i, p in enumerate(page.parent) if p >= 0)


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").cache()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = table(spark, d, "labels")
    (_, quality), (_, harmless), (_, single), (_, mixed), (_, pieces) = corpus_pipeline.STAGES
    first = quality(spark, docs, d)
    assert first.columns == docs.columns
    assert ids(first) == ids(cotraining.quality_scores(docs, labels).filter("predicted = 1"))
    assert ids(harmless(spark, docs, d)) == ids(toxicity.toxicity_scores(docs, labels).filter("predicted = 0"))
    rows = docs.orderBy("doc_id").collect()
    best = {}
    for r, g in zip(rows, groups_by_brute_force([r.text for r in rows])):
        best.setdefault(g, r.doc_id)
    assert ids(single(spark, docs, d)) == sorted(best.values())
    plan = {r.id: r.passes for r in curriculum.plan_mix(docs).collect()}
    assert Counter(ids(mixed(spark, docs, d))) == Counter({k: v for k, v in plan.items() if v})
    coded = pieces(spark, docs, d)
    back = unigram_pieces.decode_ids(coded, tokenizer_path("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in rows}
    assert set(QUERIES) == {k for k in QUERIES if k.startswith("op")} and len(QUERIES) == 13


def test_pipeline_decodes_its_pieces(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    rows = corpus_pipeline.encode(spark, docs, d).join(docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.same and r.text_crc32 == r.crc for r in rows)


GOOD = "The river runs past the old town and the mill. People walk there in the evening, when it is cool."


@pytest.mark.parametrize("source,texts", [
    ("<html><head><title>t</title><meta charset=x><body><article><p>one</p></article>", ["one"]),  # no </head>
    ("<html><head><title>t<body><p>one</p>", ["one"]),  # no </title> either
    ("<html><head><title>t</title></head><p>one", ["one"]),
    ("<head><script>x<p>y</script><style>p{}</style><p>one", ["one"]),
    ("<div><button>Share</div><p>one</p>", ["one"]),
    ("<article><p>one <button>x</p><p>two</p></article>", ["one", "two"]),
    ("<div><select><option>a<option>b</div><p>one", ["one"]),
    ("<div><svg><path d='x'><text>x</text><p>one</p></div><p>two", ["one", "two"]),
    ("<svg><g><title>x</title></g></svg><p>one", ["one"]),
    ("<div><noscript><img src=x>enable it</div><p>one", ["one"]),
    ("<noscript><p>x</p></noscript><p>one<video><track>x</video></p>", ["one"]),
    ("<template><div>x<template>y</template></div>z</template>one", ["one"]),
    ("<button/>one", ["one"])])
def test_elements_left_open_lose_no_page(source, texts):
    page = dom_model.Page(source)
    assert page.texts == texts
    assert len(page.parent) == len(page.depth) == len(page.element) == len(page.block)


def test_marginals_against_enumeration():
    """Content probabilities and joint ones of small trees equal the sums over
    all labellings."""
    import itertools
    rng = np.random.default_rng(1)
    sources = ["<div><p>one.</p><p>two</p></div>", "<nav><a href=x>a</a></nav><article><h1>t</h1><p>x <b>y</b>.</p></article>", "one", ""]
    pages = [dom_model.Page(s) for s in sources]
    model = {"element": rng.normal(size=dom_model.N_ELEMENT + 1), "block": rng.normal(size=dom_model.N_BLOCK + 1),
             "pair_element": rng.normal(size=(2, 2)), "pair_block": rng.normal(size=(2, 2))}
    for page in pages:
        forest = dom_model.Forest([page])
        p, joint = forest.infer(model)
        n = len(page.parent)
        unary = np.zeros(n)
        unary[~forest.is_block] = forest.x_element @ model["element"][:-1] + model["element"][-1]
        unary[forest.is_block] = forest.x_block @ model["block"][:-1] + model["block"][-1]
        total, content, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(unary[i] for i in range(n) if labels[i])
            for i, up in enumerate(page.parent):
                if up >= 0:
                    score += model["pair_block" if forest.is_block[i] else "pair_element"][labels[up], labels[i]]
            weight = math.exp(score)
            total += weight
            for i in range(n):
                content[i] += weight * labels[i]
                if page.parent[i] >= 0:
                    both[i, labels[page.parent[i]], labels[i]] += weight
        assert np.allclose(p, content / total)
        inner = [i for i in range(n) if page.parent[i] >= 0]
        assert np.allclose(joint[inner], both[inner] / total)


def test_mix_keeps_rows_that_differ_in_other_columns(spark):
    """Equal id and text in two sources: each comes as often as it is planned."""
    rows = [(1, GOOD, "a", "en"), (1, GOOD, "b", "fr"), (1, GOOD, "b", "fr"), (2, "one two three", "a", "en"), (3, "x " * 40, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("extra", F.create_map(F.lit("k"), F.col("lang")))
    plan = curriculum.plan_mix(docs).join(docs.select(curriculum.row_hash(docs).alias("row"), "source", "lang").distinct(), "row")
    wanted = Counter()
    for r in plan.collect():
        wanted[r.id, r.source, r.lang] += r.passes
    got = Counter((r.doc_id, r.source, r.lang) for r in curriculum.training_order(docs).collect())
    assert got == +wanted and {(1, "a", "en"), (1, "b", "fr")} <= set(got)


def test_taken_words_by_hand(spark):
    """Passes over each source's hash order against a plain walk, and positions
    of all passes in the registered query."""
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 30)), "abcd"[int(rng.integers(4)) if i % 3 else 0]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = curriculum.plan_mix(docs).collect()
    by = defaultdict(list)
    for r in plan:
        by[r.source_no].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.hash, r.id, r.row))
        target, whole, at = own[0].target, sum(r["size"] for r in own), 0
        for r in own:
            assert r.start == at
            passes = sum(at + k * whole + r["size"] <= target for k in range(3)) if r["size"] else 0
            assert r.passes - passes in (0, 1)
            at += r["size"]
        extra = [r for r in own if r["size"] and r.passes > sum(r.start + k * whole + r["size"] <= target for k in range(3))]
        taken = sum(r["size"] * r.passes for r in own)
        assert len(extra) <= 1 and abs(target - taken) <= max((r["size"] for r in own), default=0)
    found = QUERIES["op10_curriculum"](spark, "/root/testdata/sf0.001").collect()
    assert all(len(r.positions) == r.passes and sorted(r.positions) == r.positions for r in found)
    firsts = [r.first_position for r in found if r.passes]
    assert firsts == sorted(firsts) and all(0 <= p <= 1 for r in found for p in r.positions)


def test_shards_are_runs_and_prune(spark):
    """Shards follow the curve, slots its order; a filter on two dimensions
    touches few shards; null is a cell of its own; long texts have cells of their own."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = hilbert_shards.assign_shards(docs, 40).join(docs.select(F.col("doc_id").alias("id"), "source", "lang"), "id").toPandas()
    rows = rows.sort_values(["shard", "slot"])
    assert rows.hilbert.is_monotonic_increasing
    touched = [part[(part["size"] > low) & (part["size"] <= high)].shard.nunique()
               for _, part in rows.groupby(["lang"]) for low, high in ((0, 400), (4000, 10 ** 9))]
    assert np.mean(touched) < 15
    df = spark.createDataFrame([(2 ** k,) for k in range(0, 62)], "n long")
    cells = [r.c for r in df.select(hilbert_shards.number_cell(F.col("n")).alias("c")).collect()]
    assert len(set(cells)) == len(cells) and max(cells) < 2 ** hilbert_shards.BITS
    names = spark.createDataFrame([(f"s{i}",) for i in range(2000)] + [(None,)], "s string")
    cells = names.select("s", hilbert_shards.category_cell(F.col("s")).alias("c")).collect()
    assert {r.c for r in cells if r.s is None} == {0} and min(r.c for r in cells if r.s is not None) == 1


@pytest.mark.parametrize("change", [
    {}, {"pre_tokenizer": {"add_prefix_space": True}}, {"added": "[MASK]"}, {"normalizer": {"type": "Lowercase"}},
    {"truncation": {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}}])
def test_any_tokenizer_file_gives_the_library_s_ids(change, monkeypatch):
    """Files that cut texts in another way are noticed; words that are known from
    batches before, and a worker that forgets, change nothing."""
    import json

    from tokenizers import Tokenizer
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    added = change.pop("added", None)
    spec["pre_tokenizer"] |= change.pop("pre_tokenizer", {})
    spec |= change
    if added:
        spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": added})
    source = json.dumps(spec)
    assert token_blocks.cut_in_pieces(source) == (not added and "normalizer" not in change and not spec["pre_tokenizer"]["add_prefix_space"])
    library = Tokenizer.from_str(source)
    library.no_truncation()
    texts = ["Hello world", "", " lead", "It's [MASK]ed, isn't it? [MASK]", "a  b\n c\n\nd\t", "x<|endoftext|>y", "Hello, WORLD again; it's here", "a\0b c", "Hello world Hello"]
    for limit in (800_000, 2):
        monkeypatch.setattr(token_blocks, "KNOWN_WORDS", limit)
        own = token_blocks.Encoder(source)
        for batch in (texts, texts[::-1], texts[2:5], []):
            ids, bounds = own.encode(batch)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_words_of_arrow_columns_give_the_library_s_ids():
    """Texts are cut on their bytes at white space and marks; a word is encoded once, whatever mark follows it."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    library, own = Tokenizer.from_str(source), token_blocks.Encoder(source)
    texts = ["a  <|endoftext|> b\u00a0 c", "x \u2028y\u3000 \u1680z", "\u00e9, \u00bb, it's. 'S, don't!", "\n\n a\t b \n c  ", None, "", "\u4e2d \u4e2d\u2014 \u2014",
             "x\x1c \x1cy\x85 z", "a.<|endoftext|>,b,", "Word. word, word! word\nword word?"]
    for column in (pa.array(texts), pa.array(["cut off", *texts])[1:], pa.array(texts, pa.large_string())):
        ids, bounds = own.encode(column)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    seen = []
    plain = own._plain
    own._plain = lambda group: seen.extend(group) or plain(group)
    own.encode(pa.array(["Word, word. word; c"]))
    assert "".join(seen) == ";"


def test_quality_held_out(spark):
    """Labels of four folds are learned, those of the fifth are only compared."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    found = cotraining.quality_scores(docs, labels.filter(fold != 0)).join(labels.filter(fold == 0), "doc_id").toPandas()
    assert len(found) > 50 and ((found.predicted == 1) == (found.quality == 1)).mean() > 0.95
